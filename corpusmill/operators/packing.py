"""Packing rows into a token budget: in order, what does not fit is left out and packing goes on.

What remains only shrinks, so once a row of some size is left out, all later ones of that size are: of the rows of size t only the first budget / t can be packed. These
are taken by a window for each size, at most budget * ln(budget) rows in all, and only they are folded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Order in which a context's sections are packed.
SECTION_PRIORITY = ["decision", "requirement", "handoff", "question", "intent", "convention"]
SECTION_LIMITS = {"intent": 20, "handoff": 3, "question": 10, "decision": 10, "requirement": 10}
OTHER_LIMIT, STOP_BELOW = 20, 10


def pack(rows: DataFrame, budget: int, order: list, tokens_col: str = "tokens", stop_below: int = STOP_BELOW, per: list[str] | None = None) -> DataFrame:
    """rows with ``remaining`` that fit, in order; packing ends when less than stop_below tokens remain. ``per``: one budget for each group. A row takes one token at least."""
    keys = per or []
    key = [F.col(c) for c in keys]
    sized = rows.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)], *[(F.col(c) if isinstance(c, str) else c).alias(f"_o{i}") for i, c in enumerate(order)], F.greatest(F.col(tokens_col).cast("long"), F.lit(1)).alias("_t"), F.struct("*").alias("row"))
    group, places = [f"_k{i}" for i in range(len(key))], [f"_o{i}" for i in range(len(order))]
    nth = F.row_number().over(Window.partitionBy(*group, "_t").orderBy(*places))
    few = sized.filter(F.col("_t") <= budget).withColumn("_n", nth).filter(F.col("_n") <= F.floor(F.lit(budget) / F.col("_t"))).drop("_n")
    listed = few.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*places, "_t", "row"))).alias("all"))
    fold = f"""aggregate(transform(all, (x, i) -> named_struct('i', i, 't', x._t)), named_struct('left', {int(budget)}L, 'kept', cast(array() as array<struct<i:int,remaining:bigint>>)),
        (s, x) -> case when s.left < {int(stop_below)} or x.t > s.left then s
                  else named_struct('left', s.left - x.t, 'kept', concat(s.kept, array(named_struct('i', x.i, 'remaining', s.left - x.t)))) end).kept"""
    kept = listed.withColumn("kept", F.expr(fold)).select(F.explode(F.expr("transform(kept, k -> named_struct('row', all[k.i].row, 'remaining', k.remaining))")).alias("e"))
    return kept.select("e.row.*", "e.remaining")


def section_priority(kind):
    """Place of a section in packing."""
    return F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SECTION_PRIORITY]), kind), F.lit(0)), F.lit(len(SECTION_PRIORITY) + 1))


def section_limit(kind):
    """Rows of a section that are shown."""
    return F.coalesce(F.element_at(F.create_map(*[x for k, v in SECTION_LIMITS.items() for x in (F.lit(k), F.lit(v))]), kind), F.lit(OTHER_LIMIT))
