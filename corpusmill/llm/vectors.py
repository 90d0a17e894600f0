"""Near-duplicate vectors by an exact metric range join.

Angles between directions are a metric. Pivots, vectors of a bounded sample that are at least the radius apart, partition all vectors: each goes home to the cell of its nearest pivot. A pair within the
radius is found where one of them is at home, in the cell with the smaller number; so a vector is also sent to those cells, with smaller numbers than its own, that the triangle inequality leaves open:
its angle to the pivot is at most the cell's own radius and the join's, and at most twice the join's more than its angle to its own pivot (or, sharper, it is no further than the radius from
the plane between the two pivots). Cells are joined independently, and give each vector's number of links and its component in the cell, not pairs.

Vectors within half the radius of their pivot (its core) link with each other by the triangle inequality alone: they are counted and not compared, so a group of very many near-copies costs no more than its rows.
All others of a cell are dealt into blocks, and each pair of blocks is a task of its own, in which only what the angles to the pivot leave open is compared: in single precision first,
and within a margin of the bound in double precision. Blocks grow with the table, to ``STRIPS`` of them, from ``BLOCK`` rows up to ``BLOCK_BYTES`` of vectors: a row is sent once for each block that it meets, so that
what is shuffled grows with the rows until blocks are full, and only from there with their square. Vectors travel as they are stored, single precision as such.

Equal vectors are one class with a count. The number of pivots grows with the classes, a pivot for a block, up to ``PIVOT_BYTES`` of them, which bounds the sample, what is sent to the
workers and the statistics of the cells that are collected. Vectors without structure (random directions) leave most cells open to most vectors, and then the work is that of all pairs, in blocks; the README has figures.

Defined results: vectors null, zero or with null or non-finite components link with nothing, nor do vectors of different lengths; equal rows are separate vectors that link; a component without any non-null
id has a null id; a vector without links is its own component; ties of angles go to the first pivot; an empty table gives an empty result; other columns are kept, those of the result's names are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.lineage import cut
from corpusmill.llm.components import connected_components
from corpusmill.llm.memory import give_back

BLOCK, BLOCK_BYTES, STRIPS, STRIP, PIVOT_BYTES, MARGIN, SAMPLE = 4096, 16 << 20, 16, 256, 16 << 20, 1e-4, 4
#: Allowance for rounding of angles: what they leave open may be too much by it, never too little.
EPS = 1e-6
PIECE = "cell long, kind int, a int, b int, left boolean, node long, n long, angle double, v "


def unit(v: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision, without overflow."""
    v = v.astype(np.float64, copy=False)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def block_rows(total: int, longest: int) -> int:
    """Rows of a block for so many vectors, the longest with so many components."""
    return max(BLOCK, min(-(-total // STRIPS), BLOCK_BYTES // (8 * longest)))


def choose_pivots(sample: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Directions of the sample, in its order, that are at least the radius apart."""
    chosen = np.empty((0, sample.shape[1]))
    for x in sample:
        if len(chosen) == most:
            break
        if not len(chosen) or (chosen @ x).max() < math.cos(radius):
            chosen = np.vstack([chosen, x])
    return chosen


def usable(v):
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)


class Cells:
    """The pivots of each length of vector; a cell's number is the length and the pivot's place."""

    def __init__(self, pivots: dict[int, np.ndarray], radius: float):
        self.pivots, self.radius = pivots, radius

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pivot's place, angle to it) of unit vectors; without a pivot, place 0 and the largest angle."""
        p = self.pivots.get(x.shape[1])
        if p is None:
            return np.zeros(len(x), np.int64), np.full(len(x), math.pi)
        cosines = x @ p.T
        at = cosines.argmax(1)
        return at, np.arccos(np.clip(cosines[np.arange(len(x)), at], -1, 1))

    def open_cells(self, x: np.ndarray, at: np.ndarray, angle: np.ndarray, extent: dict[int, float]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(pivot's place, rows, angles to it): the rows from cells of larger numbers that may have a link in that cell. extent: the largest angle of each cell's own rows."""
        p = self.pivots.get(x.shape[1])
        for j in sorted(extent) if p is not None else ():
            rows = np.flatnonzero(at > j)
            if not len(rows):
                continue
            cosines = np.clip(x[rows] @ p[j], -1, 1)
            angles = np.arccos(cosines)
            own = np.cos(angle[rows])
            between = np.linalg.norm(p[at[rows]] - p[j], axis=1)
            keep = (angles <= extent[j] + self.radius + EPS) & (angles - angle[rows] <= 2 * self.radius + EPS) & (own - cosines <= math.sin(min(self.radius, math.pi / 2)) * between + EPS)
            yield j, rows[keep], angles[keep]


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, nodes, counts, unit vectors, vectors as they are) of a batch of (node, n, v)."""
    lengths = batch.column(2).value_lengths().to_numpy()
    for length in np.unique(lengths):
        part = batch.filter(pa.array(lengths == length)) if (lengths != length).any() else batch
        v = part.column(2).flatten().to_numpy().reshape(part.num_rows, length)
        yield int(length), part.column(0).to_numpy(), part.column(1).to_numpy(), unit(v), v


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of places i and j; a label is its component's least place."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (next_label := label[label]).tobytes() != label.tobytes():
            label[:] = next_label


def block_links(left: tuple[np.ndarray, ...], right: tuple[np.ndarray, ...] | None, cosine: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(node, links, root) of the rows of two blocks that have a link with the other block, or of one block with itself if right is None: links count equal vectors, root is the least node that links in these blocks reach.

    A block is (nodes, counts, angles to the pivot, unit vectors).
    """
    same = right is None
    sort = lambda block: tuple(c[np.argsort(block[2], kind="stable")] for c in block)
    left = sort(left)
    right = left if same else sort(right)
    (ln, lc, la, lx), (rn, rc, ra, rx) = left, right
    nodes = ln if same else np.concatenate([ln, rn])
    order = np.argsort(nodes)
    place = np.empty(len(nodes), np.int64)
    place[order] = np.arange(len(nodes))
    lp, rp = place[: len(ln)], place if same else place[len(ln) :]
    links, label = np.zeros(len(nodes), np.int64), np.arange(len(nodes))
    single = rx.astype(np.float32).T
    for at in range(0, len(ln), STRIP):
        strip = slice(at, at + STRIP)
        lo = max(np.searchsorted(ra, la[strip][0] - radius - EPS), at if same else 0)
        hi = np.searchsorted(ra, la[strip][-1] + radius + EPS, side="right")
        if lo >= hi:
            continue
        s = lx[strip].astype(np.float32) @ single[:, lo:hi]
        i, j = np.nonzero(s >= cosine - MARGIN)
        if not len(i):
            continue
        close = np.flatnonzero(s[i, j] < cosine + MARGIN)
        i, j = i + at, j + lo
        exact = np.ones(len(i), bool)
        exact[close] = np.einsum("ij,ij->i", lx[i[close]], rx[j[close]]) >= cosine
        if same:
            exact &= i < j
        i, j = i[exact], j[exact]
        links += np.bincount(lp[i], weights=rc[j], minlength=len(nodes)).astype(np.int64)
        links += np.bincount(rp[j], weights=lc[i], minlength=len(nodes)).astype(np.int64)
        join_labels(label, lp[i], rp[j])
    found = np.flatnonzero(links)
    in_order = nodes[order]
    return in_order[found], links[found], in_order[label[found]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.9, block: int | None = None) -> DataFrame:
    """vectors with n_links (other vectors with a cosine of at least this, linked directly), component_id (smallest id that links reach) and kept (whether that is the vector's own)."""
    if not 0 < cosine < 1:
        raise ValueError("cosine must be between 0 and 1")
    spark, radius = vectors.sparkSession, math.acos(cosine)
    names = [c for c in vectors.columns if c not in ("n_links", "component_id", "kept")]
    kind = "array<float>" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col(vector_col).cast(kind)
    sound = F.coalesce(usable(v), F.lit(False))
    rows = vectors.select(F.struct(*names).alias("row"), F.when(sound, v).alias("v"), F.col(id_col).alias("id"))
    classes = rows.filter("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "n", "v", "id"))
    total, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    block = block or block_rows(total, longest)
    most = max(1, min(-(-total // block), PIVOT_BYTES // (8 * longest)))
    given = classes.select("node", "n", "v")
    # a bounded sample by hash: SAMPLE directions for each pivot
    share = min(1.0, 2 * SAMPLE * most / max(total, 1))
    drawn = given.select("v", F.xxhash64("v").alias("h")).filter(F.pmod("h", F.lit(1 << 30)) <= int(share * (1 << 30))).orderBy("h").limit(SAMPLE * most).select("v").collect()
    by_length: dict[int, list] = {}
    for r in drawn:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    cells = Cells({n: choose_pivots(unit(np.array(x, np.float64)), most, radius) for n, x in by_length.items()}, radius)

    def number(length: int, place: np.ndarray | int):
        return (length << 32) + place

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each cell: rows at home beyond the core and the largest angle; rows in the core, what they stand for, their largest angle and least node."""
        for batch in batches:
            for length, node, n, x, _ in _by_length(batch):
                at, angle = cells.home(x)
                core = angle <= radius / 2 - EPS
                for j in np.unique(at):
                    here, mine = at == j, (at == j) & core
                    has = mine.any()
                    yield pa.RecordBatch.from_pylist([{
                        "cell": number(length, int(j)), "rim": int((here & ~core).sum()), "extent": float(angle[here].max()), "core": int(mine.sum()), "core_n": int(n[mine].sum()),
                        "core_extent": float(angle[mine].max()) if has else None, "core_node": int(node[mine].min()) if has else None,
                    }], schema=surveyed)

    surveyed = pa.schema([("cell", pa.int64()), ("rim", pa.int64()), ("extent", pa.float64()), ("core", pa.int64()), ("core_n", pa.int64()), ("core_extent", pa.float64()), ("core_node", pa.int64())])
    stats = given.mapInArrow(survey, "cell long, rim long, extent double, core long, core_n long, core_extent double, core_node long")
    stats = stats.groupBy("cell").agg(F.sum("rim"), F.max("extent"), F.sum("core"), F.sum("core_n"), F.max("core_extent"), F.min("core_node"))
    rim, extent, core, core_n, core_extent, core_node = ({} for _ in range(6))
    for r in stats.collect():  # a row for each pivot
        for held, value in zip((rim, extent, core, core_n, core_extent, core_node), r[1:], strict=True):
            held[r[0]] = value
    extents: dict[int, dict[int, float]] = {}
    for c, value in extent.items():
        extents.setdefault(c >> 32, {})[c & 0xFFFFFFFF] = value

    def places(batch: pa.RecordBatch) -> Iterator[tuple]:
        """(cell, role, nodes, counts, angles to the cell's pivot, vectors): rows at home in the core (0) or beyond it (1), visiting rows (2); and those of 1 and 2 that may link with the core, as 3."""
        for length, node, n, x, v in _by_length(batch):
            at, angle = cells.home(x)
            in_core = angle <= radius / 2 - EPS
            for j in np.unique(at):
                c = number(length, int(j))
                for role, which in ((0, (at == j) & in_core), (1, (at == j) & ~in_core), (3, (at == j) & ~in_core & (angle <= (core_extent[c] if core[c] else -math.pi) + radius + EPS))):
                    if which.any():
                        yield c, role, node[which], n[which], angle[which], v[which]
            for j, visit, angles in cells.open_cells(x, at, angle, extents.get(length, {})):
                c = number(length, j)
                near = angles <= core_extent[c] + radius + EPS if core[c] else np.zeros(len(visit), bool)
                for role, which in ((2, np.ones(len(visit), bool)), (3, near)):
                    if which.any():
                        yield c, role, node[visit[which]], n[visit[which]], angles[which], v[visit[which]]

    def count_visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple[int, int], int] = {}
            for c, role, node, *_ in places(batch):
                if role > 1:
                    sums[c, role] = sums.get((c, role), 0) + len(node)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.int64()), pa.array([k[1] for k in sums], pa.int32()), pa.array(list(sums.values()), pa.int64())], ["cell", "role", "rows"])

    visits = {(r[0], r[1]): r[2] for r in given.mapInArrow(count_visits, "cell long, role int, rows long").groupBy("cell", "role").agg(F.sum("rows")).collect()}  # two rows for each pivot
    blocks = lambda rows: -(-rows // block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to the pairs of blocks they belong to: kind 0, beyond the core with each other and with visitors; kind 1, the core with what may link with it."""
        for batch in batches:
            for c, role, node, n, angle, x in places(batch):
                rims, guests, near, cores = blocks(rim[c]), blocks(visits.get((c, 2), 0)), blocks(visits.get((c, 3), 0)), blocks(core[c])
                mix = (node.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                own = (mix % np.uint64(max({0: cores, 1: rims, 2: guests, 3: near}[role], 1))).astype(np.int64)
                for b in np.unique(own):
                    b, which = int(b), own == b
                    if role == 0:
                        pairs = [(1, b, o, True) for o in range(near)]
                    elif role == 1:
                        pairs = [(0, b, o, True) for o in range(b, rims + guests)] + [(0, o, b, False) for o in range(b)]
                    elif role == 2:
                        pairs = [(0, o, rims + b, False) for o in range(rims)]
                    else:
                        pairs = [(1, o, b, False) for o in range(cores)]
                    size = int(which.sum())
                    for kind, first, second, is_left in pairs:
                        offsets = pa.array(np.arange(0, size * x.shape[1] + 1, x.shape[1]), pa.int32())
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(size, c)), pa.array(np.full(size, kind, np.int32)), pa.array(np.full(size, first, np.int32)), pa.array(np.full(size, second, np.int32)), pa.array(np.full(size, is_left)),
                            pa.array(node[which]), pa.array(n[which]), pa.array(angle[which]), pa.ListArray.from_arrays(offsets, pa.array(x[which].ravel())),
                        ], ["cell", "kind", "a", "b", "left", "node", "n", "angle", "v"])
        give_back()

    def join(table: pa.Table) -> pa.Table:
        left = table.column("left").to_numpy()
        x = unit(table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1))
        of = lambda side: (*(table.column(c).to_numpy()[side] for c in ("node", "n", "angle")), x[side])
        kind, a, b = (table.column(c)[0].as_py() for c in ("kind", "a", "b"))
        found = block_links(of(left), None if kind == 0 and a == b else of(~left), cosine, radius)
        return pa.table({"node": pa.array(found[0]), "links": pa.array(found[1]), "root": pa.array(found[2])})

    def within_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for length, node, n, x, _ in _by_length(batch):
                at, angle = cells.home(x)
                of = np.flatnonzero(angle <= radius / 2 - EPS)
                c = number(length, at[of])
                sums, roots = np.array([core_n[k] for k in c.tolist()], np.int64), np.array([core_node[k] for k in c.tolist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(node[of]), pa.array(sums - n[of]), pa.array(roots)], ["node", "links", "root"])

    schema = "node long, links long, root long"
    compared = given.mapInArrow(deal, PIECE + kind).groupBy("cell", "kind", "a", "b").applyInArrow(join, schema)
    found = cut(compared.union(given.mapInArrow(within_core, schema)))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    reached = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "of")
    roots = cut(classes.join(links, "node", "left").join(reached, F.col("node") == F.col("of"), "left").select("v", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root")))
    least = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    by_class = roots.join(least, "root").select(F.col("v").alias("of"), "n_links", "component_id")
    out = rows.join(by_class, F.col("v") == F.col("of"), "left")
    component = F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("row.*", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def op13(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")).select("vec_id", "n_links", "component_id", "kept")


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e != 0)) > 0),
links AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9),
reach(node, seen) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.w, r.seen FROM reach r JOIN links l ON l.u = r.node),
least AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
n AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN least ON node = vec_id LEFT JOIN n ON u = vec_id
"""
