"""Feeds of notes and usage as streams: cursors that skip nothing, idempotent application, rate limits, session buffers and event-time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusmill.operators import notes as N
from corpusmill.sources.snapshots import SnapshotTable


def note_feed(spark: SparkSession, folder: str, schema: T.StructType, archived: bool = False) -> DataFrame:
    """New notes of a folder as a stream; the source's own offsets are the cursor, so rows of one second are never cut off."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows if archived else rows.filter(F.col("status") != "archived")


def since(notes: DataFrame, time: int, uuid: str, limit: int = 50) -> DataFrame:
    """The next active notes after a cursor of time and id; the last row is the next cursor."""
    later = (F.col("created_at") > time) | ((F.col("created_at") == time) & (F.col("uuid") > uuid))
    return notes.filter(later & (F.col("status") != "archived")).orderBy("created_at", "uuid").limit(limit)


def apply_pulls(stream: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Applies remote rows batch by batch; a batch applied twice changes nothing."""

    def one(batch: DataFrame, _: int) -> None:
        store(N.pull(load(), batch))

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def pull_feed(stream: DataFrame, kept: SnapshotTable, checkpoint: str, writer: str = "pull") -> StreamingQuery:
    """Applies remote rows batch by batch to notes kept by entity_id, as ``notes.pull`` does: a remote_id must not change its entity. A batch sent twice counts once."""

    def one(batch: DataFrame, number: int) -> None:
        kept.change(batch, N.pull, writer=writer, batch=number)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fold_feed(records: DataFrame, kept: SnapshotTable, checkpoint: str, writer: str = "fold") -> StreamingQuery:
    """Folds a stream of records into kept states (of ``notes.fold_state``), batch by batch: only the buckets of a batch's entities are read and rewritten, and a batch sent twice counts once."""

    def one(batch: DataFrame, number: int) -> None:
        kept.change(N.fold_state(batch), lambda old, new: N.merge_states(old.unionByName(new)), writer=writer, batch=number)

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repair_backlog(notes: DataFrame, embeddings: Callable[[], DataFrame], embed: Callable[[DataFrame], DataFrame], store: Callable[[DataFrame], None], page: int = 32, rounds: int = 1000) -> int:
    """Fills missing vectors page by page by key, so that it ends even if some fail; returns the pages done."""
    cursor, done = "", 0
    while done < rounds:
        rows = N.without_embedding(notes.filter("status = 'active'"), embeddings(), "uuid", cursor, page)
        last = rows.agg(F.max("uuid")).first()[0]
        if last is None:
            return done
        store(N.repair(notes, embeddings(), embed(rows)))
        cursor, done = last, done + 1
    return done


def rate_limited(calls: DataFrame, key: str, time: str, limit: int, window: int) -> DataFrame:
    """calls with ``allowed``: a key's window starts with a call after the last one has run out, and lets limit calls pass.

    One pass over the calls sorted by key and time, which keeps the last key's window only. A key's windows depend on each other, so a key stays in one task.
    """
    rest = [c for c in calls.columns if c not in (key, time)]
    dealt = calls.select(key, time, *rest).repartition(key).sortWithinPartitions(key, time, *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, start, n = object(), None, 0
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if k != last or start is None or t - start >= window:
                    last, start, n = k, t, 0
                n += 1
                allowed.append(n <= limit)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], [key, time, *rest, "allowed"])

    return dealt.mapInArrow(run, T.StructType([*dealt.schema.fields, T.StructField("allowed", T.BooleanType())]))


def rate_limited_stream(calls: DataFrame, key: str, time: str, limit: int, window: int) -> DataFrame:
    """(key, time, allowed) of a stream; a key's state goes when its window has been over for as long again."""

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        for frame in frames:
            out = []
            for t in sorted(frame[time].tolist()):
                if start is None or t - start >= window:
                    start, n = t, 0
                n += 1
                out.append((k[0], t, n <= limit))
            yield pd.DataFrame(out, columns=[key, time, "allowed"])
        if start is not None:
            state.update((int(start), int(n)))
            state.setTimeoutDuration(2000 * window)

    kind = calls.schema[key].dataType.simpleString()
    return calls.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{time}` bigint, allowed boolean", "start bigint, n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)


def relay(events: DataFrame, most: int = 10_000) -> DataFrame:
    """What is left in each session's buffer after its events (session, at, kind push / ack / poll, item): items acked are gone, polls take nothing, the oldest beyond the limit is refused to enter. A push after its ack counts anew."""
    last_ack = F.max(F.when(F.col("kind") == "ack", F.col("at"))).over(Window.partitionBy("session", "item"))
    open_items = events.withColumn("_ack", last_ack).filter((F.col("kind") == "push") & (F.col("_ack").isNull() | (F.col("at") > F.col("_ack")))).groupBy("session", "item").agg(F.min("at").alias("at"))
    return open_items.withColumn("_n", F.row_number().over(Window.partitionBy("session").orderBy("at", "item"))).filter(F.col("_n") <= most).drop("_n")


def next_batch(per_token: float, tail: list[int], ceiling: int, last: int, target: float = 240.0, growth: int = 8) -> int:
    """How many of the waiting items (their tokens, in order) fit in the target time, at most growth times the last batch, at least one."""
    room, n = target / per_token if per_token > 0 else float("inf"), 0
    for tokens in tail[: min(ceiling, max(1, last) * growth)]:
        if tokens > room and n:
            break
        room -= tokens
        n += 1
    return max(1, n)


def tumbling(events: DataFrame, time: str, size: str, keys: list[str], slide: str | None = None, late: str | None = None) -> DataFrame:
    """Extension: counts and sums by event-time window; late rows are dropped behind the watermark."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, key: str, late: str | None = None) -> DataFrame:
    """Extension: sessions of a key that end after a gap."""
    rows = events.withWatermark(time, late) if late else events
    return rows.groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
