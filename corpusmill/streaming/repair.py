"""Filling missing vectors: in pages, each a single call of the embedder, whose rows are tried one by one if the call fails; as a batch, and as a stream whose sweeps are set off by arriving rows and kept apart by timers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAGE, DEBOUNCE_MS = 32, 5000
Embedder = Callable[[list[str]], list[list[float]]]
FILLED = "embedding array<float>, error string"


def embed_page(embed: Embedder, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text: all in one call, or one by one if that fails, so that one text costs only itself its vector."""
    try:
        vectors = embed(texts)
        if len(vectors) == len(texts):
            return [(list(v), None) for v in vectors]
        error = f"{len(vectors)} vectors for {len(texts)} texts"
    except Exception as e:  # noqa: BLE001  whatever an embedder raises
        error = f"{type(e).__name__}: {e}"
    return [(None, error)] if len(texts) == 1 else [made for text in texts for made in embed_page(embed, [text])]


def fill(missing: DataFrame, embed: Embedder, id_col: str = "uuid", text_col: str = "text", page: int = PAGE) -> DataFrame:
    """(id_col, embedding, error) for every row that lacks a vector; pages are runs of rows of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for few in (batch.slice(s, page) for s in range(0, batch.num_rows, page)):
                made = embed_page(embed, few.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([few.column(0), pa.array([v for v, _ in made], pa.list_(pa.float32())), pa.array([e for _, e in made], pa.string())], [id_col, "embedding", "error"])

    rows = missing.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, {FILLED}")


class Sweeps(StatefulProcessor):
    """Keyed state of the rows that wait: an arriving row asks for a sweep, which comes at once or, if one has just been, when the time between sweeps is over.

    Without rows there is no timer and no work. A sweep takes the waiting rows in the order of their ids, page by page, and ends with none waiting: rows that fail alone are given out with their error and do not wait again until they arrive again.
    """

    def __init__(self, embed: Embedder, page: int = PAGE, debounce_ms: int = DEBOUNCE_MS):
        self.embed, self.page, self.debounce_ms = embed, page, debounce_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "id string", "text string")
        self.times = handle.getValueState("times", "swept long, due long")

    def _times(self) -> tuple[int, int]:
        return tuple(self.times.get()) if self.times.exists() else (0, 0)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        for r in rows:
            self.waiting.updateValue((r["id"],), (r["text"] or "",))
        swept, due = self._times()
        if not due:
            due = max(timerValues.getCurrentProcessingTimeInMs() + 1, swept + self.debounce_ms)
            self.handle.registerTimer(due)
            self.times.update((swept, due))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        rows = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        self.waiting.clear()
        self.times.update((timerValues.getCurrentProcessingTimeInMs(), 0))
        for at in range(0, len(rows), self.page):
            few = rows[at : at + self.page]
            for (row_id, _), (vector, error) in zip(few, embed_page(self.embed, [t for _, t in few]), strict=True):
                yield Row(key=key[0], id=row_id, embedding=vector, error=error)

    def close(self) -> None:
        pass


OUT = T.StructType([T.StructField("key", T.StringType()), T.StructField("id", T.StringType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("error", T.StringType())])


def repair_stream(missing: DataFrame, embed: Embedder, key_col: str, id_col: str = "uuid", text_col: str = "text", page: int = PAGE, debounce_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(key, id, embedding, error) of a stream of rows without a vector, swept for each key by ``Sweeps``. The session's state store must be RocksDB's, which timers need."""
    rows = missing.select(F.col(key_col).cast("string").alias("key"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    return rows.groupBy("key").transformWithState(Sweeps(embed, page, debounce_ms), OUT, "Append", "ProcessingTime")
