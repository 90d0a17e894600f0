"""Tables kept as snapshots: a manifest names the folder of each bucket of keys, and a change writes new folders first and the next manifest last.

A change rewrites only the buckets that its keys fall in. A run that is lost before the manifest is written leaves files that no manifest names, and the table as it was; readers keep the snapshot they began with. Two
writers that start from the same version can't both write the next one: the later one fails and changes nothing. A change may carry the number of the batch it comes from, and is then applied once however often it is sent.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.lineage import children

MANIFEST = "version long, bucket int, folder string, writer string, batch long"


class SnapshotTable:
    """A table in a folder that all executors share, bucketed by key columns; schema and buckets are those it was made with."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        """The newest snapshot's number; 0 for a table that has none."""
        return max((int(n) for n in children(self.spark, f"{self.path}/versions") if n.isdigit()), default=0)

    def _manifest(self, version: int) -> list:
        """Rows of a snapshot: a bucket and its folder each, and one for each writer's last batch."""
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/versions/{version:010d}").collect() if version else []

    def _rows(self, manifest: list, only: set[int] | None = None) -> DataFrame:
        folders: dict[str, list[int]] = {}
        for r in manifest:
            if r["bucket"] is not None and (only is None or r["bucket"] in only):
                folders.setdefault(r["folder"], []).append(r["bucket"])
        paths = [f"{self.path}/data/{folder}/_bucket={b}" for folder, held in folders.items() for b in held]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest snapshot, or of an older one."""
        return self._rows(self._manifest(self.version() if version is None else version))

    def applied(self, writer: str) -> int:
        """The last batch of a writer that the table holds; -1 if none."""
        return max((r["batch"] for r in self._manifest(self.version()) if r["bucket"] is None and r["writer"] == writer), default=-1)

    def change(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], every: bool = False, writer: str | None = None, batch: int = 0) -> int:
        """Sets the buckets of delta's keys to merge(their rows, delta), and returns the version: the next one, or the same if there was nothing to do.

        merge gets all rows of these buckets, and may only return rows whose keys fall in them. With ``every`` all buckets are rewritten, which a change needs that depends on what delta does not have.
        """
        version = self.version()
        manifest = self._manifest(version)
        if writer is not None and any(r["bucket"] is None and r["writer"] == writer and r["batch"] >= batch for r in manifest):
            return version
        held = {r["bucket"] for r in manifest if r["bucket"] is not None}
        touched = {r[0] for r in delta.select(self._bucket().alias("b")).distinct().collect()}  # no more than there are buckets
        if every:
            touched |= held
        if not touched and writer is None:
            return version
        folder = uuid.uuid4().hex
        if touched:
            rows = merge(self._rows(manifest, touched), delta).select(*self.schema.names).withColumn("_bucket", self._bucket())
            rows.repartition("_bucket", *self.keys).write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        written = {int(n.partition("=")[2]) for n in children(self.spark, f"{self.path}/data/{folder}") if n.startswith("_bucket=")}
        if written - touched:
            raise ValueError("a change may not write keys of other buckets")
        left = [(r["bucket"], r["folder"], None, None) for r in manifest if r["bucket"] is not None and r["bucket"] not in touched]
        done = [(None, None, r["writer"], r["batch"]) for r in manifest if r["bucket"] is None and r["writer"] not in (None, writer)]
        mine = [(None, None, writer, batch)] if writer is not None else []
        rows = left + [(b, folder, None, None) for b in written] + done + mine or [(None, None, None, None)]
        self.spark.createDataFrame([(version + 1, *r) for r in rows], MANIFEST).coalesce(1).write.parquet(f"{self.path}/versions/{version + 1:010d}")
        return version + 1

    def upsert(self, rows: DataFrame, **batch) -> int:
        """Rows stand for those with their keys; keys of ``rows`` are distinct."""
        return self.change(rows, lambda old, new: old.join(new.select(*self.keys), self.keys, "left_anti").unionByName(new), **batch)

    def replace(self, rows: DataFrame, of: DataFrame | None = None, **batch) -> int:
        """All rows of the keys in ``of`` (those of rows, if it isn't given) go, and rows come; so a key may have many rows, or none from now on."""
        keys = rows.select(*self.keys) if of is None else of.select(*self.keys).union(rows.select(*self.keys))
        marked = keys.distinct().join(rows.withColumn("_there", F.lit(True)), self.keys, "left")

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            return old.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new.filter("_there").select(*self.schema.names))

        return self.change(marked, merge, **batch)

    def keep(self, seen: DataFrame, **batch) -> int:
        """Rows of all keys that are not among those seen go."""
        return self.change(seen.select(*self.keys).distinct(), lambda old, d: old.join(d, self.keys, "left_semi"), every=True, **batch)
