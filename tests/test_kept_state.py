"""Snapshots, the fold's laws and its kept form, the repair's sweeps, and the log as a data source."""

import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.operators import notes as N
from corpusmill.sources import readers
from corpusmill.sources.note_log import LogFolder, NoteLog
from corpusmill.sources.snapshots import SnapshotTable
from corpusmill.streaming import feeds, repair

# --- snapshots

ROW = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])


def rows(df):
    return sorted(map(tuple, df.collect()))


def frame(spark, found):
    return spark.createDataFrame(found, ROW)


def test_snapshot_upsert_replace_keep(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), ROW, ["k"], 8)
    assert rows(table.read()) == [] and table.version() == 0
    table.upsert(frame(spark, [(i, "a") for i in range(50)]))
    first = table.version()
    table.upsert(frame(spark, [(3, "b"), (99, "b")]))
    want = {i: "a" for i in range(50)} | {3: "b", 99: "b"}
    assert rows(table.read()) == sorted(want.items())
    assert rows(table.read(first)) == [(i, "a") for i in range(50)]
    table.replace(frame(spark, [(3, "x"), (3, "y"), (None, "null")]), frame(spark, [(3, ""), (4, "")]))
    got = rows(table.read().filter("k is not null"))
    assert [r for r in got if r[0] in (3, 4)] == [(3, "x"), (3, "y")] and len(got) == 51
    table.keep(frame(spark, [(3, ""), (10, ""), (77, "")]))
    assert rows(table.read()) == [(3, "x"), (3, "y"), (10, "a")]
    table.keep(frame(spark, []))
    assert rows(table.read()) == []


def test_snapshot_change_that_dies_halfway(spark, tmp_path):
    """Some tasks of the write succeed and one fails: the table is as it was, and the next change goes through."""
    table = SnapshotTable(spark, str(tmp_path), ROW, ["k"], 8)
    table.upsert(frame(spark, [(i, "a") for i in range(40)]))
    fail = F.udf(lambda v, k: v if k != 17 else 1 / 0, "string")
    broken = frame(spark, [(i, "b") for i in range(40)]).repartition(8).withColumn("v", fail("v", "k"))
    with pytest.raises(Exception):
        table.upsert(broken)
    assert rows(table.read()) == [(i, "a") for i in range(40)] and table.version() == 1
    table.upsert(frame(spark, [(17, "c")]))
    assert ("c" in {r[1] for r in rows(table.read())}) and table.version() == 2


def test_snapshot_rewrites_touched_buckets_only_and_once_a_batch(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path), ROW, ["k"], 16)
    table.upsert(frame(spark, [(i, "a") for i in range(100)]), writer="w", batch=0)
    folders = {r["bucket"]: r["folder"] for r in table._manifest(1) if r["bucket"] is not None}
    table.upsert(frame(spark, [(5, "b")]), writer="w", batch=1)
    after = {r["bucket"]: r["folder"] for r in table._manifest(2) if r["bucket"] is not None}
    assert sum(folders[b] != after[b] for b in folders) == 1
    assert table.upsert(frame(spark, [(5, "again")]), writer="w", batch=1) == 2 and table.applied("w") == 1
    assert (5, "b") in rows(table.read())


def test_snapshot_two_writers(spark, tmp_path):
    a, b = (SnapshotTable(spark, str(tmp_path), ROW, ["k"], 4) for _ in range(2))
    a.upsert(frame(spark, [(1, "a")]))

    def late(old, new):
        b.upsert(frame(spark, [(2, "b")]))
        return old.unionByName(new)

    with pytest.raises(Exception):
        a.change(frame(spark, [(3, "c")]), late)
    assert rows(a.read()) == [(1, "a"), (2, "b")]


# --- the fold's laws

RECORD = "entity_id string, id long, kind string, created_at long, status string, schema_version int, valid_at long, invalid_at long, tags array<string>, linked_files array<string>, source_ref string, remote_id string, superseded_by long, superseded_by_entity_id string"


def random_records(rng, n, entities=3):
    some = lambda *x: rng.choice([None, *x])
    return [
        (f"e{rng.randrange(entities)}", rng.randrange(4), "note", rng.randrange(5), rng.choice(["active", "archived"]), rng.randrange(3), some(1, 2, 3), some(7, 8, 9), rng.choice([None, [], ["a"], ["b", "a"], ["c"]]), rng.choice([None, ["x"], ["y", "x"]]), some("s1", "s2"), some("r1", "r2"), some(4, 5), some("e7", "e8", "e9"))
        for _ in range(n)
    ]


def plain_fold(records):
    """Each entity's record by plain loops; fields in the order of ``show``."""
    nulls_first = lambda x: (x is not None, x)
    key = lambda r: tuple(nulls_first(r[i]) for i in (3, 1, 10, 11, 12))
    out = {}
    for e in {r[0] for r in records}:
        group = [r for r in records if r[0] == e]
        # of records alike in the key any may lend the base, whose other fields are the same
        successors = sorted(((-r[3], key(r), r[13]) for r in group if r[13] is not None))
        least = lambda i, group=group: min((r[i] for r in group if r[i] is not None), default=None)
        union = lambda i, group=group: sorted({t for r in group for t in r[i] or []})
        out[e] = (min(key(r) for r in group), "archived" if any(r[4] == "archived" for r in group) else "active", max(r[5] for r in group), least(6), least(7), union(8), union(9), successors[0][2] if successors else None)
    return out


def show(df):
    nulls_first = lambda x: (x is not None, x)
    return {r["entity_id"]: (tuple(nulls_first(r[c]) for c in ("created_at", "id", "source_ref", "remote_id", "superseded_by")), r["status"], r["schema_version"], r["valid_at"], r["invalid_at"], r["tags"], r["linked_files"], r["superseded_by_entity_id"]) for r in df.collect()}


def test_fold_laws(spark):
    """Whatever the order, the grouping and the repeats, states merge to what one pass over all records gives."""
    rng = random.Random(5)
    for _ in range(4):
        records = random_records(rng, 12)
        df = spark.createDataFrame(records, RECORD)
        want = plain_fold(records)
        assert show(N.fold(df)) == want
        parts = [N.fold_state(spark.createDataFrame(records[i::3], RECORD)).cache() for i in range(3)]
        for a, b, c in itertools.permutations(parts):
            assert show(N.folded(N.merge_states(N.merge_states(a.unionByName(b)).unionByName(c)))) == want
        a, b, c = parts
        assert show(N.folded(N.merge_states(a.unionByName(N.merge_states(b.unionByName(c)))))) == want
        assert show(N.folded(N.merge_states(a.unionByName(b).unionByName(a).unionByName(c).unionByName(b)))) == want
        assert show(N.folded(N.merge_states(N.merge_states(a)))) == show(N.folded(a))


def test_fold_feed_equals_batch(spark, tmp_path):
    """A stream in three files, with a restart between them and a file that comes again, leaves the states that a batch over all records gives."""
    rng = random.Random(8)
    records = random_records(rng, 60, 12)
    schema = spark.createDataFrame([], RECORD).schema
    kept = SnapshotTable(spark, str(tmp_path / "kept"), N.fold_state(spark.createDataFrame([], RECORD)).schema, ["entity_id"], 8)
    for part in (records[:20], records[20:45], records[10:30], records[45:]):
        spark.createDataFrame(part, RECORD).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        feeds.fold_feed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), kept, str(tmp_path / "checkpoint")).awaitTermination()
    assert show(N.folded(kept.read())) == plain_fold(records)


# --- repair


def make_embedder():
    def embed(texts):
        if any("bad" in t for t in texts):
            raise ValueError("refused")
        return [[float(len(t)), 1.0] for t in texts]

    return embed  # a local function goes to the workers whole; they can't import this module


embedder = make_embedder()


def test_page_falls_back_to_rows():
    calls = []

    def embed(texts):
        calls.append(len(texts))
        return embedder(texts)

    assert repair.embed_page(embed, ["a", "bad", "ccc"]) == [([1.0, 1.0], None), (None, "ValueError: refused"), ([3.0, 1.0], None)]
    assert calls == [3, 1, 1, 1]
    assert repair.embed_page(embed, ["bad"]) == [(None, "ValueError: refused")] and calls[4:] == [1]
    assert repair.embed_page(lambda t: [[1.0]], ["a", "b"]) == [([1.0], None), ([1.0], None)]
    assert repair.embed_page(embed, []) == []


def test_fill(spark):
    missing = spark.createDataFrame([(f"u{i:03d}", None if i == 7 else "bad" if i % 10 == 0 else "x" * i) for i in range(100)], "uuid string, text string").repartition(3)
    got = {r["uuid"]: r for r in repair.fill(missing, embedder, page=8).collect()}
    assert len(got) == 100
    for i in range(100):
        r = got[f"u{i:03d}"]
        assert (r["embedding"], r["error"]) == ((None, "ValueError: refused") if i % 10 == 0 else ([0.0 if i == 7 else float(i), 1.0], None))


def test_sweeps(spark, tmp_path):
    """Rows come in three files; all of a key are swept, a row that fails alone keeps its error, and two sweeps of a key are apart."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    schema = T.StructType.fromDDL("uuid string, project string, text string")
    source, got = str(tmp_path / "in"), []
    put = lambda found: spark.createDataFrame(found, schema).coalesce(1).write.mode("append").parquet(source)
    put([(f"a{i}", "p", "bad" if i == 3 else "x" * i) for i in range(6)] + [("b0", "q", "bad")])
    stream = repair.repair_stream(spark.readStream.schema(schema).parquet(source), embedder, "project", page=4, debounce_ms=3000).withColumn("at", F.current_timestamp())
    query = stream.writeStream.foreachBatch(lambda batch, _: got.extend(batch.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()

    def wait(n):
        end = time.time() + 90
        while len(got) < n and time.time() < end and query.isActive:
            time.sleep(0.3)
        return list(got)

    try:
        first = wait(7)
        put([("a7", "p", "later"), ("a3", "p", "mended")])
        every = wait(9)
    finally:
        query.stop()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert query.exception() is None
    want = [("p", f"a{i}", None if i == 3 else [float(i), 1.0], "ValueError: refused" if i == 3 else None) for i in range(6)] + [("q", "b0", None, "ValueError: refused")]
    assert sorted((r["key"], r["id"], r["embedding"], r["error"]) for r in first) == sorted(want)
    later = [r for r in every if r not in first]
    assert sorted((r["id"], r["embedding"]) for r in later) == [("a3", [6.0, 1.0]), ("a7", [5.0, 1.0])]
    assert min(r["at"] for r in later).timestamp() - max(r["at"] for r in first if r["key"] == "p").timestamp() >= 2.5


# --- the log


def test_log_folder(tmp_path):
    log = LogFolder(str(tmp_path))
    assert log.refs() == {}
    heads = [log.append("notes", [(f"c{i}", log.put(f"line {i}\n"))]) for i in range(3)]
    assert log.refs() == {"notes": heads[-1]}
    assert [c for c, _ in log.added(heads[2], heads[0])] == ["c1", "c2"]
    assert [c for c, _ in log.added(heads[2], "elsewhere")] == ["c0", "c1", "c2"]
    assert log.added(heads[2], heads[2]) == []


def test_log_batch_and_write(spark, tmp_path):
    spark.dataSource.register(NoteLog)
    path = str(tmp_path)
    assert spark.read.format("note_log").load(path).count() == 0
    found = [("main", f"c{i % 40}", i, f"v{i}") for i in range(400)] + [("side/x", "c1", 0, "other")]
    lines = spark.createDataFrame(found, "ref string, commit string, line int, value string")
    lines.repartition("ref", "commit").write.format("note_log").mode("append").save(path)
    got = spark.read.format("note_log").load(path)
    assert got.rdd.getNumPartitions() > 2
    assert sorted((r["ref"], r["commit"], r["value"]) for r in got.collect()) == sorted((r, c, v) for r, c, _, v in found)
    # a write that dies adds nothing
    broken = lines.withColumn("value", F.udf(lambda v: v if v != "v17" else 1 / 0, "string")("value"))
    with pytest.raises(Exception):
        broken.write.format("note_log").mode("append").save(path)
    assert spark.read.format("note_log").load(path).count() == len(found)


def test_log_stream_restarts_without_loss(spark, tmp_path):
    spark.dataSource.register(NoteLog)
    log, path = LogFolder(str(tmp_path / "log")), str(tmp_path / "log")

    def run():
        query = spark.readStream.format("note_log").load(path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="0 seconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted(r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    log.append("a", [("c1", log.put("1\n2\n"))])
    assert run() == ["1", "2"]
    log.append("a", [("c2", log.put("3\n"))])
    log.append("a", [("c3", log.put("4\n")), ("c4", log.put("5\n"))])
    log.append("b", [("c9", log.put("6\n"))])
    assert run() == ["1", "2", "3", "4", "5", "6"]
    assert run() == ["1", "2", "3", "4", "5", "6"]


def test_log_records_fold(spark, tmp_path):
    spark.dataSource.register(NoteLog)
    log = LogFolder(str(tmp_path))
    record = lambda **x: json.dumps({"kind": "note", "title": "t", "body": "b", "schema_version": 1, "id": 1, "created_at": 5, "status": "active"} | x)
    log.append("notes", [("c1", log.put(record() + "\nno record\n{}\n"))])
    log.append("notes", [("c2", log.put(record(id=2, created_at=9, status="archived", tags=["x"]) + "\n"))])
    records = readers.note_records(spark.read.format("note_log").load(str(tmp_path)))
    (one,) = N.fold(records).collect()
    assert (one["id"], one["status"], one["tags"], one["commit"]) == (1, "archived", ["x"], "c1")
    with open(tmp_path / "objects" / log.put("x\n"), "w") as f:
        f.write("damaged\n")
    log.append("notes", [("c3", log.put("y\n")), ("c4", "0" * 64)])
    with pytest.raises(Exception):
        spark.read.format("note_log").load(str(tmp_path)).collect()
