"""Queries over state that is kept between runs: snapshots, folds fed by a stream, pulls in pages, repair in pages, and the log of notes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.operators import notes as N
from corpusmill.plans import queries as Q
from corpusmill.plans.more import folder
from corpusmill.plans.registry import ORACLES, query
from corpusmill.plans.tables import NOTES_SQL, edges, notes, table
from corpusmill.sources import readers
from corpusmill.sources.note_log import NoteLog
from corpusmill.sources.snapshots import SnapshotTable
from corpusmill.streaming import feeds, repair


@query("p6_snapshot", ORACLES["p6_replace_edges"])
def p6_snapshot(spark, sf):
    """Edges kept by file; one file's are replaced, which rewrites its bucket only."""
    e = edges(spark, sf)
    kept = SnapshotTable(spark, folder(spark), e.schema, ["source_file"], 16)
    kept.replace(e)
    kept.replace(e.filter("source_file = 'f3' and kind = 'calls'").withColumn("line", F.lit(0)))
    return kept.read().groupBy("source_file", "kind").agg(F.count("*").alias("n"), F.sum("line").alias("lines"))


@query("m9_s8_s9_snapshot", """SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN sha256('new' || text) ELSE sha256(text) END AS hash FROM documents WHERE lang <> 'en'""")
def m9_snapshot(spark, sf):
    """Hashes of files: those of the labelled ones change and are written again, those not visited any more go."""
    d = table(spark, sf, "documents").select("doc_id", "lang", F.sha2("text", 256).alias("hash"), F.sha2(F.concat(F.lit("new"), "text"), 256).alias("now"))
    files = d.select("doc_id", "hash")
    kept = SnapshotTable(spark, folder(spark), files.schema, ["doc_id"], 16)
    kept.upsert(files)
    visited = d.join(table(spark, sf, "labels").select("doc_id", F.lit(True).alias("_new")), "doc_id", "left").select("doc_id", "lang", F.when(F.col("_new"), F.col("now")).otherwise(F.col("hash")).alias("hash"))
    kept.upsert(visited.select("doc_id", "hash").join(kept.read(), ["doc_id", "hash"], "left_anti"))
    kept.keep(visited.filter("lang <> 'en'").select("doc_id"))
    return kept.read()


@query("m5_fold_feed", ORACLES["m5_m6_fold"].replace("base, base AS anchor,", "base,"))
def m5_feed(spark, sf):
    """The fold as a feed: records arrive in four files, whose states are merged into what is kept."""
    r, path = Q.note_records(spark, sf), folder(spark)
    r.repartition(4, "id").write.parquet(f"{path}/in")
    kept = SnapshotTable(spark, f"{path}/kept", N.fold_state(r).schema, ["entity_id"], 16)
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    feeds.fold_feed(stream, kept, f"{path}/checkpoint").awaitTermination()
    return N.folded(kept.read()).select("entity_id", F.col("id").alias("base"), "status", "schema_version", "valid_at", "invalid_at", F.col("superseded_by_entity_id").alias("superseded"), F.array_join("tags", ",").alias("tags"))


@query("t2_pulls", ORACLES["m8_pull"])
def t2(spark, sf):
    """Remote notes pulled as a stream, all of an entity's in one file, into notes kept by entity."""
    n, path = notes(spark, sf), folder(spark)
    own = n.filter("conv_id % 4 < 2").withColumn("k", F.row_number().over(Window.partitionBy("entity_id").orderBy("created_at", "uuid"))).filter("k = 1").drop("k")
    kept = SnapshotTable(spark, f"{path}/kept", own.schema, ["entity_id"], 16)
    kept.upsert(own)
    remote = n.selectExpr("concat('r', uuid) AS remote_id", "kind", "title", "body", "created_at", "status = 'archived' AS archived", "entity_id")
    remote.repartition(4, "entity_id").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{path}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    feeds.pull_feed(stream, kept, f"{path}/checkpoint").awaitTermination()
    return kept.read().select("entity_id", "status", "remote_id")


def _embed(texts: list[str]) -> list[list[float]]:
    """Stands for a model: the length and the number of e; a page with a text of a length divisible by seven is refused."""
    if any(len(t) % 7 == 0 for t in texts):
        raise ValueError("refused")
    return [[float(len(t)), float(t.count("e"))] for t in texts]


@query("t5_repair", f"WITH {NOTES_SQL} SELECT uuid, length(body) % 7 = 0 AS failed, CASE WHEN length(body) % 7 > 0 THEN length(body)::FLOAT END AS size, CASE WHEN length(body) % 7 > 0 THEN (length(body) - length(replace(body, 'e', '')))::FLOAT END AS es FROM notes WHERE status = 'active'")
def t5(spark, sf):
    """Vectors for all active notes, in pages; a page that fails is tried row by row."""
    made = repair.fill(notes(spark, sf).filter("status = 'active'"), _embed, "uuid", "body")
    return made.select("uuid", F.col("error").isNotNull().alias("failed"), F.col("embedding")[0].alias("size"), F.col("embedding")[1].alias("es"))


@query("s17_t7_log", ORACLES["s17_note_log"])
def s17_log(spark, sf):
    """Notes appended to a log with a ref for each third of the conversations, read in parallel and folded."""
    spark.dataSource.register(NoteLog)
    path = folder(spark)
    n = notes(spark, sf).selectExpr("conv_id", "turn", "1 AS schema_version", "conv_id * 1000 + turn AS id", "kind", "title", "body", "tags", "linked_files", "created_at", "status", "source_ref", "valid_at", "invalid_at", "entity_id", "remote_id")
    record = F.to_json(F.struct(*[c for c in n.columns if c not in ("conv_id", "turn")]))
    lines = n.select(F.concat(F.lit("notes/"), (F.col("conv_id") % 3).cast("string")).alias("ref"), F.sha1(F.col("conv_id").cast("string")).alias("commit"), F.col("turn").cast("int").alias("line"), record.alias("value"))
    lines.repartition("ref", "commit").write.format("note_log").mode("append").save(path)
    return N.fold(readers.note_records(spark.read.format("note_log").load(path).drop("line"))).select("entity_id", "id", "status")
