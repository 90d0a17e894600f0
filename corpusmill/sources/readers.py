"""Readers and writers: a tree of files, incremental reading, note logs, commit logs and portable dumps."""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import scan
from corpusmill.functions.text import entity_id
from corpusmill.memory import short_batches
from corpusmill.operators.chunks import chunk
from corpusmill.operators.code import LANGUAGES

MAX_DUMP_BYTES = 256 << 20
#: Folders that the driver opens until there are so many to deal to tasks, entries that it reads of one, and rows and bytes that a task holds.
WALKS, WIDEST, HELD_ROWS, HELD_BYTES = 32, 10_000, 10_000, 8 << 20
FILE = "path string, language string, hash string, mtime timestamp, length long, text string"


def local_folder(spark: SparkSession, root: str) -> str | None:
    """The plain path of a folder in the machines' own file system, which executors see by the same name; null in any other store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return store.makeQualified(path).toUri().getPath() if store.getUri().getScheme() == "file" else None


def _entries(folder: str, most: int | None = None) -> tuple[list[str], list[tuple[str, os.stat_result]], bool]:
    """Folders, files and whether that is all; without the names that Spark's readers pass over, and without empty files, as there."""
    with os.scandir(folder) as found:
        entries = list(islice(found, most))
        whole = next(found, None) is None
    folders, files = [], []
    for e in entries:
        hidden = e.name.startswith(".") or e.name.endswith("._COPYING_") or (e.name.startswith("_") and "=" not in e.name)
        try:
            if e.is_dir():
                if not hidden or e.name.startswith(("_metadata", "_common_metadata")):
                    folders.append(e.name)
            elif not hidden and e.is_file() and (stat := e.stat()).st_size:
                files.append((e.name, stat))
        except OSError:  # gone meanwhile, or a circle of links
            continue
    return folders, files, whole


def _walked(base: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for batch in batches:
        for top, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            left = [os.fsdecode(top)]
            while left:
                folder = left.pop()
                folders, files, _ = _entries(f"{base}/{folder}")
                rows += [(folder + name, stat.st_mtime_ns // 1_000_000, stat.st_size) for name, stat in files]
                if deep:
                    left += [f"{folder}{name}/" for name in folders]
                while len(rows) >= HELD_ROWS:
                    yield _file_rows(rows[:HELD_ROWS])
                    rows = rows[HELD_ROWS:]
    yield _file_rows(rows)


def _file_rows(rows: list[tuple[str, int, int]]) -> pa.RecordBatch:
    names, times, lengths = zip(*rows, strict=True) if rows else ((), (), ())
    raw = [os.fsencode(x) for x in names]
    return pa.RecordBatch.from_arrays([pa.array([x.decode(errors="replace") for x in raw], pa.string()), pa.array(raw, pa.binary()), pa.array(times, pa.int64()), pa.array(lengths, pa.int64())], ["path", "raw", "ms", "length"])


def _listed(spark: SparkSession, base: str) -> DataFrame:
    """(path, raw, modificationTime, length) of the files below a local folder; raw is the path's bytes, which need not be UTF-8.

    Spark's own listing needs a task for each of many folders and holds every file on the driver. Here the driver opens folders level by level until there are enough of them, and tasks walk all that is below.
    """
    opened, wide, level = [], [], [""]
    while level and len(level) < WALKS:
        below = []
        for folder in level:
            folders, _, whole = _entries(f"{base}/{folder}", WIDEST)
            if whole:
                opened.append(folder)
                below += [f"{folder}{name}/" for name in folders]
            else:
                wide.append(folder)
        level = below
    tops = spark.createDataFrame([(os.fsencode(x), False) for x in opened] + [(os.fsencode(x), True) for x in wide + level], "top binary, deep boolean")
    files = tops.mapInArrow(lambda batches: _walked(base, batches), "path string, raw binary, ms long, length long")
    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path").select("path", "raw", F.timestamp_millis("ms").alias("modificationTime"), "length")


def _with_content(files: DataFrame, base: str) -> DataFrame:
    """files (raw) below a local folder with their bytes as content."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, start = [], 0, 0
            for i, raw in enumerate(batch.column("raw").to_pylist(), 1):
                with open(os.path.join(os.fsencode(base), raw), "rb") as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= HELD_BYTES or i == batch.num_rows:
                    yield batch.slice(start, i - start).append_column("content", pa.array(held, pa.binary()))
                    held, size, start = [], 0, i

    return files.mapInArrow(read, T.StructType([*files.schema, T.StructField("content", T.BinaryType())]))


def write_tree(files: DataFrame, root: str) -> int:
    """files (path, text) written below a local folder by the tasks that have them; the number of rows.

    A file takes its name when it is whole, so that a task may run again or twice.
    """
    base = local_folder(files.sparkSession, root)
    if base is None:
        raise ValueError(f"{root} is not in the machines' own file system")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if os.path.isabs(path) or os.path.normpath(path).split("/")[0] in ("", ".", ".."):
                    raise ValueError(f"{path} is not below the folder")
                whole = f"{base}/{path}"
                os.makedirs(folder := os.path.dirname(whole), exist_ok=True)
                with open(part := f"{folder}/.{uuid.uuid4().hex}", "wb") as file:
                    file.write(text.encode())
                os.replace(part, whole)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return short_batches(files).select("path", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_tree(spark: SparkSession, root: str, user_lines: list[str] = (), use_defaults: bool = True, detect_generated: bool = True, ignore_files: tuple[str, ...] = (), rules: DataFrame | None = None) -> DataFrame:
    """(path, language, hash, mtime, length, text) of the files below root that are to be read; path is relative to root. ``ignore_files``: names of ignore files that hold below their directories; ``rules``: lines of such files, as ``without_ignored`` takes them.

    Names that are sensitive never pass; excludes, size and language are judged before a file's content is used. Local folders are walked and read by tasks, other stores by Spark's reader.
    """
    base = root.rstrip("/")
    local = local_folder(spark, base)
    local = local if local and os.path.isdir(local) else None
    if local:
        rows = _listed(spark, local)
    else:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
        rows = files.withColumn("path", F.regexp_replace("path", "^.*?" + _quoted(base.split("://")[-1]) + "/", ""))  # names as they are, not escaped
    rows = rows.filter(~scan.is_sensitive(F.col("path")) & scan.within_size(F.col("length"))).withColumn("decision", scan.index_decision(F.col("path"), list(user_lines), use_defaults))
    if ignore_files:
        rows = without_ignored(rows, ignore_rules(spark, root, ignore_files))
    if rules is not None:
        rows = without_ignored(rows, rules)
    rows = rows.filter("decision.decision != 'exclude'").withColumn("language", scan.detect_language(F.col("path"))).filter("language is not null")
    if local:
        rows = _with_content(rows, local)
    rows = rows.filter(~scan.is_binary(F.col("content"))).withColumn("text", F.decode("content", "utf-8"))
    if detect_generated:
        rows = rows.filter((F.col("decision.decision") == "include") | scan.generated_marker(F.col("text")).isNull())
    return rows.select("path", "language", F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("mtime"), "length", "text")


def _rule_key(line: str) -> str | None:
    """What a path must have for a rule to fit: ``=name`` for a component, ``.ext`` for one that ends so; null if nothing is certain."""
    parts = line.removeprefix("!").strip("/").split("/")
    if "[" in line:
        return None
    # a component after ``a**`` may begin within another one
    safe = [p for before, p in zip(["", *parts], parts, strict=False) if p and (before == "**" or not before.endswith("**"))]
    names = [p for p in safe if not re.search(r"[*?]", p)]
    if names:
        return "=" + max(names, key=len)
    ends = [p for p in safe if re.fullmatch(r"\*\.[^*?.]+", p)]
    return ends[0][1:] if ends else None


def without_ignored(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (path) but those that ignore rules (dir, line, at) exclude: a rule holds below its directory, of those that fit the deepest and last decides, and a ``!`` line includes.

    A file meets the rules of its own directories only, and of these the ones whose key (``_rule_key``) it has: a component's name or extension. Rules without one meet every file below their directory.
    """
    lines = rules.withColumn("line", F.trim("line")).filter("line != '' and not startswith(line, '#')")
    to_regex, to_key = F.udf(lambda line: scan.glob_regex(line.removeprefix("!")), "string"), F.udf(_rule_key, "string")
    lines = lines.select(F.col("dir").alias("_dir"), F.col("at").alias("_at"), F.startswith("line", F.lit("!")).alias("_in"), to_regex("line").alias("_regex"), F.coalesce(to_key("line"), F.lit("")).alias("_key"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("_dir"), F.slice(parts, n + 1, F.size(parts)).alias("_names")))
    below = files.select("path", F.explode(above).alias("_a")).select("path", "_a.*").join(lines.select("_dir").distinct(), "_dir", "left_semi")
    named, ends = F.transform("_names", lambda n: F.concat(F.lit("="), n)), F.transform(F.filter("_names", lambda n: F.contains(n, F.lit("."))), lambda n: F.concat(F.lit("."), F.substring_index(n, ".", -1)))
    each = below.select("path", "_dir", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), named, ends))).alias("_key")).join(lines, ["_dir", "_key"])
    each = each.withColumn("_rel", F.expr("if(_dir = '', path, substr(path, length(_dir) + 2))"))
    last = each.filter(F.expr("rlike(_rel, _regex)")).groupBy("path").agg(F.max_by("_in", F.struct(F.length("_dir"), "_at")).alias("_in"))
    return files.join(last.filter("not _in").select("path"), "path", "left_anti")


def ignore_rules(spark: SparkSession, root: str, names: tuple[str, ...] = (".gitignore", ".ignore")) -> DataFrame:
    """(dir, line, at) of all ignore files below root.

    Spark's readers pass over names that begin with a dot, so these files are found level by level and read through the driver's file system client: a few lines each.
    """
    jvm, base = spark._jvm, root.rstrip("/")
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    start = len(fs.makeQualified(path(base)).toUri().getPath()) + 1
    rows, level = [], base
    while fs.globStatus(path(level + "/*")):
        for i, name in enumerate(names):
            for status in fs.globStatus(path(f"{level}/{name}")) or []:
                stream = fs.open(status.getPath())
                text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                stream.close()
                folder = status.getPath().getParent().toUri().getPath()[start:]
                rows += [(folder, line, (i << 32) + n) for n, line in enumerate(text.splitlines())]
        level += "/*"
    return spark.createDataFrame(rows, "dir string, line string, at long")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def to_parse(found: DataFrame, files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Found files, but for those whose hash is known and that have chunks."""
    known = files.join(chunks.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi").select("path", "hash")
    return found.join(known, ["path", "hash"], "left_anti")


def gone(files: DataFrame, found: DataFrame) -> DataFrame:
    """Files that were not found any more."""
    return files.join(found.select("path"), "path", "left_anti")


def sample(rows: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by a hash of their key: the same ones on every run."""
    return rows.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).orderBy("_h", key).limit(n).drop("_h")


def read_chunks(files: DataFrame, tokens: int = 512) -> DataFrame:
    """Chunks of files by the reader of their language; code over the parse limit goes through windows."""
    small = F.octet_length("text") <= scan.MAX_PARSE_BYTES
    return chunk(files.withColumn("_reader", F.when(small | ~F.col("language").isin("python", *LANGUAGES), F.col("language"))), "text", "_reader", tokens).drop("_reader")


NOTE_RECORD = "schema_version int, id long, kind string, title string, body string, tags array<string>, linked_files array<string>, created_at long, status string, superseded_by long, source_ref string, valid_at long, invalid_at long, entity_id string, remote_id string, superseded_by_entity_id string"


def note_records(lines: DataFrame, col: str = "value") -> DataFrame:
    """lines with the record's columns in place of its text; lines that are no records are left out."""
    rows = lines.withColumn("_r", F.from_json(col, NOTE_RECORD)).filter("_r is not null and _r.kind is not null").drop(col).select("*", "_r.*").drop("_r")
    return rows.withColumn("entity_id", F.coalesce("entity_id", entity_id(F.col("kind"), F.col("title"), F.col("body"))))


def read_note_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of an append-only log of JSON lines; see ``note_log`` for logs with refs."""
    return note_records(spark.read.text(path))


def read_commits(text: DataFrame, col: str = "value") -> DataFrame:
    """(sha, subject, body) of NUL-separated commits, each the hash, the subject and the body on lines."""
    each = text.select(F.explode(F.split(F.col(col), "\0")).alias("c")).withColumn("c", F.trim(F.regexp_replace("c", r"^\s+", ""))).filter("c != ''")
    return each.select(F.split("c", "\n")[0].alias("sha"), F.coalesce(F.get(F.split("c", "\n"), F.lit(1)), F.lit("")).alias("subject"), F.regexp_replace(F.array_join(F.slice(F.split("c", "\n"), F.lit(3), F.greatest(F.size(F.split("c", "\n")) - 2, F.lit(0))), "\n"), r"^\s+|\s+$", "").alias("body"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_text(rows: DataFrame, line: Column, path: str) -> None:
    rows.select(line.cast("string")).write.mode("overwrite").text(path)


def has_schema(rows: DataFrame, fields: dict[str, str]) -> bool:
    """Whether rows have just these fields and types, in any order."""
    return {f.name: f.dataType.simpleString() for f in rows.schema.fields} == fields


def dump_lines(entities: list[dict], relationships: list[dict]) -> str:
    """A portable dump: header, records, and a footer with counts and the digest of all before it."""
    lines = [json.dumps({"record": "header", "version": 1}, sort_keys=True)]
    lines += [json.dumps({"record": "entity", **e}, sort_keys=True) for e in entities] + [json.dumps({"record": "relationship", **r}, sort_keys=True) for r in relationships]
    body = "".join(x + "\n" for x in lines)
    return body + json.dumps({"record": "footer", "entities": len(entities), "relationships": len(relationships), "sha256": hashlib.sha256(body.encode()).hexdigest()}, sort_keys=True) + "\n"


def check_dump(text: str) -> None:
    """Raises ValueError unless a dump is whole: it ends with a line end, its counts and digest fit."""
    if not text.endswith("\n"):
        raise ValueError("the dump is cut off")
    body, _, last = text[:-1].rpartition("\n")
    try:
        footer, rows = json.loads(last), [json.loads(x) for x in body.split("\n")]
    except ValueError as e:
        raise ValueError("the dump has a line that is no record") from e
    kinds = [r.get("record") for r in rows]
    if footer.get("record") != "footer" or kinds[:1] != ["header"] or kinds.count("entity") != footer["entities"] or kinds.count("relationship") != footer["relationships"]:
        raise ValueError("the dump's counts do not fit")
    if hashlib.sha256((body + "\n").encode()).hexdigest() != footer["sha256"]:
        raise ValueError("the dump's digest does not fit")


def read_dump(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) of a dump of one file; refused as a whole if anything does not fit.

    The digest runs over the whole file in order, so the driver reads it; a dump over MAX_DUMP_BYTES is refused before it is read.
    """
    files = spark.read.format("binaryFile").load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > MAX_DUMP_BYTES:
        raise ValueError(f"the dump has {size} bytes; {MAX_DUMP_BYTES} are the most that is read")
    check_dump(b"".join(bytes(r["content"]) for r in files.orderBy("path").select("content").collect()).decode())
    rows = spark.read.text(path)
    entity = "record string, type string, ref string, entity_id string, created_at long, kind string, title string, body string, status string, tags array<string>"
    link = "record string, type string, from_ref string, to_ref string, created_at long"
    of = lambda schema, kind: rows.select(F.from_json("value", schema).alias("r")).filter(F.col("r.record") == kind).select("r.*").drop("record")
    return of(entity, "entity"), of(link, "relationship")


def collapse_dump(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities with one survivor for each entity_id, the least (created_at, ref), and relationships moved to survivors, without loops, one of equal ones, with its recorded time."""
    key = F.struct("created_at", "ref")
    kept = entities.groupBy("entity_id").agg(F.min_by(F.struct(*[c for c in entities.columns if c != "entity_id"]), key).alias("e")).select("entity_id", "e.*")
    to = entities.join(kept.select("entity_id", F.col("ref").alias("survivor")), "entity_id").select("ref", "survivor")
    moved = relationships.join(to.select(F.col("ref").alias("from_ref"), F.col("survivor").alias("_f")), "from_ref").join(to.select(F.col("ref").alias("to_ref"), F.col("survivor").alias("_t")), "to_ref")
    return kept, moved.filter("_f != _t").groupBy(F.col("_f").alias("from_ref"), F.col("_t").alias("to_ref"), "type").agg(F.min("created_at").alias("created_at"))


def import_dump(spark: SparkSession, path: str, target: str) -> None:
    """Checks and collapses a dump and writes both tables; entities first, and nothing if the dump is refused."""
    entities, links = collapse_dump(*read_dump(spark, path))
    entities.write.mode("overwrite").parquet(f"{target}/entities")
    links.write.mode("overwrite").parquet(f"{target}/relationships")
