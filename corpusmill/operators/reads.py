"""Named reads: probes, lookups and listings with a total order, search results with their places, and what projects take from each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import estimate_tokens
from corpusmill.operators import fusion
from corpusmill.operators import notes as N
from corpusmill.operators import text_search as B
from corpusmill.operators import vectors as V

# search results


def with_places(hits: DataFrame, chunks: DataFrame, files: DataFrame) -> DataFrame:
    """Hits (chunk_id, scores) with the columns of their chunk (chunk_id, file_id, ...) and its file (id, path, language); hits without either go.

    Hits are a result list, of at most the caps of its search, so they are broadcast and chunks aren't shuffled.
    """
    placed = chunks.join(F.broadcast(hits), "chunk_id")
    return files.select(F.col("id").alias("file_id"), "path", "language").join(F.broadcast(placed), "file_id").drop("file_id")


def hybrid_notes(notes: DataFrame, query_vector: list[float], text: str, limit: int, at: int | None = None, fields: tuple[str, ...] = ("title", "body"), index=None) -> DataFrame:
    """Notes (with an embedding) valid at a time by the fused ranks of nearness and of the text as a phrase, with score and distance; ties by uuid."""
    n = fusion.candidates(limit)
    near = B.ranked(V.knn(notes, query_vector, n, ["uuid"], N.as_of(at)), ["distance", "uuid"]).select("uuid", "rank")
    said = B.ranked(B.search_phrase(notes, text, list(fields), n, ["uuid"], N.as_of(at), index), [F.desc("score"), "uuid"]).select("uuid", "rank")
    return fusion.hybrid([near, said], notes, "uuid", limit, ["uuid"])


# probes and lookups


def found(rows: DataFrame, where: Column | None = None, name: str = "found") -> DataFrame:
    """One row: whether any row holds; reads no further than the first."""
    some = (rows if where is None else rows.filter(where)).limit(1)
    return some.agg((F.count("*") > 0).alias(name))


def by_key(rows: DataFrame, key: str, value) -> DataFrame:
    """The row of a key, or none."""
    return rows.filter(F.col(key) == value).limit(1)


# chunks and edges


def by_ids(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks of an id list by path, lines and id."""
    return N.with_ids(chunks, ids, "chunk_id").orderBy("path", "start_line", "end_line", "chunk_id")


def wants_summary() -> Column:
    """Named chunks that have no summary yet; an empty one is one."""
    return F.col("name").isNotNull() & F.col("summary").isNull()


def wants_selection(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without a title that have a vector."""
    return N.with_ids(chunks.filter("name is null"), embeddings, "chunk_id")


def token_count() -> Column:
    """The stored count, or an estimate where it is 0."""
    return F.when(F.col("token_count") == 0, estimate_tokens(F.col("content"))).otherwise(F.col("token_count"))


def callees(edges: DataFrame, name: str | None = None) -> DataFrame:
    """(source_name, target_name) of calls, distinct, in order; of one symbol or of all."""
    calls = edges.filter("kind = 'calls' and source_name is not null")
    calls = calls if name is None else calls.filter(F.col("source_name") == name)
    return calls.select("source_name", "target_name").distinct().orderBy("source_name", "target_name")


EDGE_ORDER = ["kind", "target_name", "source_file", "line", "source_name"]


def edges_of_symbol(edges: DataFrame, name: str) -> DataFrame:
    """Edges with the symbol at either end, in order."""
    return edges.filter((F.col("source_name") == name) | (F.col("target_name") == name)).orderBy(*EDGE_ORDER)


def edges_of_file(edges: DataFrame, path: str) -> DataFrame:
    return edges.filter(F.col("source_file") == path).orderBy(*EDGE_ORDER)


def symbol_chunks(chunks: DataFrame, edges: DataFrame, symbols: list[str]) -> DataFrame:
    """(symbol, chunk_id) of the chunks that mention or call one of the symbols."""
    used = edges.filter(F.col("kind").isin("mentions", "calls") & F.col("target_name").isin(symbols))
    return chunks.join(used, (chunks["name"] == used["source_name"]) & (chunks["path"] == used["source_file"])).select(F.col("target_name").alias("symbol"), "chunk_id").distinct()


# notes


def for_dedup(notes: DataFrame) -> DataFrame:
    """All notes, oldest first."""
    return notes.orderBy("created_at", "uuid")


def for_embedding(notes: DataFrame, archived: bool = False) -> DataFrame:
    """(uuid, title, body) of active notes, or of all, whether or not they have a vector."""
    return (notes if archived else notes.filter("status = 'active'")).select("uuid", "title", "body").orderBy("uuid")


def for_sync(notes: DataFrame, archived: bool = False) -> DataFrame:
    """Rows to send, oldest first, with ``archived`` from the status."""
    rows = notes.withColumn("archived", F.col("status") == "archived")
    return (rows if archived else rows.filter("not archived")).orderBy("created_at", "uuid")


def folded_list(records: DataFrame, commit_prefix: str | None = None, kind: str | None = None, archived: bool = False, at: int | None = None, limit: int = 50) -> DataFrame:
    """The newest of the folded entities of a log: anchored to a commit that begins so, of a kind, and valid at a time (which drops the filter on status)."""
    rows = N.fold(records)
    if commit_prefix is not None:
        anchored = N.anchors(records).filter(F.startswith("commit", F.lit(commit_prefix))).select("entity_id")
        rows = rows.join(anchored, "entity_id", "left_semi")
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if at is not None or not archived:
        rows = rows.filter(F.col("status") != "archived" if at is None else N.as_of(at))
    return rows.orderBy(F.desc("created_at"), "entity_id").limit(limit)


# conventions, specs, projects


def conventions_listed(conventions: DataFrame, language: str | None = None) -> DataFrame:
    """Conventions of a language, or of all by language, surest first."""
    rows = conventions if language is None else conventions.filter(F.col("language") == language)
    return rows.orderBy("language", F.desc("confidence"), "category")


def for_conventions(chunks: DataFrame) -> DataFrame:
    """All chunks, a missing language as unknown."""
    return chunks.withColumn("language", F.coalesce("language", F.lit("unknown")))


def specs_listed(specs: DataFrame, links: DataFrame) -> DataFrame:
    """(id, path, title, is_auto, linked): specs by path, each with its linked paths in order; a spec without links has an empty list."""
    linked = links.groupBy(F.col("spec_id").alias("id")).agg(F.array_sort(F.collect_set("linked")).alias("linked"))
    return specs.join(linked, "id", "left").withColumn("linked", F.coalesce("linked", F.expr("cast(array() as array<string>)"))).orderBy("path")


def specs_of_files(specs: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """(path, title) of the specs with a link that is one of the files or begins its path, each spec once: an equi-join on the files' beginnings of the links' lengths."""
    sizes = links.agg(F.collect_set(F.length("linked")).alias("sizes")).scalar()
    starts = files.withColumn("_sizes", sizes).select(F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("linked")).distinct()
    governing = links.join(starts, "linked", "left_semi").select(F.col("spec_id").alias("id")).distinct()
    return specs.join(governing, "id", "left_semi").select("path", "title")


def project_links(projects: DataFrame, deps: DataFrame) -> DataFrame:
    """(project, other, direction): what each project depends on and what depends on it, from deps (project_id, dep_id)."""
    name = lambda key, out: projects.select(F.col("id").alias(key), F.col("name").alias(out))
    pairs = deps.join(name("project_id", "a"), "project_id").join(name("dep_id", "b"), "dep_id")
    forth = pairs.select(F.col("a").alias("project"), F.col("b").alias("other"), F.lit("depends on").alias("direction"))
    return forth.union(pairs.select(F.col("b").alias("project"), F.col("a").alias("other"), F.lit("needed by").alias("direction"))).distinct()


def with_dependencies(own: DataFrame, others: DataFrame, place: str) -> DataFrame:
    """own with the cross-cutting notes of the projects it depends on, one for each (root, uuid), that of the first place; those it has already aren't repeated."""
    rest = [c for c in others.columns if c not in ("root", "uuid")]
    more = others.filter(N.cross_cutting()).groupBy("root", "uuid").agg(F.min_by(F.struct(*rest), place).alias("r")).select("root", "uuid", "r.*")
    return own.unionByName(more.join(own.select("root", "uuid"), ["root", "uuid"], "left_anti").select(*own.columns))


def moved_refs(refs: DataFrame, seen: DataFrame) -> DataFrame:
    """(ref, oid, last) of refs that point elsewhere than at the last import, are new or are gone; an import is due if there is any."""
    both = refs.join(seen.withColumnRenamed("oid", "last"), "ref", "full_outer")
    return both.filter(~F.col("oid").eqNullSafe(F.col("last"))).select("ref", "oid", "last")
