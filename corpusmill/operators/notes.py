"""Notes: temporal filters, merges and snapshots. Merges are joins or sums that make a new snapshot; none depends on the order of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.lineage import cut

LIST_CAP, PAGE_MIN, PAGE_MAX, HARVEST_TAG = 500, 1, 500, "git:"
CROSS_TAGS, CROSS_KINDS = ["locked", "cross-project"], ["decision", "requirement"]


def as_of(at: int | Column | None) -> Column:
    """True for rows valid at a time (from coalesce(valid_at, created_at) up to, not including, invalid_at); without a time for active rows."""
    if at is None:
        return F.col("status") == "active"
    at = F.lit(at) if isinstance(at, int) else at
    return (F.coalesce("valid_at", "created_at") <= at) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > at))


def listed(notes: DataFrame, kind: str | None = None, source_prefix: str | None = None, limit: int = 50, archived: bool = False, at: int | None = None) -> DataFrame:
    """Newest first, ties by uuid; the prefix is a LIKE pattern as it stands, without regard to case. A time drops the filter on status."""
    rows = notes
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    if source_prefix is not None:
        rows = rows.filter(F.ilike(F.col("source_ref"), F.lit(source_prefix + "%")))
    if at is not None or not archived:
        rows = rows.filter(as_of(at))
    return rows.orderBy(F.desc("created_at"), "uuid").limit(min(limit, LIST_CAP))


def path_matches(path: Column, asked: str) -> Column:
    """The path itself, or any path that ends so, as text, without regard to case."""
    return (path == asked) | F.endswith(F.lower(path), F.lit(asked.lower()))


def path_under(path: Column, root: str) -> Column:
    return F.startswith(F.lower(path), F.lit(root.lower()))


def with_ids(rows: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    return rows.join(ids.select(col), col, "left_semi")


def unharvested(commits: DataFrame, notes: DataFrame) -> DataFrame:
    """Commits that no note has as source_ref or as a tag ``git:<sha>``."""
    tagged = notes.select(F.explode("tags").alias("t")).filter(F.startswith("t", F.lit(HARVEST_TAG))).select(F.substring("t", len(HARVEST_TAG) + 1, 1 << 20).alias("sha"))
    return commits.join(tagged.union(notes.filter("source_ref is not null").select("source_ref")).distinct(), "sha", "left_anti")


def links_to(part: str) -> Column:
    return F.exists("linked_files", lambda f: F.contains(f, F.lit(part)))


def cross_cutting() -> Column:
    return F.arrays_overlap("tags", F.array(*[F.lit(t) for t in CROSS_TAGS])) & F.col("kind").isin(CROSS_KINDS)


def without_embedding(notes: DataFrame, embeddings: DataFrame, key: str, after=None, limit: int | None = None) -> DataFrame:
    """Rows without a vector; a page of them if a cursor or a limit is given."""
    rows = notes.join(embeddings.select(key), key, "left_anti")
    rows = rows if after is None else rows.filter(F.col(key) > after)
    return rows if limit is None else rows.orderBy(key).limit(limit)


def embed_queue(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Chunks without a vector or marked for a new one: missing first, then by rank, time and id."""
    missing = embeddings.select("chunk_id", F.lit(True).alias("_has"))
    rows = chunks.join(missing, "chunk_id", "left").filter("_has is null or embed_pending")
    return rows.orderBy(F.col("_has").isNotNull(), F.desc("graph_rank"), F.desc("mtime"), "chunk_id").drop("_has")


def page_after(rows: DataFrame, cursor, limit: int, key: str = "sync_id") -> DataFrame:
    """The next active rows after a cursor."""
    return rows.filter((F.col(key) > cursor) & (F.col("status") != "archived")).orderBy(key).limit(max(PAGE_MIN, min(limit, PAGE_MAX)))


def stride(rows: DataFrame, most: int, order: list[str]) -> DataFrame:
    """Every n-th row so that at most ``most`` stay. Rows are dealt by ranges of the order; a row's place is its place in its part after the rows of the parts before."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    parts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = parts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"), F.greatest(F.lit(1), F.ceil(F.sum("_n").over(Window.partitionBy()) / most)).alias("_step"))
    placed = dealt.withColumn("_part", part).join(starts, "_part").withColumn("_at", F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.filter("_at % _step = 0").select(*rows.columns)


def top_of(rows: DataFrame, per: str, limit: Column, order: list) -> DataFrame:
    """Rows of each section up to its limit."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(per).orderBy(*order))).filter(F.col("_n") <= limit).drop("_n")


def merged_list(first: DataFrame, second: DataFrame, limit: int) -> DataFrame:
    """Two sources as one list, the first's row for an entity in both."""
    both = first.withColumn("_n", F.lit(0)).unionByName(second.withColumn("_n", F.lit(1)))
    best = both.withColumn("_r", F.row_number().over(Window.partitionBy("entity_id").orderBy("_n", "uuid"))).filter("_r = 1")
    return best.drop("_n", "_r").orderBy(F.desc("created_at"), "uuid").limit(limit)


def successors(notes: DataFrame) -> DataFrame:
    """Notes with the title of what supersedes them."""
    return notes.join(notes.select(F.col("uuid").alias("superseded_by"), F.col("title").alias("successor_title")), "superseded_by", "left")


def synced_edges(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """relates_to edges whose ends both have remote ids."""
    ids = notes.filter("remote_id is not null").select("uuid", "remote_id")
    return edges.filter("kind = 'relates_to'").join(ids.select(F.col("uuid").alias("from_id"), F.col("remote_id").alias("from_remote")), "from_id").join(ids.select(F.col("uuid").alias("to_id"), F.col("remote_id").alias("to_remote")), "to_id")


def edges_of(edges: DataFrame, note: str) -> tuple[DataFrame, DataFrame]:
    """(out, in)."""
    return edges.filter(F.col("from_id") == note), edges.filter(F.col("to_id") == note)


def ancestors(path: Column) -> Column:
    """The path and every directory above it."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda p: p != "")


def nearest_root(paths: DataFrame, roots: DataFrame, path_col: str = "path", root_col: str = "root") -> DataFrame:
    """paths with the longest registered root at or above them (null without one): an equi-join on the exploded ancestors."""
    up = paths.select(path_col, F.explode(ancestors(F.col(path_col))).alias(root_col)).join(roots.select(root_col), root_col)
    best = up.groupBy(path_col).agg(F.max_by(root_col, F.length(root_col)).alias(root_col))
    return paths.join(best, path_col, "left")


def prefix_join(files: DataFrame, links: DataFrame, file_col: str = "path", link_col: str = "linked") -> DataFrame:
    """Pairs where the linked path is the file or a directory prefix of it, as text without regard to case.

    Links are compared with the files' prefixes of the links' own lengths only, so the join is on equal strings.
    """
    sizes = links.agg(F.collect_set(F.length(link_col)).alias("sizes"))
    sized = files.withColumn("_sizes", sizes.scalar())
    cutoff = F.filter("_sizes", lambda n: n <= F.length(file_col))
    parts = sized.withColumn("_key", F.explode(F.transform(cutoff, lambda n: F.lower(F.substring(F.col(file_col), F.lit(1), n))))).drop("_sizes")
    return parts.join(links.withColumn("_key", F.lower(link_col)), "_key").drop("_key")


def overlaps(modified: Column, intents: Column) -> Column:
    return F.array_sort(F.array_intersect(modified, intents))


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return (a_start <= b_end) & (b_start <= a_end)


def difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_anti")


# merges


def _union_lists(col: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.col(col), F.expr("cast(array() as array<string>)"))))))


BASE_KEY = ["created_at", "id", "source_ref", "remote_id", "superseded_by"]


def _key(cols: list[str]) -> Column:
    """Order of a record's key, nulls first, as a struct."""
    return F.struct(*[F.struct(F.col(c).isNotNull(), F.col(c)) for c in cols])


def fold_state(records: DataFrame, base_key: list[str] = BASE_KEY) -> DataFrame:
    """Records as one state for each entity_id: what is known of it, with what it takes to put it together with a state of other records."""
    base = [c for c in records.columns if c not in ("entity_id", "status", "schema_version", "valid_at", "invalid_at", "tags", "linked_files", "superseded_by_entity_id")]
    key = _key(base_key)
    latest = F.struct((-F.col("created_at")).alias("c"), key.alias("k"), F.col("superseded_by_entity_id").alias("v"))
    singles = records.select(
        "entity_id", key.alias("key"), F.struct(*base).alias("base"), F.col("status").alias("first_status"), (F.col("status") == "archived").alias("archived"),
        "schema_version", "valid_at", "invalid_at", "tags", "linked_files", F.when(F.col("superseded_by_entity_id").isNotNull(), latest).alias("latest"),
    )
    return merge_states(singles)


def merge_states(states: DataFrame) -> DataFrame:
    """States of the same entities as one each. Commutative, associative and idempotent: states may come in any order, in any grouping and again."""
    first = F.struct("key", "first_status", "base")
    return states.groupBy("entity_id").agg(
        F.min("key").alias("key"),
        F.min_by("base", first).alias("base"),
        F.min_by("first_status", first).alias("first_status"),
        F.bool_or("archived").alias("archived"),
        F.max("schema_version").alias("schema_version"),
        F.min("valid_at").alias("valid_at"),
        F.min("invalid_at").alias("invalid_at"),
        _union_lists("tags").alias("tags"),
        _union_lists("linked_files").alias("linked_files"),
        F.min("latest").alias("latest"),
    )


def folded(states: DataFrame) -> DataFrame:
    """The record that each state stands for."""
    return states.select("entity_id", "base.*", F.when(F.col("archived"), F.lit("archived")).otherwise(F.col("first_status")).alias("status"), "schema_version", "valid_at", "invalid_at", "tags", "linked_files", F.col("latest.v").alias("superseded_by_entity_id"))


def fold(records: DataFrame, base_key: list[str] = BASE_KEY) -> DataFrame:
    """One record for each entity_id of an append-only log: base fields of the earliest, archived for good, times at their least, lists united, the latest successor.

    Independent of order, idempotent and associative, so partial sums on either side of a shuffle agree.
    """
    return folded(fold_state(records, base_key))


def anchors(records: DataFrame, base_key: list[str] = BASE_KEY) -> DataFrame:
    """(entity_id, commit) of the record that fold() takes as base."""
    return records.groupBy("entity_id").agg(F.min_by("commit", _key(base_key)).alias("commit"))


def _first_seen_union(col: str, order: list[str]) -> Column:
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(col).alias("_v")))), lambda x: F.coalesce(x["_v"], F.expr("cast(array() as array<string>)")))))


def dedupe(notes: DataFrame) -> DataFrame:
    """One note for each entity_id: the earliest by (created_at, uuid), lists united in that order, archived if any is, superseded by the first successor outside the group (repointed to its survivor)."""
    survivor = F.min_by("uuid", F.struct("created_at", "uuid")).over(Window.partitionBy("entity_id"))
    marked = notes.withColumn("survivor", survivor)
    to = marked.select(F.col("uuid").alias("superseded_by"), F.col("survivor").alias("successor"))
    resolved = marked.join(to, "superseded_by", "left").withColumn("successor", F.when(F.col("successor") != F.col("survivor"), F.col("successor")))
    return resolved.groupBy("entity_id").agg(
        F.min_by(F.struct("uuid", "kind", "title", "body", "created_at"), F.struct("created_at", "uuid")).alias("n"),
        F.when(F.bool_or(F.col("status") == "archived"), F.lit("archived")).otherwise(F.lit("active")).alias("status"),
        _first_seen_union("tags", ["created_at", "uuid"]).alias("tags"),
        _first_seen_union("linked_files", ["created_at", "uuid"]).alias("linked_files"),
        F.min_by("successor", F.when(F.col("successor").isNotNull(), F.struct("created_at", "uuid"))).alias("superseded_by"),
        F.count("*").alias("copies"),
    ).select("n.*", "entity_id", "status", "tags", "linked_files", "superseded_by", "copies")


def repoint(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges with both ends moved to survivors (id, survivor), without loops; of equal ones the earliest."""
    a = survivors.select(F.col("id").alias("from_id"), F.col("survivor").alias("_f"))
    b = survivors.select(F.col("id").alias("to_id"), F.col("survivor").alias("_t"))
    moved = edges.join(a, "from_id", "left").join(b, "to_id", "left").select(F.coalesce("_f", "from_id").alias("from_id"), F.coalesce("_t", "to_id").alias("to_id"), "kind", "created_at")
    return moved.filter("from_id != to_id").groupBy("from_id", "to_id", "kind").agg(F.min("created_at").alias("created_at"))


def collapse(candidates: DataFrame) -> DataFrame:
    """Candidates of several stores as one for each entity_id: created_at at its least, tags united as first seen."""
    return candidates.groupBy("entity_id").agg(F.min("created_at").alias("created_at"), F.min_by("uuid", F.struct("created_at", "uuid")).alias("uuid"), _first_seen_union("tags", ["created_at", "uuid"]).alias("tags"), F.count("*").alias("n"))


def insert_or_merge(notes: DataFrame, new: DataFrame) -> DataFrame:
    """notes with new entities inserted; of an entity that is there only the lists grow, add-wins in order."""
    fresh = new.groupBy("entity_id").agg(F.min_by(F.struct(*[F.col(c) for c in notes.columns if c != "entity_id"]), F.struct("created_at", "uuid")).alias("n"), _first_seen_union("tags", ["created_at", "uuid"]).alias("_tags"), _first_seen_union("linked_files", ["created_at", "uuid"]).alias("_files"))
    both = notes.withColumn("_old", F.lit(True)).join(fresh, "entity_id", "full_outer")
    none = F.expr("cast(array() as array<string>)")
    picked = {c: F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"n.{c}")) for c in notes.columns if c not in ("entity_id", "tags", "linked_files")}
    lists = {c: F.array_union(F.coalesce(F.col(c), none), F.coalesce(F.col(m), none)) for c, m in (("tags", "_tags"), ("linked_files", "_files"))}
    return both.select(*[(F.col(c) if c == "entity_id" else lists[c] if c in lists else picked[c]).alias(c) for c in notes.columns])


def supersede(notes: DataFrame, edges: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(notes, edges) after pairs (old, new, at): an active old note is archived with its successor, invalid from ``at`` if nothing was set; pairs with a missing note do nothing."""
    there = pairs.join(notes.select(F.col("uuid").alias("old"), F.col("status").alias("_s")), "old").join(notes.select(F.col("uuid").alias("new")), "new").filter("_s = 'active'")
    one = there.groupBy("old").agg(F.min_by(F.struct("new", "at"), F.struct("at", "new")).alias("p"))
    joined = notes.join(one, notes["uuid"] == one["old"], "left")
    changed = {
        "status": F.when(F.col("old").isNotNull(), F.lit("archived")).otherwise(F.col("status")),
        "superseded_by": F.coalesce(F.col("p.new"), F.col("superseded_by")),
        "invalid_at": F.when(F.col("old").isNotNull(), F.coalesce("invalid_at", "p.at")).otherwise(F.col("invalid_at")),
    }
    more = one.select(F.col("p.new").alias("from_id"), F.col("old").alias("to_id"), F.lit("supersedes").alias("kind"), F.col("p.at").alias("created_at"))
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in notes.columns]), add_edges(edges, more)


def add_edges(edges: DataFrame, more: DataFrame) -> DataFrame:
    """Edges with those added whose (from, to, kind) is not there yet."""
    return edges.unionByName(more.groupBy("from_id", "to_id", "kind").agg(F.min("created_at").alias("created_at")).join(edges.select("from_id", "to_id", "kind"), ["from_id", "to_id", "kind"], "left_anti"))


def upsert(table: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """table where rows of new stand for those with their keys."""
    return table.join(new.select(*keys), keys, "left_anti").unionByName(new)


def latest(versions: DataFrame, key: str, version: str) -> DataFrame:
    """The last version of each key."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("v")).select(key, "v.*").select(versions.columns)


def pull(notes: DataFrame, remote: DataFrame) -> DataFrame:
    """notes after remote rows (remote_id, kind, title, body, created_at, archived, entity_id): a known remote_id can only be archived, a known entity takes a missing remote_id, the rest is inserted; nothing is un-archived."""
    by_id = remote.filter("archived").select("remote_id").distinct().withColumn("_gone", F.lit(True))
    fresh = remote.join(notes.filter("remote_id is not null").select("remote_id"), "remote_id", "left_anti").groupBy("entity_id").agg(F.min_by(F.struct("remote_id", "kind", "title", "body", "created_at"), "remote_id").alias("r"), F.bool_or("archived").alias("_archived"))
    old = notes.join(by_id, "remote_id", "left").join(fresh, "entity_id", "left")
    status = F.when(F.col("_gone") | F.col("_archived"), F.lit("archived")).otherwise(F.col("status"))
    kept = old.select(*[{"status": status, "remote_id": F.coalesce(F.col("remote_id"), F.col("r.remote_id"))}.get(c, F.col(c)).alias(c) for c in notes.columns])
    new = fresh.join(notes.select("entity_id"), "entity_id", "left_anti")
    given = {"uuid": F.col("r.remote_id"), "remote_id": F.col("r.remote_id"), "kind": F.col("r.kind"), "title": F.col("r.title"), "body": F.col("r.body"), "created_at": F.col("r.created_at"), "entity_id": F.col("entity_id"), "status": F.when(F.col("_archived"), F.lit("archived")).otherwise(F.lit("active"))}
    return kept.unionByName(new.select(*[given.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in notes.schema.fields]))


def repair(notes: DataFrame, embeddings: DataFrame, made: DataFrame) -> DataFrame:
    """embeddings with those of ``made`` (uuid, embedding) whose note is still active and still without one."""
    wanted = made.join(notes.filter("status = 'active'").select("uuid"), "uuid", "left_semi").join(embeddings.select("uuid"), "uuid", "left_anti")
    return embeddings.unionByName(wanted.dropDuplicates(["uuid"]))


def split_batch(batch: DataFrame, known: DataFrame, embeddings: DataFrame, key: str = "external_id") -> tuple[DataFrame, DataFrame]:
    """(new rows, known rows with has_embedding) of a pushed batch."""
    there = known.select(key, "uuid").join(embeddings.select("uuid").withColumn("has_embedding", F.lit(True)), "uuid", "left")
    return batch.join(known.select(key), key, "left_anti"), batch.join(there, key).withColumn("has_embedding", F.coalesce("has_embedding", F.lit(False)))
