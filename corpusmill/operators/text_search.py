"""Full-text search: tokens, postings and BM25 of terms and phrases."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K1, B, LEAST_IDF, MAX_CODE, MAX_NOTES, MAX_TIMELINE = 1.2, 0.75, 1e-6, 1000, 1000, 200
#: Tokens whose places are sorted at once.
SLICE_TOKENS = 1 << 20
ACCENTED = "".join(c for c in map(chr, range(0xC0, 0x180)) if len(unicodedata.normalize("NFD", c)) > 1 and c.islower())
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased, Latin accents folded."""
    return F.regexp_extract_all(F.translate(F.lower(F.coalesce(text, F.lit(""))), ACCENTED, PLAIN), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(text: str) -> list[str]:
    """tokens() of a query, on the driver; NUL is dropped and nothing has a meaning of its own."""
    return re.findall(r"[^\W_]+", text.replace("\0", "").lower().translate(str.maketrans(ACCENTED, PLAIN)))


def _term_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, field, terms) to (id, field, list of (term, tf, positions)), terms in the order of their bytes."""
    for whole in batches:
        sizes = np.cumsum(pc.fill_null(pc.list_value_length(whole.column(2)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < whole.num_rows:
            # slices of a bounded number of tokens, one document at least
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_TOKENS, "right")))
            batch, start = whole.slice(start, end - start), end
            words = batch.column(2)
            n = words.value_lengths().to_numpy()
            coded = words.flatten().dictionary_encode()
            # places of the dictionary's words in the order of bytes, which is that of code points
            order = pc.sort_indices(coded.dictionary.cast(pa.binary())).to_numpy()
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            doc = np.repeat(np.arange(len(n)), n)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            word = rank[coded.indices.to_numpy()] if len(doc) else doc
            by = np.lexsort((word, doc))  # stable, so that places ascend
            doc, word, at = doc[by], word[by], at[by].astype(np.int32)
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])]) if len(doc) else doc
            tf = np.diff(np.r_[first, len(doc)])
            rows = pa.StructArray.from_arrays([
                coded.dictionary.take(pa.array(order[word[first]])), pa.array(tf), pa.ListArray.from_arrays(pa.array(np.r_[first, len(doc)].astype(np.int32)), pa.array(at)),
            ], ["term", "tf", "positions"])
            ends = np.r_[0, np.cumsum(np.bincount(doc[first], minlength=len(n)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), rows)], ["id", "field", "terms"])


def term_lists(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, terms) of all fields with a token: a list of (term, tf, positions), in the order of the terms' bytes. Rows that share an id, null too, are one document, of which the lists are merged.

    A document's terms are listed where it is read; only rows whose id is not theirs alone are shuffled, and ids to find these.
    """
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), tokens(F.col(f)).alias("words")) for f in fields]))
    kind = docs.schema[id_col].dataType.simpleString()
    terms = "array<struct<term:string,tf:bigint,positions:array<int>>>"
    shared = docs.groupBy(F.col(id_col).alias("_id")).count().filter("count > 1").select("_id")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    alone = docs.join(shared, same, "left_anti").select(F.col(id_col).alias("id"), each.alias("e")).select("id", "e.field", "e.words").filter("size(words) > 0")
    listed = alone.mapInArrow(_term_lists, f"id {kind}, field string, terms {terms}")
    rows = docs.join(shared, same, "left_semi").select(F.col(id_col).alias("id"), each.alias("e")).select("id", "e.field", F.posexplode("e.words").alias("at", "term"))
    grouped = rows.groupBy("id", "field", "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("at")).alias("positions"))
    in_order = F.array_sort(F.collect_list(F.struct(F.encode("term", "utf-8").alias("b"), F.struct("term", "tf", "positions").alias("t"))))
    merged = grouped.groupBy("id", "field").agg(F.transform(in_order, lambda x: x["t"]).alias("terms"))
    return listed.union(merged).withColumnRenamed("id", id_col)


def postings(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, field, term, tf, positions) of all fields; see term_lists()."""
    return term_lists(docs, id_col, fields).select(id_col, "field", F.inline("terms"))


def _occurrences(field: str, words: list[str]) -> str:
    hit = " and ".join(f"get({field}, i + {j}) = '{w}'" for j, w in enumerate(words))
    if len(words) == 1:
        return f"size(filter({field}, w -> w = '{words[0]}'))"
    return f"case when size({field}) < {len(words)} then 0 else size(filter(sequence(0, size({field}) - {len(words)}), i -> {hit})) end"


def bm25(docs: DataFrame, phrases: list[list[str]], fields: list[str]) -> DataFrame:
    """docs that hold a phrase (a list of tokens) in some field, with ``score``: Okapi BM25 over all fields together.

    One pass counts each phrase in each document; the corpus' totals are one row, which comes back as a scalar subquery.
    """
    phrases = [p for p in phrases if p]
    if not phrases:
        return docs.limit(0).withColumn("score", F.lit(0.0))
    # the tokens are bound to a lambda's variable: a filter that is pushed below a plain column of them would tokenise once for each token
    bound = F.array(F.struct(*[tokens(F.col(f)).alias(f"t{i}") for i, f in enumerate(fields)]))
    names = [f"d.t{i}" for i in range(len(fields))]
    counts = ", ".join(f"{' + '.join(_occurrences(n, p) for n in names)} as _f{i}" for i, p in enumerate(phrases))
    length = " + ".join(f"size({n})" for n in names)
    counted = docs.select(F.struct("*").alias("row"), bound.alias("_bound")).select("row", F.expr(f"transform(_bound, d -> struct({length} as _len, {counts}))[0]").alias("_c")).select("row", "_c.*")
    totals = counted.agg(F.struct(F.count("*").alias("n"), F.avg("_len").alias("len"), F.array(*[F.count_if(F.col(f"_f{i}") > 0) for i in range(len(phrases))]).alias("df")).alias("t"))
    found = counted.filter(" or ".join(f"_f{i} > 0" for i in range(len(phrases)))).withColumn("t", totals.select("t").scalar())
    score = F.lit(0.0)
    for i in range(len(phrases)):
        df = F.get("t.df", F.lit(i))
        idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("t.n") - df + 0.5) / (df + 0.5)))
        f = F.col(f"_f{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("_len") / F.col("t.len")))
    return found.withColumn("score", score).select("row.*", "score")


def lengths(docs: DataFrame, id_col: str, fields: list[str]) -> DataFrame:
    """(id, length): tokens of all fields of every document, the other half of an index beside postings()."""
    return docs.select(id_col, sum((F.size(tokens(F.col(f))) for f in fields[1:]), F.size(tokens(F.col(fields[0])))).alias("length"))


def bm25_indexed(index: DataFrame, sizes: DataFrame, phrases: list[list[str]], id_col: str) -> DataFrame:
    """(id, score) as bm25() has it, from postings() and lengths() kept as tables: only the postings of the phrases' words are read, and no text."""
    phrases = [p for p in phrases if p]
    if not phrases:
        return sizes.limit(0).select(id_col, F.lit(0.0).alias("score"))
    words = sorted({w for p in phrases for w in p})
    mine = index.filter(F.col("term").isin(words)).groupBy(id_col, "field").agg(F.map_from_entries(F.collect_list(F.struct("term", "positions"))).alias("at"))
    place = lambda w: f"coalesce(try_element_at(at, '{w}'), cast(array() as array<int>))"
    counts = [F.expr(f"size(filter({place(p[0])}, i -> {' and '.join(['true', *(f'array_contains({place(w)}, i + {j})' for j, w in enumerate(p) if j)])}))") for p in phrases]
    each = mine.select(id_col, *[c.cast("long").alias(f"_f{i}") for i, c in enumerate(counts)]).groupBy(id_col).agg(*[F.sum(f"_f{i}").alias(f"_f{i}") for i in range(len(counts))])
    each = each.filter(" or ".join(f"_f{i} > 0" for i in range(len(counts))))
    dfs = each.agg(F.struct(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"d{i}") for i in range(len(counts))])).scalar()
    totals = sizes.agg(F.struct(F.count("*").alias("n"), F.avg("length").alias("len"))).scalar()
    rows = each.join(sizes, id_col).withColumn("_d", dfs).withColumn("_t", totals)
    score = F.lit(0.0)
    for i in range(len(counts)):
        df, f = F.col(f"_d.d{i}"), F.col(f"_f{i}")
        idf = F.greatest(F.lit(LEAST_IDF), F.ln((F.col("_t.n") - df + 0.5) / (df + 0.5)))
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("_t.len")))
    return rows.select(id_col, score.alias("score"))


def _indexed(index, docs: DataFrame, phrases: list[list[str]], limit: int, where: Column | None = None) -> DataFrame:
    """docs with score, as bm25() has it, of those that may be among the best by a kept index (``search_index.SearchIndex``)."""
    rows = docs if where is None else docs.filter(where)
    return rows.join(index.search(phrases, limit, None if where is None else rows), index.id_col)


def search_terms(docs: DataFrame, query: str, fields: list[str], limit: int, order: list[str], index=None) -> DataFrame:
    """Any of the query's terms; a term with punctuation is a phrase of its tokens. With an index over these documents and fields no text is read."""
    phrases, limit = [query_tokens(t) for t in query.split()], min(limit, MAX_CODE)
    found = bm25(docs, phrases, fields) if index is None else _indexed(index, docs, phrases, limit)
    return found.orderBy(F.desc("score"), *order).limit(limit)


def search_phrase(docs: DataFrame, query: str, fields: list[str], limit: int, order: list[str], where: Column | None = None, index=None) -> DataFrame:
    """The whole query as one phrase."""
    limit = min(limit, MAX_NOTES)
    if index is None:
        found = bm25(docs, [query_tokens(query)], fields)
        found = found if where is None else found.filter(where)
    else:
        found = _indexed(index, docs, [query_tokens(query)], limit, where)
    return found.orderBy(F.desc("score"), *order).limit(limit)


def timeline(docs: DataFrame, query: str, fields: list[str], limit: int, time: Column, order: list[str], index=None) -> DataFrame:
    """The best by BM25 whatever their status, then in the order of time."""
    return search_phrase(docs, query, fields, min(limit, MAX_TIMELINE), order, index=index).orderBy(time, *order)


def ranked(hits: DataFrame, order: list, name: str = "rank") -> DataFrame:
    """Ranks of a result list from 1; the list is a limited one, so one task ranks it."""
    return hits.withColumn(name, F.row_number().over(Window.orderBy(*order)))
