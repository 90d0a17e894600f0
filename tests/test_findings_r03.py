"""Findings of larger runs: growth of the steps, and results that stay the same."""

import re
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions import scan
from corpusmill.operators import chunks as C
from corpusmill.operators import graph
from corpusmill.operators import text_search as B
from corpusmill.operators import vectors as V
from corpusmill.plans.queries import QUERIES
from corpusmill.sources import readers


def test_symbols_are_counted_by_classes_of_chunks(spark):
    """A thousand chunks of one source and a thousand lines that use one symbol are no million rows on the way."""
    chunks = spark.createDataFrame([(1, "a", "f"), (1, "b", "f"), (2, "a", "f"), (2, "a", "f"), (3, "b", "g"), (None, "a", "f"), (4, None, "f")], "chunk_id long, name string, path string")
    edges = spark.createDataFrame([("f", "a", "x", "calls"), ("f", "a", "x", "calls"), ("f", "b", "x", "calls"), ("f", "b", "y", "mentions"), ("g", "b", "z", "imports"), ("f", None, "q", "calls")], "source_file string, source_name string, target_name string, kind string")
    want = [tuple(r) for r in graph.chunk_symbols(chunks, edges).groupBy("symbol", "kind").agg(F.countDistinct("chunk_id")).orderBy("symbol").collect()]
    assert sorted(tuple(r) for r in graph.symbol_chunks(chunks, edges).collect()) == want == [("x", "calls", 2), ("y", "mentions", 1)]
    many = spark.range(1000).select(F.col("id").alias("chunk_id"), F.lit("a").alias("name"), F.lit("f").alias("path"))
    lines = spark.range(1000).select(F.lit("f").alias("source_file"), F.lit("a").alias("source_name"), F.lit("x").alias("target_name"), F.lit("calls").alias("kind"))
    assert [tuple(r) for r in graph.symbol_chunks(many, lines).collect()] == [("x", "calls", 1000)]


def test_ignore_rules_meet_the_files_they_may_fit(spark):
    """Rules that name a component or an extension are joined by it, and give what a regex for each rule and file gives."""
    lines = ["a", "/b", "*.py", "!keep.py", "x/**/y", "**/n=3/**", "!**/n=5/**", "n=?/", "foo**/x", "***/z.md", "[ab].txt", "*.tar.gz", "d/", "q/*.c", "!/b/a", "#a", "  ", "**", "!**/*.h", "q\\r"]
    found = ["a", "b", "c/b", "a/b/c", "keep.py", "s/keep.py", "s/other.py", "x/y", "x/1/2/y/z", "x/foo", "k/n=3/f", "n=3", "k/n=5/f", "n=5/f", "foo/x", "foox", "foo/bar/x", "p/z.md", "z.md", "a.txt", "s/b.txt", "t.tar.gz", "d", "d/e", "q/m.c", "q/r/m.c", "b/a", "b/c", "w.h", "s/w.h", ".py", "py", "q\\r"]
    files = spark.createDataFrame([(f,) for f in found], "path string")
    for chosen in (lines[:17], [lines[17], lines[18]], lines[2:6], *([line] for line in lines)):
        for folder in ("", "s", "q", "x/1"):
            rules = [(folder, line, i) for i, line in enumerate(chosen)]
            ignored = set()
            for f in found:
                if folder and not f.startswith(folder + "/"):
                    continue
                fits = [line for line in chosen if line.strip() and not line.startswith("#") and re.search(scan.glob_regex(line.strip().removeprefix("!")), f[len(folder) + 1 if folder else 0 :])]
                if fits and not fits[-1].startswith("!"):
                    ignored.add(f)
            for f in found:
                key = readers._rule_key(chosen[-1].strip()) if len(chosen) == 1 and chosen[0].strip() and f in ignored else None
                names = f.split("/")
                assert key is None or key in {"=" + n for n in names} | {"." + n.rsplit(".", 1)[1] for n in names if "." in n}
            if len(chosen) > 1:
                got = readers.without_ignored(files, spark.createDataFrame(rules, "dir string, line string, at long"))
                assert {r.path for r in got.collect()} == set(found) - ignored
    assert readers._rule_key("!**/page_id=7/**") == "=page_id=7" and readers._rule_key("*.min.js") is None and readers._rule_key("foo**/x") is None


def test_more_queries_than_a_request_has(spark, monkeypatch):
    """A table of queries of any size, in blocks, gives what all pairs give; ties by id, other lengths and nulls left out."""
    monkeypatch.setattr(V, "MAX_QUERIES", 5)
    monkeypatch.setattr(V, "QUERY_BLOCK", 16)
    monkeypatch.setattr(V, "ROW_BLOCK", 32)
    rng = np.random.default_rng(5)
    rows = [(i, v) for i, v in enumerate(np.round(rng.normal(size=(200, 3)), 1).tolist())] + [(900, [1.0]), (901, None), (902, [float("nan"), 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    sound = rows[:200]
    ask = df.filter("id < 60")
    near = {(r.query_id, r["rank"]): r.id for r in V.knn_table(df, ask.withColumnRenamed("id", "query_id"), 4, "id").collect()}
    products = {(r.query, r["rank"]): r.id for r in V.largest_products(df, ask.withColumnRenamed("id", "query"), 4, "id").collect()}
    want_near, want_products = {}, {}
    for i, q in sound[:60]:
        for n, (_, j) in enumerate(sorted((reduce(add, ((a - b) * (a - b) for a, b in zip(q, v, strict=True))), j) for j, v in sound)[:4], 1):
            want_near[i, n] = j
        for n, (_, j) in enumerate(sorted((-reduce(add, (a * b for a, b in zip(q, v, strict=True))), j) for j, v in sound if j != i)[:4], 1):
            want_products[i, n] = j
    assert near == want_near and products == want_products


def test_postings_are_listed_where_documents_are_read(spark, monkeypatch):
    """Slices of few tokens, two fields, rows that share an id or have none: as a plain count has it, and no token is shuffled."""
    monkeypatch.setattr(B, "SLICE_TOKENS", 4)
    rows = [(1, "b a b É", None), (2, "", "x"), (3, None, None), (4, "z z z z z z z", "a z"), (5, "a b", "b"), (5, "b a c", None), (None, "q", ""), (None, "q r", ""), (6, "\U0001d400 Ａ b", "b")]
    df = spark.createDataFrame(rows, "id long, t string, u string")
    want = {}
    for i, *texts in rows:
        for field, text in zip("tu", texts, strict=True):
            for at, w in enumerate(B.query_tokens(text or "")):
                want.setdefault((i, field, w), []).append(at)
    got = B.postings(df, "id", ["t", "u"]).collect()
    assert {(r.id, r.field, r.term): r.positions for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want) and all(r.tf == len(r.positions) for r in got)
    for r in B.term_lists(df, "id", ["t", "u"]).collect():
        names = [t.term.encode() for t in r.terms]
        assert names == sorted(names)


def test_chunks_are_sent_in_small_frames(spark, monkeypatch):
    """A worker holds a bounded number of characters, of texts and of chunks, and no chunk is lost between frames."""
    seen, held = [], []
    monkeypatch.setattr(C, "HELD_CHARS", 100)

    class Docs:
        schema = spark.createDataFrame([], "id long, text string").schema
        sparkSession = spark

        def mapInPandas(self, run, schema):
            texts = [None, "", "a\nb", *("\n".join(f"line {i} {j}" for j in range(40)) for i in range(30))]
            frame = pd.DataFrame({"id": range(len(texts)), "text": texts})
            seen.extend(run(iter([frame])))
            held.append(texts)

    C.chunk(Docs(), tokens=8)
    assert max(f["content"].str.len().sum() for f in seen if len(f)) <= 200 and len(seen) > 2 * 30
    want = [(i, c[2], c[4]) for i, t in enumerate(held[0]) if t for c in C.plain_chunks(t, 8)]
    assert [(r.id, r.start_line, r.content) for f in seen for r in f.itertuples()] == want
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_mentions_read_a_text_once(spark):
    """The filter on the list of words does not read the words a second time."""
    plan = QUERIES["a11_mentions"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
