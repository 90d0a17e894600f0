"""Re-ranking, packing, PageRank, feeds and scanned code against plain versions."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import code, graph, packing, rag, vectors
from corpusmill.sources import readers
from corpusmill.streaming import feeds


def walk(edges, start, rounds=20, damping=0.85):
    """Personalised PageRank by a dense matrix."""
    names = sorted({x for e in edges for x in e} | set(start))
    at = {x: i for i, x in enumerate(names)}
    links = np.zeros((len(names), len(names)))
    for a, b in edges:
        if a != b:
            links[at[b], at[a]] += 1
    out = links.sum(0)
    p = np.array([start.get(x, 0.0) for x in names])
    p /= p.sum()
    r = p.copy()
    for _ in range(rounds):
        r = (1 - damping) * p + damping * (links @ np.where(out > 0, r / np.where(out > 0, out, 1), 0) + r[out == 0].sum() * p)
    return dict(zip(names, r, strict=True))


def test_personalised_pagerank_by_matrix():
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(20)}", f"n{rng.randrange(25)}") for _ in range(60)]
    got = graph.personalised_pagerank(edges, {"n1": 0.5, "n2": 2.0, "x": 1.0})
    want = walk(edges, {"n1": 0.5, "n2": 2.0, "x": 1.0})
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert graph.personalised_pagerank([], {"a": 3.0}) == {"a": 3.0}


def test_linear_rag(spark):
    rng = random.Random(2)
    pool = {c: round(rng.uniform(0.2, 1.4), 4) for c in range(0, 80)}
    symbols = [(rng.randrange(700), f"s{rng.randrange(40):02d}", rng.choice(["calls", "mentions"])) for _ in range(4000)]
    symbols = sorted(set(symbols))
    low, high = min(pool.values()), max(pool.values())
    sim = {c: 1 - (d - low) / max(high - low, 1e-6) for c, d in pool.items()}
    active = collections.defaultdict(float)
    for c, s, _ in symbols:
        if sim.get(c, 0) > rag.ACTIVE:
            active[s] = max(active[s], sim[c])
    top = sorted(active, key=lambda s: (-active[s], s))[: rag.TOP_SYMBOLS]
    links = [(c, s) for c, s, _ in symbols if c in pool and s in active]
    more = []
    for s in sorted(top):
        mine = sorted(c for c, t, _ in symbols if t == s)
        allowed = set(sorted(set(mine))[: rag.PER_SYMBOL])
        more += [(c, s) for c in mine if c in allowed]
    links += more[: rag.MAX_EXPANDED]
    pairs = [(f"c{c}", s) for c, s in links]
    ranks = walk(pairs + [(b, a) for a, b in pairs], {f"c{c}": v for c, v in sim.items()} | dict(active))
    ppr = {int(k[1:]): v for k, v in ranks.items() if k[0] == "c"}
    best = max(ppr.values())
    want = sorted(((0.5 * sim.get(c, 0) + 0.5 * v / best, c) for c, v in ppr.items()), key=lambda x: (-x[0], x[1]))[:30]
    got = rag.linear_rag(spark.createDataFrame(list(pool.items()), "chunk_id long, distance double"), spark.createDataFrame(symbols, "chunk_id long, symbol string, kind string"), spark.range(700).select(F.col("id").alias("chunk_id")), 30, ["chunk_id"]).collect()
    assert [r.chunk_id for r in got] == [c for _, c in want]
    assert all(abs(r.score - s) < 1e-9 for r, (s, _) in zip(got, want, strict=True))


def test_mmr(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 17):
        v = np.round(rng.normal(size=(n, 5)), 3)
        v[-1] = v[0]
        centre = v.mean(0)
        cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
        order, left = [], list(range(n))
        while left:
            scores = [0.5 * cos(v[i], centre) - 0.5 * max([0.0, *(cos(v[i], v[j]) for j in order)]) for i in left]
            order.append(left.pop(int(np.argmax(np.round(scores, 12)))))
        rows = spark.createDataFrame([("g", i, x.tolist()) for i, x in enumerate(v)], "g string, id long, v array<double>")
        assert [r.id for r in rag.mmr(rows, "g", "id", "v").orderBy("place").collect()] == order


def test_pagerank_both_ways(spark):
    rng = random.Random(1)
    edges = spark.createDataFrame([(f"a{rng.randrange(30)}", f"a{rng.randrange(40)}") for _ in range(300)] + [("loop", "loop")], "src string, dst string")
    small = dict(graph.pagerank(edges).collect())
    large = dict(graph.pagerank(edges, small_links=0).collect())
    assert small.keys() == large.keys() and all(abs(small[k] - large[k]) < 1e-12 for k in small) and abs(sum(small.values()) - 1) < 1e-9
    assert graph.pagerank(edges.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(5)
    rows = [(g, i, rng.choice([1, 2, 3, 7, 40, 90, 200])) for g in "ab" for i in range(800)]
    frame = spark.createDataFrame(rows, "g string, i long, tokens long")
    for stop, per in ((10, ["g"]), (0, ["g"]), (10, None)):
        want = []
        for group in [[r for r in rows if r[0] == g] for g in "ab"] if per else [sorted(rows, key=lambda r: (r[1], r[0]))]:
            left = 500
            for r in group:
                if left >= stop and r[2] <= left:
                    left -= r[2]
                    want.append((*r, left))
        got = packing.pack(frame, 500, ["i", "g"], stop_below=stop, per=per).collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_conflicts_need_a_block(spark):
    with pytest.raises(TypeError):
        vectors.conflicts(spark.range(1), spark.range(1), "id", 1.0)


def test_ignore_files(spark, tmp_path):
    for name, text in {".gitignore": "*.py\n!keep.py\nout/\n", "a/.gitignore": "!b.py\n/c.py\n# no\n\n", "x.py": "1", "keep.py": "1", "a/b.py": "1", "a/c.py": "1", "a/d/c.py": "1", "out/e.md": "1", "a/out/f.md": "1", "g.md": "1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = {r.path for r in readers.read_tree(spark, str(tmp_path), ignore_files=(".gitignore", ".ignore")).collect()}
    assert found == {"keep.py", "a/b.py", "g.md"}
    assert {"x.py", "a/c.py"} <= {r.path for r in readers.read_tree(spark, str(tmp_path)).collect()}


def test_code_of_other_languages():
    assert code.scan("", "java").definitions == [] and code.scan("}}{{ fn", "rust").calls == []
    assert [(d.kind, d.name) for d in code.definitions("impl<T: A> Shop<T> { fn a(&self) {} }\nfn b() {}", "rust")] == [("impl", "Shop"), ("method", "a"), ("function", "b")]
    assert code.scan("use a::{b, c};", "rust").imports == [(None, "a::{b, c}", 1)]  # the whole text, as the rule says
    assert code.scan("x = 'call(1)' + `t(2)`; go(3);", "typescript").calls == [(None, "go", 1)]
    assert len(code.scan("f(" * 20_000, "go").calls) == 20_000


NOTE = "uuid string, created_at long, status string, remote_id string, entity_id string, kind string, title string, body string"


def test_note_feed_sends_each_row_once(spark, tmp_path):
    schema = spark.createDataFrame([], NOTE).schema
    write = lambda n, rows: spark.createDataFrame(rows, NOTE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    row = lambda i, status="active": (f"u{i}", 7, status, None, f"e{i}", "note", "t", "b")
    seen = []

    def drain():
        feed = feeds.note_feed(spark, str(tmp_path / "in"), schema)
        feed.writeStream.foreachBatch(lambda b, _: seen.extend(r.uuid for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    write(1, [row(1), row(2, "archived"), row(3)])
    drain()
    write(2, [row(4), row(5)])  # of the same second as those before
    drain()
    drain()
    assert sorted(seen) == ["u1", "u3", "u4", "u5"]


def test_pulls_applied_twice(spark, tmp_path):
    remote = "remote_id string, kind string, title string, body string, created_at long, archived boolean, entity_id string"
    spark.createDataFrame([("r1", "note", "t", "b", 1, True, "e1"), ("r2", "note", "t2", "b", 2, False, "e2"), ("r3", "note", "t3", "b", 3, False, "e3")], remote).write.parquet(str(tmp_path / "in"))
    held = [("u1", 1, "active", "r1", "e1", "note", "t", "b"), ("u2", 2, "active", None, "e2", "note", "t2", "b")]
    state = {"rows": held}

    def store(frame):
        state["rows"] = [tuple(r) for r in frame.collect()]

    for run in ("a", "b"):  # another checkpoint: all is sent again
        stream = spark.readStream.schema(remote).parquet(str(tmp_path / "in"))
        feeds.apply_pulls(stream, lambda: spark.createDataFrame(state["rows"], NOTE), store, str(tmp_path / run)).awaitTermination()
        got = {(r[0], r[2], r[3], r[4]) for r in state["rows"]}
        assert got == {("u1", "archived", "r1", "e1"), ("u2", "active", "r2", "e2"), ("r3", "active", "r3", "e3")}


def test_repair_ends_though_some_fail(spark):
    notes = spark.createDataFrame([(f"u{i:03d}", 1, "active" if i % 10 else "archived", None, "e", "note", "t", "b") for i in range(75)], NOTE)
    state = {"rows": [("u001",)]}
    embeddings = lambda: spark.createDataFrame(state["rows"], "uuid string")
    pages = feeds.repair_backlog(notes, embeddings, lambda rows: rows.filter("uuid not like '%7'").select("uuid"), lambda df: state.update(rows=[tuple(r) for r in df.collect()]), page=32)
    assert pages == 3
    assert {r[0] for r in state["rows"]} == {f"u{i:03d}" for i in range(75) if i % 10 and i % 10 != 7}
    assert feeds.repair_backlog(notes, embeddings, lambda rows: rows.select("uuid").limit(0), lambda df: None, page=32) == 1


@pytest.mark.parametrize(("per", "tail", "ceiling", "last", "want"), [(1.0, [100, 100, 100], 10, 10, 2), (0.0, [1] * 50, 32, 2, 16), (1000.0, [500], 10, 1, 1), (0.1, [], 10, 1, 1), (0.1, [5] * 100, 8, 100, 8)])
def test_next_batch(per, tail, ceiling, last, want):
    assert feeds.next_batch(per, tail, ceiling, last) == want
