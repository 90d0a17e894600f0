"""The ten operators against brute force on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from corpusmill.llm import bpe, coder, html, langid, mixing, neighbours, quality, queries, simhash, substrings, tokenfiles, urls
from corpusmill.llm.components import connected_components

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PASSAGE = " ".join(f"w{i}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, None, None, None, 0), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, PASSAGE, "en", "b", 1), (5, "x y " + PASSAGE + "\u00e9nd 日本 😀", "fr", "b", 1), (6, PASSAGE, "en", None, 1), (6, PASSAGE, "en", None, 1)]
    rows += [(7, "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they " * 40, "en", "c", 1), (8, "word " * 30_000, "de", "c", 1), (None, "no id here", "en", "a", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(1)).withColumn("block", F.lit("x")).withColumn("_block", F.lit("y"))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def test_mixing(spark, docs, empty):
    sized = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    planned = mixing.plan_copies(sized, "doc_id", "source", "size", bucket_rows=2)
    rows = planned.select("row.*", "mix.*").collect()
    assert rows == mixing.plan_copies(sized, "doc_id", "source", "size", bucket_rows=2).select("row.*", "mix.*").collect()
    assert len(rows) == docs.count() and all(0 <= r.copies <= 2 for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r.source] += r.size
    total, weights = sum(sizes.values()), dict(zip(sorted(sizes, key=lambda s: (s is None, s)), [3, 1, 2, 3], strict=False))
    target, capped = {}, set()
    while True:
        left = 1.5 * total - sum(2 * sizes[s] for s in capped)
        free = sum(w for s, w in weights.items() if s not in capped)
        target = {s: 2 * sizes[s] if s in capped else left * w / free for s, w in weights.items()}
        over = {s for s in weights if target[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert all(abs(r.target - target[r.source]) < 1e-6 for r in rows)
    assert mixing.mix(empty).count() == 0
    emitted = mixing.mix(docs)
    assert emitted.columns == docs.columns and emitted.count() == sum(r.copies for r in mixing.plan_copies(sized, "doc_id", "source", "size").select("mix.*").collect())


def test_main_text(spark):
    page = '<body><nav><a href=/>Home</a></nav><div class="cookie-notice">We use cookies</div><main><h1>A&amp;B</h1><p>One  \n two<p>Three &#233; &copy; x</main><section id="comments"><p>Nice one</p></section><script>var p="<p>no</p>"</script><footer>c</footer>'
    rows = spark.createDataFrame([(1, "u", page, "k"), (2, None, None, "k"), (3, "u", "", "k"), (4, "u", "<p>just text", "k"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 3000, "k"), (1, "u", page, "k")], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text, r.n_chars) for r in html.main_texts(rows).orderBy("page_id").collect()]
    want = "A&B\nOne two\nThree é © x"
    assert got[:2] == [(1, want, len(want))] * 2 and got[2:5] == [(2, "", 0), (3, "", 0), (4, "just text", 9)]
    assert html.main_texts(rows.limit(0)).count() == 0
    features, model = html.trained()
    right = 0
    for text in (held := list(html.training_pages(60, seed=77))):
        page = html.parse(text)
        marked = np.zeros(len(page.tags), bool)
        marked[page.marked] = True
        right += html.main_text(page, marked) == next(html.extract([text], features, model))
    assert right / len(held) > 0.9
    child_only = html.decode([-1, 0, 1], np.array([5.0, -9.0, 1.0]))
    assert child_only.tolist() == [True, False, False]


def test_url_filter(spark):
    rows = [("http://A.Example.com/en/x?y", "block", "example.com/en/"), ("https://www.example.com/en/", "allow", "www.example.com/en/"), ("http://m.www.example.com/en/1#z", "allow", "www.example.com/en/"), ("x://z.net/es/1", "block", "net/es/"), ("x://com/", "allow", "com/"), ("x://com", None, None), ("http://badexample.com/en/", "allow", "com/"), (None, "allow", None), ("nothing", "allow", None), ("http://spam-farm.example.org/en/1", "block", None), ("http://thther.example.org/en/1", "allow", None), ("http://h.org/" + "a" * 50_000, None, None)]
    model = urls.train(urls.labelled_urls(spark))
    got = urls.judge_urls(spark.createDataFrame([(r[0], 1) for r in rows], "url string, host int"), model, urls.RULES).collect()
    for r, (url, verdict, rule) in zip(got, rows, strict=True):
        assert r.judged.rule == rule and (verdict is None or r.judged.verdict == verdict), url
    assert got[0].judged.host == "a.example.com" and got[0].judged.path == "/en/x" and got[7].judged.host == ""
    lab = urls.judge_urls(urls.labelled_urls(spark), model, []).selectExpr("avg(cast(blocked = cast(judged.verdict = 'block' as int) as int))").first()[0]
    assert lab > 0.97
    assert urls.judge_urls(spark.createDataFrame([], "url string"), model, urls.RULES).count() == 0


def test_substrings(spark, docs, empty):
    got = substrings.remove_repeats(docs, block_bytes=1000, range_words=10).collect()
    counts = collections.Counter()
    for r in docs.collect():
        w = words(r.text)
        counts.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    want = []
    for r in docs.collect():
        w = words(r.text)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if counts[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((str(r.doc_id), len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, " ".join(words(r.text))) for r in got) == sorted(want)
    plain = collections.defaultdict(list)
    for r in docs.collect():
        plain[str(r.doc_id)].append(r.text or "")
    assert all(r.text in plain[str(r.doc_id)] for r in got if not r.n_removed)
    assert all(sum(s["last"] - s["first"] + 1 for s in r.spans) == r.n_removed for r in got)
    assert substrings.remove_repeats(empty).count() == 0


def test_packed_hashes():
    h = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64) * np.uint64(2))
    twice = np.arange(len(h)) % 3 == 0
    a, b = substrings._unpack(substrings._pack(h, twice))
    assert (a == h).all() and (b == twice).all()


def test_token_files(spark, docs, empty, tmp_path):
    tokenfiles.write_ids(docs, str(tmp_path / "t"), image_ids=50)
    got = tokenfiles.read_ids(spark, str(tmp_path / "t")).orderBy("start").collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at = 0
    for r, d in zip(got, sorted(docs.collect(), key=lambda d: (d.doc_id is not None, d.doc_id or 0, d.text or "")), strict=True):
        ids = [*t.encode(d.text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (d.doc_id, at, len(ids), ids, zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokenfiles.write_ids(empty, str(tmp_path / "e"))
    assert tokenfiles.read_ids(spark, str(tmp_path / "e")).count() == 0


def test_coder():
    rng = np.random.default_rng(0)
    for n, k in ((0, 1), (1, 1), (5, 3), (2048, 5), (5000, 100), (20_000, 40_000)):
        x = rng.integers(0, k, n).astype(np.uint32) + 7
        assert (coder.unpack(coder.pack(x)) == x).all()
    image = bytearray(coder.pack(np.arange(4000, dtype=np.uint32) % 50))
    image[-300] ^= 64
    with pytest.raises(ValueError):
        coder.unpack(bytes(image))
    with pytest.raises(ValueError):
        coder.unpack(b"none")


def test_bpe(spark, docs, empty):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    c = bpe.codec(bpe.RANKS)
    rng = np.random.default_rng(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\u00a0", "é", "日本", "'s", "!", "12", "the", "ing", " \n", "😀", "\x1c", "\x85", "zq"]
    for _ in range(1500):
        s = "".join(rng.choice(parts, rng.integers(0, 30)))
        ids = c.encode(s)
        assert ids.tolist() == plain.encode_ordinary(s) and c.decode(ids) == s.encode()
    for s in ("ab" * 3000, " " * 3000, "x" * 3001):
        assert c.encode(s).tolist() == plain.encode_ordinary(s)
    rows = bpe.encode(docs, decoded="decoded").collect()
    assert all(r.ids == plain.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode() for r in rows) and len(rows) == docs.count()
    assert bpe.decode(bpe.encode(docs)).select("decoded").collect() == bpe.encode(docs, decoded="decoded").select("decoded").collect()
    assert bpe.encode(empty).count() == 0


def test_quality(spark, docs, empty):
    text = "#a b\nb\n \nb\nx|y a b c a b c d"
    more = spark.createDataFrame([(99, text, "en", "a", 1)], DOCS)
    rows = {r.id: r for r in quality.quality(docs.select(*more.columns).unionByName(more)).collect()}
    for doc_id, t in [(99, text), (8, "word " * 30_000), (4, PASSAGE), (1, None), (2, "")]:
        w, r = words(t), rows[doc_id]
        c = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        hit = {i + k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
    assert rows[8].base_failed and rows[1].base_failed and not rows[1].kept
    assert quality.quality(empty).count() == 0
    full = quality.quality(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select(F.col("id").alias("doc_id"), "kept", "base_failed")
    lab = full.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = {r[0]: r[1] for r in lab}
    assert share[1] > 0.99 and share[0] < 0.15


def test_simhash(spark, docs, empty):
    def brute(text):
        w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
        s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    small = docs.filter("doc_id is null or doc_id != 8")
    got = simhash.near_duplicates(simhash.with_fingerprint(small)).collect()
    assert all(r.fingerprint & (1 << 64) - 1 == brute(r.text) for r in got) and len(got) == small.count()
    assert {r.component_id for r in got if r.doc_id in (1, 2, 3)} == {1}
    rng = np.random.default_rng(1)
    seeds = rng.integers(0, 1 << 62, 30)
    prints = [int(s) ^ sum(1 << int(b) for b in set(rng.integers(0, 62, rng.integers(0, 4)).tolist())) for s in rng.choice(seeds, 400)]
    frame = spark.createDataFrame([(i, p) for i, p in enumerate(prints)], "doc_id long, fingerprint long")
    parent = list(range(len(prints)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(frame).collect()} == {i: find(i) for i in range(len(prints))}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect())[0] == "1"
    assert simhash.keep_one(empty).count() == 0 and simhash.near_duplicates(simhash.with_fingerprint(empty)).count() == 0


def test_dense_lists():
    rng = np.random.default_rng(2)
    x = np.unique(np.array([0xABCDEF0000000000 ^ sum(1 << int(b) for b in set(rng.integers(0, 24, rng.integers(0, 9)).tolist())) for _ in range(9000)], dtype=np.uint64))
    assert len(x) > simhash.DENSE

    def groups(links):
        parent = {int(a): int(a) for a in x}

        def find(a):
            while parent[a] != a:
                parent[a] = parent[parent[a]]
                a = parent[a]
            return a

        for u, v in links:
            for a, b in zip(u.tolist(), v.tolist(), strict=True):
                assert bin(a ^ b).count("1") <= 3
                parent[find(a)] = find(b)
        return len({find(int(a)) for a in x})

    want = groups((x[u], x[v]) for u, v in simhash._forest(x))
    assert groups(simhash._links(x, (3, 4, 5, 6, 7))) == groups(simhash._links(x, (4, 5, 6, 7))) == want


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (102, 101), (5, 5)]
    got = dict(connected_components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


def test_language(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    prototypes = langid.train(d.filter(~langid.held_out()), per_language=200)
    held = langid.identify(d.filter(langid.held_out()), prototypes)
    assert held.selectExpr("avg(cast(lang = language.lang_pred as int))").first()[0] > 0.97
    rows = {r.doc_id: r.language for r in langid.identify(docs, prototypes).collect()}
    assert all((rows[i].lang_pred, rows[i].score) == ("und", 0.0) for i in (1, 2, 3)) and all(0 <= r.score <= 1 for r in rows.values())
    assert langid.train(empty) == {} and langid.identify(docs, {}).select("language.lang_pred").distinct().collect()[0][0] == "und"
    assert langid.text_vector("1234 ... 5") is None and langid.text_vector("a") is not None


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(size=(600, 16))
    v[40:90] = v[20]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [1.0]), (None, [1.0] * 16), (1080, [None] + [1.0] * 15), (7, v[7].tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in neighbours.nearest(frame, lambda i: i % 20 == 0, k=10).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert set(got) == set(range(0, 600, 20)) and all(len(x) == 10 for x in got.values())
    hits = 0
    for q, found in got.items():
        s = v @ v[q]
        order = [int(i) for i in np.lexsort((np.arange(600), -np.round(s, 9))) if i != q][:10]
        hits += len(set(order) & {i for i, _ in found})
        assert all(abs(score - s[i]) < 1e-9 for i, score in found) and q not in {i for i, _ in found}
    assert hits / (10 * len(got)) >= 0.9
    assert [i for i, _ in got[20]][:3] == [40, 41, 42]
    few = neighbours.nearest(frame.filter("vec_id < 4"), lambda i: i % 20 == 0, k=10).collect()
    assert len(few) == 3
    assert neighbours.nearest(frame.limit(0), lambda i: i % 20 == 0).count() == 0


def test_queries_are_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def test_mixing_sql(spark):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    want = con.execute("SELECT doc_id, size, source_size, round(target, 3), taken, copies FROM (" + mixing.SQL + ") ORDER BY doc_id").fetchall()
    got = mixing.op1(spark, SF).withColumn("target", F.round("target", 3)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want


@pytest.fixture(scope="module")
def stages():
    return dict(pytest.importorskip("corpus_pipeline").STAGES)


def test_stages_on_odd_rows(spark, docs, empty, stages):
    """Nulls in every column, empty and long texts, repeated rows and columns with clashing names, then an empty table."""
    first = {"language": {4, 5, 6, 7, 8, None}, "near_dedup": {1, 4, 7, 8, None}, "substring_dedup": {1, 2, 3, 4, 5, 6, 7, 8, None}}
    for name, stage in stages.items():
        got = stage(spark, docs, SF)
        rows = got.collect()
        assert stage(spark, empty, SF).collect() == []
        if name == "tokens":
            assert len(rows) == docs.count()
            continue
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        if name in first:
            assert {r.doc_id for r in rows} == first[name], name
        if name == "mixing":
            assert max(collections.Counter(rows).values()) <= 4
        if name == "language":
            assert len(rows) == 7 and all(r.lang for r in rows)
    clash = docs.withColumn("language", F.lit(1)).withColumn("fingerprint", F.lit("x")).withColumn("row", F.lit(2)).withColumn("n_words", F.lit(3))
    assert all(sorted(map(str, stages[n](spark, clash, SF).collect())) == sorted(map(str, stages[n](spark, docs, SF).collect())) for n in first)


def similar_pairs(texts, least=0.8):
    """Pairs of documents with this Jaccard similarity of five-word shingles, by an index of all shingles."""
    sets, where = {}, collections.defaultdict(list)
    for i, t in texts.items():
        w = words((t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        for g in sets[i]:
            where[g].append(i)
    shared = collections.Counter((a, b) for ids in where.values() for n, a in enumerate(ids) for b in ids[n + 1 :])
    return {p: n / (len(sets[p[0]]) + len(sets[p[1]]) - n) for p, n in shared.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= least}


def test_near_copies_by_similarity(spark):
    """Of the pairs at 0.9 or more nearly all are found, of those at 0.8 most, and what goes has a partner near 0.8."""
    d = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    scheme = simhash.by_similarity()
    frame = spark.createDataFrame(list(d.items()), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_one(frame).collect()}
    pairs, near = similar_pairs(d, 0.8), similar_pairs(d, 0.6)
    sure = [p for p, s in pairs.items() if s >= 0.9]
    assert sure and sum(not set(p) <= kept for p in sure) >= 0.98 * len(sure)
    assert sum(not set(p) <= kept for p in pairs) >= 0.9 * len(pairs)
    partner = {i for p in near for i in p}
    assert all(i in partner or not words(d[i]) for i in set(d) - kept)
    assert (scheme.max_bits, scheme.posting_bits, len(set(scheme.sets))) == (85, 35, 128)


def test_pipeline(spark):
    import corpus_pipeline

    d = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    c = bpe.codec(bpe.RANKS)
    counts = collections.Counter(r.doc_id for r in out)
    assert out and set(counts) <= set(d) and max(counts.values()) <= 2
    first = {r.doc_id for r in simhash.keep_one(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert set(counts) <= first
    windows = collections.Counter()
    for i in first:
        w = words(d[i].text)
        windows.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    for r in out:
        w = words(d[r.doc_id].text)
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if windows[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        text = d[r.doc_id].text
        for k in range(len(w) - 1, -1, -1):  # a removed word goes with the white space after it
            if gone[k]:
                place = [m.span()[0] for m in WORD.finditer(d[r.doc_id].text)] + [len(d[r.doc_id].text)]
                text = text[: place[k]] + text[place[k + 1] :]
        ids = c.encode(text).tolist()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
