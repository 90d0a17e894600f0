"""Operations 11 to 13 against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import infill, resampling, vectors
from corpusmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", "a", "Hello, world!", "one two  three\n\nfour", "  ", "naïve café ☕ 漢字 \U0001f600 end", "<P>already<S>here<M>", "a<P", ">b<S", "x" * 300, "..,,;;", "tab\tand\rreturn\0nul", "one two  three\n\nfour",
]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


# --- 11


def plain_infill(i, text, arranged=90, first=20, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text, re.S)
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in marks) or h3 % 100 >= arranged:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h4 % 100 < first else "psm"
    return len(units), form, len(p), len(m), marks[0] + p + marks[1] + s + marks[2] + m if form == "psm" else marks[1] + s + marks[0] + p + marks[2] + m


def test_infill_against_plain_python(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], "kept") for i in range(300)] + [(None, "no id at all, but words", "kept"), (7, TEXTS[7], "kept"), (7, TEXTS[7], "kept")]
    df = spark.createDataFrame(rows, "doc_id long, text string, infill string").repartition(3)
    got = infill.arrange(df).withColumn("restored", infill.restore(F.col("infill.output"), F.col("infill.form"))).collect()
    assert len(got) == len(rows)
    assert {r["infill"]["form"] for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert tuple(r["infill"]) == plain_infill(r["doc_id"], r["text"])
        assert r["restored"] == (r["text"] or "")


def test_infill_other_sentinels_and_rates(spark):
    marks = infill.Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    df = spark.createDataFrame([(i, "some <|fim words [+] here") for i in range(50)], "doc_id long, text string")
    got = infill.arrange(df, marks=marks, arranged=100, suffix_first=100).withColumn("restored", infill.restore(F.col("infill.output"), F.col("infill.form"), marks)).collect()
    assert all(r["infill"]["form"] == "spm" and r["restored"] == r["text"] and tuple(r["infill"]) == plain_infill(r["doc_id"], r["text"], 100, 100, marks) for r in got)


@pytest.mark.parametrize("marks", [("", "<S>", "<M>"), ("<P>", "<P>x", "<M>"), ("aba", "<S>", "<M>"), ("ab", "bc", "<M>")])
def test_infill_refuses_sentinels_read_in_two_ways(marks):
    with pytest.raises(ValueError):
        infill.check_sentinels(infill.Sentinels(*marks))


def test_infill_empty_and_long(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert infill.arrange(empty).count() == 0
    text = "word, " * 200_000
    row = infill.arrange(spark.createDataFrame([(3, text)], "doc_id long, text string"), arranged=100).withColumn("back", infill.restore(F.col("infill.output"), F.col("infill.form"))).first()
    assert row["back"] == text and row["infill"]["n"] == 600_000


# --- 12


def plain_resample(docs, target, percent=10, min_words=20, ngram=1, buckets=10_000):
    def features(text):
        w = words(text)
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, ngram + 1) for i in range(len(w) - n + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in target for b in features(text)[1])
    total = lambda c: sum(c.values()) + buckets
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * total(s) / ((s[b] + 1) * total(t)))) for b in range(buckets)}
    out = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    order = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(order[: len(order) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("ngram", [1, 3])
def test_resampling_against_plain_python(spark, ngram, monkeypatch):
    monkeypatch.setattr(resampling, "SLICE", 64)
    vocabulary = ["alpha", "Beta", "GAMMA", "delta9", "épsilon", "z"]
    rng = np.random.default_rng(1)
    docs = [(i, " ".join(rng.choice(vocabulary, int(rng.integers(0, 60))))) for i in range(200)] + [(900, None), (901, ""), (902, "...!?"), (None, "alpha beta " * 30), (5, "tie " * 25), (5, "tie " * 25), (903, "ab" * 500), (904, "long words " + "y" * 3000 + " end" * 20)]
    target = ["alpha beta gamma", None, "beta beta, beta", ""]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, rank int, tag string").repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), ngram=ngram)
    assert set(got.columns) == {"doc_id", "tag", "n_words", "n_features", "weight", "score", "rank"}
    rows = sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=repr)
    assert rows == plain_resample(docs, target, ngram=ngram)


def test_resampling_slices_give_what_whole_texts_give(monkeypatch):
    import pyarrow as pa

    text = pa.py_buffer(("Some wörds, of differing-length, " * 50 + "end").encode())
    whole = sorted(b for _, f in resampling.buckets_of(text, 3) for b in f)
    for size in (1, 7, 50, 1000):
        monkeypatch.setattr(resampling, "SLICE", size)
        parts = list(resampling.buckets_of(text, 3))
        assert sorted(b for _, f in parts for b in f) == whole
        assert sum(n for n, _ in parts) == len(words(bytes(text).decode()))


def test_resampling_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    assert [tuple(r) for r in resampling.resample(one, none, percent=100).select("doc_id", "n_features", "rank").collect()] == [(1, 30, 1)]


# --- 13


def plain_links(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of (vec_id, vector) by all pairs."""
    fit = [k for k, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k in range(len(rows))}
    scaled = {k: np.array(rows[k][1]) / np.abs(rows[k][1]).max() for k in fit}
    unit = {k: v / np.linalg.norm(v) for k, v in scaled.items()}
    for a in fit:
        for b in fit:
            if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= cosine:
                links[a].add(b)
                links[b].add(a)
    out, seen = [None] * len(rows), set()
    for k in range(len(rows)):
        if k in seen:
            continue
        group, todo = {k}, [k]
        while todo:
            new = links[todo.pop()] - group
            group |= new
            todo.extend(new)
        seen |= group
        least = min((rows[g][0] for g in group if rows[g][0] is not None), default=None)
        for g in group:
            out[g] = (rows[g][0], len(links[g]), least, rows[g][0] == least)
    return sorted(out, key=repr)


def tight(rng, centre, n, spread):
    return [(centre + rng.normal(size=len(centre)) * spread).tolist() for _ in range(n)]


@pytest.mark.parametrize(("dims", "block", "cosine"), [(8, 16, 0.9), (16, 40, 0.9), (3, 10, 0.8), (16, 4096, 0.9), (8, 25, 0.97)])
def test_vectors_against_all_pairs(spark, dims, block, cosine):
    rng = np.random.default_rng(dims * block)
    centres = rng.normal(size=(6, dims))
    found = rng.normal(size=(150, dims)).tolist()
    found += [v for c, spread, n in zip(centres, (0.01, 0.05, 0.15, 0.25, 0.35, 0.0), (120, 40, 40, 40, 40, 25), strict=True) for v in tight(rng, c, n, spread)]
    # a chain whose ends are far apart, and scaled copies
    turn = [[math.cos(t), math.sin(t), *[0.0] * (dims - 2)] for t in np.arange(0, 2, 0.3)]
    found += turn + [[3.5 * x for x in v] for v in turn[:3]]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(found)), found, strict=True)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * dims), (5003, [math.nan] + [1.0] * (dims - 1)), (5004, [math.inf] * dims), (5005, [None] + [1.0] * (dims - 1)), (None, rows[0][1]), (None, None), rows[3], rows[3], (5006, [1.0]), (5007, [2.0]), (5008, [1e300] + [0.0] * (dims - 1)), (5009, [-0.0, 1.0] + [0.0] * (dims - 2))]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, tag string, kept int").repartition(4)
    got = vectors.near_vectors(df, cosine=cosine, block=block)
    assert set(got.columns) == {"vec_id", "embedding", "tag", "n_links", "component_id", "kept"}
    assert sorted((tuple(r[c] for c in ("vec_id", "n_links", "component_id", "kept")) for r in got.collect()), key=repr) == plain_links(rows, cosine)


def test_vectors_of_a_core_are_counted(spark):
    """Groups around their pivots link by the triangle inequality; with what is near them too, they give what all pairs give."""
    rng = np.random.default_rng(4)
    centres = np.eye(8)[:4] * 5
    rows = [(k * 1000 + i, v) for k, c in enumerate(centres) for i, v in enumerate(tight(rng, c, 300, 0.01))]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=50)
    assert sorted({(r["n_links"], r["component_id"]) for r in got.collect()}) == [(299, 0), (299, 1000), (299, 2000), (299, 3000)]


def test_pivots_cover_and_prune():
    """Every pair within the radius meets in exactly one cell, and well separated groups go to no other cell."""
    rng = np.random.default_rng(2)
    x = vectors.unit(np.concatenate([rng.normal(size=(300, 6)), np.repeat(rng.normal(size=(20, 6)), 20, axis=0) + rng.normal(size=(400, 6)) * 0.1]))
    radius = math.acos(0.9)
    cells = vectors.Cells({6: vectors.choose_pivots(x[rng.permutation(len(x))], 40, radius)}, radius)
    at, angle = cells.home(x)
    extent = {int(j): float(angle[at == j].max()) for j in np.unique(at)}
    visits = {j: set(rows.tolist()) for j, rows, _ in cells.open_cells(x, at, angle, extent)}
    i, j = np.nonzero(np.triu(x @ x.T >= 0.9, 1))
    for a, b in zip(i.tolist(), j.tolist(), strict=True):
        low, high = sorted((a, b), key=lambda k: at[k])
        assert at[low] == at[high] or high in visits[int(at[low])]
    apart = vectors.unit(np.repeat(np.eye(6), 50, axis=0) + rng.normal(size=(300, 6)) * 0.02)
    cells = vectors.Cells({6: vectors.choose_pivots(apart, 6, radius)}, radius)
    at, angle = cells.home(apart)
    extent = {int(j): float(angle[at == j].max()) for j in np.unique(at)}
    assert len(extent) == 6 and not sum(len(rows) for _, rows, _ in cells.open_cells(apart, at, angle, extent))


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("name", ["op11_infill", "op12_resampling", "op13_vectors"])
def test_queries_give_what_sql_gives(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)


# --- near-copies: lists of any length


def with_bits(rng, x, n):
    """x with n of its bits turned."""
    bits = np.unpackbits(x.view(np.uint8))
    bits[rng.choice(len(bits), n, replace=False)] ^= 1
    return np.packbits(bits).view(np.int64)


def differ(a, b):
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def planted(rng, n, spread):
    """Random fingerprints of eight lanes, and a pair that differs in so many of its 512 bits; then a chance neighbour in the posting's lanes between the two."""
    x = rng.integers(-(2**63), 2**63 - 1, size=(n, 8))
    x[1] = with_bits(rng, x[0].copy(), spread)
    third = x[2]
    third[:2] = x[0, :2]
    mask = x[0, :2] ^ x[1, :2]
    third[:2] ^= mask & 0x5555555555555555
    return x


@pytest.mark.parametrize("n", [3, 50, 5000])
def test_a_list_of_any_length_loses_no_pair(spark, n):
    """A pair of near-copies among random entries, with an entry between the two in the posting's lanes, is a link; no other is."""
    from corpusmill.llm import simhash

    rng = np.random.default_rng(n)
    x = planted(rng, n, 60)
    scheme = simhash.by_similarity()
    # one set of positions, at which all agree
    one = scheme._replace(sets=[(60, 61, 62)])
    x[:, 7] = x[0, 7]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, fingerprint array<long>")
    got = {tuple(sorted(r)) for r in simhash.near_by_similarity(df, one).collect()}
    want = {(i, j) for i in range(min(n, 50)) for j in range(i + 1, n) if differ(x[i], x[j]) <= scheme.max_bits}
    assert (0, 1) in got and got == want


def test_families_give_forests_of_links_that_hold(spark):
    """Variants around a centre, some nearer and some farther from each other than the bound: components are those of all pairs that hold."""
    from corpusmill.llm import simhash
    from corpusmill.llm.components import connected_components

    rng = np.random.default_rng(9)
    scheme = simhash.by_similarity()._replace(sets=[(60, 61, 62), (59, 61, 63)])
    x = []
    for _ in range(12):
        centre = rng.integers(-(2**63), 2**63 - 1, size=8)
        x += [with_bits(rng, centre.copy(), int(rng.integers(0, 70))) for _ in range(15)]
    x = np.array(x)
    x[:, 7] = 12345
    near = np.array([[differ(a, b) <= scheme.max_bits and differ(a[:2], b[:2]) <= scheme.posting_bits for b in x] for a in x])
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([root[near[i]].min() for i in range(len(x))])
    links = simhash.near_by_similarity(spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "node long, fingerprint array<long>"), scheme)
    found = links.collect()
    assert all(differ(x[u], x[v]) <= scheme.max_bits for u, v in found) and len(found) <= len(x) * 2
    got = dict(map(tuple, connected_components(spark.createDataFrame(found, "u long, v long")).collect()))
    assert [got.get(i, i) for i in range(len(x))] == root.tolist()
