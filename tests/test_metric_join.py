"""The pruned similarity join against all pairs."""

import math

import numpy as np
import pytest

from corpusmill.operators import metric_join as M
from corpusmill.operators import vectors as V


def rows_of(rng, groups, each, dims, spread):
    return [(g * each + i, g % 2, (c + rng.normal(size=dims) * spread).tolist()) for g, c in enumerate(rng.normal(size=(groups, dims)) * 4) for i in range(each)]


def plain(asking, notes, radius, k):
    out = []
    for i, block, v in asking:
        near = []
        for j, other, w in notes:
            if None not in (i, j, block, v, w) and j != i and block == other and len(v) == len(w) and v and None not in v and None not in w:
                d = math.dist(v, w)
                if d <= radius:
                    near.append((d, j))
        out += [(i, j, round(d, 6)) for d, j in sorted(near)[:k]]
    return sorted(out)


SCHEMA = "id long, project int, embedding array<double>"


@pytest.mark.parametrize(("part", "cell", "radius"), [(4096, 1024, 2.0), (16, 20, 2.0), (7, 10, 0.5), (16, 20, 40.0)])
def test_same_as_all_pairs(spark, part, cell, radius):
    rng = np.random.default_rng(part)
    rows = rows_of(rng, 8, 30, 5, 0.4)
    rows += [(1000, 0, None), (1001, None, [0.0] * 5), (None, 0, [0.0] * 5), (1002, 0, [1.0, 2.0]), (1003, 0, [1.0, 2.1]), (1004, 1, [1.0, 2.0]), (1005, 0, []), (1006, 0, [None] * 5), (1007, 0, rows[0][2]), (1008, 0, rows[0][2]), (1009, 0, rows[0][2])]
    asking = rows[:-11:3] + rows[-11:]
    notes_df, asking_df = (spark.createDataFrame(r, SCHEMA).repartition(3) for r in (rows, asking))
    got = M.nearest_within(asking_df, notes_df, "id", "embedding", "project", radius, 5, part=part, cell=cell).collect()
    assert sorted((r["id"], r["other"], round(r["distance"], 6)) for r in got) == plain(asking, rows, radius, 5)


def test_pairs_compared_are_few(spark):
    """Of groups that are apart only their own pairs are compared, and a project with nearly all rows is many tasks."""
    rng = np.random.default_rng(3)
    rows = [(i, 0 if i % 50 else 1, v) for i, _, v in rows_of(rng, 40, 100, 6, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    found = M.joined(df, df, "id", "embedding", "project", 1.0, 5, part=64, cell=50).filter("asking is null").collect()
    pairs = sum(sum(r[1] == p for r in rows) ** 2 for p in (0, 1))
    assert 0 < sum(r["compared"] for r in found) < pairs / 20
    assert len(found) >= 40


def test_string_ids_and_none(spark):
    df = spark.createDataFrame([("b", 1, [0.0, 1.0]), ("a", 1, [0.0, 1.0]), ("c", 1, [0.0, 1.5]), ("d", 2, [0.0, 1.0])], "id string, project int, embedding array<float>")
    got = V.conflicts(df, df, "id", 0.5, "project", 1).collect()
    assert sorted(map(tuple, got)) == [("a", "b", 0.0), ("b", "a", 0.0), ("c", "a", 0.5)]
    assert V.conflicts(df.limit(0), df.limit(0), "id", 0.5, "project").count() == 0


def test_pivots_leave_no_partner_out():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    pivots = M.choose_pivots(x, 20, 0.7)
    d = M.distances(x, pivots)
    home, radius = d.argmin(1), 0.7
    extent = np.array([d[home == j, j].max(initial=0) for j in range(len(pivots))])
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for i, j in zip(*np.nonzero(apart <= radius), strict=True):
        at = d[i, home[j]]
        assert at <= extent[home[j]] + radius + 1e-6 and at <= d[i].min() + 2 * radius + 1e-6 and abs(at - d[j, home[j]]) <= radius + 1e-6
