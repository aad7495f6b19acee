from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidepool.llm.multiindex import Codebooks, Settings, kmeans, nearest, search

SCHEMA = "vec_id bigint, embedding array<float>, label int, id int, v string, g string, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, "x", "y", 2) for i, v in rows], SCHEMA)


def exact(rows, k=10):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in ok:
        if q % 100 == 0:
            out[q] = sorted((float(np.sqrt(((ok[q] - x) ** 2).sum())), i) for i, x in ok.items() if i != q)[:k]
    return out


def test_walk_goes_by_the_sum_of_distances():
    rng = np.random.default_rng(1)
    books = Codebooks((rng.random((6, 3)), rng.random((5, 3))))
    one, two = rng.random(6), rng.random(5)
    cells = books.walk(one, two, np.ones(30, int), 30)
    sums = [one[c // 5] + two[c % 5] for c in cells]
    assert sorted(cells) == list(range(30)) and sums == sorted(sums)
    assert len(books.walk(one, two, np.where(np.arange(30) % 2, 3, 0), 9)) == 3


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = centres[rng.integers(0, 40, 4000)] + 0.6 * rng.normal(size=(4000, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    got = search(frame(spark, rows), F.col("vec_id") % 100 == 0, settings=Settings(centroids=16, sample=1500, shard_rows=500, block_queries=15)).collect()
    want = exact(rows)
    found = {}
    for r in got:
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    assert set(found) == set(want)
    hits = 0
    for q, near in found.items():
        near.sort()
        assert [n[0] for n in near] == list(range(1, 11)) and [n[1] for n in near] == sorted(n[1] for n in near)
        for _, score, i in near:
            assert score == np.sqrt(((np.array(rows[q][1], np.float32).astype(float) - np.array(rows[i][1], np.float32).astype(float)) ** 2).sum())
        hits += len({n[2] for n in near} & {i for _, i in want[q]})
    assert hits >= 0.9 * 10 * len(want)


def test_copies_ties_and_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(0, 400, 2)] + [(500, None), (600, [0.0] * 4), (700, [1.0, None, 1.0, 1.0]), (800, [1.0, nan, 1.0, 1.0]), (900, [inf, 1.0, 1.0, 1.0]), (1000, [1.0, 2.0]), (1, [1.0, 2.0, 3.0, 5.0]), (3, [1.0, 2.0, 3.0, 3.0])]
    rows += [(100, [1.0, 2.0, 3.0, 4.0])]  # a repeated row
    got = search(frame(spark, rows), F.col("vec_id") % 100 == 0).collect()
    want = exact([r for r in rows if r[0] != 1000])
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(q, k + 1, i, s) for q, near in want.items() for k, (s, i) in enumerate(near)}


def test_nearest_with_ties_and_large_norms():
    """Against plain sorting: 128 rows at one distance, and rows close together far from the origin."""
    rng = np.random.default_rng(6)
    q = rng.normal(size=64)
    ties = np.concatenate([q + s * np.eye(64) for s in (1.0, -1.0)])[rng.permutation(128)]
    far = 1e6 + 1e-3 * rng.normal(size=(2000, 64))
    for point, x in ((np.zeros(64), ties - q), (q, ties), (far[7], far), (far[7], np.round(far, 2)), (q, rng.normal(size=(3000, 64))), (q, np.repeat(rng.normal(size=(5, 64)), 30, 0))):
        ids = rng.permutation(len(x))
        score = np.sqrt(((x - point) ** 2).sum(1))
        want = np.lexsort((ids, score))[:11]
        at, got = nearest(point, x, ids, 11)
        assert (at == want).all() and (got == score[want]).all()


def test_ties_and_offsets_in_the_whole_search(spark):
    rows = [(100, [0.0] * 63 + [3.0])] + [(i + 1, [float(s * (j == i % 63)) for j in range(63)] + [3.0]) for i in range(126) for s in [1 if i < 63 else -1] if i != 99]
    got = search(frame(spark, rows), F.col("vec_id") % 100 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(i, 1.0) for i in range(1, 11)]
    rng = np.random.default_rng(9)
    data = np.float32(1e3) + np.float32(1e-2) * rng.normal(size=(2000, 8)).astype(np.float32)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(data)]
    found, want = {}, exact(rows)
    for r in search(frame(spark, rows), F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r["query_id"], set()).add((r["score"], r["vec_id"]))
    assert sum(len(found[q] & set(near)) for q, near in want.items()) >= 0.9 * 10 * len(want)


def test_few_and_no_rows(spark):
    few = search(frame(spark, [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [1.0, 1.0])]), F.col("vec_id") % 100 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in few} == {(0, 1, 7), (0, 2, 100), (100, 1, 7), (100, 2, 0)}
    assert search(frame(spark, [(0, [1.0, 0.0])]), F.col("vec_id") % 100 == 0).count() == 0
    assert search(frame(spark, []), F.col("vec_id") % 100 == 0).count() == 0


def test_kmeans_of_few_distinct_points():
    assert len(kmeans(np.array([[1.0, 2.0]] * 9 + [[3.0, 4.0]]), 5, 3, 1)) == 2
