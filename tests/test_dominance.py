"""Skylines, scores and rankings against plain Python, and what must hold of them."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vantage.operators import cells, kernels, score, topk
from vantage.operators import skyline as sky
from vantage.operators.points import as_points
from vantage.plans import catalogue
from vantage.plans import run as runs

# name: (points, skyline ids, scores, top 2, top 2 of the skyline)
FIXTURES = {
    "basic": ([(1, 9), (2, 6), (4, 4), (6, 2), (9, 1), (5, 5), (7, 7), (3, 8)], [0, 1, 2, 3, 4], [0, 2, 2, 1, 0, 1, 0, 0], [(1, 2), (2, 2)], [(1, 2), (2, 2)]),
    "duplicates": ([(1, 1), (1, 1), (2, 2), (2, 2), (3, 1)], [0, 1], [3, 3, 0, 0, 0], [(0, 3), (1, 3)], [(0, 3), (1, 3)]),
    "negatives": ([(-5, -5), (-1, -1), (0, -6), (-6, 3)], [0, 2, 3], [1, 0, 0, 0], [(0, 1), (1, 0)], [(0, 1), (2, 0)]),
    "anti_chain": ([(1, 4), (2, 3), (3, 2), (4, 1)], [0, 1, 2, 3], [0] * 4, [(0, 0), (1, 0)], [(0, 0), (1, 0)]),
    "three": ([(1, 1, 5), (1, 5, 1), (5, 1, 1), (2, 2, 2), (3, 3, 3), (5, 5, 5)], [0, 1, 2, 3], [1, 1, 1, 2, 1, 0], [(3, 2), (0, 1)], [(3, 2), (0, 1)]),
    "chain": ([(1,), (2,), (2,), (3,)], [0], [3, 1, 1, 0], [(0, 3), (1, 1)], [(0, 3)]),
    "single": ([(7, 7)], [0], [0], [(0, 0)], [(0, 0)]),
    "partitions": ([(0, 10), (1, 9), (0, 11), (2, 12), (11, 9), (12, 9), (13, 9)], [0, 1], [2, 4, 1, 0, 2, 1, 0], [(1, 4), (0, 2)], [(1, 4), (0, 2)]),
}


def dom(a, b):
    return all(x <= y for x, y in zip(a, b, strict=True)) and any(x < y for x, y in zip(a, b, strict=True))


def frame(spark, points, dims=None):
    d = len(points[0]) if points else dims
    names = [f"Dim_{i}" for i in range(d)]
    schema = "id long, " + ", ".join(f"{n} double" for n in names) + ", x0 string, score int, n int, cell int"
    rows = [(i, *(None if x is None else float(x) for x in p), "clash", 1, 2, 3) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, schema), names


def ids(df):
    return sorted(r["id"] for r in df.collect())


def pairs(df):
    return [tuple(r) for r in df.select("id", "score").orderBy(F.desc("score"), "id").collect()]


@pytest.mark.parametrize("name", FIXTURES)
def test_fixtures(spark, name):
    points, want, scores, top, top_sky = FIXTURES[name]
    df, dims = frame(spark, points)
    for strategy in ("anti", "two_phase", *(["window2d"] if len(dims) == 2 else [])):
        assert ids(sky.skyline(df.repartition(3), dims, strategy=strategy)) == want
    assert dict(pairs(score.dominance_score(df, dims))) == dict(enumerate(scores))
    assert pairs(topk.topk_dominating(df.repartition(2), 2, dims)) == top
    assert pairs(topk.topk_skyline(df, 2, dims)) == top_sky
    assert pairs(runs.topk_skyline_by_scores(df, 2, dims)) == top_sky


def test_empty_null_nan_and_infinite(spark):
    df, dims = frame(spark, [], 2)
    assert sky.skyline(df, dims).count() == 0 and sky.skyline(df, dims, strategy="window2d").count() == 0
    assert score.dominance_score(df, dims).count() == 0
    assert topk.topk_dominating(df, 3, dims).count() == 0 and topk.topk_skyline(df, 3, dims).count() == 0
    odd = [(1, 2), (None, 0), (float("nan"), 0), (0, None), (float("-inf"), float("inf")), (3, 3), (float("-inf"), 5)]
    df, dims = frame(spark, odd)
    assert ids(sky.skyline(df, dims)) == [0, 6]
    assert ids(sky.skyline(df, dims, strategy="anti")) == [0, 6]
    assert dict(pairs(score.dominance_score(df, dims))) == {0: 1, 4: 0, 5: 0, 6: 1}
    assert pairs(topk.topk_dominating(df, 2, dims)) == [(0, 1), (6, 1)] and topk.topk_dominating(df, 0, dims).count() == 0
    with pytest.raises(Exception, match="null or NaN"):
        as_points(df, dims, strict=True)[0].collect()
    with pytest.raises(ValueError, match="unknown dimensions"):
        sky.skyline(df, ["nope"])
    with pytest.raises(ValueError, match="min or max"):
        sky.skyline(df, dims, {"Dim_0": "up"})


@pytest.mark.parametrize(("d", "spread"), [(1, 9), (2, 6), (3, 5), (4, 4), (5, 1000)])
def test_random_points_against_brute_force(spark, d, spread):
    rng = random.Random(d)
    points = [tuple(rng.randrange(-spread, spread) for _ in range(d)) for _ in range(160)]
    df, dims = frame(spark, points)
    want = [i for i, p in enumerate(points) if not any(dom(q, p) for q in points)]
    assert ids(sky.skyline(df.repartition(5), dims)) == want
    scores = {i: sum(dom(p, q) for q in points) for i, p in enumerate(points)}
    assert dict(pairs(score.dominance_score(df, dims))) == scores
    rank = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    assert pairs(topk.topk_dominating(df, 7, dims)) == rank[:7]
    assert pairs(topk.topk_skyline(df, 7, dims)) == [x for x in rank if x[0] in want][:7]
    assert dict(pairs(score.dominated_by_count(df, dims))) == {i: sum(dom(q, p) for q in points) for i, p in enumerate(points)}
    once = sky.skyline(df, dims, distinct=True)
    assert once.count() == len({points[i] for i in want})


def test_small_blocks_and_broadcasts_give_the_same(spark, monkeypatch):
    rng = random.Random(0)
    points = [(x := rng.random(), 1 - x + rng.random() / 50, rng.random()) for _ in range(400)]
    df, dims = frame(spark, points)
    want, top = ids(sky.skyline(df, dims)), pairs(topk.topk_skyline(df, 5, dims))
    monkeypatch.setattr(sky, "BROADCAST_ROWS", 30)
    monkeypatch.setattr(sky, "MERGE_ROWS", 1)
    monkeypatch.setattr(topk, "BLOCK", 7)
    monkeypatch.setattr(score, "BLOCK", 50)
    monkeypatch.setattr(kernels, "PAIRS", 100)
    assert ids(sky.skyline(df.repartition(6), dims)) == want
    assert pairs(topk.topk_skyline(df.repartition(3), 5, dims)) == top
    scores = dict(pairs(score.dominance_score(df, dims)))
    assert scores == {i: sum(dom(p, q) for q in points) for i, p in enumerate(points)}
    assert pairs(topk.topk_dominating(df, 5, dims)) == sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:5]


def test_groups_and_directions(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(["a", "b", None]), float(rng.randrange(9)), float(rng.randrange(9))) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, u double, v double")
    found = ids(sky.skyline(df.repartition(4), ["u", "v"], {"v": "max"}, by=["g"]))
    assert found == [i for i, g, u, v in rows if not any(h == g and dom((a, -b), (u, -v)) for _, h, a, b in rows)]


@pytest.mark.parametrize(("d", "chunk"), [(1, 40), (2, 30), (3, 1000), (4, 60), (17, 70)])
def test_scores_by_slabs(spark, monkeypatch, d, chunk):
    """More candidates than are broadcast; equal points, few values, and more dimensions than a grid has."""
    monkeypatch.setattr(score, "BLOCK", 10)
    monkeypatch.setattr(score, "CHUNK", chunk)
    rng = random.Random(d)
    points = [tuple(rng.randrange(2 if d > 9 else 5) for _ in range(d)) for _ in range(150)] + [(1,) * d] * 50
    if d > 9:  # a few that dominate others
        points += [(0,) * d, (0,) * (d - 1) + (1,), (1,) * (d - 1) + (0,)]
    df, dims = frame(spark, points)
    scores = {i: sum(dom(p, q) for q in points) for i, p in enumerate(points)}
    assert dict(pairs(score.dominance_score(df.repartition(3), dims))) == scores
    some = df.where("id % 3 = 0")
    assert dict(pairs(score.dominance_score(df, dims, candidates=some))) == {i: s for i, s in scores.items() if i % 3 == 0}
    rank = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:9]
    assert pairs(topk.topk_dominating(df, 9, dims)) == rank


def test_ranking_in_64_dimensions(spark):
    rng = random.Random(1)
    points = [tuple(rng.random() for _ in range(64)) for _ in range(60)] + [(0.0,) * 64, (0.5,) * 63 + (0.0,), (1.0,) * 64]
    df, dims = frame(spark, points)
    scores = {i: sum(dom(p, q) for q in points) for i, p in enumerate(points)}
    rank = sorted(scores.items(), key=lambda x: (-x[1], x[0]))
    assert pairs(topk.topk_dominating(df, 5, dims)) == rank[:5]
    best = {i for i, p in enumerate(points) if not any(dom(q, p) for q in points)}
    assert pairs(topk.topk_skyline(df, 5, dims)) == [x for x in rank if x[0] in best][:5]


def test_groups_with_many_survivors(spark, monkeypatch):
    monkeypatch.setattr(sky, "GROUP_ROWS", 10)
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "a", "a", "b", None]), x := rng.random(), 1 - x + rng.random() / 9) for i in range(500)]
    rows += [(1000 + i, "a", 0.3, 0.2) for i in range(40)]  # equal points
    df = spark.createDataFrame(rows, "id long, g string, u double, v double")
    want = [i for i, g, u, v in rows if not any(h == g and dom((a, b), (u, v)) for _, h, a, b in rows)]
    assert ids(sky.skyline(df.repartition(6), ["u", "v"], by=["g"])) == want


def test_equal_survivors_are_broadcast_once(spark, monkeypatch):
    monkeypatch.setattr(sky, "MERGE_ROWS", 5)
    monkeypatch.setattr(sky, "BROADCAST_ROWS", 10)
    points = [(0.0, 1.0)] * 200 + [(1.0, 0.0)] * 100 + [(1.0, 1.0)] * 50 + [(k / 30, 1 - k / 30) for k in range(1, 30)]
    df, dims = frame(spark, points)
    assert len(ids(sky.skyline(df.repartition(5), dims))) == 329


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.integers(-3, 3).map(float), st.floats(allow_nan=False))] * 3), max_size=40))
def test_kernels(points):
    x = np.array(points, float).reshape(-1, 3)
    got = kernels.local_skyline(x).tolist()
    assert got == [i for i, p in enumerate(points) if not any(dom(q, p) for q in points)]
    assert kernels.count_dominated(x, x).tolist() == [sum(dom(p, q) for q in points) for p in points]
    at = kernels.order(x)
    assert not any(dom(x[b], x[a]) for n, a in enumerate(at) for b in at[n + 1 :])


def test_grid_bounds_hold_scores(spark):
    rng = random.Random(2)
    points = [(rng.randrange(12), rng.random()) for _ in range(300)]
    df, dims = frame(spark, points)
    rows, xs = as_points(df, dims, id="id")
    grid = cells.build_grid(rows, xs, 6)
    assert grid.counts.sum() == 300
    x = np.array(points, float)
    b = tuple(grid.buckets(x).T.astype(int))
    exact = np.array([sum(dom(p, q) for q in points) for p in points])
    assert (grid.lower[b] <= exact).all() and (exact <= grid.upper[b]).all()
    summary = cells.cell_summary(rows, xs, grid.edges)
    assert summary.agg(F.sum("n")).first()[0] == 300
    counted = {r["cell"]: r["n"] for r in summary.collect()}
    assert counted == {i: n for i, n in enumerate(grid.counts.ravel().tolist()) if n}


def test_scores_follow_dominance(spark):
    rng = random.Random(3)
    points = [(rng.randrange(7), rng.randrange(7)) for _ in range(60)]
    df, dims = frame(spark, points)
    scores = dict(pairs(score.dominance_score(df, dims)))
    for r in score.score_pairs(df, dims).collect():
        assert scores[r["id"]] > scores[r["other"]]
    with pytest.raises(ValueError, match="over 59 rows"):
        score.score_pairs(df, dims, most=59)
    best = ids(sky.skyline(df, dims))
    assert max(scores.values()) == max(scores[i] for i in best)
    assert ids(sky.skyline(sky.skyline(df, dims), dims)) == best


@pytest.mark.parametrize("d", [1, 2, 3, 16])
def test_scores_by_join(spark, d):
    rng = random.Random(d)
    points = [tuple(rng.choice([rng.randrange(4), rng.random() * 4, float("inf"), -0.0]) if i < 3 else 0 for i in range(d)) for _ in range(250)]
    points += points[:40] + [points[0]] * 30  # equal points
    df, dims = frame(spark, [*points, (None,) * d])
    by_id = lambda scores: sorted(pairs(scores))
    want = [(i, sum(dom(p, q) for q in points)) for i, p in enumerate(points)]
    assert by_id(score.score_by_join(df.repartition(5), dims)) == want
    assert by_id(score.score_by_join(df, dims, chunk=7)) == want
    worse = [(i, sum(dom(q, p) for q in points)) for i, p in enumerate(points)]
    assert by_id(score.score_by_join(df, dims, direction=dict.fromkeys(dims, "max"))) == worse
    assert score.score_by_join(df.where("id < 0"), dims).collect() == []


def test_score_by_join_query_over_many_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 30_000, 20_100) / 100, rng.integers(0, 25, 20_100)])
    rows = [(i, float(a), int(b)) for i, (a, b) in enumerate(x.tolist())]
    schema = "s_suppkey long, s_acctbal double, s_nationkey int"
    spark.createDataFrame([*rows, (-1, None, 3)], schema).write.parquet(f"{tmp_path}/supplier.parquet")
    got = catalogue.queries()["dominance_score_by_join_supplier"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(-1, 0), *enumerate(kernels.count_dominated(x, x).tolist())]
