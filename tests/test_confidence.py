import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlens.operators.scoring import bucket_fits, l1_logistic, permutations, permuted_place, row_confidence


def cost(w, x, y):
    weight = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    z = w[0] * x + w[1]
    return (weight * (np.maximum(z, 0) - z * y + np.log1p(np.exp(-np.abs(z))))).sum() + np.abs(w).sum()


def problems():
    draw = np.random.default_rng(3)
    out = []
    for n, shift, scale in ((30, 0.0, 1.0), (200, 1.0, 1.0), (200, 3.0, 0.1), (500, 0.3, 20.0), (40, 50.0, 1.0)):
        y = (draw.random(n) < 0.3).astype(int)
        y[:2] = 0, 1
        out.append(((draw.normal(size=n) + shift * y) * scale, y))
    return [*out, (np.full(20, 0.7), np.arange(20) % 2)]


@pytest.mark.parametrize("k", range(6))
def test_fit_is_least(k):
    x, y = problems()[k]
    w = np.array(l1_logistic(x, y))
    least = cost(w, x, y)
    for size in (1e-2, 1e-4):
        for d in ((1, 0), (0, 1), (1, 1), (1, -1)):
            assert cost(w + size * np.array(d), x, y) >= least - 1e-9 and cost(w - size * np.array(d), x, y) >= least - 1e-9


def test_buckets_like_single_fits(spark):
    rows = [(i, float(a), int(b)) for i, (x, y) in enumerate(problems()) for a, b in zip(x, y)] + [(90, 1.0, 1), (91, 1.0, 0)]
    got = {r["n_elem"]: (r["slope"], r["intercept"]) for r in bucket_fits(spark.createDataFrame(rows, "b int, x double, y int"), "b", "x", "y", 5).collect()}
    assert sorted(got) == list(range(6))
    for i, (x, y) in enumerate(problems()):
        assert got[i] == pytest.approx(l1_logistic(x, y), abs=1e-6)
    assert bucket_fits(spark.createDataFrame([], "b int, x double, y int"), "b", "x", "y", 1).collect() == []


def test_rows_like_single_fits(spark):
    draw = np.random.default_rng(4)
    base = sorted(draw.random(50).tolist())
    rows = [(i, float(draw.random()), draw.random(draw.integers(1, 40)).tolist()) for i in range(60)] + [(60, None, [0.5]), (61, float("nan"), [0.5]), (62, 0.5, []), (63, 0.5, None)]
    got = {r["id"]: r["confidence"] for r in row_confidence(spark.createDataFrame(rows, "id long, s double, r array<double>"), "id", "s", "r", base).collect()}
    for i, s, r in rows[:60]:
        slope, intercept = l1_logistic(np.array([*base, *r]), np.array([1] * 50 + [0] * len(r)))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(slope * s + intercept))), abs=1e-6)
    assert [got[i] for i in range(60, 64)] == [0.0] * 4


@pytest.mark.parametrize("n", [1, 2, 3, 50, 1000])
def test_places_are_permuted(spark, n):
    rows = spark.range(n).select("id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("seed"))
    got = rows.select("seed", permuted_place(F.col("id"), F.lit(n).cast("long"), F.col("seed")).alias("p")).groupBy("seed").agg(F.array_sort(F.collect_list("p")).alias("p")).collect()
    assert all(r["p"] == list(range(n)) for r in got)


def test_places_are_spread(spark):
    rows = spark.range(3000).select(permuted_place(F.lit(7).cast("long"), F.lit(30).cast("long"), F.col("id")).alias("p"))
    counts = [r["count"] for r in rows.groupBy("p").count().collect()]
    assert len(counts) == 30 and min(counts) > 50 and max(counts) < 170


def test_permutations_deal_every_right_once_for_each_seed(spark):
    rows = spark.createDataFrame([(f"k{i}", ["a"], ["a"] if i % 4 == 0 else ["b"]) for i in range(40)], "k string, l array<string>, r array<string>")
    got = permutations(rows, "k", "l", "r", 6).groupBy("seed").agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.collect_set(F.when(F.col("score") > 0, F.col("k"))).alias("hit")).collect()
    assert sorted(r["seed"] for r in got) == list(range(6)) and all((r["n"], r["s"]) == (40, 10.0) for r in got)
    assert len({tuple(sorted(r["hit"])) for r in got}) == 6
