"""Resampling in bulk against scalar versions of the draws, and its split over buckets against the theory."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from selectra.functions import draws
from selectra.operators import splits, statistics

P = draws.PRIME


def scalar_draw(repetition: int, number: int, seed: int) -> int:
    power = lambda x: pow(x, 5, P)
    a, b = (power((power((repetition * m + seed) % P) + m) % P) for m in (draws.FIRST, draws.SECOND))
    return power((power((power((number + a) % P) + b) % P) + a) % P)


def test_bulk_draws_equal_scalar_ones():
    got = draws.draws(draws.repetition_keys(np.arange(1, 6), 2027), np.array([0, 1, 7, P, P + 5, -3]))
    assert got.tolist() == [[scalar_draw(r, k % P, 2027) for k in (0, 1, 7, P, P + 5, -3)] for r in range(1, 6)]


def test_one_bucket_equals_scalar_resampling(spark):
    values = {"a": [0.5, 2.0, 8.0], "b": [float(i * i % 17) for i in range(40)], None: [4.0]}
    rows = [(s, i, v) for s, vs in values.items() for i, v in enumerate(vs)]
    units = spark.createDataFrame(rows, "scope string, unit bigint, d double").repartition(5)
    got = {(r.scope, r.repetition): r.resampled_mean
           for r in splits.bootstrap_means(units.where("scope IS NOT NULL"), ["scope"], "unit", "d", 30, 5).collect()}
    assert len(got) == 60
    for (scope, r), mean in got.items():
        vs = values[scope]
        picked = [vs[scalar_draw(r, i, 5) % len(vs)] for i in range(1, len(vs) + 1)]
        assert mean == pytest.approx(sum(picked) / len(vs), rel=1e-12)


@pytest.fixture()
def many_buckets(monkeypatch):
    monkeypatch.setattr(splits, "BUCKET_UNITS", 16)


def test_draws_split_over_buckets_add_up(spark, many_buckets):
    units = spark.range(500).select(F.when(F.col("id") < 450, "big").otherwise("small").alias("scope"),
                                    F.col("id").alias("unit"), F.lit(1.0).alias("d"))
    rows = splits.bootstrap_means(units, ["scope"], "unit", "d", 200, 3).collect()
    assert len(rows) == 400 and {r.resampled_mean for r in rows} == {1.0}  # n draws of n units in every repetition


def test_split_resamples_have_the_right_spread(spark, many_buckets):
    units = spark.range(400).select(F.lit("s").alias("scope"), F.col("id").alias("unit"), F.sqrt("id").alias("d"))
    means = [r.resampled_mean for r in splits.bootstrap_means(units, ["scope"], "unit", "d", 4000, 3).collect()]
    values = np.sqrt(np.arange(400))
    assert np.mean(means) == pytest.approx(values.mean(), abs=4 * values.std() / np.sqrt(400 * 4000))
    assert np.std(means) == pytest.approx(values.std() / 20, rel=0.05)
    again = splits.bootstrap_means(units.repartition(11), ["scope"], "unit", "d", 4000, 3)
    assert sorted(r.resampled_mean for r in again.collect()) == pytest.approx(sorted(means))


def test_split_resamples_treat_units_alike(spark, many_buckets):
    """How often single units of different buckets are drawn: mean one, variance one, no correlation but -1/n."""
    picks = [0, 1, 50, 199]
    counts = []
    for unit in picks:
        units = spark.range(200).select(F.col("id").alias("unit"), F.when(F.col("id") == unit, 200.0).otherwise(0.0).alias("d"))
        rows = splits.bootstrap_means(units, [], "unit", "d", 3000, 9).orderBy("repetition").collect()
        counts.append([r.resampled_mean for r in rows])
    counts = np.array(counts)
    assert np.abs(counts.mean(1) - 1).max() < 0.09 and np.abs(counts.var(1) - 0.995).max() < 0.15
    off = np.corrcoef(counts)[~np.eye(4, dtype=bool)]
    assert np.abs(off).max() < 0.09


def test_weighted_sums_equal_scalar_ones(spark):
    rows = [("a", 3, 1.5), ("a", 900, -2.0), ("b", 3, 8.0), ("b", 4, 0.25), ("b", 5, 1.0)]
    units = spark.createDataFrame(rows, "scope string, unit bigint, d double")
    for weight, of in (("sign", lambda h: 1 - 2 * (h & 1)), ("poisson", lambda h: sum(h / P >= c for c in splits.POISSON_CDF))):
        got = {(r.scope, r.repetition): (r.total, r.weight)
               for r in splits.weighted_sums(units, ["scope"], "unit", "d", 40, 7, weight).collect()}
        assert len(got) == 80
        for (scope, r), (total, weights) in got.items():
            mine = [(of(scalar_draw(r, u, 7)), d) for s, u, d in rows if s == scope]
            assert total == pytest.approx(sum(w * d for w, d in mine)) and weights == sum(w for w, _ in mine)


def test_text_units_and_no_units(spark):
    units = spark.createDataFrame([("s", f"u{i}", float(i)) for i in range(30)], "scope string, unit string, d double")
    p = statistics.sign_flip(units, ["scope"], "unit", "d", sampled=500).first()["pvalue"]
    assert 0 < p < 0.01
    empty = units.where("d < 0")
    assert splits.bootstrap_means(empty, ["scope"], "unit", "d", 10, 1).count() == 0
    assert splits.poisson_bootstrap_means(empty, ["scope"], "unit", "d", 10, 1).count() == 0
