"""Distributed ranks, quantiles, neighbours and resampling against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from selectra.operators import learning, neighbours, splits
from selectra.operators.learning import FeatureGroup
from selectra.operators.ranking import average_ranks, exact_quantiles, hash_rank
from tests.conftest import SMALL


def test_exact_quantiles_with_a_hot_value(spark):
    draw = random.Random(1)
    values = {"a": [0.5] * 400 + [draw.expovariate(1.0) for _ in range(777)], "b": [draw.gauss(0, 1e6) for _ in range(50)], "c": [3.25]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, x double").repartition(7)
    probs = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p975": 0.975, "p1": 1.0}
    for row in exact_quantiles(df, ["g"], "x", probs).collect():
        for name, p in probs.items():
            assert row[name] == pytest.approx(np.quantile(values[row["g"]], p), rel=1e-12)


def test_average_ranks(spark):
    df = spark.createDataFrame([("s", v) for v in (2.0, 1.0, 2.0, 5.0, 2.0)], "g string, x double")
    got = {r["x"]: r["avg_rank"] for r in average_ranks(df, ["g"], "x").collect()}
    assert got == {1.0: 1.0, 2.0: 3.0, 5.0: 5.0}


def test_hash_rank_is_a_permutation_and_ignores_partitions(spark):
    ids = spark.range(5000).withColumnRenamed("id", "k")
    first = {r["k"]: r["rank"] for r in hash_rank(ids.repartition(3), "k", 11).collect()}
    again = {r["k"]: r["rank"] for r in hash_rank(ids.repartition(13), "k", 11).collect()}
    assert first == again and sorted(first.values()) == list(range(1, 5001))


def test_results_do_not_depend_on_shuffle_width(spark, tables):
    import __spark_entry__ as contract

    width = spark.conf.get("spark.sql.shuffle.partitions")
    seen = []
    try:
        for parts in ("1", "64"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            seen.append(sorted(map(str, contract.queries()["test_cube_summary"](spark, tables.folder).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert seen[0] == seen[1]


@pytest.mark.parametrize("cell_rows", [4, 64])
def test_nearest_matches_brute_force(spark, cell_rows):
    draw = np.random.default_rng(4)
    hot = np.tile([[0.25, 0.25]], (120, 1))  # a third of the points are one point
    train = np.concatenate([hot, draw.normal(0, 0.05, (150, 2)), draw.uniform(-4, 4, (90, 2))])
    targets = np.concatenate([draw.uniform(-6, 6, (60, 2)), draw.normal(0, 0.05, (60, 2)), [[0.25, 0.25]]])
    frame = lambda rows, at: spark.createDataFrame(
        [(at + i, *map(float, p)) for i, p in enumerate(rows)], "id bigint, x double, y double")
    got = {}
    for r in neighbours.nearest(frame(targets, 10000), frame(train, 0), "id", ["x", "y"], 5, cell_rows).collect():
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"]))
    for i, p in enumerate(targets):
        d = np.sqrt(((train - p) ** 2).sum(1))
        expected = sorted(range(len(train)), key=lambda j: (d[j], j))[:5]
        assert [n for _, n in sorted(got[10000 + i])] == expected, i


def test_nearest_with_few_training_rows(spark):
    t = spark.createDataFrame([(1, 0.0, 0.0)], "id bigint, x double, y double")
    tr = spark.createDataFrame([(7, 1.0, 1.0), (8, 9.0, 9.0)], "id bigint, x double, y double")
    assert [r["neighbour"] for r in neighbours.nearest(t, tr, "id", ["x", "y"]).orderBy("rank").collect()] == [7, 8]


def test_bootstrap_interval_covers_the_mean(spark):
    df = spark.createDataFrame([("s", i, float(i % 10)) for i in range(400)], "scope string, unit bigint, d double")
    for means in (splits.bootstrap_means(df, ["scope"], "unit", "d", 300, 1),
                  splits.poisson_bootstrap_means(df, ["scope"], "unit", "d", 300, 1)):
        row = splits.percentile_interval(means, ["scope"]).first()
        assert row["ci_low"] < 4.5 < row["ci_high"]
        assert row["ci_high"] - row["ci_low"] == pytest.approx(2 * 1.96 * 2.872 / 20, rel=0.25)


def test_permutations_are_bijections(spark, tables):
    moved = splits.permute_by_entity(tables.features, ["f_price"], 5)
    key = lambda df: sorted(r["f_price"] for r in df.collect())
    assert key(moved) == key(tables.features)
    relabelled = splits.permute_labels(tables.perf, "context", 5)
    count = lambda df: sorted(r["count"] for r in df.groupBy("context").count().collect())
    assert count(relabelled) == count(tables.perf)


def test_permuted_cost_keeps_feasibility(spark, tables):
    moved = splits.permute_descriptors(tables.perf, ["depth", "shots", "optimizer"], 5)
    before = {(r["candidate"], r["shots"]) for r in tables.perf.select("candidate", "shots").distinct().collect()}
    after = {(r["candidate"], r["feasibility_cost"]) for r in moved.select("candidate", "feasibility_cost").distinct().collect()}
    assert before == after


def test_importance_of_an_unused_feature_is_zero(spark, tables):
    rows = tables.perf.join(tables.features, "entity")
    score = learning.weighted_score(F.col("quality"))
    row = learning.permutation_importance(rows, score, [FeatureGroup("f_price", ("f_price",), "entity")], 3).first()
    assert row["mean_increase"] == 0.0 and row["baseline_regret"] == 0.0


def test_labels_are_summed_before_they_are_spread_over_the_nodes(spark):
    """The rows of the measured strings are not multiplied by the nodes."""
    plan = contract.queries()["bitstring_labels"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the plan is printed from its end


def test_variants_are_spread_over_all_tasks_and_not_copied_per_budget(spark):
    """Small rows that each become one row per variant must not be packed into a few tasks."""
    rows = spark.createDataFrame(
        [(e, c, f"C{k}", k, "X", 256 * (1 + k % 2), (e * 7 + k * 3) % 11 / 11.0, float(e)) for e in range(8) for c in "AN" for k in range(4)],
        "entity bigint, context string, candidate string, depth bigint, optimizer string, shots bigint, quality double, f double")
    groups = [learning.FeatureGroup("f", ("f",), "entity"), learning.FeatureGroup("context", ("context",), "context")]
    plan = learning.permuted_variants(rows, groups, 3, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 4
    scored = learning.permutation_importance(rows, learning.weighted_score(F.col("f") + F.col("quality")), groups, 3, 1)
    assert "_fit" not in scored._jdf.queryExecution().logical().toString()
    assert {r["feature_group"]: r["repetitions"] for r in scored.collect()} == {"f": 3, "context": 3}


def test_edges_of_the_wide_graphs_are_made_once(spark, tables):
    """Graph operators read their edges many times; the runs behind them are read once."""
    assert tables.wide_edges is tables.wide_edges
    for df in (tables.wide_edges, tables.wide_vertices):
        assert "parquet" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
