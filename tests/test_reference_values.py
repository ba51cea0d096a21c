"""Published or hand-computable numbers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from selectra.functions import scalar
from selectra.operators import aggregates, graphs, learning, selection, splits, statistics
from selectra.operators.learning import FeatureSet
from selectra.sources import registries

# fixed values: published mean differences per test entity, and paired differences per context
ENTITY_MEANS = [
    0.0377952938988095, 0.0025921103395062, 0.0248183383736559, 0.00357511673850578, -0.00195651584201391,
    0.00899402006172837, 0.000151909722222214, 0.00330284552845526, 0.00891927083333333, -0.01826171875,
    -0.0212983630952381, 0.00130208333333333, 0.00882161458333334, -0.0409939236111111]
PAIRED = {
    "N0": [0.0949358258929, 0.0137803819444, 0.0699974798387, 0.0133351293103, -0.00406901041667, 0.0, 0.0453776041667,
           0.00435880335366, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0],
    "N1": [0.000418526785714, 0.00831886574074, 0.0229649697581, 0.00680226293103, -0.000203450520833, 0.0, -0.0200954861111,
           0.00181021341463, -0.00703125, 0.02666015625, 0.015625, 0.0078125, 0.0210286458333, -0.0604166666667],
    "N2": [0.00823102678571, -0.00459346064815, 0.0021736391129, 0.00959725215517, 0.000732421875, 0.0, -0.0155598958333,
           -0.00023818597561, 0.01640625, 0.03974609375, 0.0448521205357, 0.0292271205357, 0.0397135416667, -0.0198567708333],
}


def units(spark, values, scope="ALL"):
    return spark.createDataFrame([(scope, i, float(v)) for i, v in enumerate(values)], "scope string, unit bigint, d double")


def test_sign_flip_published(spark):
    assert statistics.sign_flip(units(spark, ENTITY_MEANS), ["scope"], "unit", "d").first()["pvalue"] == 0.809814453125


@pytest.mark.parametrize("values, p", [([1, 1], 0.5), ([0, 0], 1.0)])
def test_sign_flip_small(spark, values, p):
    assert statistics.sign_flip(units(spark, values), ["scope"], "unit", "d").first()["pvalue"] == p


def test_sign_flip_limit_and_sampling(spark):
    many = units(spark, [0.1] * 15 + [-0.1] * 10)
    with pytest.raises(Exception, match="20 units"):
        statistics.sign_flip(many, ["scope"], "unit", "d").collect()
    sampled = statistics.sign_flip(many, ["scope"], "unit", "d", sampled=4000).first()["pvalue"]
    assert abs(sampled - 0.424) < 0.03  # P(|15 - 10| or more extreme) for 25 fair signs


def test_wilcoxon_published(spark):
    rows = [(s, v) for c, vs in PAIRED.items() for v in vs for s in ("ALL", c)]
    df = spark.createDataFrame(rows, "scope string, d double")
    got = {r["scope"]: r for r in statistics.with_pvalue(statistics.signed_rank(df, ["scope"], "d")).collect()}
    assert (got["ALL"]["n"], got["ALL"]["w_plus"], got["ALL"]["w_minus"]) == (33, 439.0, 122.0)
    for scope, p in {"ALL": 0.004625, "N0": 0.027992, "N1": 0.221330, "N2": 0.086860}.items():
        assert got[scope]["pvalue"] == pytest.approx(p, abs=1e-6)


def test_paired_report_published(spark):
    rows = [("ALL", v + 0.7, 0.7, v) for vs in PAIRED.values() for v in vs]
    df = spark.createDataFrame(rows, "scope string, l double, r double, difference double")
    row = statistics.paired_report(df, "scope", "l", "r").first()
    for name, value in {"mean_difference": 0.009806, "median_difference": 0.001992, "std_difference": 0.025017,
                        "ci95_low": 0.002240, "ci95_high": 0.017372, "cohens_d": 0.391970, "better_fraction": 0.571429}.items():
        assert row[name] == pytest.approx(value, abs=1e-6)


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.9)], "scope string, p double")
    got = {r["scope"]: r["holm_pvalue"] for r in statistics.holm(df, "p").collect()}
    assert got == pytest.approx({"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.9})


def test_intervals_of_one_observation(spark):
    df = units(spark, [0.25])
    for single, expected in (("mean", 0.25), ("null", None)):
        row = df.agg(*[c.alias(n) for n, c in statistics.normal_interval("d", single).items()]).first()
        assert row["ci95_low"] == expected and row["ci95_high"] == expected


def test_registry(spark):
    rows = registries.candidate_registry(spark).orderBy("candidate").collect()
    assert len(rows) == 12
    assert (rows[0]["candidate"], rows[0]["depth"], rows[0]["optimizer"], rows[0]["shots"]) == ("C01", 1, "COBYLA", 256)
    assert (rows[11]["candidate"], rows[11]["depth"], rows[11]["optimizer"], rows[11]["shots"]) == ("C12", 3, "SPSA", 512)


def test_manifest(spark):
    instances = spark.createDataFrame(
        [(f, i) for f in ("erdos_renyi", "random_regular") for i in range(1, 11)], "family string, position int")
    rows = registries.entity_manifest(instances, "family", (10, 12, 15, 18, 20), "position").orderBy("graph_id").collect()
    assert len(rows) == 100
    first, last = rows[0], rows[99]
    assert (first["graph_id"], first["family"], first["num_nodes"], first["seed"]) == ("G0001", "erdos_renyi", 10, 10000)
    assert first["probability"] == 0.35 and first["degree"] is None
    assert (last["graph_id"], last["num_nodes"], last["seed"], last["degree"]) == ("G0100", 20, 10099, 4)


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.safe_ratio(F.lit(5), F.lit(10)).alias("half"), scalar.safe_ratio(F.lit(0), F.lit(0)).alias("one"),
        scalar.safe_ratio(F.lit(3), F.lit(0)).alias("zero"), scalar.parse_vector(F.lit("( 0.5, -1e-3,, ]")).alias("v"),
        scalar.parse_vector(F.lit("()")).alias("none"), scalar.density(F.lit(10), F.lit(12)).alias("d"),
        scalar.clip_upper(F.lit(None).cast("double"), 1.0).alias("keep"),
        scalar.run_id(F.lit("G0001"), F.lit("C01"), F.lit("N0"), F.lit(1000)).alias("id"),
        scalar.bit_label(F.lit("0011"), F.lit(0), F.lit(4)).alias("b0"), scalar.mask_label(F.lit(3), F.lit(2)).alias("m2"),
    ).first()
    assert (row["half"], row["one"], row["zero"]) == (0.5, 1.0, 0.0)
    assert row["v"] == [0.5, -1e-3] and row["none"] == []
    assert row["d"] == pytest.approx(0.2667, abs=1e-4) and row["keep"] is None
    assert row["id"] == "G0001_C01_N0_S1000" and (row["b0"], row["m2"]) == (1, 0)


def test_budget_respected(spark):
    rows = [("G1", "N0", "C01", 256, 0.2, 0.6), ("G1", "N0", "C02", 512, 0.9, 0.8)]
    df = spark.createDataFrame(rows, "entity string, context string, candidate string, shots bigint, score double, quality double")
    picked = {r["budget"]: r for r in selection.score_cases(registries.expand_budgets(df)).collect()}
    assert picked["B256"]["selected_candidate"] == "C01" and picked["B512"]["selected_candidate"] == "C02"
    fixed = {r["budget"]: r["fixed_candidate"] for r in selection.fixed_by_case(registries.expand_budgets(df)).collect()}
    assert fixed == {"B256": "C01", "B512": "C02"}


def test_oracle_tie_follows_the_prediction(spark):
    rows = [("G1", "N0", "C01", 256, 0.1, 0.8), ("G1", "N0", "C02", 256, 0.9, 0.8)]
    df = spark.createDataFrame(rows, "entity string, context string, candidate string, shots bigint, score double, quality double")
    row = selection.score_cases(registries.expand_budgets(df, [("B256", 256)])).first()
    assert row["oracle_candidate"] == "C02" and row["selected_is_oracle"] and row["regret"] == 0.0
    assert selection.best_row(df, ["entity"], "quality", "candidate").first()["candidate"] == "C01"


def fixture_split(spark, leak=False):
    rows = [(f"G{g}", f"C{c:02d}", "N0", s, 256 if c <= 6 else 512, c / 12)
            for g, s in ((1, "train"), (2, "validation"), (3, "test")) for c in range(1, 13)]
    if leak:
        rows[-1] = ("G1", *rows[-1][1:])
    return spark.createDataFrame(
        rows, "entity string, candidate string, context string, split string, shots bigint, quality double")


def test_split_integrity(spark):
    clean = splits.split_integrity(fixture_split(spark), 12).first()
    assert tuple(clean) == (0, 0, 0, 0)
    leaky = splits.split_integrity(fixture_split(spark, leak=True), 12).first()
    assert leaky["entities_in_two_splits"] == 1 and leaky["duplicate_rows"] == 1


def test_split_sizes(spark):
    ids = spark.range(89).withColumnRenamed("id", "entity")
    sizes = {r["split"]: r["count"] for r in splits.entity_split(ids, "entity", 2027).groupBy("split").count().collect()}
    assert sizes == {"train": 62, "validation": 13, "test": 14}


@pytest.mark.parametrize("edges, n, best", [
    ([(0, 1), (1, 2), (2, 3), (0, 3)], 4, 4),
    ([(i, i + 1) for i in range(5)] + [(0, 5)], 6, 6),
    ([(0, 1), (0, 2), (1, 2)], 3, 2),
    ([], 2, 0),
])
def test_maxcut(spark, edges, n, best):
    e = spark.createDataFrame([(1, u, v) for u, v in edges], "graph_id bigint, u bigint, v bigint")
    v = spark.createDataFrame([(1, i) for i in range(n)], "graph_id bigint, node bigint")
    assert graphs.exact_maxcut(v, e).first()["optimum"] == best


def test_maxcut_limit(spark):
    v = spark.createDataFrame([(1, i) for i in range(21)], "graph_id bigint, node bigint")
    e = spark.createDataFrame([(1, 0, 20)], "graph_id bigint, u bigint, v bigint")
    with pytest.raises(Exception, match="limited"):
        graphs.exact_maxcut(v, e).collect()


def test_weighted_counts(spark):
    df = spark.createDataFrame([(1, 4, 3), (1, 2, 1), (2, 5, 0)], "graph_id bigint, cut bigint, freq bigint")
    got = {r["graph_id"]: r for r in aggregates.weighted_expectation(df, ["graph_id"], "cut", "freq").collect()}
    assert (got[1]["expected"], got[1]["best"]) == (3.5, 4) and got[2]["expected"] is None


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(200, 3)) * [1.0, 5.0, 0.2] + [0.0, 3.0, -1.0]
    y = x @ [0.5, -0.1, 2.0] + rng.normal(scale=0.1, size=200)
    rows = [(*map(float, a), float(b)) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "a double, b double, c double, quality double")
    got = np.array([r["score"] for r in learning.fit_ridge(df, FeatureSet("f", ("a", "b", "c"), ()), "quality")(df)
                    .orderBy("quality").select("score").collect()])
    z = x / x.std(axis=0)
    centred = z - z.mean(axis=0)
    w = np.linalg.solve(centred.T @ centred + np.eye(3), centred.T @ (y - y.mean()))
    expected = (centred @ w + y.mean())[np.argsort(y)]
    assert np.allclose(got, expected, atol=1e-8)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (4.0, 3.0)], "y double, p double")
    row = df.agg(*[c.alias(n) for n, c in aggregates.regression_metrics("y", "p").items()]).first()
    assert row["mae"] == pytest.approx(0.5) and row["rmse"] == pytest.approx(math.sqrt(1.25 / 3))
    assert row["r2"] == pytest.approx(1 - 1.25 / (14 / 3))
