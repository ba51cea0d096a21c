"""Registered queries: neighbours, scoring models and permutation importance."""

from __future__ import annotations

from pyspark.sql import functions as F

from selectra.operators import aggregates, learning, neighbours
from selectra.operators.learning import FeatureGroup, FeatureSet
from selectra.operators.ranking import exact_quantiles
from selectra.operators.selection import score_cases
from selectra.plans.bindings import SEED, Tables, sql
from selectra.plans.catalog import query
from selectra.plans.shaping import rounded, rounded_sql
from selectra.session import shared_dir
from selectra.sources.registries import expand_budgets
from selectra.sources.sinks import write_tables

FEATURES = ("f_price", "f_quantity", "f_discount")
STRUCTURE = ("num_nodes", "num_edges", "density", "average_degree", "degree_std", "min_degree", "max_degree", "triangle_count",
             "average_clustering", "transitivity", "component_count", "largest_component_fraction", "spectral_radius",
             "adjacency_spectral_gap", "algebraic_connectivity", "laplacian_spectral_radius", "triangle_density",
             "degree_assortativity", "average_shortest_path_length", "diameter")
FULL = FeatureSet("full", ("depth", "shots", *STRUCTURE), ("optimizer", "candidate", "family", "context"))
ABLATIONS = (
    FULL,
    FULL.without("without_structure", (*STRUCTURE, "family")),
    FULL.without("without_context", ("context",)),
    FULL.without("without_candidate", ("candidate",)),
)


def n_rows():
    return F.count(F.lit(1))


# C9, L11: nearest neighbours -------------------------------------------------------------

_NEAR = """based AS (SELECT f.*, s.split FROM features f JOIN splits s USING (entity)),
    moments AS (SELECT avg(f_price) AS mp, stddev_pop(f_price) AS sp, avg(f_quantity) AS mq, stddev_pop(f_quantity) AS sq,
      avg(f_discount) AS md, stddev_pop(f_discount) AS sd FROM based WHERE split = 'train'),
    z AS (SELECT entity, split, (f_price - mp) / sp AS a, (f_quantity - mq) / sq AS b, (f_discount - md) / sd AS c FROM based, moments),
    near AS (SELECT * FROM (SELECT t.entity, n.entity AS neighbour,
        sqrt((t.a - n.a) * (t.a - n.a) + (t.b - n.b) * (t.b - n.b) + (t.c - n.c) * (t.c - n.c)) AS distance,
        row_number() OVER (PARTITION BY t.entity ORDER BY
          sqrt((t.a - n.a) * (t.a - n.a) + (t.b - n.b) * (t.b - n.b) + (t.c - n.c) * (t.c - n.c)), n.entity) AS rank
      FROM z t JOIN z n ON t.split <> 'train' AND n.split = 'train') WHERE rank <= 5)"""


def near(t: Tables):
    rows = t.features.join(t.splits, "entity")
    train = rows.where("split = 'train'")
    z = neighbours.standardize(rows, train, FEATURES).select("entity", "split", *[f"z_{c}" for c in FEATURES])
    return neighbours.nearest(z.where("split <> 'train'"), z.where("split = 'train'"), "entity", [f"z_{c}" for c in FEATURES], 5)


@query("join_knn", rounded_sql(sql("SELECT entity, neighbour, distance, rank FROM near", "features", "splits", extra=_NEAR), "distance"))
def _(t: Tables):
    return rounded(near(t).select("entity", "neighbour", "distance", "rank"))


@query("concat_ids", sql("""
    SELECT entity, string_agg(CAST(neighbour AS VARCHAR), '|' ORDER BY rank) AS neighbour_ids FROM near GROUP BY ALL""",
    "features", "splits", extra=_NEAR))
def _(t: Tables):
    return neighbours.neighbour_lists(near(t), "entity")


@query("join_knn_lsh")
def _(t: Tables):
    """Long vectors: approximate neighbours among other labels' vectors."""
    rows = t.read("embeddings").select("vec_id", "embedding", "label")
    return rounded(neighbours.nearest_ranked(rows.where("label < 2"), rows.where("label >= 2"), "vec_id", "embedding", 5))


_HEURISTIC = _NEAR + """,
    means AS (SELECT n.entity, f.context, f.budget, f.candidate, round(avg(f.quality), 9) AS neighbour_quality
      FROM near n JOIN feasible f ON f.entity = n.neighbour GROUP BY ALL),
    chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, context, budget ORDER BY neighbour_quality DESC, candidate) AS k
      FROM means) WHERE k = 1),
    heuristic AS (SELECT c.entity, c.context, c.budget, c.candidate AS selected_candidate, c.neighbour_quality,
        max(CASE WHEN f.candidate = c.candidate THEN f.quality END) AS selected_quality, max(f.quality) AS oracle_quality
      FROM chosen c JOIN feasible f ON f.entity = c.entity AND f.context = c.context AND f.budget = c.budget GROUP BY ALL)"""


def heuristic(t: Tables):
    return neighbours.heuristic_cases(t.perf_split.drop("split"), near(t))


@query("knn_heuristic", rounded_sql(sql("""
    SELECT *, greatest(0, oracle_quality - selected_quality) AS regret,
           abs(selected_quality - oracle_quality) <= 1e-8 + 1e-5 * abs(oracle_quality) AS matches_oracle_quality FROM heuristic""",
    "features", "splits", "feasible", extra=_HEURISTIC), "neighbour_quality selected_quality oracle_quality regret"))
def _(t: Tables):
    return rounded(heuristic(t))


@query("knn_heuristic_summary", rounded_sql(sql("""
    SELECT CASE WHEN grouping(budget) = 1 AND grouping(context) = 1 THEN 'ALL' WHEN grouping(context) = 1 THEN budget ELSE context END AS scope,
           count(DISTINCT entity) AS entities, count(*) AS cases, avg(selected_quality) AS heuristic_mean, avg(oracle_quality) AS oracle_mean,
           avg(greatest(0, oracle_quality - selected_quality)) AS mean_regret,
           avg(CAST(abs(selected_quality - oracle_quality) <= 1e-8 + 1e-5 * abs(oracle_quality) AS INTEGER)) AS oracle_accuracy
    FROM heuristic GROUP BY GROUPING SETS ((), (budget), (context))""", "features", "splits", "feasible", extra=_HEURISTIC),
    "heuristic_mean oracle_mean mean_regret oracle_accuracy"))
def _(t: Tables):
    return rounded(aggregates.margin_summary(heuristic(t), ["budget", "context"], neighbours.heuristic_metrics()))


# L: models ------------------------------------------------------------------------------------

def model_rows(t: Tables, *splits: str):
    return t.part(*splits).join(t.structure, "entity")


_chosen: dict[tuple[str, str], learning.Chosen] = {}


def chosen(t: Tables) -> learning.Chosen:
    """The comparison of all four models at their published sizes; worked out once per session and folder, as several
    queries carry its winner on."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _chosen:
        _chosen[key] = learning.choose(model_rows(t, "train"), model_rows(t, "validation"), FULL)
    return _chosen[key]


@query("linear_scorer", rounded_sql(sql("""
    SELECT entity, context, candidate, score FROM scored""", "scored"), "score", 9))
def _(t: Tables):
    return rounded(t.scored.select("entity", "context", "candidate", "score"), 9)


@query("encode_features")
def _(t: Tables):
    """One-hot width and non-zero count of every encoded row."""
    encoded = learning.encode_features(model_rows(t, "train"), model_rows(t, "test"), FULL)
    from pyspark.ml.functions import vector_to_array

    values = vector_to_array("features")
    return encoded.select("entity", "context", "candidate", F.size(values).alias("width"),
                          F.size(F.filter(values, lambda x: x != 0)).alias("non_zero"))


def _scored_by(t: Tables, name: str):
    model = learning.MODELS[name](model_rows(t, "train"), FULL, "quality")
    return rounded(model(model_rows(t, "validation", "test")).select("entity", "split", "context", "candidate", "quality", "score"))


def _register_models():
    for name in learning.MODELS:
        query(name)(lambda t, name=name: _scored_by(t, name))


_register_models()


@query("score_candidates")
def _(t: Tables):
    """Any scoring function fits: here a fitted model, then the budgeted choice."""
    model = learning.fit_ridge(model_rows(t, "train"), FULL, "quality")
    return rounded(score_cases(expand_budgets(model(model_rows(t, "test")))))


@query("model_selection")
def _(t: Tables):
    """All four models by validation regret."""
    return rounded(chosen(t).results)


@query("model_ranking")
def _(t: Tables):
    """The single model that wins on validation regret."""
    return rounded(learning.rank_models(chosen(t).results).limit(1))


@query("feature_ablation")
def _(t: Tables):
    """The winner on the published feature sets."""
    best = chosen(t)
    return rounded(learning.ablate(learning.MODELS[best.name], model_rows(t, "train"), model_rows(t, "validation"), ABLATIONS,
                                   known={FULL: best.fitted[best.name]}))


def refitted(t: Tables, name: str):
    return learning.MODELS[name](model_rows(t, "train", "validation"), FULL, "quality")


@query("refit_and_evaluate")
def _(t: Tables):
    """The winner refitted on train and validation, then one evaluation on the test entities."""
    cases = score_cases(expand_budgets(refitted(t, chosen(t).name)(model_rows(t, "test"))), t.fixed)
    return rounded(aggregates.cube_summary(cases, ["budget", "context"], aggregates.selection_metrics()))


@query("rmse_selection")
def _(t: Tables):
    """The other published way: the model of least validation error, refitted, and its picks per context without
    budgets against the oracle's."""
    name = learning.by_error(chosen(t).results).first()["model"]
    cases = score_cases(refitted(t, name)(model_rows(t, "test")), case=("entity", "context"))
    picks = cases.withColumn("model", F.lit(name))
    return rounded(picks.groupBy("model", "context").agg(
        n_rows().alias("cases"), F.avg("selected_quality").alias("selected_mean"), F.avg("oracle_quality").alias("oracle_mean"),
        F.avg("regret").alias("mean_regret"), aggregates.share(F.col("selected_is_oracle")).alias("oracle_accuracy"),
        aggregates.share(F.col("oracle_in_top3")).alias("oracle_top3_accuracy")))


@query("final_job")
def _(t: Tables):
    """The final job as one plan; its tables are written below the shared folder, and its manifest is the result."""
    job = learning.finalise(model_rows(t, "train", "validation", "test"), FULL, ABLATIONS, MODEL_GROUPS, chosen(t), seed=SEED)
    write_tables(job.tables, shared_dir(t.spark, "final-job"))
    return rounded(job.tables["manifest"])


GROUPS = (
    *[FeatureGroup(c, (c,), "entity") for c in FEATURES],
    FeatureGroup("all_structure", FEATURES, "entity"),
    FeatureGroup("context", ("context",), "context"),
    FeatureGroup("descriptors", ("depth", "optimizer", "shots"), "candidate"),
    FeatureGroup("candidate", ("candidate",), "candidate"),
)
MODEL_GROUPS = (
    *[FeatureGroup(c, (c,), "entity") for c in STRUCTURE],
    FeatureGroup("all_structure", (*STRUCTURE, "family"), "entity"), FeatureGroup("family", ("family",), "entity"),
    *GROUPS[-3:],
)
IMPORTANCE_REPETITIONS = 30


def hand_score():
    """A fixed score in which every feature group interacts with the candidate."""
    line = F.substring("candidate", 3, 1).cast("double")
    code = F.when(F.col("context") == "A", 1.0).when(F.col("context") == "N", 2.0).otherwise(3.0)
    even = F.when(F.col("optimizer") == "SPSA", 1.0).otherwise(-1.0)
    return F.round(
        F.sin(line * F.col("f_price") / 1000.0) + F.cos(line * F.col("f_quantity")) * F.lit(0.5)
        + F.col("depth") * F.sin(F.col("f_discount") * 1000.0) * F.lit(0.3) + even * F.sin(code) * F.lit(0.2)
        + F.col("shots") / 512.0 * F.cos(code * F.col("f_quantity")) * F.lit(0.4), 9)


_HAND = """round(sin(CAST(substr(candidate, 3, 1) AS DOUBLE) * f_price / 1000) + cos(CAST(substr(candidate, 3, 1) AS DOUBLE) * f_quantity) * 0.5::DOUBLE
      + depth * sin(f_discount * 1000) * 0.3::DOUBLE
      + (CASE WHEN optimizer = 'SPSA' THEN 1 ELSE -1 END) * sin(CAST(CASE context WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS DOUBLE)) * 0.2::DOUBLE
      + shots / 512 * cos((CASE context WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END) * f_quantity) * 0.4::DOUBLE, 9)"""


def _swap(unit: str, groups: dict[str, tuple[str, ...]], columns: tuple[str, ...]) -> str:
    """Rows of all variants of one unit: columns of the group come from the donor."""
    order = lambda role: (
        f"row_number() OVER (PARTITION BY g, r ORDER BY md5('2027|' || g || '|' || CAST(r AS VARCHAR) || '|{role}|' || CAST(k AS VARCHAR)), k)")
    names = ", ".join(f"('{g}')" for g in groups)
    own = ", ".join(f"{c} AS d_{c}" for c in columns)
    every = ("entity", "context", "candidate", "depth", "optimizer", "shots", "quality", *FEATURES)

    def value(c: str) -> str:
        hit = [g for g, cols in groups.items() if c in cols]
        if not hit:
            return f"p.{c}"
        inside = ", ".join(f"'{g}'" for g in hit)
        return f"CASE WHEN a.g IN ({inside}) THEN b.d_{c} ELSE p.{c} END AS {c}"

    return f"""{unit}_units AS (SELECT g, r, k, d.* EXCLUDE (k), {order('take')} AS tk, {order('give')} AS gv
        FROM (SELECT DISTINCT {unit} AS k, {own} FROM base) d, (VALUES {names}) gs(g), (SELECT unnest(range(1, {IMPORTANCE_REPETITIONS + 1})) AS r)),
      {unit}_rows AS (SELECT a.g, a.r, p.entity AS case_entity, p.context AS case_context, p.candidate AS candidate_id, p.shots AS feasibility_cost,
        {", ".join(value(c) for c in every)}
        FROM base p JOIN {unit}_units a ON a.k = p.{unit} JOIN {unit}_units b ON a.g = b.g AND a.r = b.r AND a.tk = b.gv)"""


_IMPORTANCE = "base AS (SELECT p.*, f_price, f_quantity, f_discount FROM perf_split p JOIN features USING (entity) WHERE split = 'validation'),\n" + ",\n".join(
    _swap(unit, {g.name: g.columns for g in GROUPS if g.unit == unit}, tuple(sorted({c for g in GROUPS if g.unit == unit for c in g.columns})))
    for unit in ("entity", "context", "candidate")) + f""",
    plain AS (SELECT '' AS g, 0 AS r, entity AS case_entity, context AS case_context, candidate AS candidate_id, shots AS feasibility_cost,
      entity, context, candidate, depth, optimizer, shots, quality, f_price, f_quantity, f_discount FROM base),
    every AS (SELECT * FROM entity_rows UNION ALL SELECT * FROM context_rows UNION ALL SELECT * FROM candidate_rows UNION ALL SELECT * FROM plain),
    picks AS (SELECT g, r, case_entity, case_context, budget, quality, max(quality) OVER w AS top,
        row_number() OVER (PARTITION BY g, r, case_entity, case_context, budget ORDER BY {_HAND} DESC, candidate_id) AS k
      FROM every JOIN budgets ON feasibility_cost <= most WINDOW w AS (PARTITION BY g, r, case_entity, case_context, budget)),
    regrets AS (SELECT g, r, avg(greatest(0, top - quality)) AS regret FROM picks WHERE k = 1 GROUP BY ALL),
    importance AS (SELECT x.g AS feature_group, b.regret AS baseline_regret, avg(x.regret - b.regret) AS mean_increase,
        stddev_samp(x.regret - b.regret) AS std_increase, count(*) AS repetitions
      FROM regrets x, (SELECT regret FROM regrets WHERE r = 0) b WHERE x.r > 0 GROUP BY ALL)"""


def importance(t: Tables):
    rows = t.part("validation").join(t.features, "entity")
    return learning.permutation_importance(rows, learning.weighted_score(hand_score()), GROUPS, IMPORTANCE_REPETITIONS, SEED)


@query("permutation_importance", rounded_sql(sql("SELECT * FROM importance", "perf_split", "features", "budgets", extra=_IMPORTANCE),
                                             "baseline_regret mean_increase std_increase"))
def _(t: Tables):
    return rounded(importance(t))


@query("topn_importance", rounded_sql(sql("""
    SELECT feature_group, round(mean_increase, 9) AS mean_increase FROM importance ORDER BY mean_increase DESC, feature_group LIMIT 3""",
    "perf_split", "features", "budgets", extra=_IMPORTANCE), "mean_increase"))
def _(t: Tables):
    scored = importance(t).select("feature_group", F.round("mean_increase", 9).alias("mean_increase"))
    return rounded(learning.top_importance(scored, 3))


@query("permutation_importance_model")
def _(t: Tables):
    """The same measure for the fitted winner and its structural features."""
    best = chosen(t)
    return rounded(learning.permutation_importance(
        model_rows(t, "validation"), best.fitted[best.name], MODEL_GROUPS, IMPORTANCE_REPETITIONS, SEED))


@query("regret_quantiles", rounded_sql(sql("""
    SELECT budget, quantile_cont(regret, 0.5) AS p50, quantile_cont(regret, 0.9) AS p90 FROM cases GROUP BY ALL""", "cases"), "p50 p90"))
def _(t: Tables):
    return rounded(exact_quantiles(t.cases, ["budget"], "regret", {"p50": 0.5, "p90": 0.9}))
