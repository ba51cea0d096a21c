"""Registered queries: replicate and scope aggregates, rankings, choices, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from selectra.operators import aggregates, selection, splits
from selectra.operators.selection import CASE
from selectra.plans.bindings import CANDIDATES, CONTEXTS, SEED, Tables, sql
from selectra.plans.catalog import query
from selectra.plans.shaping import rounded, rounded_sql
from selectra.sources.registries import expand_budgets



def n_rows():
    return F.count(F.lit(1))


# D. Aggregations ---------------------------------------------------------------------

@query("agg_replicates", rounded_sql(sql("SELECT * FROM perf", "perf"), "quality best_quality cost price"))
def _(t: Tables):
    return rounded(t.perf)


@query("agg_replicates_std", rounded_sql(sql("""
    SELECT entity, context, candidate, avg(quality) AS mean, coalesce(stddev_samp(quality), 0) AS std, count(quality) AS n
    FROM runs GROUP BY ALL""", "runs"), "mean std"))
def _(t: Tables):
    return rounded(aggregates.replicate_spread(t.runs, ["entity", "context", "candidate"], "quality"))


@query("agg_describe", rounded_sql(sql("""
    SELECT 'oracle' AS label, context, avg(oracle_quality) AS mean, stddev_samp(oracle_quality) AS std,
           count(oracle_quality) AS n, median(oracle_quality) AS median FROM cases GROUP BY ALL
    UNION ALL SELECT 'fixed', context, avg(fixed_quality), stddev_samp(fixed_quality), count(fixed_quality),
           median(fixed_quality) FROM cases GROUP BY ALL""", "cases"), "mean std median"))
def _(t: Tables):
    both = F.array(F.struct(F.lit("oracle").alias("label"), F.col("oracle_quality").alias("value")),
                   F.struct(F.lit("fixed").alias("label"), F.col("fixed_quality").alias("value")))
    return rounded(aggregates.describe(t.cases.select("context", F.inline(both)), ["label", "context"], "value"))


@query("agg_distinct_count", sql("""
    SELECT entity, context, count(DISTINCT candidate) AS candidates FROM runs GROUP BY ALL""", "runs"))
def _(t: Tables):
    return aggregates.candidate_coverage(t.runs, "entity", "context", "candidate")


@query("agg_collect_set", sql("""
    SELECT entity, bool_or(context = 'A') AS "has_A", bool_or(context = 'N') AS "has_N", bool_or(context = 'R') AS "has_R"
    FROM gap_runs GROUP BY ALL""", "gap_runs"))
def _(t: Tables):
    return aggregates.context_sets(t.gap_runs, "entity", "context", CONTEXTS)


@query("agg_coverage_admission", sql("""
    SELECT entity, count(*) AS contexts, count(*) FILTER (n = 7) AS complete_contexts,
           count(*) = 3 AND count(*) FILTER (n = 7) = 3 AS admitted
    FROM (SELECT entity, context, count(DISTINCT candidate) AS n FROM gap_runs GROUP BY ALL) GROUP BY entity""", "gap_runs"))
def _(t: Tables):
    return aggregates.admit_complete(t.gap_runs, "entity", "context", "candidate", CONTEXTS, len(CANDIDATES))


_METRICS = """count(DISTINCT entity) AS entities, count(*) AS cases, avg(selected_quality) AS selected_mean,
    avg(fixed_quality) AS fixed_mean, avg(random_expected_quality) AS random_expected_mean, avg(oracle_quality) AS oracle_mean,
    avg(selected_minus_fixed) AS selected_minus_fixed,
    100 * avg(selected_minus_fixed) / avg(fixed_quality) AS relative_gain_percent, avg(regret) AS mean_regret,
    avg(CAST(selected_is_oracle AS INTEGER)) AS oracle_accuracy, avg(CAST(oracle_in_top3 AS INTEGER)) AS oracle_top3_accuracy"""
_METRIC_COLUMNS = ("selected_mean fixed_mean random_expected_mean oracle_mean selected_minus_fixed relative_gain_percent "
                   "mean_regret oracle_accuracy oracle_top3_accuracy")
_SCOPE = """CASE WHEN grouping(budget) = 1 AND grouping(context) = 1 THEN 'ALL' WHEN grouping(context) = 1 THEN budget
    WHEN grouping(budget) = 1 THEN context ELSE budget || '_' || context END AS scope"""


@query("agg_cube_summary", rounded_sql(sql(
    f"SELECT {_SCOPE}, {_METRICS} FROM cases GROUP BY CUBE (budget, context)", "cases"), _METRIC_COLUMNS))
def _(t: Tables):
    return rounded(aggregates.cube_summary(t.cases, ["budget", "context"], aggregates.selection_metrics()))


@query("agg_grouping_sets_summary", rounded_sql(sql(
    f"SELECT {_SCOPE}, {_METRICS} FROM cases GROUP BY GROUPING SETS ((), (budget), (context))", "cases"), _METRIC_COLUMNS))
def _(t: Tables):
    return rounded(aggregates.margin_summary(t.cases, ["budget", "context"], aggregates.selection_metrics()))


@query("agg_rollup_context", rounded_sql(sql(f"""
    SELECT CASE WHEN grouping(context) = 1 THEN 'ALL' ELSE context END AS scope, {_METRICS}
    FROM cases GROUP BY ROLLUP (context)""", "cases"), _METRIC_COLUMNS))
def _(t: Tables):
    return rounded(aggregates.rollup_summary(t.cases, "context", aggregates.selection_metrics()))


@query("agg_ratio_of_means", rounded_sql(sql("""
    SELECT context, 100 * avg(selected_minus_fixed) / avg(fixed_quality) AS ratio_of_means,
           avg(100 * selected_minus_fixed / fixed_quality) AS mean_of_ratios FROM cases GROUP BY ALL""", "cases"),
    "ratio_of_means mean_of_ratios"))
def _(t: Tables):
    each = F.try_divide(F.col("selected_minus_fixed") * 100.0, F.col("fixed_quality"))
    return rounded(t.cases.groupBy("context").agg(
        aggregates.relative_gain("selected_minus_fixed", "fixed_quality").alias("ratio_of_means"),
        F.avg(each).alias("mean_of_ratios")))


@query("agg_fraction", rounded_sql(sql("""
    SELECT budget, avg(CAST(selected_is_oracle AS INTEGER)) AS accuracy, avg(CAST(oracle_in_top3 AS INTEGER)) AS top3,
           avg(CAST(selected_minus_fixed > 0 AS INTEGER)) AS better, avg(CAST(abs(regret) < 1e-12 AS INTEGER)) AS zero_regret
    FROM cases GROUP BY ALL""", "cases"), "accuracy top3 better zero_regret"))
def _(t: Tables):
    share = aggregates.share
    return rounded(t.cases.groupBy("budget").agg(
        share(F.col("selected_is_oracle")).alias("accuracy"), share(F.col("oracle_in_top3")).alias("top3"),
        share(F.col("selected_minus_fixed") > 0).alias("better"), share(F.abs("regret") < 1e-12).alias("zero_regret")))


@query("agg_entity_level", rounded_sql(sql("""
    SELECT entity, avg(selected_quality) AS selected_mean, avg(oracle_quality) AS oracle_mean, avg(regret) AS regret_mean,
           avg(selected_quality) - avg(oracle_quality) AS difference FROM cases GROUP BY ALL""", "cases"),
    "selected_mean oracle_mean regret_mean difference"))
def _(t: Tables):
    means = t.cases.groupBy("entity").agg(
        F.avg("selected_quality").alias("selected_mean"), F.avg("oracle_quality").alias("oracle_mean"),
        F.avg("regret").alias("regret_mean"))
    return rounded(means.withColumn("difference", F.col("selected_mean") - F.col("oracle_mean")))


@query("agg_selection_metrics", rounded_sql(sql("""
    SELECT scope, avg(selected_quality) AS selection_mean, avg(oracle_quality) AS oracle_mean, avg(regret) AS mean_regret,
           avg(CAST(selected_is_oracle AS INTEGER)) AS accuracy, avg(CAST(oracle_in_top3 AS INTEGER)) AS top3, count(*) AS cases,
           median(regret) AS median_regret FROM (SELECT *, unnest(['ALL', budget]) AS scope FROM cases) GROUP BY scope""", "cases"),
    "selection_mean oracle_mean mean_regret accuracy top3 median_regret"))
def _(t: Tables):
    from selectra.operators.ranking import exact_quantiles

    cases = t.cases.withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("budget"))))
    basic = cases.groupBy("scope").agg(
        F.avg("selected_quality").alias("selection_mean"), F.avg("oracle_quality").alias("oracle_mean"),
        F.avg("regret").alias("mean_regret"), aggregates.share(F.col("selected_is_oracle")).alias("accuracy"),
        aggregates.share(F.col("oracle_in_top3")).alias("top3"), n_rows().alias("cases"))
    return rounded(basic.join(exact_quantiles(cases, ["scope"], "regret", {"median_regret": 0.5}), "scope"))


@query("agg_regression_metrics", rounded_sql(sql("""
    SELECT split, avg(abs(quality - score)) AS mae, sqrt(avg((quality - score) * (quality - score))) AS rmse,
           1 - sum((quality - score) * (quality - score)) / (var_pop(quality) * count(quality)) AS r2
    FROM scored GROUP BY ALL""", "scored"), "mae rmse r2"))
def _(t: Tables):
    return rounded(t.scored.groupBy("split").agg(
        *[c.alias(n) for n, c in aggregates.regression_metrics("quality", "score").items()]))


@query("agg_split_report", sql("""
    SELECT split, count(DISTINCT entity) AS entities, count(*) AS rows, count(*) FILTER (context = 'A') AS "rows_A",
           count(*) FILTER (context = 'N') AS "rows_N", count(*) FILTER (context = 'R') AS "rows_R" FROM perf_split GROUP BY ALL""",
    "perf_split"))
def _(t: Tables):
    return aggregates.split_report(t.perf_split, CONTEXTS)


@query("agg_reindex_dimension", rounded_sql(sql("""
    SELECT CAST(d.position AS BIGINT) AS position, d.context, m.selected_mean, m.oracle_mean FROM (VALUES (0, 'R'), (1, 'A'), (2, 'X'), (3, 'N')) d(position, context)
    LEFT JOIN (SELECT context, avg(selected_quality) AS selected_mean, avg(oracle_quality) AS oracle_mean FROM cases GROUP BY ALL) m
    USING (context)""", "cases"), "selected_mean oracle_mean"))
def _(t: Tables):
    means = t.cases.groupBy("context").agg(
        F.avg("selected_quality").alias("selected_mean"), F.avg("oracle_quality").alias("oracle_mean"))
    return rounded(aggregates.reindex(means, "context", ["R", "A", "X", "N"]))


@query("agg_candidate_observed", rounded_sql(sql("""
    SELECT c.candidate, count(k.selected_candidate) AS times_selected, avg(k.selected_quality) AS mean_quality
    FROM (SELECT DISTINCT candidate FROM runs) c LEFT JOIN cases k ON k.selected_candidate = c.candidate GROUP BY ALL""",
    "cases"), "mean_quality"))
def _(t: Tables):
    picked = t.cases.groupBy(F.col("selected_candidate").alias("candidate")).agg(
        n_rows().alias("times_selected"), F.avg("selected_quality").alias("mean_quality"))
    known = t.runs.select("candidate").distinct()
    return rounded(known.join(picked, "candidate", "left").select(
        "candidate", F.coalesce("times_selected", F.lit(0)).alias("times_selected"), "mean_quality"))


@query("agg_pivot_matrix", rounded_sql(sql("""
    SELECT budget, coalesce(avg(regret) FILTER (context = 'A'), 0) AS "A", coalesce(avg(regret) FILTER (context = 'N'), 0) AS "N",
           CAST(0 AS DOUBLE) AS "X" FROM cases GROUP BY ALL""", "cases"), "A N X"))
def _(t: Tables):
    return rounded(aggregates.pivot_matrix(t.cases, "budget", "context", ["A", "N", "X"], F.avg("regret")))


# E. Rankings and choices -----------------------------------------------------------------

@query("argmax_selection", rounded_sql(sql("""
    SELECT entity, context, budget, candidate, score, predicted_rank FROM ranked""", "ranked"), "score", 9))
def _(t: Tables):
    return rounded(selection.ranked(t.feasible).select(
        "entity", "context", "budget", "candidate", "score", "predicted_rank"), 9)


@query("argmax_oracle_in_pred_order", rounded_sql(sql("""
    SELECT entity, context, budget, oracle_candidate, oracle_quality FROM cases""", "cases"), "oracle_quality"))
def _(t: Tables):
    return rounded(selection.score_cases(t.feasible).select(*CASE, "oracle_candidate", "oracle_quality"))


@query("argmax_oracle_in_row_order", rounded_sql(sql("""
    SELECT entity, context, candidate, quality FROM (
      SELECT *, row_number() OVER (PARTITION BY entity, context ORDER BY quality DESC, candidate) AS k FROM perf) WHERE k = 1""",
    "perf"), "quality"))
def _(t: Tables):
    return rounded(selection.best_row(t.perf, ["entity", "context"], "quality", "candidate"))


@query("rank_of_target", sql("""
    SELECT entity, context, budget, oracle_predicted_rank, oracle_in_top3 FROM cases""", "cases"))
def _(t: Tables):
    return selection.score_cases(t.feasible).select(*CASE, "oracle_predicted_rank", "oracle_in_top3")


@query("regret", rounded_sql(sql("""
    SELECT entity, context, budget, regret, oracle_quality - selected_quality AS unclipped FROM cases""", "cases"), "regret unclipped"))
def _(t: Tables):
    return rounded(t.cases.select(*CASE, "regret", (F.col("oracle_quality") - F.col("selected_quality")).alias("unclipped")))


def _utility_sql(alphas: str, columns: str) -> str:
    return rounded_sql(sql(f"""
      SELECT {columns}, candidate AS oracle_candidate, utility AS oracle_utility, quality AS oracle_quality, cost AS oracle_cost FROM (
        SELECT *, row_number() OVER (PARTITION BY alpha, entity, context, budget ORDER BY cost, depth, shots, candidate) AS k FROM (
          SELECT *, max(utility) OVER (PARTITION BY alpha, entity, context, budget) AS top FROM (
            SELECT f.*, alpha, round(alpha * quality - (1 - alpha) * least(cost / 10240.0::DOUBLE, 1), 9) AS utility
            FROM feasible f, (SELECT unnest({alphas})::DOUBLE AS alpha)))
        WHERE utility >= top - 0.005::DOUBLE) WHERE k = 1""", "feasible"), "oracle_utility oracle_quality oracle_cost")


@query("utility_tie_selection", _utility_sql("[0.8]", "entity, context, budget"))
def _(t: Tables):
    return rounded(selection.utility_choice(expand_budgets(t.perf), normalizer=10240.0))


@query("utility_alpha_sensitivity", _utility_sql("[0.6, 0.7, 0.8, 0.9]", "alpha, entity, context, budget"))
def _(t: Tables):
    weighed = selection.with_alphas(expand_budgets(t.perf), (0.6, 0.7, 0.8, 0.9))
    return rounded(selection.utility_choice(weighed, ("alpha", *CASE), F.col("alpha"), 10240.0))


@query("fixed_choice_by_case", rounded_sql(sql("SELECT * FROM fixed", "fixed"), "train_mean_quality"))
def _(t: Tables):
    return rounded(t.fixed)


@query("fixed_choice_global", rounded_sql(sql("""
    SELECT candidate, round(avg(quality), 9) AS train_mean_quality FROM perf_split WHERE split = 'train'
    GROUP BY candidate ORDER BY train_mean_quality DESC, candidate LIMIT 1""", "perf_split"), "train_mean_quality"))
def _(t: Tables):
    return rounded(selection.fixed_global(t.part("train")))


@query("sorted_output", rounded_sql(sql("SELECT entity, context, candidate, quality FROM perf", "perf"), "quality"))
def _(t: Tables):
    return rounded(t.perf.select("entity", "context", "candidate", "quality")).orderBy("context", "entity", "candidate")


_SEQUENCE = ["measured_at", "price", "executions", "quality", "entity"]


@query("dedupe_keep_last", rounded_sql(sql("""
    SELECT replicate, candidate, entity, context, price FROM (
      SELECT *, row_number() OVER (PARTITION BY replicate, candidate
        ORDER BY measured_at DESC, price DESC, executions DESC, quality DESC, entity DESC, context DESC) AS k FROM runs)
    WHERE k = 1""", "runs"), "price"))
def _(t: Tables):
    rows = t.runs.select("replicate", "candidate", "context", *_SEQUENCE)
    return rounded(selection.keep_last(rows, ["replicate", "candidate"], _SEQUENCE).select(
        "replicate", "candidate", "entity", "context", "price"))


@query("dedupe_keep_first", sql("""
    SELECT l_orderkey AS replicate, min(l_suppkey) AS entity, count(DISTINCT l_suppkey) = 1 AS consistent FROM lineitem GROUP BY ALL"""))
def _(t: Tables):
    rows = t.runs.select("replicate", "entity")
    first = selection.keep_first(rows, ["replicate"], ["entity"])
    odd = selection.inconsistent_keys(rows, ["replicate"], ["entity"]).withColumn("_odd", F.lit(True))
    return first.join(odd, "replicate", "left").select(
        "replicate", "entity", F.col("_odd").isNull().alias("consistent"))


# J. Splits and permutations ------------------------------------------------------------------

@query("entity_split", sql("SELECT entity, split FROM splits", "splits"))
def _(t: Tables):
    return t.splits


@query("split_from_table", sql("""
    SELECT split, context, count(*) AS n FROM perf_split GROUP BY ALL""", "perf_split"))
def _(t: Tables):
    """A stored assignment is read back instead of drawn again."""
    from selectra.session import shared_dir
    from selectra.sources.sinks import write_tables

    [path] = write_tables({"assignment": t.splits}, shared_dir(t.spark, "splits"))
    frozen = t.spark.read.parquet(path)
    return splits.assign_split(t.perf, frozen, "entity").groupBy("split", "context").agg(n_rows().alias("n"))


@query("split_integrity", sql("""
    SELECT (SELECT count(*) FROM (SELECT entity FROM perf_split GROUP BY entity HAVING count(DISTINCT split) > 1)) AS entities_in_two_splits,
           (SELECT count(*) FROM (VALUES ('train'), ('validation'), ('test')) v(s) WHERE s NOT IN (SELECT split FROM perf_split)) AS unexpected_splits,
           (SELECT count(*) FROM (SELECT 1 FROM perf_split GROUP BY entity, context HAVING count(DISTINCT candidate) <> 7)) AS incomplete_cells,
           (SELECT count(*) FROM (SELECT 1 FROM perf_split GROUP BY entity, context, candidate HAVING count(*) > 1)) AS duplicate_rows""",
    "perf_split"))
def _(t: Tables):
    return splits.split_integrity(t.perf_split, len(CANDIDATES))


@query("disjointness_check", sql("""
    SELECT count(*) AS entities, count(*) FILTER (n > 1) AS overlapping
    FROM (SELECT entity, count(DISTINCT split) AS n FROM perf_split GROUP BY entity)""", "perf_split"))
def _(t: Tables):
    return splits.disjointness(t.perf_split)


@query("random_expectation", rounded_sql(sql("""
    SELECT entity, context, budget, avg(quality) AS random_expected_quality FROM feasible GROUP BY ALL""", "feasible"),
    "random_expected_quality"))
def _(t: Tables):
    return rounded(splits.random_expectation(expand_budgets(t.perf), CASE))


@query("random_choice_baseline", rounded_sql(sql("""
    SELECT entity, context, candidate, quality FROM (
      SELECT *, row_number() OVER (PARTITION BY entity, context
        ORDER BY md5('2027|' || CAST(entity AS VARCHAR) || '|' || context || '|' || candidate)) AS k FROM perf) WHERE k = 1""",
    "perf"), "quality"))
def _(t: Tables):
    return rounded(selection.random_choice(t.perf, ["entity", "context"], SEED).select("entity", "context", "candidate", "quality"))


_PERMUTED = """ordered AS (SELECT u.*, row_number() OVER (ORDER BY md5('2027|take|' || CAST(k AS VARCHAR)), k) AS tk,
      row_number() OVER (ORDER BY md5('2027|give|' || CAST(k AS VARCHAR)), k) AS gv FROM units u)"""


@query("permute_by_entity", rounded_sql(sql("""
    SELECT a.k AS entity, b.f_price, b.f_quantity, a.f_discount FROM ordered a JOIN ordered b ON a.tk = b.gv""",
    "features", extra="units AS (SELECT entity AS k, f_price, f_quantity, f_discount FROM features),\n" + _PERMUTED),
    "f_price f_quantity f_discount"))
def _(t: Tables):
    return rounded(splits.permute_by_entity(t.features, ["f_price", "f_quantity"], SEED).select(
        "entity", "f_price", "f_quantity", "f_discount"))


@query("permute_labels_bijection", rounded_sql(sql("""
    SELECT p.entity, b.k AS context, p.candidate, p.quality FROM perf p JOIN ordered a ON a.k = p.context
    JOIN ordered b ON a.tk = b.gv""", "perf",
    extra="units AS (SELECT DISTINCT context AS k FROM perf),\n" + _PERMUTED), "quality"))
def _(t: Tables):
    return rounded(splits.permute_labels(t.perf.select("entity", "context", "candidate", "quality"), "context", SEED).select(
        "entity", "context", "candidate", "quality"))


@query("permute_candidate_descriptors", sql("""
    SELECT p.candidate, b.depth, b.shots, b.optimizer, p.shots AS feasibility_cost, count(*) AS n FROM perf p
    JOIN ordered a ON a.k = p.candidate JOIN ordered b ON a.tk = b.gv GROUP BY ALL""", "perf",
    extra="units AS (SELECT DISTINCT candidate AS k, depth, shots, optimizer FROM perf),\n" + _PERMUTED))
def _(t: Tables):
    moved = splits.permute_descriptors(t.perf, ["depth", "shots", "optimizer"], SEED)
    return moved.groupBy("candidate", "depth", "shots", "optimizer", "feasibility_cost").agg(n_rows().alias("n"))


# K9. Comparison with references ------------------------------------------------------------------

@query("score_against_references", rounded_sql(sql("""
    SELECT entity, context, budget, selected_candidate, selected_quality, fixed_candidate, fixed_quality, random_expected_quality,
           oracle_candidate, oracle_quality, selected_minus_fixed FROM test_cases""", "test_cases"),
    "selected_quality fixed_quality random_expected_quality oracle_quality selected_minus_fixed"))
def _(t: Tables):
    return rounded(t.test_cases.select(
        *CASE, "selected_candidate", "selected_quality", "fixed_candidate", "fixed_quality", "random_expected_quality",
        "oracle_candidate", "oracle_quality", "selected_minus_fixed"))


@query("test_cube_summary", rounded_sql(sql(
    f"SELECT {_SCOPE}, {_METRICS} FROM test_cases GROUP BY CUBE (budget, context)", "test_cases"), _METRIC_COLUMNS))
def flagship(t: Tables):
    """Which candidate per entity, context and budget, and how good is the choice on unseen entities?"""
    return rounded(aggregates.cube_summary(t.test_cases, ["budget", "context"], aggregates.selection_metrics()))


