"""Registered queries: paired statistics, resampling and randomisation tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from selectra.functions.draws import PRIME, draws_sql, keys_sql
from selectra.functions.scalar import ERFC_FIT
from selectra.operators import aggregates, splits, statistics
from selectra.operators.ranking import average_ranks
from selectra.operators.selection import fixed_global
from selectra.plans.bindings import SEED, Tables, sql
from selectra.plans.catalog import query
from selectra.plans.shaping import rounded, rounded_sql

# the published numbers of resamples and of sign vectors
REPETITIONS = 10_000
DRAWS = 10_000


def n_rows():
    return F.count(F.lit(1))


_PAIRS = """picked AS (SELECT entity, context, candidate, quality AS selected FROM (
      SELECT *, row_number() OVER (PARTITION BY entity, context ORDER BY score DESC, candidate) AS k FROM scored) WHERE k = 1),
    globally AS (SELECT candidate FROM perf_split WHERE split = 'train' GROUP BY candidate
      ORDER BY round(avg(quality), 9) DESC, candidate LIMIT 1),
    pairs AS (SELECT p.entity, p.context, p.selected, q.quality AS fixed, round(p.selected - q.quality, 9) AS difference
      FROM picked p JOIN perf q ON q.entity = p.entity AND q.context = p.context JOIN globally g ON g.candidate = q.candidate)"""


def pairs(t: Tables):
    """Selected quality against the one globally fixed candidate, without budgets."""
    from selectra.operators.selection import best_row

    picked = best_row(t.scored, ["entity", "context"], "score", "candidate", ["quality"]).withColumnRenamed("quality", "selected")
    choice = fixed_global(t.part("train")).select("candidate")
    fixed = t.perf_split.join(choice, "candidate").select("entity", "context", F.col("quality").alias("fixed"))
    return statistics.paired_difference(picked, fixed, ["entity", "context"], "selected", "fixed", check=False)


@query("paired_diff", rounded_sql(sql("""
    SELECT entity, context, selected, fixed, difference, 100 * difference / fixed AS relative_percent FROM pairs""",
    "scored", extra=_PAIRS), "selected fixed difference relative_percent"))
def _(t: Tables):
    return rounded(pairs(t).withColumn("relative_percent", statistics.relative_gap("difference", "fixed")))


@query("normal_ci95", rounded_sql(sql("""
    SELECT context, avg(regret) AS mean, avg(regret) - 1.96::DOUBLE * stddev_samp(regret) / sqrt(count(regret)) AS ci95_low,
           avg(regret) + 1.96::DOUBLE * stddev_samp(regret) / sqrt(count(regret)) AS ci95_high FROM cases GROUP BY ALL""", "cases"),
    "mean ci95_low ci95_high"))
def _(t: Tables):
    return rounded(t.cases.groupBy("context").agg(
        F.avg("regret").alias("mean"), *[c.alias(n) for n, c in statistics.normal_interval("regret").items()]))


@query("paired_cohens_d", rounded_sql(sql("""
    SELECT context, avg(selected_minus_fixed) / nullif(stddev_samp(selected_minus_fixed), 0) AS cohens_d FROM cases GROUP BY ALL""",
    "cases"), "cohens_d"))
def _(t: Tables):
    return rounded(t.cases.groupBy("context").agg(statistics.cohens_d("selected_minus_fixed").alias("cohens_d")))


_RANKED = _PAIRS + """,
    sized AS (SELECT context, abs(difference) AS size, difference > 0 AS up FROM pairs WHERE difference <> 0),
    ranks AS (SELECT *, rank() OVER (PARTITION BY context ORDER BY size) + (count(*) OVER (PARTITION BY context, size) - 1) / 2.0::DOUBLE AS r,
      count(*) OVER (PARTITION BY context, size) AS t FROM sized)"""


@query("wilcoxon_ranks", rounded_sql(sql("""
    SELECT context, size, count(*) AS ties, avg(r) AS avg_rank FROM ranks GROUP BY ALL""", "scored", extra=_RANKED), "size avg_rank"))
def _(t: Tables):
    sizes = pairs(t).where("difference <> 0").select("context", F.abs("difference").alias("size"))
    return rounded(average_ranks(sizes, ["context"], "size").select("context", "size", "ties", "avg_rank"))


@query("wilcoxon_signed_rank", rounded_sql(sql("""
    SELECT context, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus, coalesce(least(w_plus, w_minus), 0) AS statistic,
           (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - tie / 48.0::DOUBLE) AS z
    FROM (SELECT context, count(*) AS n, coalesce(sum(r) FILTER (up), 0) AS w_plus, coalesce(sum(r) FILTER (NOT up), 0) AS w_minus,
                 sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM ranks GROUP BY context)
    RIGHT JOIN (SELECT DISTINCT context FROM pairs) USING (context)""", "scored", extra=_RANKED),
    "w_plus w_minus statistic z"))
def _(t: Tables):
    return rounded(statistics.signed_rank(pairs(t), ["context"], "difference"))


def _p_sql(z: str) -> str:
    """The p-value of a normal score, by the fit that the column expression uses."""
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1 / (1 + {x} / 2))"
    fit = "0.0::DOUBLE"
    for c in reversed(ERFC_FIT):
        fit = f"({fit} * {t} + {c!r}::DOUBLE)"
    return f"least(1.0::DOUBLE, {t} * exp({fit} - {x} * {x}))"


def _rank_sql(scopes: str) -> str:
    return f"""scoped AS (SELECT unnest({scopes}) AS scope, selected, fixed, difference FROM pairs),
    sizes AS (SELECT scope, abs(difference) AS size, difference > 0 AS up FROM scoped WHERE difference <> 0),
    placed AS (SELECT *, rank() OVER (PARTITION BY scope ORDER BY size) + (count(*) OVER (PARTITION BY scope, size) - 1) / 2.0::DOUBLE AS r,
      count(*) OVER (PARTITION BY scope, size) AS t FROM sizes),
    ranked AS (SELECT scope, coalesce(n, 0) AS n, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus,
        coalesce(least(w_plus, w_minus), 0) AS statistic,
        (least(w_plus, w_minus) - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1.0::DOUBLE) * (2 * n + 1) / 24 - tie / 48.0::DOUBLE) AS z
      FROM (SELECT scope, count(*) AS n, coalesce(sum(r) FILTER (up), 0) AS w_plus, coalesce(sum(r) FILTER (NOT up), 0) AS w_minus,
            sum(CAST(t AS DOUBLE) * t - 1) AS tie FROM placed GROUP BY scope)
      RIGHT JOIN (SELECT DISTINCT scope FROM scoped) USING (scope))"""


@query("wilcoxon_pvalue", rounded_sql(sql(f"""
    SELECT scope AS context, n, w_plus, w_minus, statistic, z, {_p_sql("z")} AS pvalue FROM ranked""",
    "scored", extra=_PAIRS + ",\n    " + _rank_sql("[context]")), "w_plus w_minus statistic z pvalue"))
def _(t: Tables):
    return rounded(statistics.with_pvalue(statistics.signed_rank(pairs(t), ["context"], "difference")))


@query("paired_report", rounded_sql(sql(f"""
    SELECT scope, pairs, left_mean, right_mean, mean_difference, std_difference,
           CASE WHEN pairs > 1 THEN mean_difference - 1.96 * std_difference / sqrt(pairs) END AS ci95_low,
           CASE WHEN pairs > 1 THEN mean_difference + 1.96 * std_difference / sqrt(pairs) END AS ci95_high,
           mean_difference / nullif(std_difference, 0) AS cohens_d, better_fraction, median_difference, statistic, z, {_p_sql("z")} AS pvalue
    FROM (SELECT scope, count(*) AS pairs, avg(selected) AS left_mean, avg(fixed) AS right_mean, avg(difference) AS mean_difference,
                 stddev_samp(difference) AS std_difference, avg(CAST(difference > 0 AS INTEGER)) AS better_fraction,
                 median(difference) AS median_difference FROM scoped GROUP BY scope) JOIN ranked USING (scope)""",
    "scored", extra=_PAIRS + ",\n    " + _rank_sql("['ALL', context]")),
    "left_mean right_mean mean_difference std_difference ci95_low ci95_high cohens_d better_fraction median_difference statistic z pvalue"))
def _(t: Tables):
    scoped = pairs(t).withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("context"))))
    return rounded(statistics.paired_report(scoped, "scope", "selected", "fixed"))


_FLIPS = """numbered AS (SELECT scope, difference AS x, row_number() OVER (PARTITION BY scope ORDER BY unit) - 1 AS i,
      count(*) OVER (PARTITION BY scope) AS n, abs(avg(difference) OVER (PARTITION BY scope)) AS observed FROM nation_units),
    vectors AS (SELECT scope, v, abs(sum(CASE WHEN (v >> CAST(i AS INTEGER)) & 1 = 1 THEN -x ELSE x END) / max(n)) AS m, max(observed) AS o
      FROM numbered, (SELECT unnest(range(1 << 20)) AS v) WHERE v < (CAST(1 AS BIGINT) << CAST(n AS INTEGER)) GROUP BY scope, v),
    flips AS (SELECT s.scope, s.units, avg(CAST(m >= o - 1e-15 AS INTEGER)) AS pvalue FROM vectors
      JOIN (SELECT scope, count(*) AS units FROM nation_units GROUP BY ALL) s USING (scope) GROUP BY ALL)"""


@query("sign_flip_exact", rounded_sql(sql("SELECT scope, units, pvalue FROM flips", "nation_units", extra=_FLIPS), "pvalue", 9))
def _(t: Tables):
    """Nations are the units (at most 20 per context and region), all sign vectors are tried."""
    return rounded(statistics.sign_flip(t.nation_units, ["scope"], "unit", "difference"), 9)


@query("holm_adjust", rounded_sql(sql("""
    SELECT scope, pvalue, max(least(1.0::DOUBLE, (m - k + 1) * pvalue)) OVER (ORDER BY k) AS holm_pvalue FROM (
      SELECT *, row_number() OVER (ORDER BY pvalue, scope) AS k, count(*) OVER () AS m FROM flips)""",
    "nation_units", extra=_FLIPS), "pvalue holm_pvalue", 9))
def _(t: Tables):
    tests = statistics.sign_flip(t.nation_units, ["scope"], "unit", "difference").withColumn("pvalue", F.round("pvalue", 12))
    return rounded(statistics.holm(tests, "pvalue").drop("units"), 9)


@query("stratified_sign_vectors", rounded_sql(sql("""
    SELECT scope, v, sum(CASE WHEN (v >> CAST(i AS INTEGER)) & 1 = 1 THEN x ELSE -x END) AS total
    FROM (SELECT scope, difference AS x, row_number() OVER (PARTITION BY scope ORDER BY unit) - 1 AS i,
                 count(*) OVER (PARTITION BY scope) AS n FROM nation_units), (SELECT unnest(range(1 << 20)) AS v)
    WHERE v < (CAST(1 AS BIGINT) << CAST(n AS INTEGER)) GROUP BY ALL""", "nation_units"), "total", 9))
def _(t: Tables):
    """Every sign vector over the nations of each context and region."""
    return rounded(statistics.sign_vectors(t.nation_units, ["scope"], "unit", "difference"), 9)


def _boot_sql(units: str, seed: int = SEED) -> str:
    drawn = draws_sql("(SELECT scope, n, pos AS i, r, a, b FROM placed, reps)", "i")
    return f"""placed AS MATERIALIZED (SELECT scope, entity, d, row_number() OVER (PARTITION BY scope ORDER BY entity) AS pos,
        count(*) OVER (PARTITION BY scope) AS n FROM {units}),
    reps AS MATERIALIZED {keys_sql(REPETITIONS, seed)},
    drawn AS (SELECT scope, r, h % n + 1 AS pos FROM {drawn}),
    boot AS (SELECT scope, r, avg(d) AS m FROM drawn JOIN placed USING (scope, pos) GROUP BY ALL)"""


_UNITS = """units AS (SELECT context AS scope, entity, round(avg(selected_minus_fixed), 9) AS d FROM cases GROUP BY ALL)"""


def _units(t: Tables):
    return t.cases.groupBy(F.col("context").alias("scope"), "entity").agg(F.round(F.avg("selected_minus_fixed"), 9).alias("d"))


@query("bootstrap_ci", rounded_sql(sql("""
    SELECT scope, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM boot GROUP BY ALL""",
    "cases", extra=_UNITS + ",\n" + _boot_sql("units")), "ci_low ci_high"))
def _(t: Tables):
    means = splits.bootstrap_means(_units(t), ["scope"], "entity", "d", REPETITIONS, SEED)
    return rounded(splits.percentile_interval(means, ["scope"]))


def _poisson_weight(u: str) -> str:
    return " + ".join(f"CAST({u} >= {p!r}::DOUBLE AS INTEGER)" for p in splits.POISSON_CDF)


_WEIGHED = draws_sql("(SELECT scope, r, a, b, d, entity FROM units, reps)", "entity")


@query("bootstrap_ci_poisson", rounded_sql(sql(f"""
    SELECT scope, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM (
      SELECT scope, r, sum(w * d) / nullif(sum(w), 0) AS m FROM (
        SELECT scope, r, d, {_poisson_weight("q")} AS w FROM (
          SELECT scope, r, d, h / {PRIME}::DOUBLE AS q FROM {_WEIGHED})) GROUP BY ALL) GROUP BY ALL""",
    "cases", extra=_UNITS + f", reps AS MATERIALIZED {keys_sql(REPETITIONS, SEED)}"), "ci_low ci_high"))
def _(t: Tables):
    means = splits.poisson_bootstrap_means(_units(t), ["scope"], "entity", "d", REPETITIONS, SEED)
    return rounded(splits.percentile_interval(means, ["scope"]))


_CLUSTER = """units AS (SELECT scope, entity, round(avg(selected_minus_fixed), 9) AS d FROM (
      SELECT unnest(['ALL', budget, context, budget || '_' || context]) AS scope, entity, selected_minus_fixed FROM test_cases) GROUP BY ALL),
    """ + _boot_sql("units") + f""",
    sized AS (SELECT scope, entity, d, row_number() OVER (PARTITION BY scope ORDER BY entity) - 1 AS i,
      count(*) OVER (PARTITION BY scope) AS n, abs(avg(d) OVER (PARTITION BY scope)) AS observed FROM units),
    sampled AS (SELECT scope, (count(*) FILTER (m >= o - 1e-15) + 1) / {DRAWS + 1}.0::DOUBLE AS p FROM (
      SELECT scope, r, max(observed) AS o, abs(sum(CASE WHEN h % 2 = 1 THEN -d ELSE d END) / max(n)) AS m
      FROM {draws_sql("(SELECT scope, r, a, b, d, n, observed, entity FROM sized, reps)", "entity")} GROUP BY scope, r) GROUP BY scope),
    flips AS (SELECT * FROM sampled),
    holm AS (SELECT scope, max(least(1.0::DOUBLE, (m - k + 1) * p)) OVER (ORDER BY k) AS holm_pvalue FROM (
      SELECT *, row_number() OVER (ORDER BY p, scope) AS k, count(*) OVER () AS m FROM flips WHERE scope LIKE '%\\_%' ESCAPE '\\'))"""


@query("clustered_paired_stats", rounded_sql(sql("""
    SELECT u.scope, u.entities, u.mean_difference, u.better_fraction, u.median_difference, b.ci_low, b.ci_high, f.p AS pvalue, h.holm_pvalue
    FROM (SELECT scope, count(*) AS entities, avg(d) AS mean_difference, avg(CAST(d > 0 AS INTEGER)) AS better_fraction,
                 median(d) AS median_difference FROM units GROUP BY ALL) u
    JOIN (SELECT scope, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM boot GROUP BY ALL) b USING (scope)
    JOIN flips f USING (scope) LEFT JOIN holm h USING (scope)""", "test_cases", extra=_CLUSTER),
    "mean_difference better_fraction median_difference ci_low ci_high pvalue holm_pvalue"))
def _(t: Tables):
    return rounded(statistics.clustered_stats(t.test_cases, repetitions=REPETITIONS, sampled=DRAWS, seed=SEED))


@query("graph_relative_gap", rounded_sql(sql("""
    SELECT entity, context, budget, selected_quality - oracle_quality AS difference, 100 * regret / oracle_quality AS gap_percent
    FROM cases""", "cases"), "difference gap_percent"))
def _(t: Tables):
    return rounded(t.cases.select(
        "entity", "context", "budget", (F.col("selected_quality") - F.col("oracle_quality")).alias("difference"),
        statistics.relative_gap("regret", "oracle_quality").alias("gap_percent")))


@query("method_comparison", rounded_sql(sql("""
    SELECT context, selected_mean, selected_std, selected_n, baseline_mean, baseline_std, baseline_n,
           selected_mean - baseline_mean AS absolute_gain, 100 * (selected_mean - baseline_mean) / baseline_mean AS relative_gain_percent
    FROM (SELECT context, avg(selected) AS selected_mean, stddev_samp(selected) AS selected_std, count(selected) AS selected_n,
                 avg(fixed) AS baseline_mean, stddev_samp(fixed) AS baseline_std, count(fixed) AS baseline_n FROM pairs GROUP BY ALL)""",
    "scored", extra=_PAIRS), "selected_mean selected_std baseline_mean baseline_std absolute_gain relative_gain_percent"))
def _(t: Tables):
    both = pairs(t)
    return rounded(statistics.method_comparison(
        both.select("context", "selected"), both.select("context", "fixed"), "context", "selected", "fixed"))


@query("baseline_summary", rounded_sql(sql("""
    SELECT label, scope, avg(value) AS mean, stddev_samp(value) AS std, count(*) AS n, median(value) AS median FROM (
      SELECT 'fixed' AS label, unnest(['ALL', context]) AS scope, fixed AS value FROM pairs
      UNION ALL SELECT 'selected', unnest(['ALL', context]), selected FROM pairs) GROUP BY ALL""",
    "scored", extra=_PAIRS), "mean std median"))
def _(t: Tables):
    labels = F.array(F.struct(F.lit("fixed").alias("label"), F.col("fixed").alias("value")),
                     F.struct(F.lit("selected").alias("label"), F.col("selected").alias("value")))
    rows = pairs(t).withColumn("scope", F.explode(F.array(F.lit("ALL"), F.col("context")))).select("scope", F.inline(labels))
    return rounded(aggregates.describe(rows, ["label", "scope"], "value"))
