"""Paired comparisons: intervals, effect sizes, signed ranks, randomisation tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from selectra.functions.scalar import two_sided_normal_p
from selectra.operators.aggregates import explode_scopes, share
from selectra.operators.joins import one_to_one
from selectra.operators.ranking import exact_quantiles, running_total
from selectra.operators.splits import bootstrap_means, percentile_interval, weighted_sums
from selectra.session import materialise, spread

Z95 = 1.96
EXACT_UNITS = 20


def paired_difference(a: DataFrame, b: DataFrame, key: Sequence[str], left: str, right: str,
                      expected_pairs: int | None = None, check: bool = True, digits: int = 9) -> DataFrame:
    pairs = one_to_one(a.select(*key, left), b.select(*key, right), key, check)
    if expected_pairs is not None and pairs.count() != expected_pairs:
        raise ValueError(f"expected {expected_pairs} pairs")
    return pairs.withColumn("difference", F.round(F.col(left) - F.col(right), digits))


def normal_interval(value: str, single: str = "mean") -> dict[str, Column]:
    """mean -/+ 1.96 standard errors; one observation gives the mean or null."""
    n, mean = F.count(value), F.avg(value)
    half = F.lit(Z95) * F.stddev_samp(value) / F.sqrt(n)
    alone = mean if single == "mean" else F.lit(None).cast("double")
    return {"ci95_low": F.when(n > 1, mean - half).otherwise(alone),
            "ci95_high": F.when(n > 1, mean + half).otherwise(alone)}


def cohens_d(diff: str) -> Column:
    return F.try_divide(F.avg(diff), F.nullif(F.stddev_samp(diff), F.lit(0.0)))


def signed_rank(df: DataFrame, scope: Sequence[str], diff: str) -> DataFrame:
    """Wilcoxon signed ranks: zeros dropped, average ranks, normal approximation.

    Works on distinct absolute differences, so heavily tied data shrinks before
    anything is ordered.  A scope with zeros only has n = 0 and no z.
    """
    by_size = df.where(F.col(diff) != 0).groupBy(*scope, F.abs(F.col(diff)).alias("_size")).agg(
        F.count(F.lit(1)).alias("_t"), F.count_if(F.col(diff) > 0).alias("_pos"))
    placed = running_total(by_size, scope, "_size", "_t", "_from", "_n")
    rank = F.col("_from") + (F.col("_t") + 1) / F.lit(2.0)
    t = F.col("_t").cast("double")
    sums = placed.groupBy(*scope).agg(
        F.max("_n").alias("n"),
        F.sum(rank * F.col("_pos")).alias("w_plus"),
        F.sum(rank * (F.col("_t") - F.col("_pos"))).alias("w_minus"),
        F.sum(t * t * t - t).alias("_ties"))
    n = F.col("n").cast("double")
    spread = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - F.col("_ties") / 48.0)
    every = df.select(*scope).distinct().join(sums, list(scope), "left").na.fill(0, ["n"]).na.fill(
        0.0, ["w_plus", "w_minus", "_ties"])
    return every.withColumn("statistic", F.least("w_plus", "w_minus")).withColumn(
        "z", F.try_divide(F.col("statistic") - n * (n + 1) / 4.0, F.nullif(spread, F.lit(0.0)))).drop("_ties")


def with_pvalue(df: DataFrame, z: str = "z", out: str = "pvalue") -> DataFrame:
    return df.withColumn(out, two_sided_normal_p(z))


def sign_flip(units: DataFrame, scope: Sequence[str], unit: str, value: str, sampled: int | None = None,
              seed=2027, tolerance: float = 1e-15) -> DataFrame:
    """Two-sided randomisation p-value of the mean over sign flips of the units.

    Without ``sampled`` every sign vector is enumerated, and a scope of more than
    20 units is an error.  With it, every scope is tested with so many seeded
    sign vectors, whatever its size.
    """
    rows = units.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*scope, unit, value)
    sizes = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("units"), F.abs(F.avg(value)).alias("observed"))
    if sampled is not None:
        return _sampled(rows, sizes, scope, unit, value, sampled, seed, tolerance)
    too_big = F.concat(F.lit("exact enumeration is limited to 20 units, found "), F.col("units").cast("string"))
    sizes = sizes.where(F.when(F.col("units") > EXACT_UNITS, F.raise_error(too_big).cast("boolean")).otherwise(True))
    return _exact(rows, sizes, scope, unit, value, tolerance)


def sign_vectors(units: DataFrame, scope: Sequence[str], unit: str, value: str) -> DataFrame:
    """The sum of every scope under each of its 2^n sign vectors v: bit i is the sign
    of its i-th unit, 1 for a plus.  More than 20 units are an error."""
    numbered = units.withColumn("_i", F.row_number().over(Window.partitionBy(*scope).orderBy(unit)) - 1)
    sized = numbered.join(units.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n")), list(scope))
    too_big = F.concat(F.lit("exact enumeration is limited to 20 units, found "), F.col("_n").cast("string"))
    guarded = sized.where(F.when(F.col("_n") > EXACT_UNITS, F.raise_error(too_big).cast("boolean")).otherwise(True))
    one = F.lit(1).cast("bigint")
    last = F.call_function("shiftleft", one, F.col("_n").cast("int")) - 1
    vectors = guarded.withColumn("v", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    plus = F.call_function("shiftright", F.col("v"), F.col("_i")).bitwiseAND(one) == 1
    return vectors.groupBy(*scope, "v").agg(F.sum(F.when(plus, F.col(value)).otherwise(-F.col(value))).alias("total"))


def _exact(rows, sizes, scope, unit, value, tolerance):
    """At most 20 values per scope are collected; the first sign stays fixed,
    because a vector and its negation have the same absolute mean."""
    few = rows.join(sizes, list(scope)).groupBy(*scope, "units", "observed").agg(
        F.array_sort(F.collect_list(F.struct(unit, value))).alias("_x"))
    # blocks of at most 4,096 vectors are dealt out before they are spelled
    one, block = F.lit(1).cast("bigint"), 12
    left = lambda bits: F.call_function("shiftleft", one, bits.cast("int"))
    high = F.greatest(F.col("units") - 1 - block, F.lit(0))
    blocks = spread(few.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), left(high) - 1))))
    vectors = blocks.select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), left(F.least(F.col("units") - 1, F.lit(block))) - 1)).alias("_low")
    ).withColumn("_v", F.col("_block") * (1 << block) + F.col("_low"))
    signed = F.transform(
        "_x", lambda x, i: F.when(
            (i > 0) & (F.call_function("shiftright", F.col("_v"), F.greatest(i - 1, F.lit(0))).bitwiseAND(
                F.lit(1).cast("bigint")) == 1), -x[value]).otherwise(x[value]))
    mean = F.abs(F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / F.col("units"))
    return vectors.select(*scope, "units", (mean >= F.col("observed") - F.lit(tolerance)).alias("_extreme")).groupBy(
        *scope, "units").agg(share(F.col("_extreme")).alias("pvalue"))


def _sampled(rows, sizes, scope, unit, value, draws, seed, tolerance):
    sums = weighted_sums(rows, scope, unit, value, draws, seed, "sign")
    means = sums.join(sizes, list(scope)).withColumn("_m", F.abs(F.col("total") / F.col("units")))
    hits = F.count_if(F.col("_m") >= F.col("observed") - F.lit(tolerance))
    return means.groupBy(*scope, "units").agg(((hits + 1) / F.lit(float(draws + 1))).alias("pvalue"))


def holm(tests: DataFrame, p: str, family: Sequence[str] = (), order: Sequence[str] = ("scope",),
         out: str = "holm_pvalue") -> DataFrame:
    """Step-down adjustment inside a family of tests (one row per tested cell)."""
    whole = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    rank = F.row_number().over(whole.orderBy(p, *order))
    raw = F.least(F.lit(1.0), (F.count(F.lit(1)).over(whole) - F.col("_k") + 1) * F.col(p))
    upto = whole.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    return tests.withColumn("_k", rank).withColumn("_raw", raw).withColumn(
        out, F.max("_raw").over(upto)).drop("_k", "_raw")


def clustered_stats(scored: DataFrame, diff: str = "selected_minus_fixed", entity: str = "entity",
                    repetitions: int = 10000, sampled: int | None = 10000, seed=2027, digits: int = 9) -> DataFrame:
    """Per scope, with the entity as the unit: mean, median, bootstrap interval,
    sign-flip p-value, share of better entities, and Holm over the cells.

    The sign flips are sampled in every scope; ``sampled=None`` enumerates them
    in every scope and is an error above 20 entities.
    """
    units = materialise(
        explode_scopes(scored).groupBy("scope", "is_cell", entity).agg(F.round(F.avg(diff), digits).alias("_d")))
    basic = units.groupBy("scope", "is_cell").agg(
        F.count(F.lit(1)).alias("entities"), F.avg("_d").alias("mean_difference"),
        share(F.col("_d") > 0).alias("better_fraction"))
    median = exact_quantiles(units, ["scope"], "_d", {"median_difference": 0.5})
    interval = percentile_interval(bootstrap_means(units, ["scope"], entity, "_d", repetitions, seed), ["scope"])
    flips = sign_flip(units, ["scope"], entity, "_d", sampled, seed).select("scope", "pvalue")
    joined = basic.join(median, "scope").join(interval, "scope").join(flips, "scope")
    tests = holm(joined, "pvalue", ["is_cell"])
    return tests.withColumn("holm_pvalue", F.when(F.col("is_cell"), F.col("holm_pvalue"))).drop("is_cell")


def paired_report(pairs: DataFrame, scope: str, left: str, right: str, diff: str = "difference") -> DataFrame:
    """The full paired table: moments, interval, effect size, signed ranks."""
    basic = pairs.groupBy(scope).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(left).alias("left_mean"), F.avg(right).alias("right_mean"),
        F.avg(diff).alias("mean_difference"), F.stddev_samp(diff).alias("std_difference"),
        *[c.alias(n) for n, c in normal_interval(diff, "null").items()],
        cohens_d(diff).alias("cohens_d"), share(F.col(diff) > 0).alias("better_fraction"))
    median = exact_quantiles(pairs, [scope], diff, {"median_difference": 0.5})
    ranks = signed_rank(pairs, [scope], diff).select(scope, "statistic", "z")
    return with_pvalue(basic.join(median, scope, "left").join(ranks, scope, "left"))


def method_comparison(selected: DataFrame, baseline: DataFrame, key: str, value: str,
                      baseline_value: str) -> DataFrame:
    """Group statistics of two methods side by side with absolute and relative gain."""
    stats = lambda df, v, p: df.groupBy(key).agg(
        F.avg(v).alias(f"{p}_mean"), F.stddev_samp(v).alias(f"{p}_std"), F.count(v).alias(f"{p}_n"))
    both = stats(selected, value, "selected").join(stats(baseline, baseline_value, "baseline"), key, "left")
    gain = F.col("selected_mean") - F.col("baseline_mean")
    return both.withColumn("absolute_gain", gain).withColumn(
        "relative_gain_percent", F.try_divide(gain * 100.0, F.col("baseline_mean")))


def relative_gap(regret: str, oracle: str) -> Column:
    return F.try_divide(F.col(regret) * 100.0, F.col(oracle))
