"""Replicate aggregation, coverage, scope summaries and error metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from selectra.operators.ranking import exact_quantiles


def replicate_means(runs: DataFrame, group: Sequence[str], means: Mapping[str, str],
                    success: Column | None = None, digits: int | None = None,
                    count: str = "n_runs") -> DataFrame:
    """Mean of each measure over the successful replicates.

    Rows with a null group key are left out.  ``digits`` rounds the means, so
    that ties do not depend on the order in which partial sums meet.
    """
    rows = runs if success is None else runs.where(success)
    rows = rows.dropna(subset=list(group))
    mean = lambda c: F.avg(c) if digits is None else F.round(F.avg(c), digits)
    return rows.groupBy(*group).agg(
        *[mean(c).alias(n) for n, c in means.items()], F.count(F.lit(1)).alias(count))


def replicate_spread(runs: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single replicate) and count."""
    return runs.dropna(subset=list(group)).groupBy(*group).agg(
        F.avg(value).alias("mean"),
        F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"),
        F.count(value).alias("n"),
    )


def describe(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """Mean, sample deviation, exact median and count of big groups; a group of nulls keeps its row."""
    moments = df.groupBy(*group).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))
    return moments.join(exact_quantiles(df, group, value, {"median": 0.5}), list(group), "left")


def candidate_coverage(df: DataFrame, entity: str, context: str, candidate: str) -> DataFrame:
    return df.groupBy(entity, context).agg(F.countDistinct(candidate).alias("candidates"))


def context_sets(df: DataFrame, entity: str, context: str, contexts: Sequence) -> DataFrame:
    """One flag per known context instead of a collected set."""
    return df.groupBy(entity).agg(
        *[F.coalesce(F.bool_or(F.col(context) == F.lit(c)), F.lit(False)).alias(f"has_{c}") for c in contexts])


def admit_complete(df: DataFrame, entity: str, context: str, candidate: str, contexts: Sequence,
                   candidates: int) -> DataFrame:
    """Per entity: how many required contexts are there, which are complete, is it admitted."""
    cells = df.where(F.col(context).isin(*contexts)).groupBy(entity, context).agg(
        F.countDistinct(candidate).alias("_n"))
    return cells.groupBy(entity).agg(
        F.count(F.lit(1)).alias("contexts"),
        F.count_if(F.col("_n") == candidates).alias("complete_contexts"),
    ).withColumn("admitted", (F.col("contexts") == len(contexts)) & (F.col("complete_contexts") == len(contexts)))


def scope_label(dims: Sequence[str]) -> Column:
    """'ALL', a single dimension value, or the values joined by an underscore."""
    shown = [F.when(F.grouping(d) == 0, F.col(d).cast("string")) for d in dims]
    label = F.concat_ws("_", *shown)
    return F.when(label == "", F.lit("ALL")).otherwise(label)


def _scoped(grouped, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    out = grouped.agg(scope_label(dims).alias("scope"), *[c.alias(n) for n, c in aggs.items()])
    return out.select("scope", *aggs)


def cube_summary(df: DataFrame, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """All margins and cells out of one scan."""
    return _scoped(df.cube(*dims), dims, aggs)


def margin_summary(df: DataFrame, dims: Sequence[str], aggs: Mapping[str, Column]) -> DataFrame:
    """The grand total and one margin per dimension, without the cells."""
    sets = [[], *[[F.col(d)] for d in dims]]
    return _scoped(df.groupingSets(sets, *[F.col(d) for d in dims]), dims, aggs)


def rollup_summary(df: DataFrame, dim: str, aggs: Mapping[str, Column]) -> DataFrame:
    return _scoped(df.rollup(dim), [dim], aggs)


def explode_scopes(df: DataFrame, budget: str = "budget", context: str = "context") -> DataFrame:
    """One copy per scope, and whether it is a cell (not a margin); for summaries
    that first reduce within (scope, entity)."""
    named = lambda label, cell: F.struct(label.alias("scope"), F.lit(cell).alias("is_cell"))
    scopes = F.array(named(F.lit("ALL"), False), named(F.col(budget), False), named(F.col(context), False),
                     named(F.concat_ws("_", budget, context), True))
    return df.select("*", F.inline(scopes))


def share(predicate: Column) -> Column:
    return F.avg(predicate.cast("int"))


def selection_metrics() -> dict[str, Column]:
    """Summary columns of scored cases (see ``selection.score_cases``)."""
    return {
        "entities": F.countDistinct("entity"),
        "cases": F.count(F.lit(1)),
        "selected_mean": F.avg("selected_quality"),
        "fixed_mean": F.avg("fixed_quality"),
        "random_expected_mean": F.avg("random_expected_quality"),
        "oracle_mean": F.avg("oracle_quality"),
        "selected_minus_fixed": F.avg("selected_minus_fixed"),
        "relative_gain_percent": relative_gain("selected_minus_fixed", "fixed_quality"),
        "mean_regret": F.avg("regret"),
        "oracle_accuracy": share(F.col("selected_is_oracle")),
        "oracle_top3_accuracy": share(F.col("oracle_in_top3")),
    }


def relative_gain(diff: str, base: str) -> Column:
    """Ratio of means, in percent (not the mean of ratios)."""
    return F.try_divide(F.avg(diff) * 100.0, F.avg(base))


def regression_metrics(actual: str, predicted: str) -> dict[str, Column]:
    err = F.col(actual) - F.col(predicted)
    sst = F.var_pop(actual) * F.count(actual)
    return {
        "mae": F.avg(F.abs(err)),
        "rmse": F.sqrt(F.avg(err * err)),
        "r2": F.lit(1.0) - F.try_divide(F.sum(err * err), sst),
    }


def weighted_expectation(df: DataFrame, group: Sequence[str], value: str, weight: str) -> DataFrame:
    """Expected value under frequencies, and the best value seen; zero mass gives null."""
    return df.groupBy(*group).agg(
        F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("expected"),
        F.max(value).alias("best"), F.sum(weight).cast("bigint").alias("total"))


def split_report(df: DataFrame, contexts: Sequence, split: str = "split", entity: str = "entity",
                 context: str = "context") -> DataFrame:
    return df.groupBy(split).agg(
        F.countDistinct(entity).alias("entities"), F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(context) == F.lit(c)).alias(f"rows_{c}") for c in contexts])


def reindex(summary: DataFrame, key: str, order: Sequence) -> DataFrame:
    """Force a fixed member order; absent members appear with nulls."""
    dim = summary.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(order)], f"position bigint, {key} string")
    return dim.join(summary, key, "left").orderBy("position")


def pivot_matrix(df: DataFrame, row: str, column: str, columns: Sequence, value: Column) -> DataFrame:
    wide = df.groupBy(row).pivot(column, list(columns)).agg(value)
    return wide.na.fill(0.0)


def histogram(df: DataFrame, value: str, bins: int, low: float | None = None, high: float | None = None) -> DataFrame:
    """Equal-width bins 1..bins over the range of the data, or over a given one.

    The upper edge belongs to the last bin.  Values below a given range are in
    bin 0, those above it in bin bins + 1; nulls are not counted.  A range of
    one value is bin 1.
    """
    rows = df.where(F.col(value).isNotNull())
    if low is None or high is None:
        least, most = rows.agg(F.min(value).cast("double"), F.max(value).cast("double")).first()
        low, high = (least if low is None else low), (most if high is None else high)
    x = F.col(value).cast("double")
    if low is None or high <= low:
        inside = F.lit(1)
    else:
        inside = F.least(F.lit(bins), F.floor((x - low) / ((high - low) / bins)) + 1)
    at = F.when(x < F.lit(low), 0).when(x > F.lit(high), bins + 1).otherwise(inside)
    return rows.groupBy(at.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("rows"))
