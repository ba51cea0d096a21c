"""Joins with the cardinality they promise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from selectra.operators.rules import ContractViolation, assert_no_leakage, has_duplicates


def assert_unique(df: DataFrame, key: Sequence[str], what: str) -> None:
    if has_duplicates(df, key):
        raise ContractViolation(f"{what}: duplicate rows for {list(key)}")


def once_per_key(df: DataFrame, key: Sequence[str], what: str) -> DataFrame:
    """One row per key; a key with more rows is an error of the job that reads the result, so that nothing is read
    twice to find out. The rows meet in the shuffle of the join that follows."""
    rest = [c for c in df.columns if c not in key]
    again = F.raise_error(F.lit(f"{what}: duplicate rows for {list(key)}"))
    row = F.first(F.struct(F.lit(True).alias("_there"), *[F.col(c) for c in rest]))
    kept = df.groupBy(*key).agg(F.when(F.count(F.lit(1)) > 1, again.cast("boolean")).otherwise(True).alias("_once"), row.alias("_row"))
    return kept.where("_once").select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def many_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], check: bool = True) -> DataFrame:
    """Attach features: the right key is unique and no left row stays without. Both are checked in the one join; a
    breach raises when the result is read."""
    if not check:
        return left.join(right, list(key), "left")
    features = once_per_key(right, key, "feature side").withColumn("_found", F.lit(True))
    lost = F.raise_error(F.lit("missing features after the join")).cast("boolean")
    joined = left.join(features, list(key), "left")
    return joined.where(F.when(F.col("_found").isNull(), lost).otherwise(True)).drop("_found")


def one_to_one(left: DataFrame, right: DataFrame, key: Sequence[str], check: bool = True) -> DataFrame:
    if check:
        left, right = once_per_key(left, key, "left side"), once_per_key(right, key, "right side")
    return left.join(right, list(key))


def missing_keys(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct left keys without a partner."""
    return left.select(*key).join(right.select(*key), list(key), "left_anti").distinct()


def lookup(df: DataFrame, table: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """Map a key to one value; an unmapped key gives null."""
    return df.join(table.select(*key, value), list(key), "left")


def semi(df: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.join(ids.select(*key), list(key), "left_semi")


#: rows that a table of limits may have
MOST_LIMITS = 10_000


def within_limit(df: DataFrame, limits: DataFrame, cost: str, limit: str) -> DataFrame:
    """Inequality join with a dimension table of at most MOST_LIMITS rows: every row meets every limit that it keeps, so
    a long table of limits is an error instead of a join that grows with both sides."""
    if limits.limit(MOST_LIMITS + 1).count() > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} limits")
    return df.join(limits, F.col(cost) <= F.col(limit))


def chosen_only(df: DataFrame, choices: DataFrame, key: Sequence[str], candidate: str,
                chosen: str) -> DataFrame:
    """Rows of the chosen candidate: the filter is part of the equality key."""
    picks = choices.withColumnRenamed(chosen, candidate)
    return df.join(picks, [*key, candidate])


def reuse_parameters(existing: DataFrame, baseline: DataFrame, expected: DataFrame,
                     key: Sequence[str], context: str, success: Column) -> DataFrame:
    """For every expected (context, key) not yet measured, the baseline row to reuse.

    ``expected`` holds (context, key) rows; ``baseline`` the successful rows of
    the context whose parameters are taken over.
    """
    todo = expected.join(existing.where(success).select(context, *key), [context, *key], "left_anti")
    return todo.join(baseline, list(key))


def training_table(features: DataFrame, labels: DataFrame, key: Sequence[str],
                   forbidden: Sequence[str], check: bool = True) -> DataFrame:
    """Leakage guard, unique key, complete features, then a 1:1 join with labels."""
    assert_no_leakage(features, forbidden)
    if check:
        for name, df in (("features", features), ("labels", labels)):
            if df.isEmpty():
                raise ContractViolation(f"no {name}")
        if not missing_keys(labels, features, key).isEmpty():
            raise ContractViolation("labelled rows without features")
    return one_to_one(features, labels, key, check)
