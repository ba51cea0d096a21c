"""Data-contract rules, evaluated together in one pass over the table.

A rule is a boolean column that is true on a violating row.  All row rules of a
table share one aggregation; rules about keys and group sizes need one more
aggregation on their key each.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


class ContractViolation(ValueError):
    """Raised in fail-fast mode."""


def _column_status(df: DataFrame, required: Sequence[str]) -> list[tuple[str, str]]:
    have, need = set(df.columns), set(required)
    return [(c, "missing") for c in sorted(need - have)] + [(c, "extra") for c in sorted(have - need)]


def column_report(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """(column, status): 'missing' is fatal, 'extra' is only a warning."""
    return df.sparkSession.createDataFrame(_column_status(df, required), "column string, status string")


def counted_column_report(df: DataFrame, required: Sequence[str], count: str) -> DataFrame:
    """The same with the number of rows that the answer is about, counted in one pass."""
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(s).alias("status")) for c, s in _column_status(df, required)])
    return df.agg(F.count(F.lit(1)).alias(count)).select(
        F.inline(rows.cast("array<struct<column:string,status:string>>")), count)


def leakage_report(df: DataFrame, forbidden: Sequence[str]) -> list[str]:
    return sorted(set(forbidden) & set(df.columns))


def assert_no_leakage(df: DataFrame, forbidden: Sequence[str]) -> DataFrame:
    leaked = leakage_report(df, forbidden)
    if leaked:
        raise ContractViolation(f"outcome columns among the features: {leaked}")
    return df


# Row rules ------------------------------------------------------------------

def in_domain(column: str, allowed: Sequence) -> Column:
    return F.col(column).isNotNull() & ~F.col(column).isin(*allowed)


def over_cap(success: Column, column: str, cap) -> Column:
    return success & (F.col(column) > F.lit(cap))


def product_mismatch(success: Column, a: str, b: str, total: str) -> Column:
    return success & ~F.coalesce(F.col(a) * F.col(b) == F.col(total), F.lit(False))


def missing_measurement(success: Column, columns: Sequence[str]) -> Column:
    return success & reduce(lambda x, y: x | y, [F.col(c).isNull() for c in columns])


def ratio_mismatch(success: Column, num: str, den: str, ratio: str, tol: float = 1e-9,
                   strict: bool = True) -> Column:
    """Strict: an undefined ratio violates.  Lenient: only a defined one can."""
    gap = F.abs(F.try_divide(F.col(num), F.col(den)) - F.col(ratio))
    if strict:
        return success & ~F.coalesce(gap < F.lit(tol), F.lit(False))
    return success & (F.col(den) != 0) & F.coalesce(gap > F.lit(tol), F.lit(False))


def failure_without_reason(status: str, reason: str) -> Column:
    return (F.col(status) == "failed") & (F.coalesce(F.col(reason), F.lit("")) == "")


def not_numeric(column: str) -> Column:
    value = F.col(column).cast("string").try_cast("double")
    return value.isNull() | F.isnan(value)


def evaluate(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations, passed) for every row rule, in one scan and one aggregation."""
    counted = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
    return to_report(counted, list(rules))


def to_report(counted: DataFrame, names: Sequence[str]) -> DataFrame:
    """Turn one wide row of counts into (rule, violations, passed)."""
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("bigint").alias("violations"))
                     for n in names])
    return counted.select(F.inline(rows)).withColumn("passed", F.col("violations") == 0)


# Rules about keys, groups and tables ------------------------------------------

def duplicate_keys(df: DataFrame, key: Sequence[str], rule: str) -> DataFrame:
    """Counts all members of duplicated keys, and the duplicated keys."""
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return sizes.agg(
        F.lit(rule).alias("rule"),
        F.count(F.lit(1)).alias("duplicated_keys"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("member_rows"),
    )


def has_duplicates(df: DataFrame, key: Sequence[str]) -> bool:
    return not df.groupBy(*key).count().where("count > 1").isEmpty()


def domain_difference(df: DataFrame, column: str, expected: DataFrame) -> DataFrame:
    """Observed but unexpected, and expected but unobserved values.

    ``expected`` is a one-column frame of the same name; both sides are joined
    as distinct values, so that a large id domain stays distributed.
    """
    seen = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_seen", F.lit(True))
    wish = expected.select(column).distinct().withColumn("_wish", F.lit(True))
    return (
        seen.join(wish, column, "full_outer")
        .where(F.col("_seen").isNull() | F.col("_wish").isNull())
        .select(F.col(column).cast("string").alias("value"),
                F.when(F.col("_seen").isNull(), "missing").otherwise("unexpected").alias("status"))
    )


def observed_set(df: DataFrame, column: str, expected: Sequence) -> DataFrame:
    """One row: does the observed set of a small domain equal the expected one?"""
    expect = F.array(*[F.lit(str(v)) for v in sorted(map(str, expected))])
    seen = F.sort_array(F.collect_set(F.col(column).cast("string")))
    return df.agg(seen.alias("_seen")).select(
        F.concat_ws(",", "_seen").alias("observed"),
        F.concat_ws(",", F.array_except("_seen", expect)).alias("unexpected"),
        F.concat_ws(",", F.array_except(expect, F.col("_seen"))).alias("missing"),
        (F.col("_seen") == expect).alias("passed"),
    )


def group_size_violations(df: DataFrame, group: Sequence[str], expected: int) -> DataFrame:
    return (df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
            .where(F.col("rows") != F.lit(expected)))


def row_count_rule(df: DataFrame, expected: Column | int) -> DataFrame:
    want = expected if isinstance(expected, Column) else F.lit(expected)
    return df.agg(F.count(F.lit(1)).alias("rows"), want.cast("bigint").alias("expected")).withColumn(
        "passed", F.col("rows") == F.col("expected"))


def id_overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """How many ids are only in a, only in b, and in both."""
    side = lambda df, n: df.select(key).distinct().withColumn(n, F.lit(1))
    both = side(a, "_a").join(side(b, "_b"), key, "full_outer")
    return both.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"),
        F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("common"),
    )


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), column)


def raise_on_fail(report: DataFrame) -> DataFrame:
    """Fail-fast mode: the first violated rule, in the order of the report."""
    bad = report.where("not passed").limit(1).collect()
    if bad:
        raise ContractViolation(f"{bad[0]['rule']}: {bad[0]['violations']} violations")
    return report
