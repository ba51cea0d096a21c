"""Global ranks, running totals and exact quantiles without a one-task sort.

A plain ``Window.orderBy`` without partition columns (or ``percentile`` over one
big group) sends the whole group to one task.  Here a group is cut into ordered
buckets; only one count per bucket is prefix-summed, and the inner order is
worked out bucket by bucket.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from selectra.functions.hashing import row_hash
from selectra.session import materialise

_FIRST = Window.unboundedPreceding


def with_offsets(counted: DataFrame, group: Sequence[str], bucket: str, count: str,
                 before: str, total: str) -> DataFrame:
    """Per group: how much lies in earlier buckets, and in all of them."""
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    earlier = whole.orderBy(bucket).rowsBetween(_FIRST, -1)
    return counted.select(
        *group, bucket,
        F.coalesce(F.sum(count).over(earlier), F.lit(0)).cast("bigint").alias(before),
        F.sum(count).over(whole).cast("bigint").alias(total),
    )


def hash_rank(df: DataFrame, key: str | Sequence[str], seed, group: Sequence[str] = (),
              rank: str = "rank", total: str = "n", prefix: int = 3) -> DataFrame:
    """1-based rank of every row in seeded hash order; ``key`` is unique in its group.

    The first hex digits of the hash are the ordered buckets, evenly filled by
    construction, so neither the keys nor the group sizes can skew a task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    hashed = df.withColumn("_h", row_hash(seed, *keys)).withColumn("_b", F.substring("_h", 1, prefix))
    counts = hashed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    offsets = with_offsets(counts, group, "_b", "_c", "_before", total)
    if group:  # up to a row per key, which an estimate from the scan below generators takes for few
        offsets = offsets.hint("merge")
    inner = Window.partitionBy(*group, "_b").orderBy("_h", *keys)
    return (
        hashed.join(offsets, [*group, "_b"])
        .withColumn(rank, (F.col("_before") + F.row_number().over(inner)).cast("bigint"))
        .drop("_h", "_b", "_before")
    )


def _value_buckets(df: DataFrame, value: str, out: str) -> DataFrame:
    """Ordered buckets of about equal size; the edges are literals, so a retried
    task puts every value where the first attempt put it."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = df.approxQuantile(value, [i / parts for i in range(1, parts)], 0.5 / parts)
    edges = [-float("inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) < 3:
        return df.withColumn(out, F.lit(0.0))
    return Bucketizer(splits=edges, inputCol=value, outputCol=out).transform(df)


def running_total(counts: DataFrame, group: Sequence[str], value: str, weight: str,
                  before: str = "before", total: str = "total") -> DataFrame:
    """Weight of all smaller values of the group, for rows unique on (group, value).

    The input is aggregated per distinct value first, so that a value shared by
    a third of all rows is one row here.  They are kept once, because the bucket
    edges need a pass of their own.
    """
    cut = _value_buckets(materialise(counts), value, "_b")
    sums = cut.groupBy(*group, "_b").agg(F.sum(weight).cast("bigint").alias("_w"))
    offsets = with_offsets(sums, group, "_b", "_w", "_before", total)
    inner = Window.partitionBy(*group, "_b").orderBy(value).rowsBetween(_FIRST, -1)
    return (
        cut.join(offsets, [*group, "_b"])
        .withColumn(before, F.col("_before") + F.coalesce(F.sum(weight).over(inner), F.lit(0)))
        .drop("_b", "_before")
    )


def exact_quantiles(df: DataFrame, group: Sequence[str], value: str,
                    probs: Mapping[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group."""
    counts = (
        df.where(F.col(value).isNotNull()).groupBy(*group, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = running_total(counts, group, value, "_c", "_from", "_n")
    picks = []
    for name, p in probs.items():
        pos = (F.col("_n") - 1) * F.lit(float(p))
        low, high = F.floor(pos), F.ceil(pos)
        upto = F.col("_from") + F.col("_c")
        picks += [
            F.max(F.when((F.col("_from") <= low) & (low < upto), F.col(value))).alias(f"_lo_{name}"),
            F.max(F.when((F.col("_from") <= high) & (high < upto), F.col(value))).alias(f"_hi_{name}"),
            F.max(pos - low).alias(f"_f_{name}"),
        ]
    wide = placed.groupBy(*group).agg(*picks)
    return wide.select(*group, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_f_{n}")).alias(n)
        for n in probs
    ])


def average_ranks(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """One row per (group, distinct value): tie size and shared average rank."""
    counts = df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("ties"))
    placed = running_total(counts, group, value, "ties", "before", "n")
    return placed.withColumn("avg_rank", F.col("before") + (F.col("ties") + 1) / F.lit(2.0))
