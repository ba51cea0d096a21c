"""Dimension tables: candidates, contexts, budgets and the entity manifest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# Candidate dimensions, context error levels, budget limits.
DEPTHS = (1, 2, 3)
OPTIMIZERS = ("COBYLA", "SPSA")
SHOTS = (256, 512)
BUDGETS = (("B256", 256), ("B512", 512))
CONTEXTS = (
    ("N0", 0.0, 0.0, 0.0, "ideal simulation"),
    ("N1", 0.001, 0.01, 0.02, "controlled moderate noise"),
    ("N2", 0.005, 0.03, 0.05, "controlled higher noise"),
)


def _digit(values: Sequence, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (position + 1).cast("int"))


def candidate_registry(spark: SparkSession, depths: Sequence = DEPTHS, optimizers: Sequence = OPTIMIZERS,
                       shots: Sequence = SHOTS, prefix: str = "C") -> DataFrame:
    """Every combination of the three dimensions, numbered in nested order.

    The row number is read as a mixed-radix number, one digit per dimension, so
    that no join is needed to build the product.
    """
    i = F.col("id")
    a, b = len(optimizers), len(shots)
    return spark.range(len(depths) * a * b).select(
        F.format_string(f"{prefix}%02d", i + 1).alias("candidate"),
        _digit(depths, F.floor(i / (a * b))).alias("depth"),
        _digit(optimizers, F.floor(i / b) % a).alias("optimizer"),
        _digit(shots, i % b).alias("shots"),
    )


def context_registry(spark: SparkSession, rows: Sequence[tuple] = CONTEXTS) -> DataFrame:
    return spark.createDataFrame(
        list(rows),
        "context string, single_error double, double_error double, readout_error double, description string",
    )


def lookup_candidates(df: DataFrame, registry: DataFrame, key: str = "candidate") -> DataFrame:
    """Attach the descriptors of the registry."""
    return df.join(registry, key)


def unknown_candidates(df: DataFrame, registry: DataFrame, key: str = "candidate") -> DataFrame:
    return df.join(registry, key, "left_anti").select(key).distinct()


def entity_manifest(instances: DataFrame, family: str, sizes: Sequence[int], instance: str,
                    per_setting: int | None = None, seed_start: int = 10000, probability: float = 0.35,
                    degree: int = 4, random_family: str | None = None, prefix: str = "G") -> DataFrame:
    """Number every (family, size, instance) in nested order.

    ``instances`` has one row per (family, position in the family).  The running
    number follows from the family offsets and the two inner positions, without
    sorting the manifest.  ``instance`` is the 1-based position.
    """
    from pyspark.sql import Window

    per_family = instances.groupBy(family).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy(family).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_family.select(
        family, "_n", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) * len(sizes)).alias("_base"),
    )
    sized = instances.join(offsets, family).select(
        "*", F.posexplode(F.array(*[F.lit(int(s)).cast("bigint") for s in sizes])).alias("_p", "num_nodes"),
    )
    number = (F.col("_base") + F.col("_p") * F.col("_n") + F.col(instance)).cast("bigint")
    if per_setting is not None:
        sized = sized.where(F.col(instance) <= per_setting)
    is_random = F.col(family) == (F.lit(random_family) if random_family else F.lit("erdos_renyi"))
    return sized.select(
        F.format_string(f"{prefix}%04d", number).alias("graph_id"),
        F.col(family).alias("family"), "num_nodes", (number - 1 + seed_start).alias("seed"),
        F.when(is_random, F.lit(probability)).alias("probability"),
        F.when(~is_random, F.lit(degree).cast("bigint")).alias("degree"),
    )


def expand_budgets(df: DataFrame, budgets: Sequence[tuple[str, int]] = BUDGETS, cost: str = "shots",
                   out: str = "budget") -> DataFrame:
    """One copy of each row per budget it fits in.

    The budgets are literals, so this inequality join is a generator inside the
    scan stage: no broadcast, no nested loop.  Budgets may overlap.
    """
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("most")) for n, v in budgets])
    fits = F.filter(names, lambda b: F.col(cost) <= b["most"])
    return df.withColumn("_fit", F.explode(fits)).withColumn(out, F.col("_fit.name")).drop("_fit")
