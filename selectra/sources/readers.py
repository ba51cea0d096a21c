"""Scans with declared schemas, column aliases and tagged unions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

# The raw run contract (name, type), 26 columns.
RUN_SCHEMA = StructType([StructField(n, t) for n, t in (
    ("experiment_id", StringType()), ("graph_id", StringType()), ("graph_family", StringType()),
    ("num_nodes", LongType()), ("num_edges", LongType()), ("graph_seed", LongType()),
    ("noise_condition", StringType()), ("config_id", StringType()), ("depth", LongType()),
    ("optimizer", StringType()), ("shots_per_circuit", LongType()), ("expected_cut", DoubleType()),
    ("best_sampled_cut", DoubleType()), ("exact_optimum", DoubleType()),
    ("expected_approximation_ratio", DoubleType()), ("best_sampled_approximation_ratio", DoubleType()),
    ("optimizer_evaluations", LongType()), ("circuit_executions", LongType()),
    ("total_executed_shots", LongType()), ("two_qubit_gates", LongType()), ("circuit_depth", LongType()),
    ("simulator_runtime_seconds", DoubleType()), ("run_seed", LongType()), ("run_status", StringType()),
    ("failure_reason", StringType()), ("schema_version", StringType()),
)])


def scan_runs(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read runs from CSV (with header) or parquet; a missing path is an error.

    For CSV the schema is never inferred from the data: the version column would
    turn into a number and two files could disagree.
    """
    if path.rstrip("/").endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return nan_to_null(reader.parquet(path))
    reader = spark.read.option("header", True).option("enforceSchema", False)
    return nan_to_null(reader.schema(schema or RUN_SCHEMA).csv(path))


def nan_to_null(df: DataFrame) -> DataFrame:
    """One representation of 'missing' for every floating column."""
    floating = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    if not floating:
        return df
    return df.select(*[
        F.when(~F.isnan(c), F.col(c)).alias(c) if c in floating else F.col(c) for c in df.columns
    ])


def scan_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a parquet or CSV target that may not exist yet."""
    try:
        if path.rstrip("/").endswith(".csv"):
            return spark.read.schema(schema).option("header", True).csv(path)
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def union_tagged(frames: Mapping[str, DataFrame], tag: str = "source_file") -> DataFrame:
    """Concatenate frames by column name, each row tagged with where it came from."""
    tagged = [df.withColumn(tag, F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def resolve_aliases(df: DataFrame, wanted: Mapping[str, Sequence[str]],
                    optional: Sequence[str] = ()) -> DataFrame:
    """Rename the first alias that exists of every wanted column; drop the rest.

    Required columns without an alias are reported together.
    """
    present = {target: [a for a in aliases if a in df.columns] for target, aliases in wanted.items()}
    absent = {t: list(wanted[t]) for t, found in present.items() if not found and t not in optional}
    if absent:
        raise ValueError(f"no alias is present for {absent}; available: {df.columns}")
    return df.select(*[F.col(found[0]).alias(target) for target, found in present.items() if found])


def scan_manifest(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Entity manifest with its contract columns asserted."""
    require_columns(df, required)
    return df


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")
