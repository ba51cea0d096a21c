"""Structured Streaming forms of the incremental operators.

Every job reads a file stream, checkpoints below the shared folder and drains
what is there (``availableNow``); results land in parquet.

Totals over all that has arrived (``distinct_keys``, ``window_means``,
``completeness``) keep no state in the stream: the partial result of each
micro-batch is merged once into a stored keyed table, so that what is read does
not grow with the number of batches.  They equal the batch result in any order
of arrival.  ``dedupe`` and ``windowed_means`` emit while the stream runs, with
state that expires by a watermark; rows later than that are not in their result.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from selectra.operators.incremental import upsert_table
from selectra.operators.rules import evaluate
from selectra.operators.stored import SPLIT_ROWS, KeyedTable
from selectra.session import shared_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(path))


def _drain(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def drain_append(stream: DataFrame, name: str, checkpoint: str | None = None, target: str | None = None) -> DataFrame:
    """Append-mode file sink; exactly once through the sink log."""
    spark = stream.sparkSession
    target = target or shared_dir(spark, f"{name}-out")
    writer = stream.writeStream.outputMode("append").format("parquet").option("path", target)
    _drain(writer, checkpoint or shared_dir(spark, f"{name}-ckpt"))
    return spark.read.schema(stream.schema).parquet(target)


def drain_updates(stream: DataFrame, name: str, key: Sequence[str], checkpoint: str | None = None,
                  target: str | None = None) -> DataFrame:
    """Update-mode results as one table: each micro-batch overwrites its own folder,
    so a retried batch leaves no duplicates, and the latest batch wins per key."""
    spark = stream.sparkSession
    target = target or shared_dir(spark, f"{name}-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    _drain(stream.writeStream.outputMode("update").foreachBatch(write), checkpoint or shared_dir(spark, f"{name}-ckpt"))
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", LongType())])).parquet(target)
    rest = [c for c in stream.columns if c not in key]
    return rows.groupBy(*key).agg(F.max(F.struct("batch", *rest)).alias("_last")).select(
        *key, *[F.col(f"_last.{c}").alias(c) for c in rest])


def dedupe(stream: DataFrame, key: Sequence[str], time: str, delay: str) -> DataFrame:
    """First arrival of each key; the state of a key expires with the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(key)).select(*key)


def windowed_means(stream: DataFrame, key: Sequence[str], value: str, time: str, delay: str,
                   window: str = "1 day") -> DataFrame:
    """Count and mean per key and tumbling window, with a watermark."""
    return (stream.withWatermark(time, delay).groupBy(F.window(time, window), *key)
            .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
            .select(F.col("window.start").alias("window_start"), *key, "n", "mean"))


def drain_merged(stream: DataFrame, partial: Callable[[DataFrame], DataFrame], key: Sequence[str],
                 merged: Callable[[DataFrame], DataFrame], name: str, checkpoint: str | None = None,
                 target: str | None = None, split_rows: int = SPLIT_ROWS) -> DataFrame:
    """The partial results of all micro-batches so far, merged per key into one stored table as they come; a batch that
    is retried is merged once."""
    spark = stream.sparkSession
    schema = partial(spark.createDataFrame([], stream.schema)).schema
    table = KeyedTable(spark, target or shared_dir(spark, f"{name}-out"), key, schema, split_rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        table.merge(partial(batch), lambda old, new: merged(old.unionByName(new)), batch_id)

    _drain(stream.writeStream.foreachBatch(write), checkpoint or shared_dir(spark, f"{name}-ckpt"))
    return table.read()


def distinct_keys(stream: DataFrame, key: Sequence[str], name: str, **folders: str) -> DataFrame:
    """Each key that has arrived, once."""
    return drain_merged(stream, lambda rows: rows.select(*key).distinct(), key, DataFrame.distinct, name, **folders)


def window_means(stream: DataFrame, key: Sequence[str], value: str, time: str, name: str, window: str = "1 day",
                 **folders: str) -> DataFrame:
    """Count and mean per key and tumbling window over all that has arrived, late or not."""
    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.window(time, window).alias("_window"), *key).agg(
            F.count(F.lit(1)).alias("_rows"), F.count(value).alias("_values"), F.sum(value).alias("_sum")).select(
            F.col("_window.start").alias("window_start"), *key, "_rows", "_values", "_sum")

    def added(rows: DataFrame) -> DataFrame:
        return rows.groupBy("window_start", *key).agg(*[F.sum(c).alias(c) for c in ("_rows", "_values", "_sum")])

    table = drain_merged(stream, sums, ["window_start", *key], added, name, **folders)
    return table.select("window_start", *key, F.col("_rows").alias("n"), F.try_divide("_sum", "_values").alias("mean"))


def completeness(stream: DataFrame, entity: str, item: str, expected: Sequence, name: str, **folders: str) -> DataFrame:
    """Entities for which every expected item has arrived, and the number of items."""
    seen = drain_merged(stream, lambda rows: rows.where(F.col(item).isin(*expected)).select(entity, item).distinct(),
                        [entity, item], DataFrame.distinct, name, **folders)
    return seen.groupBy(entity).agg(F.countDistinct(item).alias("items")).where(F.col("items") == len(set(expected)))


def monitor_rules(stream: DataFrame, rules: Mapping[str, Column], name: str, checkpoint: str | None = None,
                  target: str | None = None) -> DataFrame:
    """Violation counts of each micro-batch, by the batch rule function."""
    spark = stream.sparkSession
    target = target or shared_dir(spark, f"{name}-out")

    def write(batch: DataFrame, batch_id: int) -> None:
        evaluate(batch, rules).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    _drain(stream.writeStream.foreachBatch(write), checkpoint or shared_dir(spark, f"{name}-ckpt"))
    return spark.read.schema("rule string, violations bigint, passed boolean, batch bigint").parquet(target)


def upsert_stream(stream: DataFrame, path: str, key: Sequence[str], sequence: Sequence[str], name: str,
                  checkpoint: str | None = None, split_rows: int = SPLIT_ROWS,
                  prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Merge arriving batches into a keyed table; the same function as the batch upsert. Returns the table."""
    schema = prepare(stream.sparkSession.createDataFrame([], stream.schema)).schema
    table = KeyedTable(stream.sparkSession, path, key, schema, split_rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_table(prepare(batch), path, key, sequence, split_rows, batch_id)

    _drain(stream.writeStream.foreachBatch(write), checkpoint or shared_dir(stream.sparkSession, f"{name}-ckpt"))
    return table.read()
