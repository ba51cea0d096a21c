"""Resumable ingestion: what is done, what is missing, and idempotent upserts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from selectra.operators.selection import keep_last
from selectra.operators.stored import SPLIT_ROWS, KeyedTable


def completed_keys(runs: DataFrame, key: Sequence[str], success: Column) -> DataFrame:
    return runs.where(success).select(*key).distinct()


def completeness(runs: DataFrame, entity: str, context: str, item: Sequence[str], contexts: Sequence,
                 expected: int, success: Column) -> DataFrame:
    """Distinct successful items per required context; complete when all reach ``expected``."""
    items = runs.where(success).groupBy(entity, context, *item).agg(F.lit(1).alias("_one"))
    per = items.groupBy(entity).agg(
        *[F.count_if(F.col(context) == F.lit(c)).alias(f"done_{c}") for c in contexts])
    done = [F.col(f"done_{c}") >= expected for c in contexts]
    state = done[0]
    for d in done[1:]:
        state = state & d
    return per.withColumn("complete", state)


def expected_grid(entities: DataFrame, dimensions: Mapping[str, Sequence]) -> DataFrame:
    """Every combination of the literal dimensions for every entity, by generators."""
    for name, values in dimensions.items():
        entities = entities.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return entities


def missing_work(runs: DataFrame, entities: DataFrame, dimensions: Mapping[str, Sequence], entity: str,
                 success: Column) -> DataFrame:
    key = [entity, *dimensions]
    return expected_grid(entities.select(entity).distinct(), dimensions).join(
        completed_keys(runs, key, success), key, "left_anti")


def ingestion_report(runs: DataFrame, entities: DataFrame, entity: str, context: str, item: Sequence[str],
                     expected: Mapping[str, int], success: Column, first: str) -> DataFrame:
    """What an operator of the ingestion sees per entity and context: distinct items done, items missing, failed rows,
    and a state. No other context of an entity may start before ``first`` is complete: until then it is blocked.

    Every pair has a row, also those without runs; runs of other contexts are not counted.
    """
    tried = runs.groupBy(entity, context, *item).agg(
        F.max(F.when(success, 1).otherwise(0)).alias("_done"), F.count_if(~success).alias("_failed"))
    counts = tried.groupBy(entity, context).agg(F.sum("_done").alias("_d"), F.sum("_failed").alias("_f"))
    grid = expected_grid(entities.select(entity).distinct(), {context: list(expected)})
    wanted = F.create_map(*[F.lit(x) for pair in expected.items() for x in pair])[F.col(context)].cast("bigint")
    zero = F.lit(0).cast("bigint")
    rows = grid.join(counts, [entity, context], "left").select(
        entity, context, F.coalesce("_d", zero).alias("done"), wanted.alias("expected"),
        F.greatest(wanted - F.coalesce("_d", zero), zero).alias("missing"),
        F.coalesce("_f", zero).alias("failed_rows"))
    # as many rows per entity as there are contexts
    opened = F.max((F.col(context) == first) & (F.col("missing") == 0)).over(Window.partitionBy(entity))
    return rows.withColumn("state", F.when(F.col("missing") == 0, "complete").when(
        (F.col(context) != first) & ~opened, "blocked").when(F.col("done") == 0, "not started").otherwise("incomplete"))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str], sequence: Sequence[str]) -> DataFrame:
    """Union of both, the last row of every key; ``new`` rows carry later sequence values."""
    return keep_last(old.unionByName(new), key, sequence)


def replace_entities(old: DataFrame, fresh: DataFrame, entity: str) -> DataFrame:
    """Drop all rows of the entities that come again, and append the fresh ones."""
    stale = fresh.select(entity).distinct()
    return old.join(stale, entity, "left_anti").unionByName(fresh)


def upsert_table(batch: DataFrame, path: str, key: Sequence[str], sequence: Sequence[str],
                 split_rows: int = SPLIT_ROWS, batch_id: int | None = None) -> KeyedTable:
    """Merge a batch into a stored table in which the last row of every key wins (``stored.KeyedTable``).

    Only the leaves the batch touches are read and rewritten. Merging the same batch twice changes nothing, so the write
    may be retried.
    """
    table = KeyedTable(batch.sparkSession, path, key, batch.schema, split_rows)
    table.merge(batch, lambda old, new: upsert(old, new, key, sequence), batch_id)
    return table
