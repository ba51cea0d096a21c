"""Sharding by jump consistent hashing: a stable key and the number of shards decide, without a ring table.

Going from n to n + 1 shards moves one row in n + 1 on average, all of them into the new shard. Slots number the rows
of a shard without a gap: a task counts on within its own rows, and the small table of (task, shard) counts gives each
task its first slot, so that no shard is ever gathered.

Cases: a null key is a key like any other; equal keys (repeated rows, a hot key) share a shard and get slots of their
own; a null or empty text has the size of the row's overhead; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from selectra.session import materialise

SHARDS = 24
ROW_OVERHEAD = 8
#: fixed values of the published jump consistent hash: multiplier of its generator, and the span of its draws
_STEP, _SPAN = np.uint64(2862933555777941757), float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key; all keys still jumping advance together."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard, ahead = np.zeros(len(state), np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    while moving.size:
        shard[moving] = ahead[moving]
        state[moving] = state[moving] * _STEP + np.uint64(1)
        draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1.0
        ahead[moving] = ((shard[moving] + 1) * (_SPAN / draw)).astype(np.int64)
        moving = moving[ahead[moving] < shards]
    return shard


def _placed(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    task, filled = TaskContext.get().partitionId(), np.zeros(shards, np.int64)
    for batch in batches:
        keys = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
        shard, grown = jump(keys, shards), jump(keys, shards + 1)
        local = np.zeros(len(keys), np.int64)
        for s in np.unique(shard):
            mine = np.flatnonzero(shard == s)
            local[mine] = filled[s] + np.arange(len(mine))
            filled[s] += len(mine)
        columns = [*batch.columns[:-1], pa.array(np.full(len(keys), task, np.int64)), pa.array(shard.astype(np.int32)),
                   pa.array(local), pa.array(grown.astype(np.int32))]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "_task", "shard", "_local", "grown_shard"])


def assign_shards(rows: DataFrame, key: Column, shards: int = SHARDS) -> DataFrame:
    """The rows with shard, slot and grown_shard (the shard if there were one more). Give the few columns that the
    assignment should carry; they are kept once in the shared folder, so that both passes see the same rows."""
    keyed = rows.withColumn("_key", F.xxhash64(key))
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    schema = f"{carried}, _task bigint, shard int, _local bigint, grown_shard int"
    placed = materialise(keyed.mapInArrow(lambda b: _placed(b, shards), schema))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (placed.groupBy("_task", "shard").agg(F.count("*").alias("_rows"))
              .select("_task", "shard", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first")))
    return (placed.join(firsts, ["_task", "shard"])
            .select(*rows.columns, "shard", (F.col("_first") + F.col("_local")).alias("slot"), "grown_shard"))


def document_rows(docs: DataFrame) -> DataFrame:
    """What the assignment carries of a document: its id, stored size and the checksum of its text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       (F.octet_length(text).cast("bigint") + ROW_OVERHEAD).alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents as Parquet files below one folder per shard."""
    keyed = docs.withColumn("_key", F.xxhash64("doc_id"))
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    schema = f"{carried}, _task bigint, shard int, _local bigint, grown_shard int"
    placed = keyed.mapInArrow(lambda b: _placed(b, shards), schema).drop("_task", "_local", "grown_shard")
    placed.write.partitionBy("shard").parquet(path)
