"""Entity-level splits, permutations and resampling in seeded hash order."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from selectra.functions.draws import PRIME, draws, number_of, repetition_keys
from selectra.operators.ranking import hash_rank
from selectra.session import materialise, spread

SPLITS = ("train", "validation", "test")


def entity_split(entities: DataFrame, key: str, seed, train: float = 0.70, validation: float = 0.15) -> DataFrame:
    """Assign each entity to one split; sizes are rounded half to even."""
    placed = hash_rank(entities.select(key), key, seed)
    n_train = F.bround(F.col("n") * F.lit(train))
    n_valid = F.bround(F.col("n") * F.lit(validation))
    label = F.when(F.col("rank") <= n_train, SPLITS[0]).when(
        F.col("rank") <= n_train + n_valid, SPLITS[1]).otherwise(SPLITS[2])
    return placed.select(key, label.alias("split"))


def assign_split(df: DataFrame, assignment: DataFrame, key: str) -> DataFrame:
    return df.join(assignment, key)


def split_integrity(df: DataFrame, candidates: int, entity: str = "entity", context: str = "context",
                    candidate: str = "candidate", split: str = "split") -> DataFrame:
    """All split rules out of one scan, by three nested aggregations."""
    cells = df.groupBy(entity, context, candidate).agg(
        F.count(F.lit(1)).alias("_rows"), F.min(split).alias("_lo"), F.max(split).alias("_hi"))
    contexts = cells.groupBy(entity, context).agg(
        F.count(F.lit(1)).alias("_cands"), F.count_if(F.col("_rows") > 1).alias("_dup"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    entities = contexts.groupBy(entity).agg(
        F.count_if(F.col("_cands") != candidates).alias("_gaps"), F.sum("_dup").alias("_dup"),
        F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    seen = F.array_distinct(F.flatten(F.array(F.collect_set("_lo"), F.collect_set("_hi"))))
    return entities.agg(
        F.count_if(F.col("_lo") != F.col("_hi")).alias("entities_in_two_splits"),
        (F.size(F.array_except(F.array(*map(F.lit, SPLITS)), seen))
         + F.size(F.array_except(seen, F.array(*map(F.lit, SPLITS))))).cast("bigint").alias("unexpected_splits"),
        F.sum("_gaps").cast("bigint").alias("incomplete_cells"),
        F.sum("_dup").cast("bigint").alias("duplicate_rows"))


def disjointness(df: DataFrame, entity: str = "entity", split: str = "split") -> DataFrame:
    """All pairwise intersections at once: an entity in two splits has two extremes."""
    per = df.groupBy(entity).agg(F.min(split).alias("_lo"), F.max(split).alias("_hi"))
    return per.agg(F.count(F.lit(1)).alias("entities"),
                   F.count_if(F.col("_lo") != F.col("_hi")).alias("overlapping"))


def random_expectation(candidates: DataFrame, case: Sequence[str], quality: str = "quality") -> DataFrame:
    return candidates.groupBy(*case).agg(F.avg(quality).alias("random_expected_quality"))


# Permutations -------------------------------------------------------------------

def permute_units(units: DataFrame, key: str, columns: Sequence[str], seed,
                  group: Sequence[str] = ()) -> DataFrame:
    """Give every unit the block of columns of another unit, by one bijection.

    Two independent hash orders are matched position by position.
    """
    takers = hash_rank(units.select(*group, key), key, _sub(seed, "take"), group, "_pos", "_n").drop("_n")
    givers = hash_rank(units.select(*group, key, *columns), key, _sub(seed, "give"), group, "_pos", "_n")
    return takers.join(givers.drop("_n", key), [*group, "_pos"]).drop("_pos")


def _sub(seed, role: str) -> Column:
    base = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.concat_ws("|", base, F.lit(role))


def permute_by_entity(df: DataFrame, columns: Sequence[str], seed, entity: str = "entity") -> DataFrame:
    units = df.select(entity, *columns).dropDuplicates([entity])
    return df.drop(*columns).join(permute_units(units, entity, columns, seed), entity)


def permute_labels(df: DataFrame, label: str, seed) -> DataFrame:
    """Relabel through one global bijection, which keeps every case intact."""
    labels = df.select(label).distinct().withColumn("_to", F.col(label))
    mapping = permute_units(labels, label, ["_to"], seed)
    return df.join(mapping, label).drop(label).withColumnRenamed("_to", label)


def permute_descriptors(df: DataFrame, columns: Sequence[str], seed, candidate: str = "candidate",
                        cost: str = "shots") -> DataFrame:
    """Shuffle descriptors across candidates; feasibility keeps the original cost."""
    kept = df.withColumn("feasibility_cost", F.col(cost))
    units = df.select(candidate, *columns).dropDuplicates([candidate])
    return kept.drop(*columns).join(permute_units(units, candidate, columns, seed), candidate)


# Resampling -----------------------------------------------------------------------
# Only sums per (scope, repetition) are shuffled, never units x repetitions rows: the draws of a repetition are dealt to
# buckets of units first, and each task resamples its own bucket.

#: units of a bucket (about), repetitions that a task works out at once, and units whose weights it draws at once
BUCKET_UNITS, REPETITION_BLOCK, UNIT_BLOCK = 4_096, 1_000, 512


def bootstrap_means(units: DataFrame, scope: Sequence[str], unit: str, value: str, repetitions: int,
                    seed: int) -> DataFrame:
    """Mean of each resample (n draws with replacement out of the n units of a scope).

    A scope lies in 2^k buckets. How many of a repetition's n draws fall into a bucket is split from the whole scope
    downwards, half by half, by seeded binomials; each task that meets a node draws the same numbers there. Inside its
    bucket a task draws places by hash. A scope of one bucket needs no binomials.
    """
    if not scope:
        one = units.withColumn("_every", F.lit(0))
        return bootstrap_means(one, ["_every"], unit, value, repetitions, seed).drop("_every")
    rows = materialise(units.select(*scope, F.col(unit).alias("_unit"), F.col(value).cast("double").alias("_x")))
    sizes = rows.groupBy(*scope).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n").alias("n")).first()["n"] or 0
    depth = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(float(BUCKET_UNITS))))).cast("int")
    placed = rows.join(sizes.withColumn("_depth", depth), list(scope))
    bucket = F.pmod(F.xxhash64("_unit"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_depth")))
    buckets = placed.groupBy(*scope, bucket.alias("_bucket")).agg(
        F.first("_n").alias("_n"), F.first("_depth").alias("_depth"),
        F.transform(F.array_sort(F.collect_list(F.struct("_unit", "_x"))), lambda u: u["_x"]).alias("_values"))
    for level in range(max(0, math.ceil(math.log2(max(most, 1) / BUCKET_UNITS)))):
        down = F.col("_depth") - level
        node = F.when(down > 0, F.call_function("shiftright", F.col("_bucket"), F.greatest(down, F.lit(0))))
        right = F.call_function("shiftright", F.col("_bucket"), F.greatest(down - 1, F.lit(0))).bitwiseAND(F.lit(1).cast("bigint"))
        whole = Window.partitionBy(*scope, f"_node{level}")
        inside = F.size("_values").cast("bigint")
        buckets = buckets.withColumn(f"_node{level}", node).withColumn(f"_right{level}", right)
        buckets = buckets.withColumn(f"_all{level}", F.sum(inside).over(whole)).withColumn(
            f"_left{level}", F.sum(F.when(F.col(f"_right{level}") == 0, inside).otherwise(0)).over(whole))
    levels = sum(c.startswith("_node") for c in buckets.columns)
    path = F.filter(F.array(*[F.struct(*[F.col(f"_{c}{i}").alias(c) for c in ("node", "right", "all", "left")])
                              for i in range(levels)]), lambda s: s["node"].isNotNull()) if levels else F.lit(None)
    blocks = -(-repetitions // REPETITION_BLOCK)
    work = spread(buckets.select(
        F.xxhash64(*scope).alias("_key"), "_bucket", "_n", "_values",
        path.cast("array<struct<node: bigint, right: bigint, all: bigint, left: bigint>>").alias("_path"), *scope,
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")))
    schema = T.StructType([*[units.schema[c] for c in scope], T.StructField("repetition", T.IntegerType()),
                           T.StructField("_total", T.DoubleType()), T.StructField("_n", T.LongType())])
    sums = work.mapInArrow(lambda b: _resampled(b, len(scope), repetitions, seed), schema)
    return sums.groupBy(*scope, "repetition").agg((F.sum("_total") / F.first("_n")).alias("resampled_mean"))


def _resampled(batches: Iterator[pa.RecordBatch], scopes: int, repetitions: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            key, bucket, n, values, path = (batch.column(c)[i].as_py() for c in range(5))
            block = batch.column(batch.num_columns - 1)[i].as_py()
            first = block * REPETITION_BLOCK + 1
            numbers = np.arange(first, min(first + REPETITION_BLOCK, repetitions + 1))
            drawn = np.full(len(numbers), n)
            for level, step in enumerate(path or []):
                dice = np.random.default_rng([seed, key & (1 << 64) - 1, level, step["node"], block])
                to_left = dice.binomial(drawn, step["left"] / step["all"])
                drawn = drawn - to_left if step["right"] else to_left
            keys, here = repetition_keys(numbers, seed), np.array(values)
            total, most = np.zeros(len(numbers)), int(drawn.max())
            for start in range(0, most, UNIT_BLOCK):
                place = np.arange(start, min(start + UNIT_BLOCK, most))
                picked = here[(draws(keys, (bucket << 21) + 1 + place) % np.uint64(len(here))).astype(np.int64)]
                total += np.where(place[None, :] < drawn[:, None], picked, 0.0).sum(1)
            same = pa.array(np.full(len(numbers), i))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(5 + c).take(same) for c in range(scopes)], pa.array(numbers.astype(np.int32)),
                 pa.array(total), pa.array(np.full(len(numbers), n, np.int64))],
                [*batch.schema.names[5:5 + scopes], "repetition", "_total", "_n"])


def _signs(drawn: np.ndarray) -> np.ndarray:
    return 1.0 - 2.0 * (drawn & np.uint64(1)).astype(np.float64)


#: P(X <= k) of a Poisson count of mean 1, up to where 31 bits see no more
POISSON_CDF = tuple(math.exp(-1.0) * sum(1.0 / math.factorial(j) for j in range(k + 1)) for k in range(13))


def _poisson(drawn: np.ndarray) -> np.ndarray:
    return np.searchsorted(np.array(POISSON_CDF), drawn / float(PRIME), side="right").astype(np.float64)


WEIGHTS = {"sign": _signs, "poisson": _poisson}


def weighted_sums(units: DataFrame, scope: Sequence[str], unit: str, value: str, repetitions: int, seed: int,
                  weight: str) -> DataFrame:
    """Per scope and repetition: the sum of the values under independent weights of the units ("sign": plus or minus
    one, "poisson": a count of mean one) as ``total``, and of the weights as ``weight``.

    A task keeps the sums of the scopes it meets, so that one row per task, scope and repetition is shuffled.
    """
    number = number_of(units.schema[unit].dataType, F.col(unit))
    rows = spread(units.select(number.alias("_unit"), F.col(value).cast("double").alias("_x"), *scope), "_unit")
    schema = T.StructType([*[units.schema[c] for c in scope], T.StructField("repetition", T.IntegerType()),
                           T.StructField("_total", T.DoubleType()), T.StructField("_weight", T.DoubleType())])
    sums = rows.mapInArrow(lambda b: _weighted(b, repetitions, seed, WEIGHTS[weight]), schema)
    return sums.groupBy(*scope, "repetition").agg(F.sum("_total").alias("total"), F.sum("_weight").alias("weight"))


def _weighted(batches: Iterator[pa.RecordBatch], repetitions: int, seed: int, weigh) -> Iterator[pa.RecordBatch]:
    kept: dict[tuple, np.ndarray] = {}
    names = []

    def flush():
        for key, sums in kept.items():
            columns = [pa.array([v] * repetitions, kind) for v, kind in zip(key, kinds)]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.arange(1, repetitions + 1, dtype=np.int32)), pa.array(sums[0]), pa.array(sums[1])],
                [*names, "repetition", "_total", "_weight"])
        kept.clear()

    for batch in batches:
        names, kinds = batch.schema.names[2:], [f.type for f in batch.schema][2:]
        for start in range(0, batch.num_rows, UNIT_BLOCK):
            part = batch.slice(start, UNIT_BLOCK)
            numbers, values = part.column(0).to_numpy(), part.column(1).to_numpy(zero_copy_only=False)
            keys = list(zip(*[part.column(2 + c).to_pylist() for c in range(len(names))])) or [()] * len(numbers)
            places: dict[tuple, list[int]] = {}
            for i, key in enumerate(keys):
                places.setdefault(key, []).append(i)
            distinct, which = np.unique(numbers, return_inverse=True)
            for first in range(0, repetitions, REPETITION_BLOCK):
                last = min(first + REPETITION_BLOCK, repetitions)
                weights = weigh(draws(repetition_keys(np.arange(first + 1, last + 1), seed), distinct))
                for key, here in places.items():
                    mine = weights[:, which[here]]
                    sums = kept.setdefault(key, np.zeros((2, repetitions)))
                    sums[0, first:last] += mine @ values[here]
                    sums[1, first:last] += mine.sum(1)
            if len(kept) > 64:
                yield from flush()
    yield from flush()


def poisson_bootstrap_means(units: DataFrame, scope: Sequence[str], unit: str, value: str,
                            repetitions: int, seed: int) -> DataFrame:
    """Streaming-friendly variant: every unit gets an independent Poisson(1) weight, one pass without positions."""
    sums = weighted_sums(units, scope, unit, value, repetitions, seed, "poisson")
    return sums.select(*scope, "repetition", F.try_divide(
        F.col("total"), F.nullif(F.col("weight"), F.lit(0.0))).alias("resampled_mean"))


def percentile_interval(means: DataFrame, scope: Sequence[str], low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval with linear interpolation; a scope has one row per repetition."""
    return means.groupBy(*scope).agg(
        F.percentile("resampled_mean", F.lit(low)).alias("ci_low"),
        F.percentile("resampled_mean", F.lit(high)).alias("ci_high"))
