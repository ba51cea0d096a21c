"""Nearest neighbours: exact in balanced boxes, approximate in ranked buckets, and what is chosen by them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from selectra.functions.hashing import row_hash

from selectra.operators.aggregates import share
from selectra.operators.selection import best_row
from selectra.functions.scalar import is_close
from selectra.session import materialise
from selectra.sources.registries import BUDGETS, expand_budgets

def standardize(df: DataFrame, fitted_on: DataFrame, columns: Sequence[str], prefix: str = "z_") -> DataFrame:
    """Centre and scale by the population moments of the training rows only."""
    stats = fitted_on.agg(*[F.avg(c).alias(f"_m_{c}") for c in columns],
                          *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]).first()
    out = [((F.col(c) - F.lit(stats[f"_m_{c}"])) / F.lit(stats[f"_s_{c}"] or 1.0)).alias(prefix + c) for c in columns]
    return df.select("*", *out)


# Exact search in few dimensions ------------------------------------------------------------
# Cells are balanced boxes; a target looks into its own cell, and then into those boxes that are no farther than the k-th
# row found there. Three shuffles, whatever the data.

@dataclass(frozen=True)
class Cells:
    """A k-d partition: per inner node (heap numbers) a dimension and a cut, per cell its box and its points."""

    dim: np.ndarray
    cut: np.ndarray
    ids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    points: np.ndarray

    def place(self, x: np.ndarray) -> np.ndarray:
        return _descend(self.dim, self.cut, x)

    def least(self, x: np.ndarray) -> np.ndarray:
        """Distance from each row to each box."""
        out = np.zeros((len(x), len(self.ids)))
        for c in range(x.shape[1]):
            gap = np.maximum(np.maximum(self.low[:, c][None, :] - x[:, c][:, None], x[:, c][:, None] - self.high[:, c][None, :]), 0.0)
            out += gap * gap
        return np.sqrt(out)

    def surely(self, x: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each row has k points for certain: boxes in order of their far corners."""
        far = np.zeros((len(x), len(self.ids)))
        for c in range(x.shape[1]):
            gap = np.maximum(np.abs(x[:, c][:, None] - self.low[:, c]), np.abs(x[:, c][:, None] - self.high[:, c]))
            far += gap * gap
        order = np.argsort(far, axis=1)
        enough = (np.cumsum(self.points[order], axis=1) >= k).argmax(1)
        return np.sqrt(np.take_along_axis(far, order, 1)[np.arange(len(x)), enough])


def _descend(dim: np.ndarray, cut: np.ndarray, x: np.ndarray) -> np.ndarray:
    node = np.ones(len(x), np.int64)
    going = np.flatnonzero(dim[node] >= 0)
    while len(going):
        here = node[going]
        node[going] = 2 * here + (x[going, dim[here]] > cut[here])
        going = going[dim[node[going]] >= 0]
    return node


#: cells at most; points of a group (larger cells are split), and targets of a group
MOST_CELLS, GROUP_POINTS, GROUP_TARGETS = 4_096, 4_096, 65_536


def cut_cells(points: DataFrame, width: int, rows: int, cell_rows: int = 1024) -> Cells:
    """Boxes of about ``cell_rows`` points (more where MOST_CELLS would be passed), halved along their widest side at
    the median, one aggregate per level. Only boxes reach the driver; a box of one place is not halved."""
    levels = max(0, math.ceil(math.log2(max(1, rows) / max(cell_rows, rows / MOST_CELLS))))
    dim, cut = np.full(2 << levels, -1), np.zeros(2 << levels)
    stats = [f(F.col("_x")[c]).alias(f"{n}{c}") for c in range(width) for n, f in (("lo", F.min), ("hi", F.max))]
    middle = [F.percentile_approx(F.col("_x")[c], 0.5).alias(f"mid{c}") for c in range(width)]
    for level in range(levels + 1):
        placed = points.select("_x").mapInArrow(
            lambda b, dim=dim.copy(), cut=cut.copy(): _at_cells(b, dim, cut), "_x array<double>, _cell bigint")
        last = level == levels
        boxes = placed.groupBy("_cell").agg(F.count("*").alias("n"), *stats, *([] if last else middle)).collect()
        if last:
            break
        for r in boxes:
            if r["_cell"] < 1 << level:
                continue  # one place, left as it is
            widest = max(range(width), key=lambda c: r[f"hi{c}"] - r[f"lo{c}"])
            lo, hi, mid = r[f"lo{widest}"], r[f"hi{widest}"], r[f"mid{widest}"]
            between = mid if mid < hi else lo + (hi - lo) / 2
            if lo <= between < hi:
                dim[r["_cell"]], cut[r["_cell"]] = widest, between
    side = lambda n: np.array([[r[f"{n}{c}"] for c in range(width)] for r in boxes], dtype=float).reshape(-1, width)
    return Cells(dim, cut, np.array([r["_cell"] for r in boxes], np.int64), side("lo"), side("hi"),
                 np.array([r["n"] for r in boxes], np.int64))


def _at_cells(batches, dim, cut):
    for batch in batches:
        x = vectors(batch.column(0))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_descend(dim, cut, x))], ["_x", "_cell"])


def vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _numbers(columns: Sequence[str]):
    """The coordinates as one array, null where one is missing."""
    xs = [F.col(c).cast("double") for c in columns]
    whole = reduce(lambda a, b: a & b, [x.isNotNull() & ~F.isnan(x) for x in xs])
    return F.when(whole, F.array(*xs)).alias("_x")


def nearest(targets: DataFrame, train: DataFrame, key: str, columns: Sequence[str], k: int = 5,
            cell_rows: int = 1024) -> DataFrame:
    """(key, neighbour, distance, rank): the k nearest training rows of every target, exactly; ties go to the lower id.

    Equal training points are first reduced to their k lowest ids. The training rows are cut into balanced boxes. A
    target is compared with the points of one box, which bounds its k-th distance, and then with those of all boxes
    within the bound. Boxes of many points or targets are split over groups. Meant for few dimensions. Rows without a
    coordinate (null or NaN) take no part.
    """
    points = materialise(train.select(F.col(key).alias("neighbour"), _numbers(columns)).where("_x IS NOT NULL").withColumn(
        "_n", F.row_number().over(Window.partitionBy("_x").orderBy("neighbour"))).where(F.col("_n") <= k).drop("_n"))
    asked = targets.select(key, _numbers(columns)).where("_x IS NOT NULL")
    rows = points.count()
    kinds = (train.schema[key], targets.schema[key])
    if not rows:
        return _pairs(asked, key, kinds).limit(0)
    need, width = min(k, rows), len(columns)
    cells = cut_cells(points, width, rows, cell_rows)

    def home(batches):
        for batch in batches:
            for part in _slices(batch):
                x = vectors(part.column(1))
                near = cells.least(x)
                inside = cells.place(x)
                at = np.where((near == near.min(1)[:, None]) & (cells.ids[None, :] == inside[:, None]), -1.0, near).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at)], [key, "_x", "_cell"])

    at_home = materialise(asked.mapInArrow(home, T.StructType(
        [targets.schema[key], _X, T.StructField("_cell", T.LongType())])))
    first = materialise(_met(at_home, points, cells, key, kinds, need))
    bounds = first.groupBy(key).agg(F.max(F.when(F.col("rank") == need, F.col("distance"))).alias("_bound"))
    bounded = at_home.join(bounds, key, "left")

    def around(batches):
        for batch in batches:
            for part in _slices(batch):
                x, own = vectors(part.column(1)), part.column(2).to_numpy()
                bound = part.column(3).to_numpy(zero_copy_only=False).astype(float)
                bound = np.fmin(bound, cells.surely(x, need))
                hit = cells.least(x) * (1 - 1e-9) <= bound[:, None]
                hit[np.arange(len(x)), own] = False
                row, cell = np.nonzero(hit)
                took = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(took), part.column(1).take(took), pa.array(cell)], [key, "_x", "_cell"])

    beyond = bounded.select(key, "_x", "_cell", "_bound").mapInArrow(around, at_home.schema)
    second = _met(beyond, points, cells, key, kinds, need)
    order = Window.partitionBy(key).orderBy("distance", "neighbour")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= need)


_X = T.StructField("_x", T.ArrayType(T.DoubleType()))


def _slices(batch: pa.RecordBatch, rows: int = 1024):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _pairs(asked: DataFrame, key: str, kinds) -> DataFrame:
    return asked.select(key, F.lit(None).cast(kinds[0].dataType).alias("neighbour"), F.lit(0.0).alias("distance"),
                        F.lit(0).cast("bigint").alias("rank"))


def _met(asked: DataFrame, points: DataFrame, cells: Cells, key: str, kinds, need: int) -> DataFrame:
    """The ``need`` nearest rows of each target out of each cell that it asks."""
    crowd = dict(asked.groupBy("_cell").count().collect())  # one row a cell
    salts = np.array([-(-crowd.get(i, 0) // GROUP_TARGETS) for i in range(len(cells.ids))], np.int64)
    slots = -(-cells.points // GROUP_POINTS)
    where = {int(c): i for i, c in enumerate(cells.ids)}

    def offered(batches):
        for batch in batches:
            cell = np.array([where[c] for c in cells.place(vectors(batch.column(1))).tolist()], np.int64)
            # a target's salt picks one copy of the cell's points; it meets all slots of that copy
            row = np.repeat(np.arange(len(cell)), salts[cell])
            salt = np.arange(len(row)) - np.repeat(np.cumsum(salts[cell]) - salts[cell], salts[cell])
            took = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(took), batch.column(1).take(took), batch.column(2).take(took),
                 pa.array(cell[row]), pa.array(salt)], ["neighbour", "_x", "_hash", "_cell", "_salt"])

    limits = lambda values: F.element_at(F.lit(values.tolist()), (F.col("_cell") + 1).cast("int"))
    sides = points.select("neighbour", "_x", F.xxhash64("neighbour").alias("_hash")).mapInArrow(offered, T.StructType(
        [T.StructField("neighbour", kinds[0].dataType), _X,
         *[T.StructField(c, T.LongType()) for c in ("_hash", "_cell", "_salt")]]))
    sides = sides.select("neighbour", "_x", "_cell", "_salt", F.pmod("_hash", limits(slots)).alias("_slot"))
    wanted = asked.select(key, "_x", "_cell", F.pmod(F.xxhash64(key), limits(salts)).alias("_salt"),
                          F.explode(F.sequence(F.lit(0).cast("bigint"), limits(slots) - 1)).alias("_slot"))
    group = ["_cell", "_salt", "_slot"]
    schema = T.StructType([kinds[1], T.StructField("neighbour", kinds[0].dataType),
                           T.StructField("distance", T.DoubleType())])
    met = wanted.groupBy(*group).cogroup(sides.groupBy(*group)).applyInArrow(
        lambda left, right: _closest(left, right, key, need), schema)
    order = Window.partitionBy(key).orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= need)


def _nearest_pairs(x: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of places, with their distances, that hold the k nearest of each row of x and all that tie with them.

    Squared distances as a matrix product are off by rounding, so what lies within twice their largest error is measured
    again column by column. Where the error is unbounded or leaves too many pairs, all are measured that way.
    """
    with np.errstate(all="ignore"):
        xx, pp = (x * x).sum(1), (p * p).sum(1)
        gap = x @ (-2 * p.T) + pp[None, :] + xx[:, None]
        error = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (xx + pp.max()) + np.finfo(float).tiny
    if np.isfinite(gap).all():
        row, column = np.nonzero(gap <= (np.partition(gap, k - 1, axis=1)[:, k - 1] + 2 * error)[:, None])
        if 8 * len(row) <= gap.size:
            exact = np.zeros(len(row))
            for c in range(x.shape[1]):
                exact += (x[row, c] - p[column, c]) ** 2
            return row, column, np.sqrt(exact)
    gap = np.zeros((len(x), len(p)))
    for c in range(x.shape[1]):
        gap += (x[:, c][:, None] - p[:, c][None, :]) ** 2
    gap = np.sqrt(gap)
    row, column = np.nonzero(gap <= np.partition(gap, k - 1, axis=1)[:, k - 1][:, None])
    return row, column, gap[row, column]


def _closest(left: pa.Table, right: pa.Table, key: str, need: int) -> pa.Table:
    """The nearest rows of the right side for each of the left, compared in blocks."""
    rows, columns, distances = [], [], []
    if left.num_rows and right.num_rows:
        right = right.sort_by("neighbour")
        x, p = vectors(left.column("_x")), vectors(right.column("_x"))
        k, step = min(need, len(p)), max(1, 2_000_000 // len(p))
        for start in range(0, len(x), step):
            row, column, gap = _nearest_pairs(x[start:start + step], p, k)
            order = np.lexsort((column, gap, row))
            row, column, gap = row[order], column[order], gap[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            taken = nth < k
            rows.append(row[taken] + start)
            columns.append(column[taken])
            distances.append(gap[taken])
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return pa.table({key: left.column(key).take(pa.array(joined(rows, np.int64))),
                     "neighbour": right.column("neighbour").take(pa.array(joined(columns, np.int64))),
                     "distance": joined(distances, np.float64)})


# Approximate search in many dimensions ---------------------------------------------------------

def nearest_ranked(targets: DataFrame, train: DataFrame, key: str, vector: str, k: int = 5, share_probed: float = 0.75,
                   pivots: int = 256, seed: int = 2027) -> DataFrame:
    """Neighbours of long vectors: each target looks into the buckets nearest to it, and gets k rows for certain.

    Up to ``pivots`` training rows, drawn by seed, are the centres of buckets; every training row lies in the bucket of
    its nearest centre. A target ranks the centres and probes the nearest ones that together hold ``share_probed`` of
    the rows. If these hold fewer than k rows, it goes on to the next ones (in order) until they hold k. With
    ``share_probed=1`` all buckets are probed and the result is exact; recall falls slowly with the share where vectors
    lie in clusters and in proportion where they don't. Buckets of many rows are split over groups.
    """
    points = materialise(train.select(F.col(key).alias("neighbour"), F.col(vector).cast("array<double>").alias("_x")).where(
        "_x IS NOT NULL"))
    asked = targets.select(key, F.col(vector).cast("array<double>").alias("_x")).where("_x IS NOT NULL")
    rows = points.count()
    kinds = (train.schema[key], targets.schema[key])
    if not rows:
        return _pairs(asked, key, kinds).limit(0)
    count = min(pivots, max(1, math.isqrt(rows)))
    drawn = points.orderBy(row_hash(seed, "neighbour"), "neighbour").limit(count).select("_x").toArrow()
    centres = vectors(drawn.column("_x"))

    def bucketed(batches):
        for batch in batches:
            for part in _slices(batch):
                at = _gaps(vectors(part.column(1)), centres).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at)], ["neighbour", "_x", "_cell"])

    held = materialise(points.mapInArrow(bucketed, T.StructType(
        [T.StructField("neighbour", kinds[0].dataType), _X, T.StructField("_cell", T.LongType())])))
    sizes = np.zeros(len(centres), np.int64)
    for r in held.groupBy("_cell").count().collect():  # one row a bucket
        sizes[r["_cell"]] = r["count"]
    need, least = min(k, rows), max(min(k, rows), share_probed * rows)

    def probes(batches):
        for batch in batches:
            for part in _slices(batch):
                order = np.argsort(_gaps(vectors(part.column(1)), centres), axis=1, kind="stable")
                before = np.cumsum(sizes[order], axis=1) - sizes[order]
                row, nth = np.nonzero(before < least)
                cell, took = order[row, nth], pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(took), part.column(1).take(took), pa.array(cell)], [key, "_x", "_cell"])

    wanted = asked.mapInArrow(probes, T.StructType([targets.schema[key], _X, T.StructField("_cell", T.LongType())]))
    crowd = dict(wanted.groupBy("_cell").count().collect())  # one row a bucket
    slots = np.maximum(1, -(-sizes // GROUP_POINTS))
    salts = np.array([max(1, -(-crowd.get(i, 0) // GROUP_TARGETS)) for i in range(len(sizes))])
    of_cell = lambda values: F.element_at(F.lit(values.tolist()), (F.col("_cell") + 1).cast("int"))
    upto = lambda values: F.explode(F.sequence(F.lit(0).cast("bigint"), of_cell(values) - 1))
    left = wanted.withColumn("_salt", F.pmod(F.xxhash64(key), of_cell(salts))).withColumn("_slot", upto(slots))
    right = held.withColumn("_slot", F.pmod(F.xxhash64("neighbour"), of_cell(slots))).withColumn("_salt", upto(salts))
    group = ["_cell", "_salt", "_slot"]
    schema = T.StructType([kinds[1], T.StructField("neighbour", kinds[0].dataType), T.StructField("distance", T.DoubleType())])
    met = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(
        lambda a, b: _closest(a, b, key, need), schema)
    order = Window.partitionBy(key).orderBy("distance", "neighbour")
    return met.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= need)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)[None, :]


def neighbour_lists(near: DataFrame, key: str) -> DataFrame:
    """The k neighbours of each target as text, nearest first."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("neighbour").cast("string").alias("id"))))
    return near.groupBy(key).agg(F.concat_ws("|", F.transform(ordered, lambda s: s["id"])).alias("neighbour_ids"))


def heuristic_cases(candidates: DataFrame, near: DataFrame, budgets=BUDGETS, digits: int = 9) -> DataFrame:
    """Pick the candidate with the best mean among the neighbours, per case.

    ``candidates`` has one row per (entity, context, candidate); ``near`` the
    neighbours of each evaluated entity.
    """
    feasible = expand_budgets(candidates, budgets)
    around = near.select("entity", F.col("neighbour").alias("_e")).join(
        feasible.withColumnRenamed("entity", "_e"), "_e")
    means = around.groupBy("entity", "context", "budget", "candidate").agg(
        F.round(F.avg("quality"), digits).alias("neighbour_quality"))
    chosen = best_row(means, ["entity", "context", "budget"], "neighbour_quality", "candidate").withColumnRenamed(
        "candidate", "selected_candidate")
    own = feasible.join(chosen, ["entity", "context", "budget"])
    hit = F.max(F.when(F.col("candidate") == F.col("selected_candidate"), F.col("quality")))
    cases = own.groupBy("entity", "context", "budget", "selected_candidate", "neighbour_quality").agg(
        hit.alias("selected_quality"), F.max("quality").alias("oracle_quality"))
    gap = F.col("oracle_quality") - F.col("selected_quality")
    return cases.withColumn("regret", F.greatest(F.lit(0.0), gap)).withColumn(
        "matches_oracle_quality", is_close("selected_quality", "oracle_quality"))


def heuristic_metrics() -> dict:
    return {"entities": F.countDistinct("entity"), "cases": F.count(F.lit(1)),
            "heuristic_mean": F.avg("selected_quality"), "oracle_mean": F.avg("oracle_quality"),
            "mean_regret": F.avg("regret"), "oracle_accuracy": share(F.col("matches_oracle_quality"))}
