"""Short codes for vectors: product quantisation whose rounds assign whole subtrees of cover trees.

A vector is cut into consecutive parts; each part has its own codebook, improved by rounds of assigning every part to
its nearest entry and moving each entry to the floor of its parts' mean. Blocks of rows get a cover tree per part once,
kept in the shared folder: on each level no two nodes lie closer than the level's scale, every node lies within twice
that of its parent, and a node knows its radius and the sum and number of the points below. A round walks the trees
level by level. By the triangle inequality no point below a node of radius r can prefer an entry that is more than 2r
farther from the node than the nearest one; where that leaves one entry, the whole subtree is assigned through its sums.
Only ambiguous nodes descend, and points below the last ambiguous node are compared exactly (whole numbers, ties to the
lower index). A level that would hold more than a quarter of the points is not built: it would save nothing.

Tasks hand on one sum per part and entry; the codebooks (parts x entries x width) are all that passes the driver.

Cases: rows whose vector is null or has a null or non-finite component are dropped; shorter vectors end in zeros, and
the width is filled up with zeros to a multiple of the parts; components beyond 2^22 after scaling are held there; null
ids are kept and come last in the order of ids, equal ids are ordered by their components; repeated rows are rows of
their own; fewer rows than entries give a codebook of so many; null labels are one label; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from selectra.llm.vectors import floored, matrix, usable
from selectra.session import materialise

#: rows of a block; a tree level may hold so many nodes per point
BLOCK_ROWS, NODES_PER_POINT = 4_096, 0.25
#: what rounding of a square root may hide
SLACK = 1e-3


@dataclass(frozen=True)
class Coding:
    scale: int = 1024
    parts: int = 4
    entries: int = 256
    rounds: int = 4


def squared(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole numbers, as floats."""
    x, c = points.astype(np.float64), entries.astype(np.float64)
    return (x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)[None, :]


class CoverTree:
    """A cover tree over distinct points with multiplicities.

    Arrays by level, from the root: ``centre`` (which point a node is), ``parent`` (place on the level above),
    ``radius``, ``total`` and ``count`` of the points below; ``leaf`` is each point's node on the last level.
    """

    def __init__(self, points: np.ndarray, counts: np.ndarray):
        self.points, self.counts = points, counts
        self.centres, self.parents, self.leaf = self._grow(points.astype(np.float64))
        self.radius, self.total, self.count = [], [], []
        owner = self.leaf
        for level in range(len(self.centres) - 1, -1, -1):
            centre = points[self.centres[level]]
            gap = np.sqrt((((points - centre[owner]).astype(np.float64)) ** 2).sum(1))
            n = len(centre)
            radius, total, count = np.zeros(n), np.zeros((n, points.shape[1]), np.int64), np.zeros(n, np.int64)
            np.maximum.at(radius, owner, gap)
            np.add.at(total, owner, points * counts[:, None])
            np.add.at(count, owner, counts)
            self.radius.insert(0, radius)
            self.total.insert(0, total)
            self.count.insert(0, count)
            owner = self.parents[level][owner]

    @staticmethod
    def _grow(points: np.ndarray):
        gap = np.sqrt(((points - points[0]) ** 2).sum(1))
        near = np.zeros(len(points), np.int64)  # each point's nearest node so far
        centres = [np.zeros(1, np.int64)]
        parents = [np.zeros(1, np.int64)]
        leaf, most = near, max(1, int(len(points) * NODES_PER_POINT))
        scale = 2.0 ** np.ceil(np.log2(max(gap.max(), 1.0)))
        while gap.max() > 0:
            scale /= 2
            chosen, finer, fine_gap = list(centres[-1]), near.copy(), gap.copy()
            while len(chosen) <= most:
                open_points = np.flatnonzero(fine_gap > scale)
                if not open_points.size:
                    break
                point = open_points[0]
                from_it = np.sqrt(((points - points[point]) ** 2).sum(1))
                closer = from_it < fine_gap
                finer[closer], fine_gap[closer] = len(chosen), from_it[closer]
                chosen.append(point)
            if len(chosen) > most:
                break
            if len(chosen) > len(centres[-1]):
                chosen = np.array(chosen)
                parents.append(near[chosen])
                centres.append(chosen)
                leaf = finer
            near, gap = finer, fine_gap
        return centres, parents, leaf

    def walk(self, entries: np.ndarray) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """("subtrees", level, nodes, entry of each) for whole subtrees, then ("points", -1, points, entry of each)."""
        open_nodes = np.zeros(1, np.int64)
        for level, centre in enumerate(self.centres):
            gaps = np.sqrt(np.maximum(squared(self.points[centre[open_nodes]], entries), 0.0))
            reach = gaps.min(1) + 2 * self.radius[level][open_nodes] + SLACK
            alone = (gaps <= reach[:, None]).sum(1) == 1
            yield "subtrees", level, open_nodes[alone], gaps[alone].argmin(1)
            still = np.zeros(len(centre), bool)
            still[open_nodes[~alone]] = True
            if level + 1 < len(self.centres):
                open_nodes = np.flatnonzero(still[self.parents[level + 1]])
        points = np.flatnonzero(still[self.leaf])
        yield "points", -1, points, squared(self.points[points], entries).argmin(1)

    def sums(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and number of the points that each entry is nearest to."""
        total, count = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
        for kind, level, which, entry in self.walk(entries):
            if kind == "subtrees":
                np.add.at(total, entry, self.total[level][which])
                np.add.at(count, entry, self.count[level][which])
            else:
                np.add.at(total, entry, self.points[which] * self.counts[which, None])
                np.add.at(count, entry, self.counts[which])
        return total, count

    def codes(self, entries: np.ndarray) -> np.ndarray:
        """The nearest entry of each point."""
        above, code = None, np.full(len(self.points), -1, np.int64)
        for kind, level, which, entry in self.walk(entries):
            if kind == "points":
                code = above[self.leaf]
                code[which] = entry
            else:
                here = np.full(len(self.centres[level]), -1, np.int64) if above is None else above[self.parents[level]]
                here[which] = entry
                above = here
        return code

    def arrays(self) -> dict:
        """What a stored tree consists of."""
        return {"points": self.points.astype("<i4").tobytes(), "counts": self.counts.astype("<i8").tobytes(),
                "leaf": self.leaf.astype("<i4").tobytes(), "sizes": [len(c) for c in self.centres],
                "centres": np.concatenate(self.centres).astype("<i4").tobytes(),
                "parents": np.concatenate(self.parents).astype("<i4").tobytes(),
                "radius": np.concatenate(self.radius).astype("<f8").tobytes(),
                "total": np.concatenate(self.total).astype("<i8").tobytes(),
                "count": np.concatenate(self.count).astype("<i8").tobytes()}

    @classmethod
    def stored(cls, kept: dict, width: int) -> "CoverTree":
        tree = cls.__new__(cls)
        ends = np.cumsum(kept["sizes"])[:-1]
        load = lambda name, kind: np.frombuffer(kept[name], kind)
        by_level = lambda values: np.split(values, ends)
        tree.points = load("points", "<i4").reshape(-1, width).astype(np.int64)
        tree.counts, tree.leaf = load("counts", "<i8"), load("leaf", "<i4").astype(np.int64)
        tree.centres = by_level(load("centres", "<i4").astype(np.int64))
        tree.parents = by_level(load("parents", "<i4").astype(np.int64))
        tree.radius, tree.count = by_level(load("radius", "<f8")), by_level(load("count", "<i8"))
        tree.total = by_level(load("total", "<i8").reshape(-1, width))
        return tree


_TREE = pa.struct([("points", pa.binary()), ("counts", pa.binary()), ("leaf", pa.binary()), ("sizes", pa.list_(pa.int32())),
                   ("centres", pa.binary()), ("parents", pa.binary()), ("radius", pa.binary()), ("total", pa.binary()),
                   ("count", pa.binary()), ("place", pa.binary())])
_BLOCK = pa.schema([("vec_ids", pa.list_(pa.int64())), ("labels", pa.list_(pa.string())), ("trees", pa.list_(_TREE))])
_BLOCK_SQL = ("vec_ids array<bigint>, labels array<string>, trees array<struct<points: binary, counts: binary, "
              "leaf: binary, sizes: array<int>, centres: binary, parents: binary, radius: binary, total: binary, "
              "count: binary, place: binary>>")


def _planted(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            block = batch.slice(start, BLOCK_ROWS)
            values, trees = matrix(block.column(2), parts * width), []
            for part in range(parts):
                points, place, counts = np.unique(
                    values[:, part * width:(part + 1) * width], axis=0, return_inverse=True, return_counts=True)
                trees.append(CoverTree(points, counts).arrays() | {"place": place.astype("<i4").tobytes()})
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.column(0).to_pylist()], _BLOCK.field(0).type),
                 pa.array([block.column(1).to_pylist()], _BLOCK.field(1).type), pa.array([trees], _BLOCK.field(2).type)],
                schema=_BLOCK)


_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("count", pa.int64()), ("total", pa.list_(pa.int64()))])


def _summed(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    total, count = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
    for batch in batches:
        for trees in batch.column(0).to_pylist():
            for part, kept in enumerate(trees):
                more, n = CoverTree.stored(kept, books.shape[2]).sums(books[part])
                total[part] += more
                count[part] += n
    part, entry = np.nonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]),
         pa.array(total[part, entry].tolist(), _SUMS.field(3).type)], schema=_SUMS)


_CODES = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])


def _coded(batches: Iterator[pa.RecordBatch], books: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for vec_ids, labels, trees in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            codes, error = np.zeros((len(vec_ids), len(trees)), np.uint8), np.zeros(len(vec_ids), np.int64)
            for part, kept in enumerate(trees):
                tree, place = CoverTree.stored(kept, books.shape[2]), np.frombuffer(kept["place"], "<i4")
                code = tree.codes(books[part])
                away = ((tree.points - books[part][code]) ** 2).sum(1)
                codes[:, part], error = code[place], error + away[place]
            spelled, step = codes.tobytes().hex(), 2 * len(trees)
            yield pa.RecordBatch.from_arrays(
                [pa.array(vec_ids, pa.int64()), pa.array(labels, pa.string()),
                 pa.array([spelled[i:i + step] for i in range(0, len(spelled), step)], pa.string()), pa.array(error)],
                schema=_CODES)


def fit_codes(embeddings: DataFrame, coding: Coding = Coding()) -> tuple[DataFrame, np.ndarray]:
    """Rows (vec_id, label, code, error) of all usable vectors, and the codebooks (part, entry, component)."""
    if not 1 <= coding.entries <= 256:
        raise ValueError("an entry is spelled with two hex digits: 1 to 256 entries")
    rows = embeddings.where(usable("embedding")).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"),
        floored("embedding", coding.scale).alias("v"))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    width = max(1, -(-longest // coding.parts))
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").limit(coding.entries).select("v").toArrow()
    books = (matrix(first.column("v"), coding.parts * width)
             .reshape(first.num_rows, coding.parts, width).transpose(1, 0, 2).copy())
    planted = materialise(rows.mapInArrow(lambda b: _planted(b, coding.parts, width), _BLOCK_SQL))
    if not first.num_rows:
        books = np.zeros((coding.parts, 0, width), np.int64)
        return planted.select(F.lit(0).cast("bigint").alias("vec_id"), F.lit("").alias("label"), F.lit("").alias("code"),
                              F.lit(0).cast("bigint").alias("error")), books
    schema = "part int, entry int, count bigint, total array<bigint>"
    for _ in range(coding.rounds):
        sums = planted.select("trees").mapInArrow(lambda b, books=books: _summed(b, books), schema)
        summed = sums.groupBy("part", "entry").agg(
            F.sum("count").alias("count"), F.array(*[F.sum(F.col("total")[i]) for i in range(width)]).alias("total"))
        moved = books.copy()
        for row in summed.collect():  # at most parts x entries rows
            moved[row["part"], row["entry"]] = np.array(row["total"], np.int64) // row["count"]
        books = moved
    coded = planted.mapInArrow(lambda b: _coded(b, books), "vec_id bigint, label string, code string, error bigint")
    return coded, books


def books_sha256(books: np.ndarray) -> str:
    """Checksum of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded_rows(embeddings: DataFrame, coding: Coding = Coding()) -> DataFrame:
    """vec_id, code, error, label_error and the checksum of the codebooks."""
    coded, books = fit_codes(embeddings, coding)
    coded = materialise(coded)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))
