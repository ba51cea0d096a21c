"""Hard negatives by a vertical scan: rows of another label that score just below an anchor's positives.

Anchors (every so-manieth id) in blocks of bounded size meet blocks of rows, each pair of blocks once, as groups of one
shuffle; nothing passes the driver. Inside a pair the rows lie column by column. For each anchor the columns are read
in descending order of the anchor's magnitude there; what the unread columns can still add at least and at most (from
the block's smallest and largest component per column) bounds every score, and rows that no bound keeps in play leave
the bitmap of candidates: for positives, those that surely miss the first five; for negatives, those surely outside all
windows, or surely behind ten rows of a window. What is left at the last column has its exact score. Each pair hands on
its best few rows per question, and the best of those are the answer, as if all rows had been ranked.

Cases: rows without id, label or vector, or with a null or non-finite component take no part; a shorter vector counts
as one that ends in zeros, an empty one scores zero; components beyond 2^22 after scaling are held there; ties go to
the smaller id; repeated rows are rows of their own, but those of the anchor's own id are never its positives; a
positive with a negative score has an empty window; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from selectra.llm.vectors import floored, matrix, usable
from selectra.session import materialise

#: rows and anchors of a block at most (about), and the fewest rows for which a block pays
ROW_BLOCK, ANCHOR_BLOCK, LEAST_BLOCK = 32_768, 4_096, 2_048
#: columns read between two looks at the bounds
STEP = 8


@dataclass(frozen=True)
class Mining:
    """What is asked: who is an anchor, how many rows of either kind, and the window in hundredths of the positive."""

    scale: int = 256
    every: int = 100
    positives: int = 5
    negatives: int = 10
    low: int = 30
    high: int = 90


class Block:
    """Rows column by column, with the range of each column."""

    def __init__(self, table: pa.Table, width: int):
        values = matrix(table.column("v"), width)
        self.ids = table.column("vec_id").to_numpy()
        self.labels = table.column("label").to_numpy()
        self.columns = np.ascontiguousarray(values.T, dtype=np.float64)
        self.smallest, self.largest = self.columns.min(axis=1), self.columns.max(axis=1)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, in_play) -> tuple[np.ndarray, np.ndarray]:
        """The rows that stay in play to the last column, and their exact scores. ``in_play`` is given the lower and
        upper bounds of all candidates and says which stay."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = np.sort(np.stack([anchor * self.smallest, anchor * self.largest]), axis=0)[:, order]
        rest = np.concatenate([np.cumsum(ends[:, ::-1], axis=1)[:, ::-1], np.zeros((2, 1))], axis=1)
        rows, partial = np.flatnonzero(alive), np.zeros(int(alive.sum()))
        for start in range(0, len(order), STEP):
            if not rows.size:
                break
            read = order[start:start + STEP]
            partial += anchor[read] @ self.columns[read[:, None], rows[None, :]]
            done = min(start + STEP, len(order))
            if done < len(order):
                bitmap = in_play(partial + rest[0, done], partial + rest[1, done])
                if not bitmap.all():
                    rows, partial = rows[bitmap], partial[bitmap]
        return rows, partial

    def first(self, rows: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
        """The k best candidates: high scores first, then small ids."""
        if len(rows) > k:
            kth = np.partition(scores, len(scores) - k)[len(scores) - k]
            at = np.flatnonzero(scores >= kth)
        else:
            at = np.arange(len(rows))
        return at[np.lexsort((self.ids[rows[at]], -scores[at]))[:k]]


def _best(k: int):
    """In play: what may be among the k best."""
    def in_play(lower, upper):
        if len(lower) <= k:
            return np.ones(len(lower), bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return in_play


def _windows(windows: list[tuple[int, int]], k: int):
    """In play: what may be among the k best of any window."""
    def in_play(lower, upper):
        out = np.zeros(len(lower), bool)
        for low, high in windows:
            reach = (upper >= low) & (lower <= high)
            sure = lower[reach & (lower >= low) & (upper <= high)]
            if len(sure) >= k:
                reach &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            out |= reach
        return out

    return in_play


_POSITIVES = pa.schema([("anchor", pa.int64()), ("row_id", pa.int64()), ("score", pa.int64())])
_NEGATIVES = pa.schema([("anchor", pa.int64()), ("nth", pa.int32()), ("row_id", pa.int64()), ("score", pa.int64())])


def _table(out: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*out)) or [()] * len(schema)
    return pa.table([pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, schema)], schema=schema)


def _positives(rows: pa.Table, anchors: pa.Table, width: int, mining: Mining) -> pa.Table:
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        block, vectors = Block(rows, width), matrix(anchors.column("v"), width).astype(np.float64)
        uids, ids, labels = (anchors.column(c).to_numpy() for c in ("anchor", "vec_id", "label"))
        for uid, own, label, vector in zip(uids, ids, labels, vectors):
            alive = (block.labels == label) & (block.ids != own)
            found, scores = block.scan(vector, alive, _best(mining.positives))
            top = block.first(found, scores, mining.positives)
            out.append((np.full(len(top), uid), block.ids[found[top]], scores[top].astype(np.int64)))
    return _table(out, _POSITIVES)


def _negatives(rows: pa.Table, anchors: pa.Table, width: int, mining: Mining) -> pa.Table:
    out: list[tuple] = []
    if rows.num_rows and anchors.num_rows:
        block, vectors = Block(rows, width), matrix(anchors.column("v"), width).astype(np.float64)
        uids, labels = (anchors.column(c).to_numpy() for c in ("anchor", "label"))
        for uid, label, vector, goals in zip(uids, labels, vectors, anchors.column("goals").to_pylist()):
            windows = [(-(-mining.low * p // 100), mining.high * p // 100) for p in goals]
            found, scores = block.scan(vector, block.labels != label, _windows(windows, mining.negatives))
            for nth, (low, high) in enumerate(windows):
                inside = np.flatnonzero((scores >= low) & (scores <= high))
                top = inside[block.first(found[inside], scores[inside], mining.negatives)]
                out.append((np.full(len(top), uid), np.full(len(top), nth), block.ids[found[top]],
                            scores[top].astype(np.int64)))
    return _table(out, _NEGATIVES)


def _meet(rows: DataFrame, anchors: DataFrame, slots: int, blocks: int, schema: str, answer) -> DataFrame:
    """Each block of anchors with each block of rows. Rows are dealt by their place in the input, so that repeated or
    hot rows spread."""
    placed = (rows.withColumn("_slot", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(slots)).cast("int"))
              .withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (anchors.withColumn("_block", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).cast("int"))
             .withColumn("_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)))))
    return placed.groupBy("_slot", "_block").cogroup(asked.groupBy("_slot", "_block")).applyInArrow(answer, schema)


def whole_rows(embeddings: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """The rows that take part: vec_id, label and whole components."""
    vec_id, label = F.col("vec_id").cast("bigint"), F.col("label").cast("bigint")
    good = embeddings.where(vec_id.isNotNull() & label.isNotNull() & usable("embedding"))
    return good.select(vec_id.alias("vec_id"), label.alias("label"), floored("embedding", mining.scale).alias("v"))


def mine(rows: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for rows (vec_id, label, v)."""
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(1, size["width"] or 0)
    anchors = materialise(rows.where(F.col("vec_id") % mining.every == 0).withColumn(
        "anchor", F.monotonically_increasing_id()))
    spread = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size["n"] // LEAST_BLOCK))
    slots, blocks = max(1, spread, -(-size["n"] // ROW_BLOCK)), max(1, -(-anchors.count() // ANCHOR_BLOCK))

    near = _meet(rows, anchors, slots, blocks, "anchor bigint, row_id bigint, score bigint",
                 lambda left, right: _positives(left, right, width, mining))
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), "row_id")
    near = near.withColumn("nth", F.row_number().over(best) - 1).where(F.col("nth") < mining.positives)
    goals = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("nth", "row_id", "score"))).alias("near"))
    asked = materialise(anchors.join(goals, "anchor").withColumn("goals", F.col("near.score")))

    far = _meet(rows, asked.drop("near"), slots, blocks, "anchor bigint, nth int, row_id bigint, score bigint",
                lambda left, right: _negatives(left, right, width, mining))
    best = Window.partitionBy("anchor", "nth").orderBy(F.desc("score"), "row_id")
    far = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= mining.negatives)
    positive = F.col("near")[F.col("nth")]
    return far.join(asked.select("anchor", F.col("vec_id").alias("anchor_id"), "near"), "anchor").select(
        "anchor_id", positive["row_id"].alias("positive_id"), "rank", F.col("row_id").alias("negative_id"),
        positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
