"""Regression trees grown by aggregates: extremely randomised trees, forests, and boosting with a leaf limit.

All work on rows of ``x array<double>, y double``. A tree is rows of a node table: tree, node, feature (-1 at a leaf),
cut (``x[feature] <= cut`` goes left), value and rows. A node's id is a hash of its path, so that a child's id follows
from its parent's, at any depth.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from selectra.session import materialise, spread

ROOT = 1
NODES = "tree int, node bigint, feature int, cut double, value double, rows bigint"
_NODES = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("feature", pa.int32()), ("cut", pa.float64()),
                    ("value", pa.float64()), ("rows", pa.int64())])


def _mixed(x: np.ndarray) -> np.ndarray:
    """The published 64-bit finaliser of splitmix."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def child(node: np.ndarray, right) -> np.ndarray:
    """Ids of the left (0) or right (1) children."""
    return _mixed(np.atleast_1d(np.asarray(node, np.int64)).view(np.uint64) * np.uint64(2)
                  + np.asarray(right).astype(np.uint64)).view(np.int64)


def uniforms(seed: int, tree: np.ndarray, node: np.ndarray, features: int | np.ndarray) -> np.ndarray:
    """A draw in [0, 1) per node and feature (so many, or those of an array that has a row for all nodes or one for
    each), the same wherever the node is grown."""
    of_tree = _mixed(_mixed(np.full(1, seed, np.uint64)) + tree.astype(np.uint64))
    of_node = _mixed(of_tree ^ np.asarray(node, np.int64).view(np.uint64))
    wanted = np.arange(features, dtype=np.uint64)[None, :] if isinstance(features, int) else np.atleast_2d(features).astype(np.uint64)
    of_all = _mixed(of_node[:, None] + wanted)
    return (of_all >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def grain(most: float | None, weight: float) -> float:
    """A power of two whose multiples, up to ``most`` in size, have exact sums as long as the weights add up to no more
    than ``weight``. Targets that are rounded to it have the same sums in any order, on any split of the work."""
    if not most or not math.isfinite(most) or weight <= 0:
        return 0.0
    return math.ldexp(1.0, max(-1000, math.frexp(most)[1] + math.frexp(float(weight))[1] - 53))


class Places:
    """The features of some rows as places among their distinct values. Constant features can't be cut and are left out,
    and so is a feature of two values that parts the rows as an earlier one does, which wins every tie."""

    def __init__(self, x: np.ndarray):
        self.width = x.shape[1]
        two, more, self.values, seen = [], [], {}, set()
        self.columns = np.ascontiguousarray(x.T)
        codes = []
        for f, column in enumerate(self.columns):
            values, place = np.unique(column, return_inverse=True)
            if len(values) == 2:
                parts = place.astype(bool) ^ bool(place[0])
                if parts.tobytes() not in seen:
                    seen.add(parts.tobytes())
                    two.append((f, place.astype(bool)))
                    self.values[f] = values
            elif len(values) > 2:
                more.append(f)
                codes.append(place.astype(np.uint16 if len(values) <= 1 << 16 else np.int32))
                self.values[f] = values
        rows = len(x)
        self.two = np.array([f for f, _ in two], np.int64)
        self.bits = np.array([b for _, b in two], bool).reshape(len(two), rows)
        self.more = np.array(more, np.int64)
        self.ends = np.array([self.values[f] for f in self.two]).reshape(len(two), 2).T
        narrow = all(c.dtype == np.uint16 for c in codes)
        self.codes = np.array(codes, np.uint16 if narrow else np.int32).reshape(len(more), rows)

    def orders(self) -> tuple[np.ndarray, np.ndarray]:
        """Features of more than two values (of equal ones the first, which wins every tie), and the rows in order of each."""
        seen: dict[bytes, int] = {}
        for i, codes in enumerate(self.codes):
            seen.setdefault(codes.tobytes(), i)
        kept = np.array(sorted(seen.values()), np.int64)
        return kept, np.stack([np.argsort(self.codes[i], kind="stable") for i in kept]) if len(kept) else np.zeros((0, self.bits.shape[1]), np.int64)


#: numbers of an array of features by rows that are worked on at once, so that they stay in the cache
CACHED = 131_072


def _chunks(features: int, rows: int) -> Iterator[slice]:
    step = max(1, CACHED // max(1, rows))
    return (slice(a, min(a + step, features)) for a in range(0, features, step))


def _counts(which: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(which.view(np.uint8), starts, axis=1, dtype=np.uint16 if which.shape[1] < 1 << 16 else np.int64)


def _parted(rows: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Rows in one or several orders: in each, all that go left come before all that go right, otherwise as they were."""
    goes = right[rows]
    return np.concatenate([rows[~goes].reshape(*rows.shape[:-1], -1), rows[goes].reshape(*rows.shape[:-1], -1)], axis=-1)


# Extremely randomised trees --------------------------------------------------------------

#: rows of a node from which on its subtree is grown inside one task, and nodes that levels above may hold
TASK_ROWS, MOST_UPPER_NODES = 4_096, 1_000_000
#: tables of up to this many times TASK_ROWS rows give whole extra trees inside a task, so many from the same rows
WHOLE_TIMES, WHOLE_TREES = 8, 8


def spans(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Per run of rows: size, sum of y, and the ranges of y and of every feature."""
    return {"rows": np.diff(np.append(starts, len(y))), "sum": np.add.reduceat(y, starts),
            "y_lo": np.minimum.reduceat(y, starts), "y_hi": np.maximum.reduceat(y, starts),
            "lo": np.minimum.reduceat(x, starts, axis=0), "hi": np.maximum.reduceat(x, starts, axis=0)}


def random_cuts(seed: int, tree: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """A cut per node and feature, uniform in its range."""
    return _cut(lo, hi, uniforms(seed, tree, node, lo.shape[1]))


def _cut(lo: np.ndarray, hi: np.ndarray, u: np.ndarray) -> np.ndarray:
    cut = lo + u * (hi - lo)
    return np.where(cut >= hi, lo, cut)


def left_sums(x: np.ndarray, y: np.ndarray, starts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per run and feature: rows left of the run's cut, and their sum of y."""
    left = x <= np.repeat(cuts, np.diff(np.append(starts, len(y))), axis=0)
    return (np.add.reduceat(left.astype(np.int64), starts, axis=0),
            np.add.reduceat(np.where(left, y[:, None], 0.0), starts, axis=0))


def best_features(s: dict, n_left: np.ndarray, sum_left: np.ndarray, leaf: int) -> np.ndarray:
    """The feature whose cut leaves the least squared error per node, -1 where none may be cut."""
    n_right, sum_right = s["rows"][:, None] - n_left, s["sum"][:, None] - sum_left
    good = (s["lo"] < s["hi"]) & (n_left >= leaf) & (n_right >= leaf)
    score = np.where(good, sum_left ** 2 / np.maximum(n_left, 1) + sum_right ** 2 / np.maximum(n_right, 1), -np.inf)
    return np.where(good.any(1) & (s["y_lo"] < s["y_hi"]), score.argmax(1), -1)


def grow_subtree(tree: int, node: int, table: Places, y: np.ndarray, leaf: int, seed: int) -> Iterator[tuple]:
    """Columns of the node table below (and with) one node, level by level."""
    nodes, sizes, rows = np.array([node], np.int64), np.array([len(y)]), np.arange(len(y))
    number = np.concatenate([table.more, table.two])
    by_number, wide = np.argsort(number), len(table.more)
    while len(nodes):
        starts = np.cumsum(sizes) - sizes
        ys = y[rows]
        total = np.add.reduceat(ys, starts)
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes))
        open_ = (sizes >= 2 * leaf) & (np.minimum.reduceat(ys, starts) < np.maximum.reduceat(ys, starts))
        runs = np.flatnonzero(open_)
        if len(runs) and len(number):
            inside = np.repeat(open_, sizes)
            rows, ys, size, s = rows[inside], ys[inside], sizes[runs], total[runs]
            at = np.cumsum(size) - size
            of = np.full(len(runs), tree, np.int32)
            cuts, n_left, sum_left = np.zeros((wide, len(runs))), np.zeros((len(number), len(runs))), np.zeros((len(number), len(runs)))
            if wide:
                u = uniforms(seed, of, nodes[runs], table.more).T
            for part in _chunks(wide, len(rows)):
                codes = table.codes[part].take(rows, axis=1)
                lo, hi = np.minimum.reduceat(codes, at, axis=1), np.maximum.reduceat(codes, at, axis=1)
                last = np.zeros(lo.shape, codes.dtype)
                for i, f in enumerate(table.more[part]):
                    values, j = table.values[f], part.start + i
                    cuts[j] = _cut(values[lo[i]], values[hi[i]], u[j])
                    last[i] = np.searchsorted(values, cuts[j], "right") - 1
                left = codes <= np.repeat(last, size, axis=1)
                n_left[part] = _counts(left, at)
                sum_left[part] = np.add.reduceat(left * ys, at, axis=1)
            for part in _chunks(len(table.two), len(rows)):
                bits, here = table.bits[part].take(rows, axis=1), slice(wide + part.start, wide + part.stop)
                n_left[here] = size - _counts(bits, at)
                sum_left[here] = s - np.add.reduceat(bits * ys, at, axis=1)
            n_right, sum_right = size - n_left, s - sum_left
            good = (n_left >= leaf) & (n_right >= leaf)
            score = np.where(good, sum_left ** 2 / np.maximum(n_left, 1) + sum_right ** 2 / np.maximum(n_right, 1), -np.inf)[by_number]
            best = by_number[score.argmax(0)]
            found = good.any(0)
            feature[runs] = np.where(found, number[best], -1)
            drawn = np.zeros(len(runs))
            is_wide = best < wide
            drawn[is_wide] = cuts[best[is_wide], np.flatnonzero(is_wide)]
            is_two = np.flatnonzero(found & ~is_wide)
            if len(is_two):
                u = uniforms(seed, of[is_two], nodes[runs[is_two]], number[best[is_two], None])[:, 0]
                drawn[is_two] = _cut(*table.ends[:, best[is_two] - wide], u)
            cut[runs] = np.where(found, drawn, 0.0)
        yield np.full(len(nodes), tree, np.int32), nodes, feature.astype(np.int32), cut, total / sizes, sizes
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            return
        run = np.repeat(np.arange(len(runs)), size)
        stays = feature[runs][run] >= 0
        rows, run = rows[stays], runs[run[stays]]
        goes = table.columns[feature[run], rows] > cut[run]
        right = np.zeros(len(y), bool)
        right[rows] = goes
        rows = _parted(rows, right)
        most = np.bincount(run[goes], minlength=len(nodes))[inner]
        nodes = np.concatenate([child(nodes[inner], side) for side in (0, 1)])
        sizes = np.concatenate([sizes[inner] - most, most])


def _features(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class Upper:
    """The levels that are grown by aggregates over all rows: per level the nodes in order of (tree, node)."""

    trees: int
    levels: list[dict[str, np.ndarray]] = field(default_factory=list)

    def places(self, x: np.ndarray, trees: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """Per tree (all, or those given), the node that each row has come to."""
        for tree in range(self.trees) if trees is None else np.unique(trees).tolist():
            at = np.full(len(x), ROOT, np.int64)
            for level in self.levels:
                a, b = np.searchsorted(level["tree"], [tree, tree + 1])
                if a == b:
                    break
                nodes = level["node"][a:b]
                found = np.minimum(np.searchsorted(nodes, at), b - a - 1)
                inner = np.flatnonzero(nodes[found] == at)
                here = a + found[inner]
                at[inner] = child(at[inner], x[inner, level["feature"][here]] > level["cut"][here])
            yield tree, at


def _by_node(x, y, at, wanted):
    """Rows of the wanted nodes in runs: which of them occur, the rows in order, and where each run starts."""
    found = np.minimum(np.searchsorted(wanted, at), len(wanted) - 1)
    mine = np.flatnonzero(wanted[found] == at)
    order = mine[np.argsort(found[mine], kind="stable")]
    which, starts = np.unique(found[order], return_index=True)
    return which, x[order], y[order], starts


def _level_spans(batches, upper: Upper, front: dict) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("at", pa.int64()), ("rows", pa.int64()), ("sum", pa.float64()), ("y_lo", pa.float64()),
                        ("y_hi", pa.float64()), ("lo", pa.list_(pa.float64())), ("hi", pa.list_(pa.float64()))])
    for batch in batches:
        x, y = _features(batch.column(0)), batch.column(1).to_numpy()
        for tree, at in upper.places(x, front["tree"]):
            a, b = np.searchsorted(front["tree"], [tree, tree + 1])
            if a < b:
                which, xs, ys, starts = _by_node(x, y, at, front["node"][a:b])
                if len(which):
                    s = spans(xs, ys, starts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a + which), *[pa.array(s[c]) for c in ("rows", "sum", "y_lo", "y_hi")],
                         *[pa.array(s[c].tolist(), pa.list_(pa.float64())) for c in ("lo", "hi")]], schema=schema)


def _level_cuts(batches, upper: Upper, front: dict, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("at", pa.int64()), ("n", pa.list_(pa.int64())), ("s", pa.list_(pa.float64()))])
    for batch in batches:
        x, y = _features(batch.column(0)), batch.column(1).to_numpy()
        for tree, at in upper.places(x, front["tree"]):
            a, b = np.searchsorted(front["tree"], [tree, tree + 1])
            if a < b:
                which, xs, ys, starts = _by_node(x, y, at, front["node"][a:b])
                if len(which):
                    n, s = left_sums(xs, ys, starts, cuts[a + which])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a + which), pa.array(n.tolist(), pa.list_(pa.int64())),
                         pa.array(s.tolist(), pa.list_(pa.float64()))], schema=schema)


def _grow_upper(rows: DataFrame, n: int, width: int, trees: int, leaf: int, seed: int) -> tuple[Upper, dict, list]:
    """Levels of nodes above the task size: two aggregates a level, for all trees at once. Returns the levels, the nodes
    left to tasks, and finished columns of the node table."""
    upper, done = Upper(trees), []
    front = {"tree": np.arange(trees, dtype=np.int32), "node": np.full(trees, ROOT, np.int64),
             "rows": np.full(trees, n, np.int64)}
    small: list[dict] = []
    while True:
        big = front["rows"] > TASK_ROWS
        small.append({c: v[~big] for c, v in front.items()})
        front = {c: v[big] for c, v in front.items()}
        if not big.any():
            break
        if sum(len(level["tree"]) for level in upper.levels) + len(front["tree"]) > MOST_UPPER_NODES:
            raise ValueError("too many nodes above TASK_ROWS rows: raise it, or grow fewer trees")
        order = np.lexsort((front["node"], front["tree"]))
        front = {c: v[order] for c, v in front.items()}
        each = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(width)]).alias(c)
        s = rows.mapInArrow(
            lambda b, front=front: _level_spans(b, upper, front),
            "at bigint, rows bigint, sum double, y_lo double, y_hi double, lo array<double>, hi array<double>",
        ).groupBy("at").agg(F.sum("rows").alias("rows"), F.sum("sum").alias("sum"), F.min("y_lo").alias("y_lo"),
                            F.max("y_hi").alias("y_hi"), each(F.min, "lo"), each(F.max, "hi")).toArrow().sort_by("at")
        s = {c: _features(s.column(c)) if c in ("lo", "hi") else s.column(c).to_numpy() for c in s.column_names}
        cuts = random_cuts(seed, front["tree"], front["node"], s["lo"], s["hi"])
        left = rows.mapInArrow(
            lambda b, front=front, cuts=cuts: _level_cuts(b, upper, front, cuts), "at bigint, n array<bigint>, s array<double>",
        ).groupBy("at").agg(each(F.sum, "n"), each(F.sum, "s")).toArrow().sort_by("at")
        n_left, sum_left = _features(left.column("n")), _features(left.column("s"))
        feature = best_features(s, n_left, sum_left, leaf)
        here = np.arange(len(feature))
        cut = np.where(feature >= 0, cuts[here, feature], 0.0)
        done.append((front["tree"], front["node"], feature.astype(np.int32), cut, s["sum"] / s["rows"], s["rows"]))
        inner = np.flatnonzero(feature >= 0)
        upper.levels.append({"tree": front["tree"][inner], "node": front["node"][inner],
                             "feature": feature[inner], "cut": cut[inner]})
        first = n_left[inner, feature[inner]]
        front = {"tree": np.concatenate([front["tree"][inner]] * 2),
                 "node": np.concatenate([child(front["node"][inner], side) for side in (0, 1)]),
                 "rows": np.concatenate([first, s["rows"][inner] - first])}
    waiting = {c: np.concatenate([part[c] for part in small]) for c in ("tree", "node")}
    order = np.lexsort((waiting["node"], waiting["tree"]))
    return upper, {c: v[order] for c, v in waiting.items()}, done


def _dealt(batches, upper: Upper, waiting: dict) -> Iterator[pa.RecordBatch]:
    """Each row once per tree, with the node whose subtree a task will grow."""
    for batch in batches:
        x = _features(batch.column(0))
        for tree, at in upper.places(x):
            a, b = np.searchsorted(waiting["tree"], [tree, tree + 1])
            if a == b:
                continue
            nodes = waiting["node"][a:b]
            mine = np.flatnonzero(nodes[np.minimum(np.searchsorted(nodes, at), b - a - 1)] == at)
            if len(mine):
                took = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine), tree, np.int32)), pa.array(at[mine]), batch.column(0).take(took),
                     batch.column(1).take(took)], ["tree", "node", "x", "y"])


def _grown(group: pa.Table, leaf: int, seed: int) -> pa.Table:
    tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
    levels = list(grow_subtree(tree, node, Places(_features(group.column("x"))), group.column("y").to_numpy(), leaf, seed))
    return pa.table([np.concatenate(c) for c in zip(*levels)], schema=_NODES)


def _grained(rows: DataFrame, step: float) -> DataFrame:
    """Targets in multiples of a step (``grain``), so that their sums do not depend on the order of arrival."""
    return rows.withColumn("y", F.rint(F.col("y") / F.lit(step)) * F.lit(step)) if step else rows


def _per_block(rows: DataFrame, blocks: int) -> DataFrame:
    """The rows once per block of trees, in as many partitions, so that long tasks even out."""
    return rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartitionByRange(max(2, blocks), "block")


def _grown_whole(group: pa.Table, trees: int, leaf: int, seed: int) -> pa.Table:
    first = group.column("block")[0].as_py() * WHOLE_TREES
    table, y = Places(_features(group.column("x"))), group.column("y").to_numpy()
    levels = [level for tree in range(first, min(first + WHOLE_TREES, trees)) for level in grow_subtree(tree, ROOT, table, y, leaf, seed)]
    return pa.table([np.concatenate(c) for c in zip(*levels)], schema=_NODES)


def grow_extra_trees(rows: DataFrame, trees: int, leaf: int = 2, seed: int = 2027) -> DataFrame:
    """The node table of so many extremely randomised trees: every tree sees all rows, every node draws one cut per
    feature and keeps the best. Small tables (WHOLE_TIMES) go to tasks that grow some whole trees each; beyond, the number of jobs
    follows the depth of the upper levels, not the trees.

    Rows without a target take no part; no rows give no nodes.
    """
    rows = materialise(spread(rows.where(F.col("y").isNotNull()).select("x", "y")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.abs("y")).alias("most")).first()
    spark = rows.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], NODES)
    rows = _grained(rows, grain(size["most"], size["n"]))
    if size["n"] <= WHOLE_TIMES * TASK_ROWS:
        blocks = -(-trees // WHOLE_TREES)
        return materialise(_per_block(rows, blocks).groupBy("block").applyInArrow(
            lambda g: _grown_whole(g, trees, leaf, seed), NODES))
    upper, waiting, done = _grow_upper(rows, size["n"], size["width"], trees, leaf, seed)
    below = (rows.mapInArrow(lambda b: _dealt(b, upper, waiting), "tree int, node bigint, x array<double>, y double")
             .groupBy("tree", "node").applyInArrow(lambda g: _grown(g, leaf, seed), NODES))
    if done:
        table = pa.table([np.concatenate(c) for c in zip(*done)], schema=_NODES)
        below = below.unionByName(spark.createDataFrame(table, NODES))
    return materialise(below)


# Forests of exact cuts ----------------------------------------------------------------------

#: bins of a feature in nodes above TASK_ROWS rows, whose rows are looked at in order of their values; nodes of one
#: aggregate; rows, counted once per tree, that are dealt to subtrees at once
UPPER_BINS, UPPER_NODES, DEALT_ROWS = 64, 2_000, 20_000_000


def drawn_weights(seed: int, tree: int, key: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often a tree draws each distinct row (Poisson, of mean ``copies``), and how many of its copies it draws. The
    draws depend on the row alone, not on where it lies."""
    of_tree = _mixed(_mixed(np.full(1, seed, np.uint64)) + np.uint64(tree))
    of_row = _mixed(key.view(np.uint64) ^ of_tree)
    u = lambda rows, j: (_mixed(of_row[rows] + np.uint64(j)) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    weight, held = np.zeros(len(key)), np.zeros(len(key))
    few = copies <= 30
    for j in range(int(copies[few].max(initial=0))):
        rows = np.flatnonzero(few & (copies > j))
        times = np.searchsorted(POISSON, u(rows, j), side="right")
        weight[rows] += times
        held[rows] += times > 0
    many = np.flatnonzero(~few)
    if len(many):
        bell = np.sqrt(-2 * np.log(1 - u(many, 0))) * np.cos(2 * np.pi * u(many, 1))
        weight[many] = np.maximum(1.0, np.rint(copies[many] + np.sqrt(copies[many]) * bell))
        held[many] = np.minimum(weight[many], np.rint(copies[many] * (1 - math.exp(-1))))
    return weight, held


POISSON = np.array([math.exp(-1.0) * sum(1.0 / math.factorial(j) for j in range(k + 1)) for k in range(16)])


def _starts_of(run: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)


def _gains(table: Places, kept: np.ndarray, orders: np.ndarray, rows: np.ndarray, sums: tuple, pairs: np.ndarray,
           size: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """Per feature and run of rows, the best score of a cut between any two values, and the place in the feature's order
    of the last row on its left; -inf where there is none. ``sums`` are the weights, weighted targets and copies of
    all rows of the table, the last None where every row is one copy, and ``pairs`` the first two as one complex number."""
    n = sums[2]
    starts = np.cumsum(size) - size
    total = [np.add.reduceat(v[rows], starts) if v is not None else size for v in sums]
    wide, runs, m = len(kept), len(size), len(rows)
    base = np.cumsum(total[0]) - total[0] + 1j * (np.cumsum(total[1]) - total[1])
    best, place = np.full((wide + len(table.two), runs), -np.inf), np.zeros((wide, runs), np.int64)
    run = np.repeat(np.arange(runs), size)
    inside = run[1:] == run[:-1]
    if n is None:  # rows on the left are counted by the place
        before = np.arange(m) - np.repeat(starts, size) + 1
        inside &= ((before >= leaf) & (np.repeat(size, size) - before >= leaf))[:-1]
    for part in _chunks(wide, m):
        order = orders[part]
        codes = np.stack([table.codes[i].take(o) for i, o in zip(kept[part], order)])
        at = np.flatnonzero((codes[:, 1:] != codes[:, :-1]) & inside)
        if not len(at):
            continue
        of, at = np.divmod(at, m - 1)
        here, flat = run[at], of * m + at
        both = np.cumsum(pairs.take(order), axis=1).take(flat) - base[here]  # runs hold the same rows in every order
        left = [both.real, both.imag]
        if n is None:
            left.append(before[at])
        else:
            left.append(np.cumsum(n.take(order), axis=1).take(flat) - (np.cumsum(total[2]) - total[2])[here])
            good = (left[2] >= leaf) & (total[2][here] - left[2] >= leaf)
            of, at, here, left = of[good], at[good], here[good], [v[good] for v in left]
            if not len(at):
                continue
        score = left[1] ** 2 / left[0] + (total[1][here] - left[1]) ** 2 / (total[0][here] - left[0])
        cell = of * runs + here
        first = _starts_of(cell)
        top = np.maximum.reduceat(score, first)
        best[part].ravel()[cell[first]] = top
        hits = np.flatnonzero(score == np.repeat(top, np.diff(np.append(first, len(cell)))))
        hits = hits[_starts_of(cell[hits])]
        place[part].ravel()[cell[hits]] = at[hits]
    for part in _chunks(len(table.two), m):
        bits = table.bits[part].take(rows, axis=1)
        right = [_counts(bits, starts) if v is None else np.add.reduceat(bits * v[rows], starts, axis=1) for v in sums]
        left = [whole - v for whole, v in zip(total, right)]
        good = (left[2] >= leaf) & (right[2] >= leaf)
        best[wide + part.start:wide + part.stop] = np.where(
            good, left[1] ** 2 / np.maximum(left[0], 1e-300) + right[1] ** 2 / np.maximum(right[0], 1e-300), -np.inf)
    return best, place


def grow_forest_subtree(tree, node, table: Places, prepared: tuple, y, w, n, leaf: int) -> Iterator[tuple]:
    """Columns of the node table below (and with) one node, level by level: of the rows of the table those of some weight.
    ``prepared`` is the table's ``orders``; each level parts the rows in every order, so that nothing is sorted again."""
    kept, orders = prepared
    rows = np.flatnonzero(w > 0)
    if len(rows) < len(w):
        orders = orders[(w > 0)[orders]].reshape(len(orders), -1)
    wy, one = w * y, bool((n[rows] == 1).all())
    sums, pairs = (w, wy, None if one else n), w + 1j * wy
    number = np.concatenate([table.more[kept], table.two])
    by_number, wide = np.argsort(number), len(kept)
    nodes, sizes = np.array([node], np.int64), np.array([len(rows)])
    while len(nodes):
        starts = np.cumsum(sizes) - sizes
        ys, held = y[rows], sizes if one else np.add.reduceat(n[rows], starts)
        all_w, all_s = np.add.reduceat(w[rows], starts), np.add.reduceat(wy[rows], starts)
        feature, cut = np.full(len(nodes), -1), np.zeros(len(nodes))
        open_ = (held >= 2 * leaf) & (np.minimum.reduceat(ys, starts) < np.maximum.reduceat(ys, starts))
        runs = np.flatnonzero(open_)
        if len(runs) and len(number):
            if len(runs) < len(nodes):
                inside = np.repeat(open_, sizes)
                rows, orders = rows[inside], orders[:, inside]
            size = sizes[runs]
            score, place = _gains(table, kept, orders, rows, sums, pairs, size, leaf)
            best = by_number[score[by_number].argmax(0)]
            top, level = score[best, np.arange(len(runs))], all_s[runs] ** 2 / all_w[runs]
            found = top > level * (1 + 1e-12) + 1e-12 * np.abs(level)
            feature[runs] = np.where(found, number[best], -1)
            is_wide = np.flatnonzero(found & (best < wide))
            f, at = best[is_wide], place[best[is_wide], is_wide]
            cut[runs[is_wide]] = _middle(*(table.columns[number[f], orders[f, at + i]] for i in (0, 1)))
            is_two = np.flatnonzero(found & (best >= wide))
            cut[runs[is_two]] = _middle(*table.ends[:, best[is_two] - wide])
        yield (np.full(len(nodes), tree, np.int32), nodes, feature.astype(np.int32), cut, all_s / all_w, held.astype(np.int64))
        inner = np.flatnonzero(feature >= 0)
        if not len(inner):
            return
        run = np.repeat(runs, size)
        stays = feature[run] >= 0
        if not stays.all():
            rows, orders, run = rows[stays], orders[:, stays], run[stays]
        goes = table.columns[feature[run], rows] > cut[run]
        right = np.zeros(len(y), bool)
        right[rows] = goes
        rows, orders = _parted(rows, right), _parted(orders, right)
        most = np.bincount(run[goes], minlength=len(nodes))[inner]
        nodes = np.concatenate([child(nodes[inner], side) for side in (0, 1)])
        sizes = np.concatenate([sizes[inner] - most, most])


def _middle(v: np.ndarray, after: np.ndarray) -> np.ndarray:
    """A cut between two values: their mean, or the lower one where it is no less than the upper one."""
    middle = (v + after) / 2
    return np.where(middle < after, middle, v)


def _forest_batch(batch: pa.RecordBatch):
    return (_features(batch.column(0)), batch.column(1).to_numpy(), batch.column(2).to_numpy(),
            batch.column(3).to_numpy())


def _upper_histograms(batches, upper: Upper, front: dict, edges: list, seed: int) -> Iterator[pa.RecordBatch]:
    width = len(edges)
    size = width * UPPER_BINS
    offsets = np.arange(width) * UPPER_BINS
    total = np.zeros((3, len(front["tree"]) * size))
    for batch in batches:
        x, y, key, copies = _forest_batch(batch)
        bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1)
        for tree, at in upper.places(x, front["tree"]):
            a, b = np.searchsorted(front["tree"], [tree, tree + 1])
            nodes = front["node"][a:b]
            found = np.minimum(np.searchsorted(nodes, at), b - a - 1)
            open_ = np.flatnonzero(nodes[found] == at)
            w, n = drawn_weights(seed, tree, key[open_], copies[open_])
            took = np.flatnonzero(w > 0)
            mine, w, n = open_[took], w[took], n[took]
            cells = ((found[mine] * size)[:, None] + offsets + bins[mine]).ravel()
            for k, v in enumerate((n, w, w * y[mine])):
                total[k, a * size:b * size] += np.bincount(cells, np.repeat(v, width), (b - a) * size)
    filled = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_arrays([pa.array(filled), *[pa.array(t[filled]) for t in total]], ["cell", "n", "w", "s"])


def _bin_ends(batches, edges: list) -> Iterator[pa.RecordBatch]:
    ends = np.full((2, len(edges) * UPPER_BINS), np.inf) * np.array([[1.0], [-1.0]])
    for batch in batches:
        x = _features(batch.column(0))
        for i, e in enumerate(edges):
            cells = i * UPPER_BINS + np.searchsorted(e, x[:, i], side="left")
            np.minimum.at(ends[0], cells, x[:, i])
            np.maximum.at(ends[1], cells, x[:, i])
    filled = np.flatnonzero(ends[0] <= ends[1])
    yield pa.RecordBatch.from_arrays([pa.array(filled), *(pa.array(e[filled]) for e in ends)], ["cell", "lo", "hi"])


def _by_value(rows: DataFrame, edges: list) -> tuple[np.ndarray, DataFrame]:
    """The bins (feature * UPPER_BINS + bin) that hold more than one value, and their rows in order of the value."""
    ends = rows.mapInArrow(lambda b: _bin_ends(b, edges), "cell bigint, lo double, hi double").groupBy("cell").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi").select("cell").toArrow()
    cells = np.sort(ends.column("cell").to_numpy())

    def dealt(batches):
        for batch in batches:
            x = _features(batch.column(0))
            for f in np.unique(cells // UPPER_BINS).tolist():
                cell = f * UPPER_BINS + np.searchsorted(edges[f], x[:, f], side="left")
                mine = np.flatnonzero(np.isin(cell, cells))
                if len(mine):
                    took = pa.array(mine)
                    yield pa.RecordBatch.from_arrays([*(c.take(took) for c in batch.columns), pa.array(cell[mine]), pa.array(x[mine, f])],
                                                     [*batch.schema.names, "cell", "v"])

    return cells, materialise(rows.mapInArrow(dealt, "x array<double>, y double, key bigint, copies bigint, cell bigint, v double")
                              .repartition("cell").sortWithinPartitions("cell", "v"))


def _whole_cells(batches) -> Iterator[pa.Table]:
    """The rows of one cell at a time, from rows sorted by it."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        if not len(cell):
            continue
        starts = _starts_of(cell).tolist()
        for a, b in zip(starts, [*starts[1:], len(cell)]):
            if waiting and waiting[0].column("cell")[0].as_py() != cell[a]:
                yield pa.Table.from_batches(waiting)
                waiting = []
            waiting.append(batch.slice(a, b - a))
    if waiting:
        yield pa.Table.from_batches(waiting)


def _inner_cuts(batches, upper: Upper, front: dict, cells: np.ndarray, before: np.ndarray, total: np.ndarray, leaf: int,
                seed: int) -> Iterator[pa.RecordBatch]:
    """Per open node and cell, the best cut between two values of the cell. ``before`` holds the copies, weights and sums of
    the node's rows in lower bins of the feature (node x cell), ``total`` those of all its rows."""
    for group in _whole_cells(batches):
        x, y, key, copies, v = (_features(group.column("x")), *(group.column(c).to_numpy() for c in ("y", "key", "copies", "v")))
        cell = group.column("cell")[0].as_py()
        c, out = int(np.searchsorted(cells, cell)), []
        for tree, at in upper.places(x, front["tree"]):
            a, b = np.searchsorted(front["tree"], [tree, tree + 1])
            nodes = front["node"][a:b]
            found = np.minimum(np.searchsorted(nodes, at), b - a - 1)
            open_ = np.flatnonzero(nodes[found] == at)
            w, n = drawn_weights(seed, tree, key[open_], copies[open_])
            took = np.flatnonzero(w > 0)
            took = took[np.argsort(found[open_[took]], kind="stable")]
            mine, w, n = open_[took], w[took], n[took]
            run = a + found[mine]
            starts = _starts_of(run)
            if not len(starts):
                continue
            sizes = np.diff(np.append(starts, len(run)))
            left = []
            for k, part in enumerate((n, w, w * y[mine])):
                sums = np.cumsum(part)
                left.append(sums - np.repeat(sums[starts] - part[starts], sizes) + before[k, run, c])
            all_n, all_w, all_s = total[:, run]
            value = v[mine]
            good = np.append((run[1:] == run[:-1]) & (value[1:] != value[:-1]), False) & (left[0] >= leaf) & (all_n - left[0] >= leaf)
            score = np.where(good, left[2] ** 2 / np.maximum(left[1], 1e-300)
                             + (all_s - left[2]) ** 2 / np.maximum(all_w - left[1], 1e-300), -np.inf)
            top = np.flatnonzero(good & (score == np.repeat(np.maximum.reduceat(score, starts), sizes)))
            top = top[_starts_of(run[top])]
            out.append((run[top], score[top], value[top], left[0][top]))
        if out:
            run, score, value, n = (np.concatenate(p) for p in zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(run), pa.array(score), pa.array(np.full(len(run), cell)), pa.array(value), pa.array(n)],
                                             ["at", "score", "cell", "v", "n"])


def _near_cuts(batches, upper: Upper, front: dict, feature: np.ndarray, threshold: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """Per node, the greatest drawn value that goes left and the least that goes right."""
    ends = np.full((2, len(feature)), np.inf) * np.array([[-1.0], [1.0]])
    for batch in batches:
        x, _, key, copies = _forest_batch(batch)
        for tree, at in upper.places(x, front["tree"]):
            a, b = np.searchsorted(front["tree"], [tree, tree + 1])
            nodes = front["node"][a:b]
            found = np.minimum(np.searchsorted(nodes, at), b - a - 1)
            open_ = np.flatnonzero((nodes[found] == at) & (feature[a + found] >= 0))
            mine = open_[drawn_weights(seed, tree, key[open_], copies[open_])[0] > 0]
            node = a + found[mine]
            value = x[mine, feature[node]]
            left = value <= threshold[node]
            np.maximum.at(ends[0], node[left], value[left])
            np.minimum.at(ends[1], node[~left], value[~left])
    seen = np.flatnonzero(np.isfinite(ends).any(0))
    yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(e[seen]) for e in ends)], ["at", "lo", "hi"])


def _grow_forest_upper(rows: DataFrame, ordered: DataFrame, cells: np.ndarray, count: int, edges: list, trees: range, leaf: int, seed: int):
    """Levels of nodes above the task size, cut exactly as the smaller ones: histograms of the rows give the scores of cuts
    between bins, the rows of a bin in order of their values those of cuts inside it, and a last look at the rows the
    two values that the best cut lies between."""
    upper, done, small = Upper(trees.stop), [], []
    front = {"tree": np.arange(trees.start, trees.stop, dtype=np.int32), "node": np.full(len(trees), ROOT, np.int64), "rows": np.full(len(trees), count)}
    size = len(edges) * UPPER_BINS
    while True:
        big = front["rows"] > TASK_ROWS
        small.append({c: front[c][~big] for c in ("tree", "node")})
        front = {c: v[big] for c, v in front.items()}
        if not big.any():
            break
        if sum(len(level["tree"]) for level in upper.levels) + len(front["tree"]) > MOST_UPPER_NODES:
            raise ValueError("too many nodes above TASK_ROWS rows: raise it, or grow fewer trees")
        order = np.lexsort((front["node"], front["tree"]))
        front = {c: v[order] for c, v in front.items()}
        feature, cut, value, held, left = [], [], [], [], []
        for start in range(0, len(order), UPPER_NODES):
            part = {c: v[start:start + UPPER_NODES] for c, v in front.items()}
            got = rows.mapInArrow(lambda b, part=part: _upper_histograms(b, upper, part, edges, seed),
                                  "cell bigint, n double, w double, s double").groupBy("cell").agg(
                F.sum("n").alias("n"), F.sum("w").alias("w"), F.sum("s").alias("s")).toArrow()
            k = len(part["tree"])
            sums = np.zeros((3, k * size))
            for v, c in zip(sums, "nws"):
                v[got.column("cell").to_numpy()] = got.column(c).to_numpy()
            sums = sums.reshape(3, k, len(edges), UPPER_BINS)
            total = sums[:, :, 0].sum(2)
            until = sums.cumsum(3)
            (ln, lw, ls), (all_n, all_w, all_s) = until[..., :-1], total
            rn, rw, rs = (t[:, None, None] - v for t, v in zip(total, (ln, lw, ls)))
            score = np.where((ln >= leaf) & (rn >= leaf), ls ** 2 / np.maximum(lw, 1e-300) + rs ** 2 / np.maximum(rw, 1e-300),
                             -np.inf).reshape(k, -1)
            best = score.argmax(1)
            f, bin_ = np.divmod(best, UPPER_BINS - 1)
            top, cell, first = score[np.arange(k), best], f * UPPER_BINS + bin_, ln[np.arange(k), f, bin_]
            threshold = np.array([edges[i][min(j, len(edges[i]) - 1)] if len(edges[i]) else 0.0 for i, j in zip(f, bin_)])
            if len(cells):
                before = (until - sums).reshape(3, k, size)[:, :, cells]
                inner = ordered.mapInArrow(
                    lambda b, part=part, before=before, total=total: _inner_cuts(b, upper, part, cells, before, total, leaf, seed),
                    "at bigint, score double, cell bigint, v double, n double").groupBy("at").agg(
                    F.min(F.struct((-F.col("score")).alias("s"), "cell", "v", "n")).alias("b")).select("at", "b.*").toArrow()
                at, s, c, v, n = (inner.column(i).to_numpy() for i in range(5))
                # of equal scores that of the lower value: a bin's inner cuts come before its end
                better = (-s > top[at]) | ((-s == top[at]) & (c <= cell[at]))
                at = at[better]
                top[at], f[at], threshold[at], first[at] = -s[better], c[better] // UPPER_BINS, v[better], n[better]
            level = all_s ** 2 / np.maximum(all_w, 1e-300)
            f = np.where(top > level * (1 + 1e-12) + 1e-12 * np.abs(level), f, -1)
            ends = rows.mapInArrow(lambda b, part=part, f=f, threshold=threshold: _near_cuts(b, upper, part, f, threshold, seed),
                                   "at bigint, lo double, hi double").groupBy("at").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).toArrow()
            near = np.zeros(k)
            near[ends.column("at").to_numpy()] = _middle(ends.column("lo").to_numpy(), ends.column("hi").to_numpy())
            feature.append(f)
            cut.append(near)
            value.append(all_s / np.maximum(all_w, 1e-300))
            held.append(all_n)
            left.append(first)
        feature, cut, value, held, left = (np.concatenate(v) for v in (feature, cut, value, held, left))
        done.append((front["tree"], front["node"], feature.astype(np.int32), cut, value, held.astype(np.int64)))
        inner = np.flatnonzero(feature >= 0)
        upper.levels.append({"tree": front["tree"][inner], "node": front["node"][inner],
                             "feature": feature[inner], "cut": cut[inner]})
        front = {"tree": np.concatenate([front["tree"][inner]] * 2),
                 "node": np.concatenate([child(front["node"][inner], side) for side in (0, 1)]),
                 "rows": np.concatenate([left[inner], held[inner] - left[inner]])}
    waiting = {c: np.concatenate([part[c] for part in small]) for c in ("tree", "node")}
    order = np.lexsort((waiting["node"], waiting["tree"]))
    return upper, {c: v[order] for c, v in waiting.items()}, done


def _dealt_drawn(batches, upper: Upper, waiting: dict, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x, _, key, copies = _forest_batch(batch)
        for tree, at in upper.places(x, waiting["tree"]):
            a, b = np.searchsorted(waiting["tree"], [tree, tree + 1])
            nodes = waiting["node"][a:b]
            w, n = drawn_weights(seed, tree, key, copies)
            mine = np.flatnonzero((nodes[np.minimum(np.searchsorted(nodes, at), b - a - 1)] == at) & (w > 0))
            if len(mine):
                took = pa.array(mine)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(mine), tree, np.int32)), pa.array(at[mine]), batch.column(0).take(took),
                     batch.column(1).take(took), pa.array(w[mine]), pa.array(n[mine])], ["tree", "node", "x", "y", "w", "n"])


def _grown_drawn(group: pa.Table, leaf: int) -> pa.Table:
    tree, node = group.column("tree")[0].as_py(), group.column("node")[0].as_py()
    table = Places(_features(group.column("x")))
    levels = list(grow_forest_subtree(tree, node, table, table.orders(), *(group.column(c).to_numpy() for c in "ywn"), leaf))
    return pa.table([np.concatenate(c) for c in zip(*levels)], schema=_NODES)


def _grown_drawn_block(group: pa.Table, trees: int, leaf: int, seed: int) -> pa.Table:
    """The trees of a block, from one copy of all rows."""
    first = group.column("block")[0].as_py() * WHOLE_TREES
    y, key, copies = (group.column(c).to_numpy() for c in ("y", "key", "copies"))
    table, levels = Places(_features(group.column("x"))), []
    prepared = table.orders()
    for tree in range(first, min(first + WHOLE_TREES, trees)):
        w, n = drawn_weights(seed, tree, key, copies)
        if w.any():
            levels += grow_forest_subtree(tree, ROOT, table, prepared, y, w, n, leaf)
    return pa.table([np.concatenate(c) for c in zip(*levels)] if levels else [[]] * len(_NODES), schema=_NODES)


def grow_forest(rows: DataFrame, trees: int, leaf: int = 2, seed: int = 2027) -> DataFrame:
    """The node table of a random forest: every tree draws rows with replacement (Poisson counts of the distinct rows)
    and takes the best of all cuts, without a depth limit. Small tables (WHOLE_TIMES) go to tasks once per block of trees,
    which are grown there. Of larger ones, nodes of more than TASK_ROWS rows are cut by aggregates (``_grow_forest_upper``),
    the subtrees below each in one task, for as many trees at once as DEALT_ROWS allow. Both give the same trees."""
    rows = materialise(spread(rows.where(F.col("y").isNotNull()).groupBy("x", "y").agg(F.count("*").alias("copies")).select(
        "x", "y", F.xxhash64("x", "y").alias("key"), "copies")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("width"), F.max(F.abs("y")).alias("most"),
                    F.sum("copies").alias("copies")).first()
    spark = rows.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], NODES)
    rows = _grained(rows, grain(size["most"], 4 * size["copies"] + 100))
    if size["n"] <= WHOLE_TIMES * TASK_ROWS:
        blocks = -(-trees // WHOLE_TREES)
        return materialise(_per_block(rows, blocks).groupBy("block").applyInArrow(
            lambda g: _grown_drawn_block(g, trees, leaf, seed), NODES))
    steps = [k / UPPER_BINS for k in range(1, UPPER_BINS)]
    cuts = rows.agg(*[F.percentile_approx(F.col("x")[i], steps, 100 * UPPER_BINS).alias(f"q{i}")
                      for i in range(size["width"])]).first()
    edges = [np.unique(cuts[f"q{i}"])[:UPPER_BINS - 1] for i in range(size["width"])]
    cells, ordered = _by_value(rows, edges)
    together, parts = max(1, DEALT_ROWS // size["n"]), []
    for start in range(0, trees, together):
        upper, waiting, done = _grow_forest_upper(rows, ordered, cells, size["n"], edges, range(start, min(start + together, trees)), leaf, seed)
        below = (rows.mapInArrow(lambda b, upper=upper, waiting=waiting: _dealt_drawn(b, upper, waiting, seed),
                                 "tree int, node bigint, x array<double>, y double, w double, n double")
                 .groupBy("tree", "node").applyInArrow(lambda g: _grown_drawn(g, leaf), NODES))
        if done:
            table = pa.table([np.concatenate(c) for c in zip(*done)], schema=_NODES)
            below = below.unionByName(spark.createDataFrame(table, NODES))
        parts.append(materialise(below))
    return reduce(DataFrame.unionByName, parts)


# Boosting ---------------------------------------------------------------------------------

#: bins of a feature; distinct binned rows up to which the driver sums their histograms; rounds between checkpoints
BINS, DRIVER_CELLS, KEPT_ROUNDS = 255, 200_000, 10


@dataclass(frozen=True)
class Boosting:
    rounds: int = 300
    rate: float = 0.05
    leaves: int = 15
    l2: float = 1.0
    leaf_rows: int = 20


def bin_edges(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Inner edges of each feature: midpoints of its values where they are few, else quantiles."""
    values = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i", "v").agg(F.count("*").alias("c"))
    distinct = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.count("*").alias("n")).collect()}
    few = [i for i, n in distinct.items() if n <= BINS]
    edges: list[np.ndarray] = [np.zeros(0)] * width
    by_feature: dict[int, list[float]] = {}
    for r in values.where(F.col("i").isin(few)).collect():  # at most BINS values a feature
        by_feature.setdefault(r["i"], []).append(r["v"])
    for i, vs in by_feature.items():
        vs = np.sort(vs)
        edges[i] = (vs[:-1] + vs[1:]) / 2
    many = sorted(set(distinct) - set(few))
    if many:
        steps = [k / BINS for k in range(1, BINS)]
        cuts = rows.agg(*[F.percentile_approx(F.col("x")[i], steps, 50 * BINS).alias(f"q{i}") for i in many]).first()
        for i in many:
            edges[i] = np.unique(cuts[f"q{i}"])
    return edges


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)


@dataclass
class Branch:
    """A node of the tree under construction. Its parts are known before they are taken for its children."""

    id: int
    grad: float = 0.0
    count: float = 0.0
    split: tuple[float, int, int] | None = None  # gain, feature, last bin on the left
    children: tuple["Branch", "Branch"] | None = None
    parts: tuple["Branch", "Branch"] | None = None
    sums: tuple[np.ndarray, np.ndarray] | None = None  # of gradients and counts, by feature and bin


def leaf_value(grad: float, count: float, boosting: Boosting) -> float:
    return -boosting.rate * grad / (count + boosting.l2)


def best_split(grad: np.ndarray, count: np.ndarray, boosting: Boosting) -> tuple[float, int, int] | None:
    """The (feature, bin) of highest gain from a node's histograms (feature x bin), and the gain."""
    left_g, left_n = grad.cumsum(1)[:, :-1], count.cumsum(1)[:, :-1]
    all_g, all_n = grad[0].sum(), count[0].sum()
    right_g, right_n = all_g - left_g, all_n - left_n
    good = (left_n >= boosting.leaf_rows) & (right_n >= boosting.leaf_rows)
    gain = np.where(good, left_g ** 2 / (left_n + boosting.l2) + right_g ** 2 / (right_n + boosting.l2)
                    - all_g ** 2 / (all_n + boosting.l2), -np.inf)
    feature, last = np.unravel_index(gain.argmax(), gain.shape)
    return (float(gain[feature, last]), int(feature), int(last)) if gain[feature, last] > 0 else None


def _walk(tree: Branch, bins: np.ndarray, below: str = "children") -> Iterator[tuple[Branch, np.ndarray]]:
    """The tree's current leaves (or parts) with the rows that end there; bins are feature by row."""
    open_ = [(tree, np.arange(bins.shape[1]))]
    while open_:
        branch, rows = open_.pop()
        if getattr(branch, below) is None:
            yield branch, rows
        else:
            _, feature, last = branch.split
            left = bins[feature].take(rows) <= last
            open_ += [(getattr(branch, below)[0], rows[left]), (getattr(branch, below)[1], rows[~left])]


def _histograms(bins: np.ndarray, grad: np.ndarray, count: np.ndarray, rows: np.ndarray, live: list[int]) -> np.ndarray:
    """Sums of gradients and counts by feature and bin, of the features that have more than one."""
    out = np.zeros((2, len(bins), BINS + 1))
    grad, count = grad.take(rows), count.take(rows)
    for f in live:
        at = bins[f].take(rows).astype(np.intp)
        out[0, f], out[1, f] = np.bincount(at, grad, BINS + 1), np.bincount(at, count, BINS + 1)
    return out


def _moved(before: np.ndarray, trees: list[Branch], bins: np.ndarray, boosting: Boosting) -> np.ndarray:
    """Predictions after more trees, which are added one after the other."""
    out = before.copy()
    for tree in trees:
        for branch, rows in _walk(tree, bins):
            out[rows] += leaf_value(branch.grad, branch.count, boosting)
    return out


def _gradients(count: np.ndarray, target: np.ndarray, before: np.ndarray, step: float) -> np.ndarray:
    """In multiples of a step, so that their sums do not depend on the order."""
    grad = count * before - target
    return np.rint(grad / step) * step if step else grad


@dataclass(frozen=True)
class Cells:
    """What all distinct binned rows share: features, those with more than one bin, step of the gradients."""

    width: int
    live: list[int]
    base: float
    step: float
    boosting: Boosting


class DriverCells:
    """A bounded number of distinct binned rows, summed here. For squared errors, the count and the sum of targets of
    equal binned rows are all that any tree can see of them."""

    ahead = 1

    def __init__(self, cells: DataFrame, of: Cells):
        table = cells.toArrow().sort_by("bins").combine_chunks()
        self.bins = np.ascontiguousarray(np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, of.width).T)
        self.count, self.sum = table.column("n").to_numpy().astype(float), table.column("s").to_numpy()
        self.of, self.before = of, np.full(len(self.count), of.base)
        self.grad = _gradients(self.count, self.sum, self.before, of.step)

    def histograms(self, tree: Branch, wanted: list[Branch]) -> dict[int, np.ndarray]:
        ids = {b.id for b in wanted}
        return {branch.id: _histograms(self.bins, self.grad, self.count, rows, self.of.live)
                for branch, rows in _walk(tree, self.bins, "parts") if branch.id in ids}

    def add(self, tree: Branch) -> None:
        self.before = _moved(self.before, [tree], self.bins, self.of.boosting)
        self.grad = _gradients(self.count, self.sum, self.before, self.of.step)


class SparkCells:
    """Any number of distinct binned rows: one aggregate for all nodes that may be split next; predictions are
    checkpointed every few rounds."""

    ahead = 1 << 30

    def __init__(self, cells: DataFrame, of: Cells):
        self.of, self.recent = of, []
        self.cells = materialise(spread(cells.withColumn("p", F.lit(of.base))))

    def histograms(self, tree: Branch, wanted: list[Branch]) -> dict[int, np.ndarray]:
        of, recent, size = self.of, self.recent, self.of.width * (BINS + 1)
        at = {b.id: i for i, b in enumerate(wanted)}

        def summed(batches):
            total = np.zeros((2, len(at), size))
            for batch in batches:
                bins, count, target, before = _cells(batch, of.width)
                grad = _gradients(count, target, _moved(before, recent, bins, of.boosting), of.step)
                for branch, rows in _walk(tree, bins, "parts"):
                    if branch.id in at and len(rows):
                        total[:, at[branch.id]] += _histograms(bins, grad, count, rows, of.live).reshape(2, -1)
            filled = np.flatnonzero(total[1].ravel())
            yield pa.RecordBatch.from_arrays(
                [pa.array(filled), pa.array(total[0].ravel()[filled]), pa.array(total[1].ravel()[filled])], ["k", "g", "n"])

        # a bounded row of bins per task and node, so a shuffle would take longer than the sums
        sums = self.cells.mapInArrow(summed, "k bigint, g double, n double").toArrow()
        k = sums.column("k").to_numpy()
        out = np.stack([np.bincount(k, sums.column(c).to_numpy(), len(at) * size) for c in "gn"])
        return {b.id: part for b, part in zip(wanted, out.reshape(2, len(at), of.width, -1).swapaxes(0, 1))}

    def add(self, tree: Branch) -> None:
        self.recent = [*self.recent, tree]
        if len(self.recent) >= KEPT_ROUNDS:
            of, recent = self.of, self.recent

            def moved(batches):
                for batch in batches:
                    bins, _, _, before = _cells(batch, of.width)
                    yield pa.RecordBatch.from_arrays(
                        [*batch.columns[:3], pa.array(_moved(before, recent, bins, of.boosting))], batch.schema.names)

            self.cells, self.recent = materialise(self.cells.mapInArrow(moved, self.cells.schema)), []


def _cells(batch: pa.RecordBatch, width: int):
    bins = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, width)
    return np.ascontiguousarray(bins.T), batch.column(1).to_numpy().astype(float), batch.column(2).to_numpy(), batch.column(3).to_numpy()


def _known(branch: Branch, sums: np.ndarray, live: list[int], boosting: Boosting) -> None:
    branch.sums = sums
    branch.grad, branch.count = (float(v[live[0]].sum()) for v in sums)
    branch.split = best_split(*sums[:, live], boosting)
    if branch.split:
        gain, feature, last = branch.split
        branch.split = (gain, live[feature], last)


def grow_tree(cells: DriverCells | SparkCells, boosting: Boosting) -> Branch:
    """Best first: the leaf of highest gain is split until the leaf limit, or until nothing gains. Where a look at the
    rows is dear, the parts of all leaves that may still be split are worked out at once. Only the smaller part of a leaf
    is summed, the other one is what is left."""
    live = cells.of.live or [0]
    tree = Branch(ROOT)
    _known(tree, cells.histograms(tree, [tree])[tree.id], live, boosting)
    waiting, leaves = [tree] if tree.split else [], 1
    while waiting and leaves < boosting.leaves:
        best = max(range(len(waiting)), key=lambda i: (waiting[i].split[0], -i))
        if waiting[best].parts is None:
            unknown = [b for b in sorted(waiting, key=lambda b: -b.split[0])[:boosting.leaves - leaves] if b.parts is None]
            asked = {}
            for branch in unknown[:cells.ahead]:
                branch.parts = tuple(Branch(int(child(branch.id, side)[0])) for side in (0, 1))
                _, feature, last = branch.split
                on_left = branch.sums[1][feature, :last + 1].sum()
                asked[branch.id] = (branch, int(2 * on_left > branch.count))
            if waiting[best].id not in asked:
                raise RuntimeError("the best leaf was not asked for")
            sums = cells.histograms(tree, [branch.parts[side] for branch, side in asked.values()])
            for branch, side in asked.values():
                some = sums[branch.parts[side].id]
                _known(branch.parts[side], some, live, boosting)
                _known(branch.parts[1 - side], branch.sums - some, live, boosting)
        branch = waiting.pop(best)
        branch.children, leaves = branch.parts, leaves + 1
        waiting += [part for part in branch.children if part.split]
    return _bare(tree)


def _bare(tree: Branch) -> Branch:
    """The tree as it is sent to tasks: without sums, and without parts that were not taken."""
    open_ = [tree]
    while open_:
        branch = open_.pop()
        branch.parts = branch.sums = None
        open_ += branch.children or ()
    return tree


def grow_boosted(rows: DataFrame, boosting: Boosting = Boosting()) -> tuple[DataFrame, float]:
    """The node table of boosted trees and the score they start from.

    Rows are counted by their binned features first. Up to DRIVER_CELLS distinct ones, histograms are summed in the
    driver; beyond, by aggregates. Both follow the same steps, on sums that do not depend on the order.
    """
    rows = materialise(rows.where(F.col("y").isNotNull()).select("x", "y"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.abs("y")).alias("most"), F.max(F.size("x")).alias("width")).first()
    spark = rows.sparkSession
    if not size["n"]:
        return spark.createDataFrame([], NODES), 0.0
    width, edges, step = size["width"], bin_edges(rows, size["width"]), grain(size["most"], 8 * size["n"])
    rows = _grained(rows, step)

    def cut(batches):
        for batch in batches:
            bins = binned(_features(batch.column(0)), edges)
            yield pa.RecordBatch.from_arrays([pa.array([b.tobytes() for b in bins], pa.binary()), batch.column(1)], ["bins", "y"])

    cells = materialise(rows.mapInArrow(cut, "bins binary, y double").groupBy("bins").agg(
        F.count("*").alias("n"), F.sum("y").alias("s")))
    found = cells.agg(F.count("*").alias("n"), F.sum("s").alias("s")).first()
    base = found["s"] / size["n"]
    source = (DriverCells if found["n"] <= DRIVER_CELLS else SparkCells)(
        cells, Cells(width, [f for f, e in enumerate(edges) if len(e)], base, step, boosting))
    out = []
    for number in range(boosting.rounds):
        tree = grow_tree(source, boosting)
        source.add(tree)
        open_ = [tree]
        while open_:
            b = open_.pop()
            if b.children is None:
                out.append((number, b.id, -1, 0.0, leaf_value(b.grad, b.count, boosting), int(b.count)))
            else:
                _, feature, last = b.split
                out.append((number, b.id, feature, float(edges[feature][last]), 0.0, int(b.count)))
                open_ += b.children
    table = pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _NODES)], schema=_NODES)
    return materialise(spark.createDataFrame(table, NODES)), base


# Scoring -----------------------------------------------------------------------------------

#: rows and nodes of a block of the scoring grid; rows that walk at once; steps between looks at which have arrived
SCORED_ROWS, SCORED_NODES, WALKED, STEPS = 131_072, 2_000_000, 4_096, 4
_PACKED = "tree int, n bigint, feature binary, cut binary, left binary, value binary"


def packed(nodes: DataFrame) -> DataFrame:
    """One row per tree, its nodes as arrays that rows can walk: the root first, the two children of a node side by side
    (``left``), and leaves that lead to themselves."""
    return materialise(nodes.groupBy("tree").applyInArrow(_packed, _PACKED))


def _packed(group: pa.Table) -> pa.Table:
    node, feature, cut, value = (group.column(c).to_numpy() for c in ("node", "feature", "cut", "value"))
    order = np.argsort(node)
    node, feature, cut, value = (v[order] for v in (node, feature, cut, value))
    inner = np.flatnonzero(feature >= 0)
    place, firsts = np.zeros(len(node), np.int64), 1 + 2 * np.arange(len(inner))
    for side in (0, 1):
        place[np.searchsorted(node, child(node[inner], side))] = firsts + side
    left = place.copy()
    left[inner] = firsts
    cut = np.where(feature >= 0, cut, np.inf)
    out = [np.empty_like(v) for v in (feature, cut, left, value)]
    for into, v in zip(out, (np.maximum(feature, 0), cut, left, value)):
        into[place] = v
    kinds = (np.int32, np.float64, np.int64, np.float64)
    return pa.table([pa.array([group.column("tree")[0].as_py()], pa.int32()), pa.array([len(node)], pa.int64()),
                     *(pa.array([v.astype(k).tobytes()], pa.binary()) for v, k in zip(out, kinds))],
                    ["tree", "n", "feature", "cut", "left", "value"])


def tree_sums(rows: DataFrame, nodes: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """The sum of the trees' values per row: ``rows`` has a unique ``_row`` and ``x``. ``model`` is the ``packed`` form of
    the nodes, if it is at hand.

    Blocks of rows meet blocks of trees, each pair in a group of one shuffle, so that neither the rows nor the model
    need to fit a task; the sums per row are added up afterwards. Of more rows than a block holds, equal ones go once.
    """
    spark = rows.sparkSession
    model = packed(nodes) if model is None else model
    per_tree = model.agg(F.max("n").alias("n"), F.max("tree").alias("t")).first()
    if per_tree["n"] is None:
        return rows.select("_row", F.lit(0.0).alias("_sum"))
    count = rows.count()
    if count > SCORED_ROWS:
        once = materialise(rows.select("x").distinct().withColumn("_row", F.monotonically_increasing_id()))
        sums = _grid_sums(once, once.count(), model, per_tree["n"], per_tree["t"] + 1)
        return rows.select("_row", "x").join(once.join(sums, "_row").select("x", "_sum"), "x").select("_row", "_sum")
    return _grid_sums(rows, count, model, per_tree["n"], per_tree["t"] + 1)


def _grid_sums(rows: DataFrame, count: int, model: DataFrame, most: int, trees: int) -> DataFrame:
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = max(1, -(-count // SCORED_ROWS))
    together = max(1, min(SCORED_NODES // most, -(-trees * slots // (4 * width))))
    blocks = -(-trees // together)
    asked = rows.select("_row", "x", F.pmod(F.xxhash64("_row"), F.lit(slots)).cast("int").alias("_slot"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    model = model.withColumn("_block", F.floor(F.col("tree") / together).cast("int")).withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    sums = asked.groupBy("_slot", "_block").cogroup(model.groupBy("_slot", "_block")).applyInArrow(
        _scored, "_row bigint, _sum double")
    return sums.groupBy("_row").agg(F.sum("_sum").alias("_sum"))


def _scored(rows: pa.Table, model: pa.Table) -> pa.Table:
    if not rows.num_rows or not model.num_rows:
        return pa.table({"_row": pa.array([], pa.int64()), "_sum": pa.array([], pa.float64())})
    x, total = _features(rows.column("x")), np.zeros(rows.num_rows)
    # the trees of a block in order, as sums depend on it
    of = np.argsort(model.column("tree").to_numpy())
    for tree in of.tolist():
        feature, cut, left, value = (
            np.frombuffer(model.column(c)[tree].as_py(), k) for c, k in
            (("feature", np.int32), ("cut", np.float64), ("left", np.int64), ("value", np.float64)))
        for start in range(0, len(x), WALKED):
            total[start:start + WALKED] += value[_leaves(x[start:start + WALKED], feature, cut, left)]
    return pa.table({"_row": rows.column("_row"), "_sum": pa.array(total)})


def _leaves(x: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The leaf that each row comes to."""
    flat, out = x.ravel(), np.zeros(len(x), np.int64)
    going, begin, at = np.arange(len(x)), np.arange(len(x)) * x.shape[1], np.zeros(len(x), np.int64)
    while len(going):
        for _ in range(STEPS):
            at = left.take(at) + (flat.take(begin + feature.take(at)) > cut.take(at))
        out[going] = at
        on = np.flatnonzero(left.take(at) != at)
        going, begin, at = going.take(on), begin.take(on), at.take(on)
    return out
