"""Tree builders against recursive versions written out node by node."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from selectra.operators import trees
from selectra.operators.trees import Boosting

SCHEMA = "x array<double>, y double"


def dyadic_rows(n, seed=1, hot=True):
    """Targets whose sums are exact in any order; a third of the rows are one row."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        if hot and i % 3 == 0:
            rows.append(([0.5, 2.0, 1.0], 0.25))
        else:
            x = [draw.randrange(64) / 64, float(draw.randrange(4)), float(draw.random() < 0.3)]
            rows.append((x, round(8 * x[0] * x[1]) / 8 + draw.randrange(3) / 8))
    return rows


def extra_tree_by_recursion(rows, tree, leaf, seed):
    out = {}

    def grow(node, part):
        ys = [y for _, y in part]
        best = None
        if min(ys) < max(ys):
            for f in range(3):
                lo, hi = min(x[f] for x, _ in part), max(x[f] for x, _ in part)
                if lo == hi:
                    continue
                u = trees.uniforms(seed, np.array([tree]), np.array([node]), 3)[0, f]
                cut = lo + u * (hi - lo)
                cut = lo if cut >= hi else cut
                left, right = [y for x, y in part if x[f] <= cut], [y for x, y in part if x[f] > cut]
                if min(len(left), len(right)) < leaf:
                    continue
                score = sum(left) ** 2 / len(left) + sum(right) ** 2 / len(right)
                if best is None or score > best[0]:
                    best = (score, f, cut)
        out[node] = (-1 if best is None else best[1], 0.0 if best is None else best[2], sum(ys) / len(ys), len(ys))
        if best:
            for side in (0, 1):
                grow(int(trees.child(node, side)[0]), [r for r in part if (r[0][best[1]] > best[2]) == bool(side)])

    grow(trees.ROOT, rows)
    return out


@pytest.mark.parametrize("task_rows", [4096, 40])
def test_extra_trees_equal_recursion(spark, monkeypatch, task_rows):
    """The same trees, whether tasks grow them whole or levels of aggregates come first."""
    monkeypatch.setattr(trees, "TASK_ROWS", task_rows)
    rows = dyadic_rows(400)
    df = spark.createDataFrame(rows + [([0.0, 0.0, 0.0], None)], SCHEMA).repartition(5)
    got = {}
    for r in trees.grow_extra_trees(df, 6, leaf=2, seed=9).collect():
        got.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, pytest.approx(r.value), r.rows)
    assert len(got) == 6
    for tree in range(6):
        assert got[tree] == extra_tree_by_recursion(rows, tree, 2, 9)
    assert len({tuple(sorted(nodes)) for nodes in got.values()}) > 1  # trees differ


def test_small_tables_need_no_upper_levels(spark, monkeypatch):
    """Some task sizes in all: blocks of whole trees, the last one not full, without an aggregate a level."""
    monkeypatch.setattr(trees, "TASK_ROWS", 60)
    monkeypatch.setattr(trees, "_grow_upper", None)
    rows = dyadic_rows(400)
    got = {}
    for r in trees.grow_extra_trees(spark.createDataFrame(rows, SCHEMA).repartition(5), 20, leaf=2, seed=9).collect():
        got.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, pytest.approx(r.value), r.rows)
    assert sorted(got) == list(range(20))
    for tree in (0, 7, 8, 19):
        assert got[tree] == extra_tree_by_recursion(rows, tree, 2, 9)


def test_jobs_follow_the_depth_not_the_trees(spark):
    df = spark.createDataFrame(dyadic_rows(300), SCHEMA)
    counts = []
    for n in (4, 64):
        group = f"trees-{n}"
        spark.sparkContext.setJobGroup(group, group)
        trees.grow_extra_trees(df, n)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert counts[0] == counts[1] > 0


def test_sums_over_the_grid_equal_walks(spark, monkeypatch):
    monkeypatch.setattr(trees, "SCORED_NODES", 300)
    monkeypatch.setattr(trees, "SCORED_ROWS", 50)
    rows = dyadic_rows(200)
    nodes = trees.grow_extra_trees(spark.createDataFrame(rows, SCHEMA), 7, seed=4)
    asked = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "_row bigint, x array<double>")
    got = {r["_row"]: r["_sum"] for r in trees.tree_sums(asked, nodes).collect()}
    grown = [extra_tree_by_recursion(rows, t, 2, 4) for t in range(7)]
    for i, (x, _) in enumerate(rows):
        total = 0.0
        for nodes_of in grown:
            at = trees.ROOT
            while nodes_of[at][0] >= 0:
                at = int(trees.child(at, int(x[nodes_of[at][0]] > nodes_of[at][1]))[0])
            total += nodes_of[at][2]
        assert got[i] == pytest.approx(total)
    assert trees.tree_sums(asked, nodes.where("tree < 0")).agg(F.sum("_sum")).first()[0] == 0.0


def boosted_by_recursion(rows, boosting):
    """Predictions of boosting on the values themselves (few distinct ones, so that bins are values)."""
    xs, ys = [x for x, _ in rows], [y for _, y in rows]
    base = sum(ys) / len(ys)
    pred = [base] * len(rows)

    def best(part):
        g = sum(pred[i] - ys[i] for i in part)
        found = None
        for f in range(3):
            values = sorted({x[f] for x in xs})
            for lo, hi in zip(values, values[1:]):
                left = [i for i in part if xs[i][f] <= lo]
                right = [i for i in part if xs[i][f] > lo]
                if min(len(left), len(right)) < boosting.leaf_rows:
                    continue
                gl, gr = (sum(pred[i] - ys[i] for i in side) for side in (left, right))
                gain = gl * gl / (len(left) + boosting.l2) + gr * gr / (len(right) + boosting.l2) - g * g / (len(part) + boosting.l2)
                if gain > 1e-12 and (found is None or gain > found[0] + 1e-12):
                    found = (gain, left, right)
        return found

    for _ in range(boosting.rounds):
        leaves = [list(range(len(rows)))]
        while len(leaves) < boosting.leaves:
            splits = [(best(part), k) for k, part in enumerate(leaves)]
            splits = [(s, k) for s, k in splits if s]
            if not splits:
                break
            s, k = max(splits, key=lambda t: t[0][0])
            leaves[k:k + 1] = [s[1], s[2]]
        steps = {}
        for part in leaves:
            g = sum(pred[i] - ys[i] for i in part)
            for i in part:
                steps[i] = -boosting.rate * g / (len(part) + boosting.l2)
        pred = [p + steps[i] for i, p in enumerate(pred)]
    return pred


def boosted_scores(spark, rows, boosting):
    nodes, base = trees.grow_boosted(spark.createDataFrame(rows, SCHEMA).repartition(4), boosting)
    asked = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows)], "_row bigint, x array<double>")
    got = {r["_row"]: base + r["_sum"] for r in trees.tree_sums(asked, nodes).collect()}
    return nodes, [got[i] for i in range(len(rows))]


@pytest.mark.parametrize("driver_cells", [200_000, 0])
def test_boosting_equals_recursion(spark, monkeypatch, driver_cells):
    """The same scores, whether the driver sums the histograms or Spark does."""
    monkeypatch.setattr(trees, "DRIVER_CELLS", driver_cells)
    monkeypatch.setattr(trees, "KEPT_ROUNDS", 2)
    draw = random.Random(2)
    rows = []
    for _ in range(120):
        x = [draw.randrange(9) / 8, float(draw.randrange(4)), float(draw.random() < 0.4)]
        rows.append((x, x[0] * x[1] + draw.random()))
    boosting = Boosting(rounds=4, rate=0.3, leaves=5, l2=1.0, leaf_rows=8)
    nodes, scores = boosted_scores(spark, rows, boosting)
    assert scores == pytest.approx(boosted_by_recursion(rows, boosting), abs=1e-9)
    per_tree = {r.tree: r.n for r in nodes.where("feature < 0").groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert set(per_tree) == set(range(4)) and max(per_tree.values()) == 5  # leaves


def test_first_gain_by_hand(spark):
    """y is 0 for x = 0 and 1 for x = 1: gradients -+1/2, gain 25 * (1/2)^2 * 50 / ... worked out below."""
    rows = [([float(i % 2)], float(i % 2)) for i in range(50)]
    nodes, base = trees.grow_boosted(spark.createDataFrame(rows, SCHEMA), Boosting(rounds=1, rate=0.1))
    assert base == 0.5
    by = {r.node: r for r in nodes.collect()}
    assert (by[trees.ROOT].feature, by[trees.ROOT].cut, by[trees.ROOT].rows) == (0, 0.5, 50)
    # each side: 25 rows of gradient -+0.5, sum -+12.5; value = -0.1 * -+12.5 / (25 + 1)
    values = [by[int(trees.child(trees.ROOT, side)[0])].value for side in (0, 1)]
    assert values == pytest.approx([-1.25 / 26, 1.25 / 26])
    grad = np.array([[12.5, -12.5]])
    count = np.array([[25.0, 25.0]])
    gain, feature, last = trees.best_split(grad, count, Boosting())
    assert (gain, feature, last) == (pytest.approx(2 * 12.5 ** 2 / 26), 0, 0)


def test_many_values_are_binned_by_quantiles(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=3000)
    rows = [([float(v), 1.0], float(v > 0.3)) for v in x]
    nodes, scores = boosted_scores(spark, rows, Boosting(rounds=30, rate=0.3))
    wrong = sum((s > 0.5) != (y > 0.5) for s, (_, y) in zip(scores, rows))
    assert wrong < 30 and len(trees.bin_edges(spark.createDataFrame(rows, SCHEMA), 2)[0]) <= trees.BINS


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert trees.grow_extra_trees(empty, 5).count() == 0
    nodes, base = trees.grow_boosted(empty)
    assert nodes.count() == 0 and base == 0.0


def forest_tree_by_recursion(rows, weights, leaf):
    out = {}

    def grow(node, part):
        sw, s = sum(weights[i][0] for i in part), sum(weights[i][0] * rows[i][1] for i in part)
        best = None
        for f in range(3):
            values = sorted({rows[i][0][f] for i in part})
            for lo, hi in zip(values, values[1:]):
                left, right = [i for i in part if rows[i][0][f] <= lo], [i for i in part if rows[i][0][f] > lo]
                if min(sum(weights[i][1] for i in side) for side in (left, right)) < leaf:
                    continue
                score = sum(sum(weights[i][0] * rows[i][1] for i in side) ** 2 / sum(weights[i][0] for i in side)
                            for side in (left, right))
                if score > s * s / sw * (1 + 1e-12) and (best is None or score > best[0]):
                    best = (score, f, (lo + hi) / 2)
        out[node] = (-1 if best is None else best[1], 0.0 if best is None else best[2], s / sw)
        if best:
            for side in (0, 1):
                grow(int(trees.child(node, side)[0]), [i for i in part if (rows[i][0][best[1]] > best[2]) == bool(side)])

    grow(trees.ROOT, [i for i in range(len(rows)) if weights[i][0] > 0])
    return out


def test_forest_equals_recursion(spark):
    copies = {}
    for x, y in dyadic_rows(240):
        copies[tuple(x), y] = copies.get((tuple(x), y), 0) + 1
    rows = [(list(x), y) for x, y in copies]
    df = spark.createDataFrame(dyadic_rows(240), SCHEMA).repartition(3)
    keys = {(tuple(r.x), r.y): r.k for r in df.distinct().select("x", "y", F.xxhash64("x", "y").alias("k")).collect()}
    got = {}
    for r in trees.grow_forest(df, 4, seed=6).collect():
        got.setdefault(r.tree, {})[r.node] = (r.feature, r.cut, pytest.approx(r.value))
    for tree in range(4):
        w, n = trees.drawn_weights(6, tree, np.array([keys[tuple(x), y] for x, y in rows]), np.array(list(copies.values())))
        assert got[tree] == forest_tree_by_recursion(rows, list(zip(w, n)), 2)


def test_forest_above_the_task_size(spark, monkeypatch):
    """Levels of histograms first, exact subtrees below: about as good as exact cuts alone."""
    draw = np.random.default_rng(1)
    x = draw.uniform(size=(1500, 3))
    rows = [([float(v) for v in r], float(np.sin(6 * r[0]) + r[1] * (r[2] > 0.5))) for r in x]
    df = spark.createDataFrame(rows, SCHEMA)
    asked = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "_row bigint, x array<double>")
    errors = []
    for size in (4096, 200):
        monkeypatch.setattr(trees, "TASK_ROWS", size)
        nodes = trees.grow_forest(df, 10)
        got = {r["_row"]: r["_sum"] / 10 for r in trees.tree_sums(asked, nodes).collect()}
        errors.append(np.mean([(got[i] - y) ** 2 for i, (_, y) in enumerate(rows)]))
    assert max(errors) < 0.01 and errors[1] < 2 * errors[0]


def test_forest_of_small_tables_is_grown_by_blocks(spark, monkeypatch):
    """Blocks of trees from one copy of the rows give the same forest as rows dealt to every tree."""
    monkeypatch.setattr(trees, "TASK_ROWS", 60)
    df = spark.createDataFrame(dyadic_rows(400, hot=False), SCHEMA)
    table = lambda: sorted(map(tuple, trees.grow_forest(df, 10).collect()))
    monkeypatch.setattr(trees, "WHOLE_TIMES", 0)
    dealt = table()
    monkeypatch.setattr(trees, "WHOLE_TIMES", 8)
    monkeypatch.setattr(trees, "_dealt_drawn", None)
    assert table() == dealt and len({r[0] for r in dealt}) == 10


def test_upper_levels_walk_only_the_trees_asked_for():
    upper = trees.Upper(4, [{"tree": np.arange(4), "node": np.full(4, trees.ROOT), "feature": np.zeros(4, int), "cut": np.full(4, 0.5)}])
    x = np.array([[0.0], [1.0]])
    assert [t for t, _ in upper.places(x, np.array([2, 2, 3]))] == [2, 3]
    assert [a.tolist() for _, a in upper.places(x, np.array([2]))] == [a.tolist() for t, a in upper.places(x) if t == 2]


def test_draws_are_poisson_for_any_number_of_copies():
    key = np.arange(20_000, dtype=np.int64) * 7919
    for copies in (1, 5, 400):
        w, n = trees.drawn_weights(3, 1, key, np.full(len(key), copies))
        assert w.mean() == pytest.approx(copies, rel=0.03) and w.var() == pytest.approx(copies, rel=0.06)
        assert (n <= w).all() and n.mean() == pytest.approx(copies * (1 - np.exp(-1)), rel=0.05)


def test_forest_cuts_are_exact_above_the_task_size(spark, monkeypatch):
    """Many values, targets of any digits: levels of aggregates and tasks of whole trees give the same forest."""
    draw = np.random.default_rng(7)
    x = np.column_stack([draw.normal(size=(900, 2)), draw.integers(0, 150, 900), draw.random(900) < 0.3])
    rows = [([float(v) for v in r], float(np.sin(3 * r[0]) + draw.random())) for r in x]
    df = spark.createDataFrame(rows + rows[:200], SCHEMA).repartition(5)
    table = lambda: sorted(map(tuple, trees.grow_forest(df, 3).collect()))
    whole = table()
    monkeypatch.setattr(trees, "TASK_ROWS", 60)
    monkeypatch.setattr(trees, "WHOLE_TIMES", 0)
    monkeypatch.setattr(trees, "UPPER_NODES", 2)
    monkeypatch.setattr(trees, "DEALT_ROWS", 2 * len(rows))
    assert table() == whole and len({r[0] for r in whole}) == 3


def test_equal_rows_are_scored_once(spark, monkeypatch):
    """More rows than a block holds: the sums are those of one block, and only distinct rows walk."""
    rows = dyadic_rows(300)
    nodes = trees.grow_extra_trees(spark.createDataFrame(rows, SCHEMA), 5, seed=3)
    asked = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(rows * 2)], "_row bigint, x array<double>")
    table = lambda: {r["_row"]: r["_sum"] for r in trees.tree_sums(asked, nodes).collect()}
    whole, walked = table(), []
    monkeypatch.setattr(trees, "SCORED_ROWS", 100)
    grid = trees._grid_sums
    monkeypatch.setattr(trees, "_grid_sums", lambda rows, count, *a: walked.append(count) or grid(rows, count, *a))
    got = table()
    assert set(got) == set(range(600)) and all(got[i] == pytest.approx(whole[i]) for i in got)
    assert walked == [len({tuple(x) for x, _ in rows})]


def test_boosting_gives_the_same_trees_on_both_sides(spark, monkeypatch):
    """Targets of any digits: the driver's sums and the aggregates' are equal to the last digit."""
    draw = np.random.default_rng(11)
    x = np.column_stack([draw.normal(size=(700, 2)), draw.integers(0, 5, 700)])
    df = spark.createDataFrame([([float(v) for v in r], float(np.sin(3 * r[0]) + draw.random() / 3)) for r in x], SCHEMA).repartition(5)
    boosting, out = Boosting(rounds=4, rate=0.3, leaves=8), []
    for cells in (200_000, 0):
        monkeypatch.setattr(trees, "DRIVER_CELLS", cells)
        nodes, base = trees.grow_boosted(df, boosting)
        out.append((base, sorted(map(tuple, nodes.collect()))))
    assert out[0] == out[1]
