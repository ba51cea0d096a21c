"""Neighbour search against brute force: clusters, hot points, far targets, split cells; recall of ranked buckets."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from selectra.operators import neighbours


def frame(spark, rows, at):
    return spark.createDataFrame([(at + i, *map(float, p)) for i, p in enumerate(rows)], "id bigint, x double, y double")


def clustered():
    draw = np.random.default_rng(8)
    hot = np.tile([[0.25, 0.25]], (400, 1))  # a third of the points are one point
    blobs = [draw.normal(c, 0.01, (200, 2)) for c in ((0, 0), (3, 3), (-5, 2))]
    line = np.stack([np.zeros(200), draw.integers(0, 20, 200) / 4], axis=1)  # ties, one dimension without extent
    train = np.concatenate([hot, *blobs, line])
    far = np.array([[1e6, -1e6], [-1e3, 0.0], [0.25, 1e5]])
    targets = np.concatenate([np.tile([[0.25, 0.25]], (150, 1)), draw.normal(3, 0.01, (80, 2)), draw.uniform(-6, 6, (60, 2)), far])
    return train, targets


def check(rows, train, targets, k=5):
    got = {}
    for r in rows:
        got.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    for i, p in enumerate(targets):
        d = np.sqrt(((train - p) ** 2)[:, 0] + ((train - p) ** 2)[:, 1])
        expected = sorted(range(len(train)), key=lambda j: (d[j], j))[:k]
        assert [n for _, n, _ in sorted(got[100_000 + i])] == expected, i
        assert [x for _, _, x in sorted(got[100_000 + i])] == pytest.approx([d[j] for j in expected])


@pytest.mark.parametrize("cell_rows, group_points, group_targets", [(1024, 4096, 65_536), (40, 16, 20), (4, 3, 7)])
def test_clusters_and_far_targets(spark, monkeypatch, cell_rows, group_points, group_targets):
    monkeypatch.setattr(neighbours, "GROUP_POINTS", group_points)
    monkeypatch.setattr(neighbours, "GROUP_TARGETS", group_targets)
    train, targets = clustered()
    check(neighbours.nearest(frame(spark, targets, 100_000), frame(spark, train, 0), "id", ["x", "y"], 5, cell_rows).collect(),
          train, targets)


def test_no_group_sees_all_points(spark, monkeypatch):
    """Boxes are balanced, and a target looks into few of them."""
    train, targets = clustered()
    distinct = np.unique(train, axis=0)
    points = spark.createDataFrame([([float(x), float(y)],) for x, y in distinct], "_x array<double>")
    cells = neighbours.cut_cells(points, 2, len(distinct), 40)
    assert cells.points.sum() == len(distinct) and cells.points.max() <= 60
    gaps = np.sqrt(((targets[:, None, :] - distinct[None]) ** 2).sum(2))
    kth = np.sort(gaps, axis=1)[:, 4]
    assert (cells.surely(targets, 5) >= kth).all()
    asked = (cells.least(targets) <= kth[:, None]).sum(1)
    assert asked.max() <= 6 and asked[-3:].max() <= 3  # far targets ask no more boxes than others
    monkeypatch.setattr(neighbours, "MOST_CELLS", 4)
    assert len(neighbours.cut_cells(points, 2, len(distinct), 40).ids) <= 4


def test_jobs_do_not_follow_the_data(spark):
    jobs = []
    for n in (200, 3000):
        draw = np.random.default_rng(n)
        train, targets = draw.normal(size=(n, 2)), draw.normal(size=(20, 2))
        group = f"near-{n}"
        spark.sparkContext.setJobGroup(group, group)
        neighbours.nearest(frame(spark, targets, 100_000), frame(spark, train, 0), "id", ["x", "y"], 5, n // 8).collect()
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    assert 0 < jobs[1] <= jobs[0] + 8


def test_missing_coordinates_and_little_data(spark):
    schema = "id bigint, x double, y double"
    train = spark.createDataFrame([(1, 0.0, None), (2, float("nan"), 0.0), (3, 1.0, 1.0)], schema)
    targets = spark.createDataFrame([(8, 0.0, 0.0), (9, None, 0.0)], schema)
    assert [(r.id, r.neighbour) for r in neighbours.nearest(targets, train, "id", ["x", "y"]).collect()] == [(8, 3)]
    assert neighbours.nearest(targets, train.where("id < 0"), "id", ["x", "y"]).count() == 0
    assert neighbours.nearest(targets.where("id < 0"), train, "id", ["x", "y"]).count() == 0


def long_vectors(spark, rows, at):
    return spark.createDataFrame([(at + i, [float(v) for v in p]) for i, p in enumerate(rows)], "id bigint, v array<float>")


def recall(rows, train, targets, k):
    got = {}
    for r in rows:
        got.setdefault(r["id"], set()).add(r["neighbour"])
    assert all(len(got[100_000 + i]) == k for i in range(len(targets)))  # k rows for every target
    hit = 0
    for i, p in enumerate(targets):
        d = ((train - p) ** 2).sum(1)
        hit += len(got[100_000 + i] & set(np.argsort(d, kind="stable")[:k]))
    return hit / (k * len(targets))


def test_recall_of_ranked_buckets(spark, tables, monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_POINTS", 64)
    monkeypatch.setattr(neighbours, "GROUP_TARGETS", 64)
    draw = np.random.default_rng(4)
    rows = tables.read("embeddings").orderBy("vec_id").collect()
    given = np.array([r.embedding for r in rows], dtype=np.float32).astype(float)
    centres = draw.normal(0, 1, (40, 32))
    gathered = (centres[draw.integers(0, 40, 2000)] + draw.normal(0, 0.2, (2000, 32))).astype(np.float32).astype(float)
    for data, share in ((given, 0.75), (gathered, 0.1)):
        targets, train = data[::5], data
        a, b = long_vectors(spark, targets, 100_000), long_vectors(spark, train, 0)
        assert recall(neighbours.nearest_ranked(a, b, "id", "v", 5, share).collect(), train, targets, 5) >= 0.9
    a, b = long_vectors(spark, given[:30], 100_000), long_vectors(spark, given, 0)
    assert recall(neighbours.nearest_ranked(a, b, "id", "v", 5, 1.0).collect(), given, given[:30], 5) == 1.0


def test_targets_with_few_rows_near_go_on(spark):
    train = long_vectors(spark, [[100.0 * i] * 4 for i in range(9)], 0)
    target = long_vectors(spark, [[0.0] * 4], 100_000)
    rows = neighbours.nearest_ranked(target, train, "id", "v", 5, 0.01).orderBy("rank").collect()
    assert [r.neighbour for r in rows] == [0, 1, 2, 3, 4]
    assert neighbours.nearest_ranked(target, train.where(F.col("id") < 0), "id", "v").count() == 0


@pytest.mark.parametrize("kind", ["plain", "whole numbers", "far from zero", "copies and infinity", "tiny"])
def test_products_give_the_same_neighbours_as_columns(kind):
    """Distances by matrix products only choose what is measured exactly: ties, offsets and scales change nothing."""
    draw = np.random.default_rng(5)
    x, p = draw.normal(size=(70, 16)), draw.normal(size=(300, 16))
    if kind == "whole numbers":
        x, p = np.round(x), np.round(p)
    elif kind == "far from zero":
        x, p = x + 1e8, p + 1e8
    elif kind == "copies and infinity":
        p[:100], x[:9], p[200] = p[0], p[0], np.inf
    elif kind == "tiny":
        x, p = x * 1e-170, p * 1e-170
    gap = np.zeros((len(x), len(p)))
    for c in range(16):
        gap += (x[:, c][:, None] - p[:, c][None, :]) ** 2
    gap = np.sqrt(gap)
    table = lambda rows, name: pa.table({name: list(range(len(rows))), "_x": pa.array(rows.tolist(), pa.list_(pa.float64()))})
    got = neighbours._closest(table(x, "t"), table(p, "neighbour"), "t", 5)
    order = np.argsort(gap, axis=1, kind="stable")[:, :5]
    assert got["t"].to_pylist() == np.repeat(np.arange(70), 5).tolist()
    assert got["neighbour"].to_pylist() == order.ravel().tolist()
    assert got["distance"].to_pylist() == np.take_along_axis(gap, order, 1).ravel().tolist()


def test_few_pairs_are_measured_column_by_column():
    """Of separated vectors hardly more than the wanted ones are measured a second time."""
    draw = np.random.default_rng(6)
    x, p = draw.normal(size=(50, 64)), draw.normal(size=(2000, 64))
    assert len(neighbours._nearest_pairs(x, p, 5)[0]) == 250
