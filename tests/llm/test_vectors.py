"""Operators on embeddings against plain whole-number versions, on hostile little tables and the given ones."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import types as T

from selectra.llm import hard_negatives, vector_codes
from tests.conftest import SMALL

SCHEMA = T.StructType([
    T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("label", T.IntegerType()), T.StructField("anchor", T.StringType()), T.StructField("v", T.StringType()),
    T.StructField("error", T.StringType()), T.StructField("_label", T.StringType())])


def hostile_rows(n=700, width=8, seed=5):
    """A third of all rows equal, ties, repeated rows, nulls, lost components, short, empty and huge vectors."""
    draw, rows = random.Random(seed), []
    hot = [0.5, -0.25, 0.125, 0.5, 0.0, 0.25, -0.5, 0.75]
    for i in range(n):
        v = hot if i % 3 == 0 else [draw.choice([-0.5, -0.25, 0.0, 0.25, 0.5, 0.75]) + draw.random() * (i % 2)
                                    for _ in range(width)]
        rows.append((i, v, draw.randrange(3), "a", "b", "c", "d"))
    odd = [(n, None, 1), (n + 1, [None] + hot[1:], 1), (n + 2, [math.nan] + hot[1:], 1), (n + 3, [math.inf] + hot[1:], 1),
           (n + 4, hot, None), (None, hot, 1), (n + 5, hot[:3], 2), (n + 6, [], 2), (n + 7, [1e30] + hot[1:], 1),
           (100, hot, 2), (100, hot, 2), (7, hot, 0), (-100, hot, 1)]
    return rows + [(*r, "a", "b", "c", "d") for r in odd]


def good(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def whole(v, scale, width):
    out = [max(-(1 << 22), min(1 << 22, math.floor(scale * float(np.float32(x))))) for x in v]
    return out + [0] * (width - len(out))


def mined(rows, width, every=100):
    kept = [(r[0], r[2], np.array(whole(r[1], 256, width), dtype=object)) for r in rows
            if r[0] is not None and r[2] is not None and good(r[1])]
    out = []
    for a_id, a_label, a in kept:
        if a_id % every:
            continue
        scored = [(-int(a @ v), i, label) for i, label, v in kept]
        positives = sorted((s, i) for s, i, label in scored if label == a_label and i != a_id)[:5]
        for s, p_id in positives:
            window = sorted((t, i) for t, i, label in scored if label != a_label and 30 * -s <= 100 * -t <= 90 * -s)[:10]
            out += [(a_id, p_id, k + 1, i, -s, -t) for k, (t, i) in enumerate(window)]
    return sorted(out)


@pytest.fixture(scope="module")
def hostile(spark):
    return spark.createDataFrame(hostile_rows(), SCHEMA).repartition(5).persist()


@pytest.mark.parametrize("blocks", [(32_768, 4_096, 2_048), (100, 3, 50)])
def test_hard_negatives_equal_brute_force(hostile, monkeypatch, blocks):
    for name, value in zip(("ROW_BLOCK", "ANCHOR_BLOCK", "LEAST_BLOCK"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    got = sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.whole_rows(hostile)).collect())
    assert got == mined(hostile_rows(), 8)


def test_hard_negatives_of_the_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = sorted(tuple(r) for r in hard_negatives.mine(hard_negatives.whole_rows(table)).collect())
    assert got == mined(rows, 64) and len(got) > 100


def test_hard_negatives_of_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(hard_negatives.whole_rows(empty)).count() == 0
    alone = spark.createDataFrame([(0, [1.0], 1, *"abcd")], SCHEMA)
    assert hard_negatives.mine(hard_negatives.whole_rows(alone)).count() == 0


def test_bounds_take_rows_out_of_play(spark):
    import pyarrow as pa

    draw = np.random.default_rng(1)
    values = (draw.normal(size=(2000, 64)) * np.geomspace(200, 1, 64)).astype(int)
    table = pa.table({"vec_id": np.arange(2000), "label": np.zeros(2000, int), "v": values.tolist()})
    block, looks = hard_negatives.Block(table, 64), []

    def in_play(lower, upper):
        looks.append(len(lower))
        return hard_negatives._best(5)(lower, upper)

    rows, scores = block.scan(values[0].astype(float), np.ones(2000, bool), in_play)
    assert looks[0] == 2000 and looks[-1] < 200  # steep vectors: a few columns decide
    top = block.first(rows, scores, 5)
    exact = values @ values[0]
    assert list(rows[top]) == sorted(range(2000), key=lambda i: (-exact[i], i))[:5]


def coded(rows, width, parts=4, entries=256, rounds=4):
    def key(r):
        return (r[0] is None, r[0] or 0, whole(r[1], 1024, 0))

    kept = sorted((r for r in rows if good(r[1])), key=key)
    step = -(-width // parts)
    x = np.array([whole(r[1], 1024, parts * step) for r in kept], dtype=np.int64).reshape(len(kept), parts, step)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        gaps = ((x[:, :, None, :] - books[None]) ** 2).sum(3)
        return gaps.argmin(2), gaps.min(2).sum(1)

    for _ in range(rounds):
        code, _ = assign()
        books = books.copy()
        for p in range(parts):
            for e in set(code[:, p]):
                mine = x[code[:, p] == e, p]
                books[p, e] = mine.sum(0) // len(mine)
    code, error = assign()
    labels = [r[2] for r in kept]
    total = {b: sum(int(e) for e, c in zip(error, labels) if c == b) for b in set(labels)}
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{c:02x}" for c in code[i]), int(error[i]), total[r[2]], digest)
                   for i, r in enumerate(kept)), key=str)


@pytest.mark.parametrize("block", [4_096, 60])
def test_codes_equal_brute_force(hostile, monkeypatch, block):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", block)
    got = sorted((tuple(r) for r in vector_codes.coded_rows(hostile).collect()), key=str)
    assert got == coded(hostile_rows(), 8)


def test_codes_of_the_given_table(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    got = sorted((tuple(r) for r in vector_codes.coded_rows(table).collect()), key=str)
    assert got == coded(rows, 64)


def test_codes_of_little(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.coded_rows(empty).count() == 0
    three = spark.createDataFrame([(i, [float(i), 1.0, 2.0], None, *"abcd") for i in range(3)], SCHEMA)
    got = sorted(vector_codes.coded_rows(three).collect(), key=lambda r: r.vec_id)
    assert [r.error for r in got] == [0, 0, 0] and [r.label_error for r in got] == [0, 0, 0]
    assert [r.code for r in got][1][:2] == "01"
    with pytest.raises(ValueError):
        vector_codes.fit_codes(empty, vector_codes.Coding(entries=257))


def test_cover_trees_keep_their_promises():
    draw = np.random.default_rng(2)
    middles = draw.integers(-2000, 2000, (30, 6))
    points = np.unique(middles[draw.integers(0, 30, 3000)] + draw.integers(-4, 5, (3000, 6)), axis=0)
    counts = draw.integers(1, 5, len(points))
    tree = vector_codes.CoverTree(points, counts)
    for level, centre in enumerate(tree.centres):
        assert (tree.total[level].sum(0) == (points * counts[:, None]).sum(0)).all()
        assert tree.count[level].sum() == counts.sum()
        if level:  # nodes stay nodes on finer levels, as their own children
            assert set(tree.centres[level - 1]) <= set(centre)
            gaps = np.sqrt(vector_codes.squared(points[centre], points[centre]))
            parent = tree.centres[level - 1][tree.parents[level]]
            away = np.sqrt(((points[centre] - points[parent]) ** 2).sum(1))
            apart = gaps[~np.eye(len(centre), dtype=bool)].min()
            assert away.max() <= 2 * 2 ** math.ceil(math.log2(apart))
    again = vector_codes.CoverTree.stored(tree.arrays(), 6)
    entries = middles[:25]
    total, count = again.sums(entries)
    code = vector_codes.squared(points, entries).argmin(1)
    assert (tree.codes(entries) == code).all()
    assert (count == np.bincount(code, counts, 25)).all()
    assert (total == np.stack([(points * counts[:, None])[code == e].sum(0) for e in range(25)])).all()
    single = sum(len(which) for kind, _, which, _ in tree.walk(entries) if kind == "points")
    assert single < len(points) / 2  # clusters are assigned as subtrees
