"""Stored keyed tables: growth by splitting, merges that touch few leaves, crashes, retries, reading cost."""

import time
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, functions as F

from selectra.operators.incremental import upsert
from selectra.operators.stored import KeyedTable, Leaf

SCHEMA = "k bigint, seq bigint, v string, leaf string"


def rows(spark, ks, seq):
    return spark.createDataFrame([(k, seq, f"{k}-{seq}", "x") for k in ks], SCHEMA)


def table(spark, path, split_rows=50):
    return KeyedTable(spark, str(path), ["k"], rows(spark, [], 0).schema, split_rows)


def last(old, new):
    return upsert(old, new, ["k"], ["seq"])


def files(path):
    return sum(1 for _ in Path(path).rglob("*.parquet"))


def test_leaves_split_as_the_table_grows(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0
    for seq in range(4):
        t.merge(rows(spark, range(seq * 60, seq * 60 + 120), seq), last)
    leaves = t.manifest().leaves
    assert len(leaves) >= 6 and max(x.rows for x in leaves) <= 50
    assert sum(2.0 ** -x.bits for x in leaves) == 1.0  # the leaves are the whole hash space, once
    got = {r.k: r.seq for r in t.read().collect()}
    assert got == {k: min(3, k // 60) for k in range(300)}
    assert sum(x.rows for x in leaves) == 300


def test_only_touched_leaves_are_rewritten(spark, tmp_path):
    t = table(spark, tmp_path)
    t.merge(rows(spark, range(400), 1), last)
    before = {x.folder for x in t.manifest().leaves}
    t.merge(rows(spark, [7], 2), last)
    after = {x.folder for x in t.manifest().leaves}
    assert len(before - after) == 1
    assert {r.k: r.seq for r in t.read().where("k in (7, 8)").collect()} == {7: 2, 8: 1}


def test_what_is_read_does_not_grow_with_the_batches(spark, tmp_path):
    t = table(spark, tmp_path, 1000)
    for seq in range(12):
        t.merge(rows(spark, range(30), seq), last)
    assert len(t.read().inputFiles()) == 1
    assert files(tmp_path) <= 2 and len(list((tmp_path / "manifests").glob("*.json"))) == 2


def test_a_crash_before_the_manifest_loses_nothing(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.merge(rows(spark, range(100), 1), last, batch_id=0)

    def crash(self, manifest):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyedTable, "_publish", crash)
        with pytest.raises(RuntimeError, match="lost"):
            t.merge(rows(spark, range(50, 150), 2), last, batch_id=1)
    assert {r.seq for r in t.read().collect()} == {1} and t.read().count() == 100
    assert t.merge(rows(spark, range(50, 150), 2), last, batch_id=1)
    got = {r.k: r.seq for r in t.read().collect()}
    assert got == {k: 1 if k < 50 else 2 for k in range(150)}
    folders = {p.name for p in (tmp_path / "rows").iterdir()}
    assert len(folders) == 2  # what the crash left is swept


def test_a_batch_is_merged_once(spark, tmp_path):
    t = table(spark, tmp_path)
    added = lambda old, new: old.unionByName(new)
    one = rows(spark, range(10), 1)
    assert t.merge(one, added, batch_id=3) and not t.merge(one, added, batch_id=3) and not t.merge(one, added, batch_id=2)
    assert t.read().count() == 10 and t.merge(one, added, batch_id=4) and t.read().count() == 20


def test_hot_keys_and_null_keys(spark, tmp_path):
    """Rows of one key can not be split; they stay together and the merge ends."""
    t = table(spark, tmp_path, 5)
    hot = rows(spark, [1] * 40, 1).unionByName(spark.createDataFrame([(None, 1, "n", "x")], SCHEMA))
    t.merge(hot, lambda old, new: old.unionByName(new))
    assert t.read().count() == 41 and t.read().where(F.col("k").isNull()).count() == 1
    t.merge(hot, lambda old, new: DataFrame.distinct(old.unionByName(new)))
    assert t.read().where("k = 1").count() == 1


def test_places_in_many_leaves_and_few_deep_ones(spark, tmp_path):
    rows = spark.range(500).select(F.col("id").alias("k"), F.xxhash64("id").alias("hashed"))
    table = KeyedTable(spark, str(tmp_path), ["k"], rows.select("k").schema)
    # the prefixes 0 to 6 of three bits, and below the last one a few of sixteen bits: those that the first keys have
    deep = sorted({(r.hashed % 2 ** 64) >> 48 for r in rows.collect() if (r.hashed % 2 ** 64) >> 61 == 7})[:5]
    leaves = [Leaf(16, p) for p in deep] + [Leaf(3, p) for p in range(7)]
    placed = rows.withColumn("leaf", table._place(leaves)).collect()
    for r in placed:
        top, low = (r.hashed % 2 ** 64) >> 61, (r.hashed % 2 ** 64) >> 48
        assert r.leaf == (5 + top if top < 7 else deep.index(low) if low in deep else None)
    assert len(deep) == 5
    began = time.monotonic()
    many = rows.withColumn("leaf", table._place([Leaf(14, p) for p in range(1 << 14)]))
    assert time.monotonic() - began < 5  # a literal per leaf took 18 s
    assert all(r.leaf == (r.hashed % 2 ** 64) >> 50 for r in many.collect())
