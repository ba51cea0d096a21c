"""Graphs of at most 60 nodes, one row each: the neighbours of a node are one integer.

Once a graph is packed (one shuffle on its id), every feature is an expression
over a short array, so many small graphs need no joins and no iterations.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from selectra.session import spread

LIMIT = 60


def _big(value) -> Column:
    return (F.lit(value) if not isinstance(value, Column) else value).cast("bigint")


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", _big(1), position.cast("int"))


def _has(mask: Column, position: Column) -> Column:
    return F.call_function("shiftright", mask, position.cast("int")).bitwiseAND(_big(1)) == 1


def _count(mask: Column) -> Column:
    return F.bit_count(mask).cast("bigint")


def _total(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def pack(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, n, masks): the caller guarantees at most 60 nodes per graph."""
    ends = F.array(F.struct(F.col("u").alias("node"), _bit(F.col("v")).alias("mask")),
                   F.struct(F.col("v").alias("node"), _bit(F.col("u")).alias("mask")))
    arcs = edges.select("graph_id", F.inline(ends))
    alone = vertices.select("graph_id", "node", _big(0).alias("mask"))
    # one shuffle on the graph serves both groupings
    together = spread(arcs.unionByName(alone), "graph_id")
    nodes = together.groupBy("graph_id", "node").agg(F.bit_or("mask").alias("mask"))
    rows = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("node", "mask"))).alias("_m"))
    return rows.select("graph_id", F.size("_m").cast("bigint").alias("n"), F.col("_m.mask").alias("masks"))


def _index() -> Column:
    return F.sequence(_big(0), F.col("n") - 1)


def clustering(packed: DataFrame) -> DataFrame:
    """Twice the triangles of a node: common neighbours summed over its neighbours."""
    masks = F.col("masks")
    twice = F.transform(masks, lambda m: F.aggregate(
        _index(), _big(0), lambda a, j: a + F.when(_has(m, j), _count(m.bitwiseAND(F.get(masks, j.cast("int"))))).otherwise(_big(0))))
    rows = packed.withColumn("_d", F.transform(masks, _count)).withColumn("_t", twice)
    n = F.col("n").cast("double")
    local = F.zip_with("_d", "_t", lambda d, t: F.when(d < 2, F.lit(0.0)).otherwise(
        F.try_divide(t.cast("double"), d * (d - 1))))
    corners, pairs = _total(F.col("_t")), _total(F.transform("_d", lambda d: d * (d - 1)))
    return rows.select(
        "graph_id", F.floor(corners / 6).cast("bigint").alias("triangle_count"),
        (corners / 6.0 / F.greatest(F.lit(1.0), n * (n - 1) * (n - 2) / 6.0)).alias("triangle_density"),
        (_total(local, "double") / n).alias("average_clustering"),
        F.coalesce(F.try_divide(corners.cast("double"), pairs), F.lit(0.0)).alias("transitivity"))


def assortativity(packed: DataFrame) -> DataFrame:
    """Integer moments, so that a regular graph has exactly no variance."""
    rows = packed.withColumn("_d", F.transform("masks", _count))
    degree = F.col("_d")
    around = F.transform("masks", lambda m: F.aggregate(
        _index(), _big(0), lambda a, j: a + F.when(_has(m, j), F.get(degree, j.cast("int"))).otherwise(_big(0))))
    both = _total(F.zip_with(degree, around, lambda d, s: d * s))
    arcs, first = _total(degree), _total(F.transform(degree, lambda d: d * d))
    second = _total(F.transform(degree, lambda d: d * d * d))
    return rows.select("graph_id", F.coalesce(F.try_divide(
        (both * arcs - first * first).cast("double"), second * arcs - first * first), F.lit(0.0)).alias("degree_assortativity"))


def closed(packed: DataFrame) -> DataFrame:
    """Adds ``reach``: per node, everything it can reach, itself included."""
    start = F.transform("masks", lambda m, i: m.bitwiseOR(_bit(i)))
    closure = F.aggregate(_index(), start, lambda r, k: F.transform(
        r, lambda x: F.when(_has(x, k), x.bitwiseOR(F.get(r, k.cast("int")))).otherwise(x)))
    return packed.withColumn("reach", closure)


def _lowest(mask: Column) -> Column:
    return _count(mask.bitwiseAND(-mask) - 1)


def components(packed: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node reachable."""
    return closed(packed).select("graph_id", F.posexplode("reach").alias("node", "_r")).select(
        "graph_id", F.col("node").cast("bigint").alias("node"), _lowest(F.col("_r")).alias("component"))


def component_stats(packed: DataFrame) -> DataFrame:
    rows = closed(packed)
    firsts = F.array_distinct(F.transform("reach", _lowest))
    biggest = F.array_max(F.transform("reach", _count))
    return rows.select(
        "graph_id", F.size(firsts).cast("bigint").alias("component_count"),
        (biggest.cast("double") / F.col("n")).alias("largest_component_fraction"))


def shortest_paths(packed: DataFrame) -> DataFrame:
    """Balls of growing radius; every pair still outside the ball adds one to its distance."""
    rows = closed(packed).withColumn("_sizes", F.transform("reach", _count)).withColumn(
        "_big", F.get("reach", (F.array_position("_sizes", F.array_max("_sizes")) - 1).cast("int")))
    whole = _count(F.col("_big"))
    masks = F.col("masks")
    shape = "struct<balls:array<bigint>,total:bigint,far:bigint>"
    start = F.struct(F.transform(masks, lambda m, i: _bit(i)).alias("balls"), _big(0).alias("total"), _big(0).alias("far")).cast(shape)

    def grow(state: Column, _level: Column) -> Column:
        balls = state["balls"]
        left = F.aggregate(_index(), _big(0), lambda a, i: a + F.when(
            _has(F.col("_big"), i), whole - _count(F.get(balls, i.cast("int")))).otherwise(_big(0)))
        wider = F.transform(balls, lambda ball, i: F.aggregate(_index(), ball, lambda a, j: F.when(
            _has(F.get(masks, i), j), a.bitwiseOR(F.get(balls, j.cast("int")))).otherwise(a)))
        step = F.struct(wider.alias("balls"), (state["total"] + left).alias("total"), (state["far"] + 1).alias("far")).cast(shape)
        return F.when(left > 0, step).otherwise(state)

    done = rows.withColumn("_w", whole).withColumn("_s", F.aggregate(_index(), start, grow))
    pairs = F.col("_w") * (F.col("_w") - 1)
    return done.select(
        "graph_id", F.try_divide(F.col("_s.total").cast("double"), F.nullif(pairs, _big(0))).alias("average_shortest_path_length"),
        F.when(pairs > 0, F.col("_s.far")).alias("diameter"))


SPECTRUM = ("spectral_radius", "adjacency_spectral_gap", "algebraic_connectivity", "laplacian_spectral_radius")
MOMENTS = ("a1", "a2", "a3", "l1", "l2")


def _solve(sizes: pd.Series, masks: pd.Series, width: int, reduce) -> np.ndarray:
    """Eigenvalues of all graphs of a batch, graphs of equal size stacked together."""
    out = np.full((len(sizes), width), np.nan)
    for n in np.unique(sizes.to_numpy()):
        rows = np.flatnonzero(sizes.to_numpy() == n)
        for part in np.array_split(rows, 1 + len(rows) * int(n) ** 2 // 4_000_000):
            packed = np.stack([np.asarray(masks.iat[i], dtype=np.int64) for i in part])
            a = ((packed[:, :, None] >> np.arange(n)) & 1).astype(float)
            lap = np.einsum("bi,ij->bij", a.sum(axis=2), np.eye(n)) - a
            out[part] = reduce(np.linalg.eigvalsh(a), np.linalg.eigvalsh(lap))
    return out


def _extremes(ea: np.ndarray, el: np.ndarray) -> np.ndarray:
    none = np.full(len(ea), np.nan)
    second = ea.shape[1] > 1
    return np.column_stack([ea[:, -1], ea[:, -1] - ea[:, -2] if second else none,
                            np.maximum(0.0, el[:, 1]) if second else none, el[:, -1]])


def _power_sums(ea: np.ndarray, el: np.ndarray) -> np.ndarray:
    return np.column_stack([ea.sum(1), (ea**2).sum(1), (ea**3).sum(1), el.sum(1), (el**2).sum(1)])


def _eigen(packed: DataFrame, names: tuple[str, ...], reduce) -> DataFrame:
    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def solve(sizes: pd.Series, masks: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(_solve(sizes, masks, len(names), reduce), columns=list(names))

    return packed.select("graph_id", solve("n", "masks").alias("_e")).select(
        "graph_id", *[F.nanvl(F.col(f"_e.{n}"), F.lit(None)).alias(n) for n in names])


def spectrum(packed: DataFrame) -> DataFrame:
    return _eigen(packed, SPECTRUM, _extremes)


def eigenvalue_moments(packed: DataFrame) -> DataFrame:
    return _eigen(packed, MOMENTS, _power_sums)
