"""Structure of many graphs at once, from an edge table (graph_id, u, v), u < v.

Vertices (graph_id, node) are given too, because isolated vertices count; the
nodes of a graph are numbered 0..n-1.  Neighbour sets are kept as bit masks in
blocks of 60 nodes, so that intersections and reachability are integer
operations on a few rows per vertex, whatever the graph size, and no operator
lists the pairs or wedges of a graph.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from selectra.functions.hashing import hash_int, hash_unit, row_hash
from selectra.operators import small_graphs as small
from selectra.operators.ranking import hash_rank
from selectra.session import materialise, spread

BITS = 60
MAX_EXACT_NODES = 20
CHUNK_BITS = 12


def _one() -> Column:
    return F.lit(1).cast("bigint")


def _bit(node) -> Column:
    n = F.col(node) if isinstance(node, str) else node
    return F.call_function("shiftleft", _one(), (n % BITS).cast("int"))


def _block(node) -> Column:
    n = F.col(node) if isinstance(node, str) else node
    return F.floor(n / BITS).cast("bigint")


def by_size(vertices: DataFrame, edges: DataFrame):
    """(vertices, edges) of the graphs that fit one row, and of the others or None.

    Nodes are numbered from 0, so a node number of 60 or more marks a big graph.
    """
    big = vertices.where(F.col("node") >= small.LIMIT).select("graph_id").distinct()
    if big.isEmpty():
        return (vertices, edges), None
    big = materialise(big)
    split = lambda how: (vertices.join(big, "graph_id", how), edges.join(big, "graph_id", how))
    return split("left_anti"), split("left_semi")


def _both(vertices: DataFrame, edges: DataFrame, of_packed, of_tables) -> DataFrame:
    """Packed rows for small graphs, joins for big ones."""
    few, many = by_size(vertices, edges)
    done = of_packed(small.pack(*few))
    return done if many is None else done.unionByName(of_tables(*many))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each undirected edge as two arcs, by a generator instead of a union."""
    arcs = F.array(F.struct(F.col("u").alias("a"), F.col("v").alias("b")),
                   F.struct(F.col("v").alias("a"), F.col("u").alias("b")))
    return edges.select("graph_id", F.inline(arcs))


#: other ends of a node's edges that lie in one part: a hub's edges are dealt by the part of their other end
PART_NODES = 4_096


def _part(node) -> Column:
    return F.floor((F.col(node) if isinstance(node, str) else node) / PART_NODES).cast("bigint")


def has_parts(nodes: DataFrame, node: str = "node") -> bool:
    """Whether any graph has more than one part. If none has, no node has more than ``PART_NODES`` edges."""
    return not nodes.where(F.col(node) >= PART_NODES).isEmpty()


def attach(rows: DataFrame, end: str, other: str, values: DataFrame, keys: Sequence[str] = (), parts: bool = True) -> DataFrame:
    """Rows with what ``values`` holds for their node ``end`` (and ``keys``), without a task that holds a hub's rows.

    ``values`` has columns graph_id, ``end``, the keys and others. It first meets the few parts in which the node has
    other ends, then the rows of each part. Without parts (``has_parts``) it meets the rows at once.
    """
    on = ["graph_id", end, *keys]
    if not parts:
        return rows.join(values, on)
    dealt = rows.withColumn("_part", _part(other))
    met = dealt.select(*on, "_part").distinct().join(values, on)
    return dealt.join(met, [*on, "_part"]).drop("_part")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Degree of every vertex, 0 for isolated ones."""
    counted = both_ways(edges).groupBy("graph_id", F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.join(counted, ["graph_id", "node"], "left").select(
        "graph_id", "node", F.coalesce("degree", F.lit(0)).alias("degree"))


def degree_stats(vertices: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Nodes, edges, density and the degree distribution, one row per graph; ``known`` are the degrees, if at hand.

    The degree sum is twice the edge count, so one aggregation gives both.
    """
    n, total = F.count(F.lit(1)), F.sum("degree")
    return (degrees(vertices, edges) if known is None else known).groupBy("graph_id").agg(
        n.alias("num_nodes"), (total / 2).cast("bigint").alias("num_edges"),
        F.when(n <= 1, F.lit(0.0)).otherwise(F.try_divide(total.cast("double"), n * (n - 1))).alias("density"),
        F.avg("degree").alias("average_degree"), F.stddev_pop("degree").alias("degree_std"),
        F.min("degree").cast("bigint").alias("min_degree"), F.max("degree").cast("bigint").alias("max_degree"))


def neighbour_masks(edges: DataFrame) -> DataFrame:
    """(graph_id, node, block, mask): the neighbours of a node, 60 per row."""
    return both_ways(edges).groupBy(
        "graph_id", F.col("a").alias("node"), _block("b").alias("block")).agg(F.bit_or(_bit("b")).alias("mask"))


def oriented(edges: DataFrame, parts: bool = True) -> DataFrame:
    """Each edge from the end of smaller degree (ties: smaller number) to the other, as (graph_id, a, b): nobody has
    more than about the square root of twice the edges before it, hubs have the fewest."""
    counted = both_ways(edges).withColumn("_part", _part("b")).groupBy("graph_id", "a", "_part").agg(
        F.count(F.lit(1)).alias("_c")).groupBy("graph_id", "a").agg(F.sum("_c").alias("degree"))
    of = lambda end, name: counted.select("graph_id", F.col("a").alias(end), F.col("degree").alias(name))
    sized = attach(attach(edges, "u", "v", of("u", "_du"), parts=parts), "v", "u", of("v", "_dv"), parts=parts)
    swap = F.struct("_du", "u") > F.struct("_dv", "v")
    return sized.select("graph_id", F.when(swap, F.col("v")).otherwise(F.col("u")).alias("a"),
                        F.when(swap, F.col("u")).otherwise(F.col("v")).alias("b"))


def _masks(arcs: DataFrame, node: str, other: str) -> DataFrame:
    return arcs.groupBy("graph_id", F.col(node).alias("node"), _block(other).alias("block")).agg(
        F.bit_or(_bit(other)).alias("mask"))


def node_triangles(edges: DataFrame, parts: bool = True) -> DataFrame:
    """Triangles through each node that has any.

    With edges pointing to higher degrees, a triangle has a first, a middle and a last node. Along a -> b, the common
    later nodes of both count the triangles in which a is first and b in the middle; those after a and before b count
    the triangles in which b is last. Only the later nodes of a, which are few, are met with the masks of b, and those
    of a hub b are dealt by the part of a.
    """
    arcs = materialise(oriented(edges, parts))
    later = materialise(_masks(arcs, "a", "b"))
    asked = materialise(attach(arcs, "a", "b", later.select("graph_id", F.col("node").alias("a"), "block", "mask"), parts=parts))

    def common(side: DataFrame, name: str) -> DataFrame:
        masks = side.select("graph_id", F.col("node").alias("b"), "block", F.col("mask").alias("_other"))
        met = attach(asked, "b", "a", masks, ["block"], parts)
        return met.select("graph_id", "a", "b", F.bit_count(F.col("mask").bitwiseAND(F.col("_other"))).cast("bigint").alias(name))

    inner = common(later, "_c").where("_c > 0")
    outer = common(_masks(arcs, "b", "a"), "_c").where("_c > 0")
    # part sums first: a hub is the end of very many edges
    of = lambda df, end, other: df.groupBy("graph_id", F.col(end).alias("node"), _part(other).alias("_p")).agg(
        F.sum("_c").alias("_c"))
    every = of(inner, "a", "b").unionByName(of(inner, "b", "a")).unionByName(of(outer, "b", "a"))
    return every.groupBy("graph_id", "node").agg(F.sum("_c").cast("bigint").alias("triangles"))


def clustering(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Triangles, their density, mean local clustering and transitivity per graph."""
    return _both(vertices, edges, small.clustering, clustering_by_joins)


def clustering_by_joins(vertices: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Triangles, their density, mean local clustering and transitivity per graph."""
    d = degrees(vertices, edges) if known is None else known
    t = d.join(node_triangles(edges, has_parts(vertices)), ["graph_id", "node"], "left").withColumn(
        "triangles", F.coalesce("triangles", F.lit(0)))
    pairs = F.col("degree") * (F.col("degree") - 1)
    local = F.when(F.col("degree") < 2, F.lit(0.0)).otherwise(F.try_divide(2.0 * F.col("triangles"), pairs))
    n = F.count(F.lit(1)).cast("double")
    count = (F.sum("triangles") / 3).cast("bigint")
    possible = F.greatest(F.lit(1.0), n * (n - 1) * (n - 2) / 6.0)
    return t.groupBy("graph_id").agg(
        count.alias("triangle_count"), (F.sum("triangles") / 3.0 / possible).alias("triangle_density"),
        F.avg(local).alias("average_clustering"),
        F.coalesce(F.try_divide(2.0 * F.sum("triangles"), F.sum(pairs)), F.lit(0.0)).alias("transitivity"))


def assortativity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Correlation of the end degrees over both edge directions, 0 if they do not vary."""
    return _both(vertices, edges, small.assortativity, assortativity_by_joins)


def assortativity_by_joins(vertices: DataFrame, edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Correlation of the end degrees over both edge directions, 0 if they do not vary.

    Moments of the ends follow from the degrees alone; only the product needs
    the edges.
    """
    d, parts = degrees(vertices, edges) if known is None else known, has_parts(vertices)
    du = d.select("graph_id", F.col("node").alias("u"), F.col("degree").alias("_du"))
    dv = d.select("graph_id", F.col("node").alias("v"), F.col("degree").alias("_dv"))
    products = attach(attach(edges, "u", "v", du, parts=parts), "v", "u", dv, parts=parts).groupBy("graph_id").agg(
        F.sum(F.col("_du") * F.col("_dv")).alias("_xy"))
    x = F.col("degree")
    moments = d.groupBy("graph_id").agg(
        F.sum(x).alias("_m"), F.sum(x * x).alias("_s1"), F.sum(x * x * x).alias("_s2"))
    # integer numerators: no cancellation, and a regular graph gives exactly zero variance
    cov = 2 * F.coalesce("_xy", F.lit(0)) * F.col("_m") - F.col("_s1") * F.col("_s1")
    var = F.col("_s2") * F.col("_m") - F.col("_s1") * F.col("_s1")
    return moments.join(products, "graph_id", "left").select(
        "graph_id", F.coalesce(F.try_divide(cov.cast("double"), var.cast("double")), F.lit(0.0))
        .alias("degree_assortativity"))


# Reachability -----------------------------------------------------------------------

def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, component): the smallest node reachable."""
    return _both(vertices, edges, small.components, components_by_joins)


def components_by_joins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for graphs of any size, by alternating stars.

    Edges point from the larger to the smaller node. A large star hangs every larger neighbour of a node on the smallest
    node around it, a small star every smaller one; both keep the components, and after about as many rounds as the
    logarithm of the longest path every node hangs on the smallest of its component. The centre of a giant component
    has as many edges as nodes; they are dealt by the part of their other end (``attach``).
    """
    links = materialise(edges.select("graph_id", F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).where("a > b"))
    seen, parts = _mark(links), has_parts(links, "a")
    while seen[0]:
        around = links.select("graph_id", "a", "b").unionByName(links.select("graph_id", F.col("b").alias("a"), F.col("a").alias("b")))
        large = materialise(attach(around, "a", "b", _smallest(around), parts=parts).where("b > a").select(
            "graph_id", F.col("b").alias("a"), F.least("a", "_m").alias("b")).distinct())
        small_ = attach(large, "a", "b", _smallest(large), parts=parts)
        hung = F.array(F.struct(F.col("b").alias("a"), F.col("_m").alias("b")), F.struct("a", F.col("_m").alias("b")))
        links = materialise(small_.select("graph_id", F.inline(hung)).where("a > b").distinct())
        now = _mark(links)
        if now == seen:
            break
        seen = now
    hung = links.select("graph_id", F.col("a").alias("node"), F.col("b").alias("component"))
    return vertices.select("graph_id", "node").join(hung, ["graph_id", "node"], "left").select(
        "graph_id", "node", F.coalesce("component", "node").alias("component"))


def _smallest(arcs: DataFrame) -> DataFrame:
    """The smallest other end of each node, over part minima."""
    parts = arcs.groupBy("graph_id", "a", _part("b").alias("_p")).agg(F.min("b").alias("_m"))
    return parts.groupBy("graph_id", "a").agg(F.min("_m").alias("_m"))


def _mark(links: DataFrame) -> tuple:
    """Number and checksum of the edges: equal marks, equal edges."""
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("graph_id", "a", "b")),
                           F.sum(F.xxhash64("a", "graph_id", "b") % 1_000_003)).first())


def component_stats(components: DataFrame) -> DataFrame:
    """Component count and share of the largest, per graph; the largest with the
    smallest label stands for ties."""
    sizes = components.groupBy("graph_id", "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("component_count"),
        F.try_divide(F.max("size").cast("double"), F.sum("size")).alias("largest_component_fraction"),
        (-F.max(F.struct("size", (-F.col("component")).alias("_n")))["_n"]).alias("largest_component"))


def components_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Component count and share of the largest component per graph."""
    return _both(vertices, edges, small.component_stats,
                 lambda v, e: component_stats(components_by_joins(v, e)).drop("largest_component"))


def shortest_paths(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean distance and diameter of the largest component of each graph."""
    return _both(vertices, edges, small.shortest_paths, paths_by_joins)


def paths_by_joins(vertices: DataFrame, edges: DataFrame, components: DataFrame | None = None,
                   rounds_per_check: int = 2) -> DataFrame:
    """The same for graphs of any size.

    Components of more than ``PART_NODES`` nodes whose paths mostly cross hubs are counted by their distances to the hubs
    (``_through_hubs``), which takes work in proportion to the graph. All others are searched from 60 sources at a time:
    a vertex carries one mask of the sources that reached it, so a level is one join with the edges and one ``bit_or``.
    Only counts per level leave the loop.  A component of one vertex has no distances and gives nulls.
    """
    comp = components_by_joins(vertices, edges) if components is None else components
    big = component_stats(comp).select("graph_id", F.col("largest_component").alias("component"))
    inside = materialise(comp.join(big, ["graph_id", "component"]).select("graph_id", "node"))
    arcs = materialise(both_ways(edges).join(
        inside.select("graph_id", F.col("node").alias("a")), ["graph_id", "a"], "left_semi"))
    totals = _through_hubs(inside, arcs)
    if totals is None:
        totals = _by_masks(inside, arcs, rounds_per_check)
    else:
        rest = [materialise(df.join(totals, "graph_id", "left_anti")) for df in (inside, arcs)]
        totals = totals.unionByName(_by_masks(*rest, rounds_per_check))
    return vertices.select("graph_id").distinct().join(totals, "graph_id", "left").select(
        "graph_id", F.try_divide(F.col("_d").cast("double"), F.nullif("_pairs", F.lit(0)))
        .alias("average_shortest_path_length"),
        F.when(F.col("_pairs") > 0, F.col("_far")).alias("diameter"))


def _by_masks(inside: DataFrame, arcs: DataFrame, rounds_per_check: int) -> DataFrame:
    """(graph_id, _pairs, _d, _far): pairs at a distance, the sum and the greatest of their distances."""
    key, parts = ["graph_id", "block", "node"], has_parts(inside)
    state = materialise(inside.select(
        "graph_id", _block("node").alias("block"), "node", _bit("node").alias("seen"), _bit("node").alias("front"),
        F.lit(0).cast("bigint").alias("reached"), F.lit(0).cast("bigint").alias("distance_sum"),
        F.lit(0).cast("bigint").alias("far")))
    level, running = 0, True
    while running:
        for _ in range(rounds_per_check):
            level += 1
            state = _bfs_level(state, arcs, key, level, parts)
        state = materialise(state)
        running = not state.where("front <> 0").isEmpty()
    return state.groupBy("graph_id").agg(
        F.sum("reached").alias("_pairs"), F.sum("distance_sum").alias("_d"), F.max("far").alias("_far"))


#: hubs of a component at most; groups over which the classes of a graph are dealt
HUBS, CLASS_GROUPS = 16, 8


def _through_hubs(inside: DataFrame, arcs: DataFrame) -> DataFrame | None:
    """The totals of ``_by_masks`` for the large components with hubs that this form suits, or None.

    Hubs have more neighbours than the root of the component's size. A shortest path that crosses a hub is as long as the
    least sum of both ends' distances to a hub. Nodes at the same distances to all hubs are one class, so these sums are
    counted by pairs of classes. Pairs with a shorter path around the hubs are found by a search without the hubs: what
    it reaches no earlier than through a hub needs no further steps, because no path beyond it is shorter either.
    Components with more than ``PART_NODES`` classes, or with more such pairs than rows of masks, are left out.
    """
    count, number = F.count(F.lit(1)), lambda v: F.lit(v).cast("bigint")
    sizes = materialise(inside.groupBy("graph_id").agg(count.alias("size")).where(F.col("size") > PART_NODES))
    if sizes.isEmpty():
        return None
    mine = arcs.join(sizes, "graph_id")
    degree = mine.groupBy("graph_id", "size", "a", _part("b").alias("_p")).agg(count.alias("_c")).groupBy(
        "graph_id", "size", "a").agg(F.sum("_c").alias("_c")).where(F.col("_c") * F.col("_c") > F.col("size"))
    order = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("_c"), "a"))
    hubs = materialise(degree.select("graph_id", F.col("a").alias("source"), order.alias("i")).where(F.col("i") <= HUBS))
    if hubs.isEmpty():
        return None
    mine = arcs.join(hubs.select("graph_id").distinct(), "graph_id", "left_semi")
    to_hubs = _search(hubs.select("graph_id", "source"), mine).join(hubs, ["graph_id", "source"])
    profiles = materialise(to_hubs.groupBy("graph_id", "node").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "d"))), lambda x: x["d"]).alias("profile")))
    classes = materialise(profiles.groupBy("graph_id", "profile").agg(count.alias("n")))
    load = materialise(classes.groupBy("graph_id").agg(count.alias("_k")).where(F.col("_k") <= PART_NODES)
                       .join(sizes, "graph_id").select("graph_id", "size", number(0).alias("rows")))
    if load.isEmpty():
        return None
    via = lambda a, b: F.array_min(F.zip_with(a, b, lambda x, y: x + y))
    outside = lambda end: hubs.select("graph_id", F.col("source").alias(end))
    inner = materialise(mine.join(load, "graph_id", "left_semi").join(outside("a"), ["graph_id", "a"], "left_anti").join(
        outside("b"), ["graph_id", "b"], "left_anti").select("graph_id", "a", "b"))
    front = materialise(profiles.join(load, "graph_id", "left_semi").join(outside("node"), ["graph_id", "node"], "left_anti").select(
        "graph_id", F.col("node").alias("source"), "node", number(0).alias("d"), F.col("profile").alias("own"),
        number(0).alias("via")))
    levels = [front.limit(0), front]
    while not levels[-1].isEmpty():
        came = attach(inner, "a", "b", levels[-1].select("graph_id", "source", F.col("node").alias("a"), "d", "own")).select(
            "graph_id", "source", F.col("b").alias("node"), (F.col("d") + 1).alias("d"), "own").distinct()
        nearer = came.join(profiles, ["graph_id", "node"]).withColumn("via", via(F.col("own"), F.col("profile"))).where("d < via")
        known = levels[-1].unionByName(levels[-2])  # a neighbour is at most one level away
        fresh = materialise(nearer.drop("profile").join(known, ["graph_id", "source", "node"], "left_anti"))
        load = materialise(load.join(fresh.groupBy("graph_id").agg(count.alias("_c")), "graph_id", "left").select(
            "graph_id", "size", (F.col("rows") + F.coalesce("_c", number(0))).alias("rows")).where(
            F.col("rows") * BITS <= F.col("size") * F.col("size")))
        levels.append(fresh.join(load, "graph_id", "left_semi"))
    kept = classes.join(load, "graph_id", "left_semi").withColumn("_g", F.pmod(F.xxhash64("profile"), number(CLASS_GROUPS)))
    groups = F.explode(F.sequence(number(0), number(CLASS_GROUPS - 1)))
    left = kept.select("graph_id", F.col("profile").alias("_p"), F.col("n").alias("_n"), F.col("_g").alias("_x"), groups.alias("_y"))
    right = kept.select("graph_id", "profile", "n", F.col("_g").alias("_y"), groups.alias("_x"))
    others = F.col("n") - F.when(F.col("_p") == F.col("profile"), 1).otherwise(0)  # a node is no pair with itself
    crossing = left.join(right, ["graph_id", "_x", "_y"]).select(
        "graph_id", via(F.col("_p"), F.col("profile")).alias("d"), (F.col("_n") * others).alias("n"))
    around = reduce(DataFrame.unionByName, levels[2:]).join(load, "graph_id", "left_semi").select("graph_id", F.inline(F.array(
        F.struct(F.col("via").alias("d"), number(-1).alias("n")), F.struct("d", number(1).alias("n")))))
    counts = crossing.unionByName(around).groupBy("graph_id", "d").agg(F.sum("n").alias("n")).where("n > 0")
    return materialise(counts.groupBy("graph_id").agg(
        F.sum("n").alias("_pairs"), F.sum(F.col("d") * F.col("n")).alias("_d"), F.max("d").alias("_far")))


def _bfs_level(state: DataFrame, arcs: DataFrame, key: list[str], level: int, parts: bool) -> DataFrame:
    moving = state.where("front <> 0").select("graph_id", "block", F.col("node").alias("a"), "front")
    came = attach(arcs, "a", "b", moving, parts=parts).groupBy(
        "graph_id", "block", F.col("b").alias("node")).agg(F.bit_or("front").alias("came"))
    joined = state.join(came, key, "full_outer")
    zero = F.lit(0).cast("bigint")
    seen = F.coalesce("seen", zero)
    fresh = F.coalesce("came", zero).bitwiseAND(F.bitwise_not(seen))
    gained = F.bit_count(fresh).cast("bigint")
    return joined.select(
        *key, seen.bitwiseOR(fresh).alias("seen"), fresh.alias("front"),
        (F.coalesce("reached", zero) + gained).alias("reached"),
        (F.coalesce("distance_sum", zero) + gained * F.lit(level)).alias("distance_sum"),
        F.when(gained > 0, F.lit(level).cast("bigint")).otherwise(F.coalesce("far", zero)).alias("far"))


def diameters(vertices: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(graph_id, diameter, searches) of the largest component by few searches.

    A search from v gives every node w at distance d an eccentricity of at least max(d, ecc(v) - d) and at most
    ecc(v) + d. All graphs search at once, each from the nodes that may lie farthest out (twice as many every round) and
    from the one that may lie most central; a graph is done when no upper bound exceeds the largest distance seen. A
    component of one node has a null diameter.
    """
    comp = components_by_joins(vertices, edges) if components is None else components
    big = component_stats(comp).select("graph_id", F.col("largest_component").alias("component"))
    inside = comp.join(big, ["graph_id", "component"]).select("graph_id", "node")
    arcs = materialise(both_ways(edges).join(
        inside.select("graph_id", F.col("node").alias("a")), ["graph_id", "a"], "left_semi"))
    number = lambda v: F.lit(v).cast("bigint")
    bounds = materialise(inside.withColumn("low", number(0)).withColumn("high", F.lit(None).cast("bigint")))
    graphs_ = bounds.groupBy("graph_id").agg(F.count(F.lit(1)).alias("size"))
    found = graphs_.select("graph_id", "size", number(0).alias("searches"), number(0).alias("best"))
    found = materialise(found)
    todo, together = found.where("size > 1").select("graph_id"), 1
    while not todo.isEmpty():
        open_ = bounds.join(todo, "graph_id")
        outer = Window.partitionBy("graph_id").orderBy(F.desc_nulls_first("high"), "low", "node")
        inner = Window.partitionBy("graph_id").orderBy("low", F.asc_nulls_last("high"), "node")
        picked = open_.select("graph_id", "node", F.row_number().over(outer).alias("_o"), F.row_number().over(inner).alias(
            "_i")).where((F.col("_o") <= together) | (F.col("_i") == 1)).select("graph_id", F.col("node").alias("source"))
        together *= 2
        distances = _search(picked, arcs)
        reach = distances.groupBy("graph_id", "source").agg(F.max("d").alias("_e"))
        told = distances.join(reach, ["graph_id", "source"]).groupBy("graph_id", "node").agg(
            F.max(F.greatest("d", F.col("_e") - F.col("d"))).alias("_low"), F.min(F.col("_e") + F.col("d")).alias("_high"))
        bounds = materialise(bounds.join(told, ["graph_id", "node"], "left").select(
            "graph_id", "node", F.greatest("low", "_low").alias("low"), F.least("high", "_high").alias("high")))
        gain = reach.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_e").alias("_m"))
        found = materialise(found.join(gain, "graph_id", "left").select(
            "graph_id", "size", (F.col("searches") + F.coalesce("_n", number(0))).alias("searches"),
            F.greatest("best", "_m").alias("best")))
        widest = bounds.groupBy("graph_id").agg(F.max("high").alias("_h"))
        todo = materialise(found.join(widest, "graph_id").where("size > 1 AND _h > best").select("graph_id"))
    return vertices.select("graph_id").distinct().join(found, "graph_id", "left").select(
        "graph_id", F.when(F.col("size") > 1, F.col("best")).alias("diameter"), "searches")


def _search(sources: DataFrame, arcs: DataFrame) -> DataFrame:
    """(graph_id, source, node, d): breadth-first distances from each source."""
    front = materialise(sources.select("graph_id", "source", F.col("source").alias("node"), F.lit(0).cast("bigint").alias("d")))
    levels = [front.limit(0), front]
    while not levels[-1].isEmpty():
        came = attach(arcs, "a", "b", levels[-1].withColumnRenamed("node", "a")).select(
            "graph_id", "source", F.col("b").alias("node"), (F.col("d") + 1).alias("d")).distinct()
        known = levels[-1].unionByName(levels[-2])  # a neighbour is at most one level away
        levels.append(materialise(came.join(known, ["graph_id", "source", "node"], "left_anti")))
    return reduce(DataFrame.unionByName, levels[1:-1])


# Spectra ------------------------------------------------------------------------------

def spectrum(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Extreme eigenvalues of adjacency and Laplacian, per graph.

    Small graphs are solved densely, many at a time; big ones by distributed
    subspace iteration, so that no group ever grows with the data.
    """
    return _both(vertices, edges, small.spectrum, iterative_spectrum)


def eigenvalue_moments(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Power sums of all adjacency and Laplacian eigenvalues of each graph.

    The sums count edges, triangles and squared degrees, which is how big graphs
    get them, and what checks the decomposition of the small ones.
    """
    return _both(vertices, edges, small.eigenvalue_moments, moments_by_counting)


def moments_by_counting(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    d = degrees(vertices, edges).join(node_triangles(edges), ["graph_id", "node"], "left")
    x, tri = F.col("degree").cast("double"), F.coalesce("triangles", F.lit(0)).cast("double")
    return d.groupBy("graph_id").agg(
        F.lit(0.0).alias("a1"), F.sum(x).alias("a2"), F.sum(2 * tri).alias("a3"), F.sum(x).alias("l1"),
        F.sum(x * x + x).alias("l2"))


def iterative_spectrum(vertices: DataFrame, edges: DataFrame, tolerance: float = 1e-9,
                       max_rounds: int = 5000, rounds_per_check: int = 5) -> DataFrame:
    """The same four values by shifted power iteration in DataFrames.

    Four vectors per vertex advance together: x1, x2 under A + (c/2 + 1)I (x2
    kept orthogonal to x1), y under L - (c+1)/2 I, z under min(2c, n)I - L kept
    orthogonal to the constant vector; c is the largest degree of the graph.  As
    c + 1 <= largest Laplacian eigenvalue <= min(2c, n), the shifts put the wanted
    eigenvalues on top.  Vectors are made orthogonal
    again after every few rounds.  A round is
    one join with the edges plus two small per-graph sums.
    """
    d = degrees(vertices, edges)
    tops = d.groupBy("graph_id").agg(F.max("degree").cast("double").alias("c"), F.count(F.lit(1)).alias("n"))
    arcs = materialise(both_ways(edges))
    start = lambda s: hash_unit(row_hash(s, "graph_id", "node")) - 0.5
    state = materialise(_normalised(d.join(tops, "graph_id").select(
        "graph_id", "node", "degree", "c", "n", (start("x1") + 1.0).alias("x1"), start("x2").alias("x2"),
        start("y").alias("y"), start("z").alias("z"))))
    last = None
    for _ in range(0, max_rounds, rounds_per_check):
        for _ in range(rounds_per_check):
            state = materialise(_advance(state, arcs))
        state = materialise(_normalised(state))
        values = materialise(_rayleigh(state, arcs))
        if last is not None:
            moved = values.join(last.toDF("graph_id", *[f"_{c}" for c in values.columns[1:]]), "graph_id").where(
                " or ".join(f"abs({c} - _{c}) > {tolerance}" for c in values.columns[1:]))
            if moved.isEmpty():
                return values
        last = values
    raise RuntimeError("subspace iteration did not converge")


def _sums_of_neighbours(state: DataFrame, arcs: DataFrame) -> DataFrame:
    far = state.select("graph_id", F.col("node").alias("b"), "x1", "x2", "y", "z")
    near = arcs.join(far, ["graph_id", "b"]).groupBy("graph_id", F.col("a").alias("node")).agg(
        *[F.sum(c).alias(f"n_{c}") for c in ("x1", "x2", "y", "z")])
    return state.join(near, ["graph_id", "node"], "left").na.fill(0.0, ["n_x1", "n_x2", "n_y", "n_z"])


def _advance(state: DataFrame, arcs: DataFrame) -> DataFrame:
    s = _sums_of_neighbours(state, arcs)
    shift = F.col("c") / 2 + 1
    lap = lambda v: F.col("degree") * F.col(v) - F.col(f"n_{v}")
    return s.select(
        "graph_id", "node", "degree", "c", "n",
        (F.col("n_x1") + shift * F.col("x1")).alias("x1"),
        (F.col("n_x2") + shift * F.col("x2")).alias("x2"),
        (lap("y") - (F.col("c") + 1) / 2 * F.col("y")).alias("y"),
        (F.least(2 * F.col("c"), F.col("n")) * F.col("z") - lap("z")).alias("z"))


def _normalised(state: DataFrame) -> DataFrame:
    first = state.groupBy("graph_id").agg(
        F.sum(F.col("x1") * F.col("x1")).alias("_11"), F.sum(F.col("x1") * F.col("x2")).alias("_12"),
        F.sum(F.col("x2") * F.col("x2")).alias("_22"), F.sum(F.col("y") * F.col("y")).alias("_yy"),
        F.sum("z").alias("_z"), F.sum(F.col("z") * F.col("z")).alias("_zz"))
    j = state.join(first, "graph_id")
    unit = lambda v, sq: F.coalesce(F.try_divide(v, F.sqrt(F.greatest(sq, F.lit(0.0)))), F.lit(0.0))
    proj = F.coalesce(F.try_divide(F.col("_12"), F.col("_11")), F.lit(0.0))
    mean = F.col("_z") / F.col("n")
    return j.select(
        "graph_id", "node", "degree", "c", "n", unit(F.col("x1"), F.col("_11")).alias("x1"),
        unit(F.col("x2") - proj * F.col("x1"), F.col("_22") - proj * F.col("_12")).alias("x2"),
        unit(F.col("y"), F.col("_yy")).alias("y"),
        unit(F.col("z") - mean, F.col("_zz") - mean * F.col("_z")).alias("z"))


def _rayleigh(state: DataFrame, arcs: DataFrame) -> DataFrame:
    s = _sums_of_neighbours(state, arcs)
    dot = lambda v, w: F.sum(F.col(v) * w)
    sq = lambda v: F.nullif(F.sum(F.col(v) * F.col(v)), F.lit(0.0))
    lap = lambda v: F.col("degree") * F.col(v) - F.col(f"n_{v}")
    l1 = F.coalesce(F.try_divide(dot("x1", F.col("n_x1")), sq("x1")), F.lit(0.0))
    l2 = F.coalesce(F.try_divide(dot("x2", F.col("n_x2")), sq("x2")), F.lit(0.0))
    return s.groupBy("graph_id").agg(
        l1.alias("spectral_radius"), (l1 - l2).alias("adjacency_spectral_gap"),
        F.greatest(F.lit(0.0), F.coalesce(F.try_divide(dot("z", lap("z")), sq("z")), F.lit(0.0))).alias("algebraic_connectivity"),
        F.coalesce(F.try_divide(dot("y", lap("y")), sq("y")), F.lit(0.0)).alias("laplacian_spectral_radius"))


# Cuts -----------------------------------------------------------------------------------

def cut_value(vertices: DataFrame, edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Crossing edges per graph for explicit labels (graph_id, node, side).

    Every graph with a vertex has a row, without edges as well.  Edges and
    nodes without a label, or with one outside 0/1, are reported.
    """
    u = labels.select("graph_id", F.col("node").alias("u"), F.col("side").alias("_a"))
    v = labels.select("graph_id", F.col("node").alias("v"), F.col("side").alias("_b"))
    joined = edges.join(u, ["graph_id", "u"], "left").join(v, ["graph_id", "v"], "left")
    good = lambda c: F.coalesce(F.col(c).isin(0, 1), F.lit(False))
    crossing = joined.groupBy("graph_id").agg(
        F.count_if(F.col("_a") != F.col("_b")).alias("cut"),
        F.count_if(~(good("_a") & good("_b"))).alias("invalid_edges"))
    nodes = vertices.join(labels.select("graph_id", "node", "side"), ["graph_id", "node"], "left").groupBy(
        "graph_id").agg(F.count_if(~good("side")).alias("invalid_nodes"))
    return nodes.join(crossing, "graph_id", "left").select(
        "graph_id", F.coalesce("cut", F.lit(0)).alias("cut"),
        F.coalesce("invalid_edges", F.lit(0)).alias("invalid_edges"), "invalid_nodes")


def mask_cut(edges: DataFrame, masks: DataFrame) -> DataFrame:
    """Crossing edges of many labellings given as masks (graph_id, mask, ...).

    The edges of a graph ride along as one array, which is short because a mask
    labels 63 nodes at most; an edge beyond them is an error.  A graph without
    edges has cut 0.
    """
    beyond = F.concat(F.lit("a mask labels nodes 0 to 62, found "), F.col("v").cast("string"))
    checked = F.when((F.col("u") < 0) | (F.col("v") > 62), F.raise_error(beyond).cast("int")).otherwise(F.col("v").cast("int"))
    lists = edges.groupBy("graph_id").agg(F.collect_list(F.struct(F.col("u").cast("int").alias("u"), checked.alias("v"))).alias("_edges"))
    rest = [c for c in masks.columns if c != "graph_id"]
    bit = lambda end: F.call_function("shiftright", F.col("mask"), end).bitwiseAND(_one())
    crossing = F.size(F.filter("_edges", lambda e: bit(e["u"]) != bit(e["v"])))
    return masks.join(lists, "graph_id", "left").select(
        "graph_id", *rest, F.when(F.col("_edges").isNull(), F.lit(0)).otherwise(crossing).cast("bigint").alias("cut"))


def label_blocks(sides: DataFrame) -> DataFrame:
    """Labellings (graph_id, label, node, side 0/1) as blocks of 60 bits: (graph_id, label, block, bits)."""
    one = F.when(F.col("side") == 1, _bit("node")).otherwise(F.lit(0).cast("bigint"))
    return sides.groupBy("graph_id", "label", _block("node").alias("block")).agg(F.bit_or(one).alias("bits"))


def block_cut(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(graph_id, label, cut): crossing edges of labellings given as blocks, for graphs of any size.

    Edges between the same two blocks ride along as one array (at most 3,600), and meet only those two blocks of a
    labelling. A node without a bit is on side 0, a graph without edges has cut 0.
    """
    ends = F.struct((F.col("u") % BITS).cast("int").alias("u"), (F.col("v") % BITS).cast("int").alias("v"))
    lists = edges.groupBy("graph_id", _block("u").alias("_a"), _block("v").alias("_b")).agg(F.collect_list(ends).alias("_edges"))
    every = blocks.select("graph_id", "label").distinct()
    side = lambda b, bits: blocks.select("graph_id", "label", F.col("block").alias(b), F.col("bits").alias(bits))
    asked = every.join(lists, "graph_id").join(side("_a", "_x"), ["graph_id", "label", "_a"], "left").join(
        side("_b", "_y"), ["graph_id", "label", "_b"], "left").na.fill(0, ["_x", "_y"])
    bit = lambda bits, end: F.call_function("shiftright", F.col(bits), end).bitwiseAND(_one())
    crossing = F.size(F.filter("_edges", lambda e: bit("_x", e["u"]) != bit("_y", e["v"]))).cast("bigint")
    cuts = asked.groupBy("graph_id", "label").agg(F.sum(crossing).alias("cut"))
    return every.join(cuts, ["graph_id", "label"], "left").na.fill(0, ["cut"])


def adjacency_rows(edges: DataFrame, nodes: int = MAX_EXACT_NODES) -> DataFrame:
    """One row per graph: column a<k> is the mask of the larger neighbours of node k."""
    bit = F.call_function("shiftleft", _one(), F.col("v").cast("int"))
    return edges.groupBy("graph_id").agg(*[
        F.coalesce(F.bit_or(F.when(F.col("u") == k, bit)), F.lit(0).cast("bigint")).alias(f"a{k}")
        for k in range(nodes)])


def _cut_of(mask: str, nodes: int = MAX_EXACT_NODES) -> Column:
    """Per node, neighbours on the other side; unrolled so that it is compiled."""
    total = F.lit(0)
    m = F.col(mask)
    for k in range(nodes):
        own = F.call_function("shiftright", m, F.lit(k)).bitwiseAND(_one()) == 1
        other = F.when(own, F.bitwise_not(m)).otherwise(m)
        total = total + F.bit_count(F.col(f"a{k}").bitwiseAND(other))
    return total.cast("bigint")


def exact_maxcut(vertices: DataFrame, edges: DataFrame, max_nodes: int = MAX_EXACT_NODES) -> DataFrame:
    """Best cut of every graph by enumerating the 2^(n-1) sides with node 0 fixed.

    Larger graphs than ``max_nodes`` are an error, as the work is exponential.
    The enumeration is a generator and the best is a map-side maximum, so a
    graph sends one row into the shuffle per task.
    """
    sizes = vertices.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    message = F.concat(F.lit("exact cut is limited, found nodes: "), F.col("n").cast("string"))
    guarded = sizes.where(F.when(F.col("n") > max_nodes, F.raise_error(message).cast("boolean")).otherwise(True))
    wide = guarded.join(adjacency_rows(edges, max_nodes), "graph_id", "left").na.fill(0)
    # (high bits) spread over the tasks, then (low bits) enumerated where they land
    low = F.least(F.col("n") - 1, F.lit(CHUNK_BITS)).cast("int")
    upto = lambda bits: F.sequence(F.lit(0).cast("bigint"), F.call_function("shiftleft", _one(), bits.cast("int")) - 1)
    chunks = spread(wide.withColumn("_low", low).withColumn("_hi", F.explode(upto(F.col("n") - 1 - F.col("_low")))))
    sides = chunks.withColumn("_lo", F.explode(upto(F.col("_low")))).withColumn(
        "mask", F.call_function("shiftleft", F.call_function("shiftleft", F.col("_hi"), F.col("_low")) + F.col("_lo"), F.lit(1)))
    best = F.max(F.struct(_cut_of("mask", max_nodes).alias("cut"), (-F.col("mask")).alias("_neg"))).alias("_best")
    return sides.groupBy("graph_id").agg(best).select(
        "graph_id", F.col("_best.cut").alias("optimum"), (-F.col("_best._neg")).alias("best_mask"))


# Seeded graphs ----------------------------------------------------------------------------

def random_edges(specs: DataFrame, probability: str = "probability", seed: str = "seed") -> DataFrame:
    """Independent edges for specs (graph_id, num_nodes, probability, seed).

    Each pair draws its own hash; only accepted partners leave the row.  A graph
    of one node has no pairs.
    """
    rows = specs.where(F.col("num_nodes") >= 2).withColumn(
        "u", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_nodes") - 2)))
    later = F.sequence(F.col("u") + 1, F.col("num_nodes") - 1)
    hit = F.filter(later, lambda v: hash_unit(F.md5(F.concat_ws(
        "|", F.col(seed).cast("string"), F.col("u").cast("string"), v.cast("string")).cast("binary"))) < F.col(probability))
    return rows.select("graph_id", "u", F.explode(hit).alias("v"))


def regular_edges(specs: DataFrame, degree: int = 4, seed: str = "seed", rounds: int = 4) -> DataFrame:
    """A simple ``degree``-regular graph per spec (graph_id, num_nodes, seed): a circulant, then rounds of seeded edge
    switches (``switched``), by which every regular graph can come out."""
    start = circulant_edges(specs, degree, seed)
    return switched(start, specs.select("graph_id", F.col(seed).alias("_seed")), rounds)


def switched(edges: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """Random switches that keep every degree: two edges a-b, c-d become a-d, c-b or a-c, b-d.

    A round pairs all edges of a graph in seeded order and carries out, at once, the switches that stay clear of loops,
    of the round's edges and of each other. ``seeds`` has a row (graph_id, _seed) per graph.

    Every side has rows in proportion to the graphs. Estimates from the scan take them for few, because they lie below
    generators; the joins are merges, so that no side is gathered in the driver.
    """
    seeds = seeds.hint("merge")
    for r in range(rounds):
        edges = materialise(edges)
        label = lambda role: F.concat_ws("|", F.col("_seed").cast("string"), F.lit(role), F.lit(str(r)))
        placed = hash_rank(edges.join(seeds, "graph_id"), ["u", "v"], label("pair"), ["graph_id"], "_pos", "_n")
        pairs = placed.groupBy("graph_id", F.floor((F.col("_pos") - 1) / 2).cast("bigint").alias("_k")).agg(
            F.count(F.lit(1)).alias("_c"), F.first("_seed").alias("_seed"),
            F.min(F.struct("_pos", "u", "v")).alias("_e"), F.max(F.struct("_pos", "u", "v")).alias("_f"))
        across = hash_int(row_hash(label("way"), "_k")) % 2 == 0
        a, b, c, d = (F.col(x) for x in ("_e.u", "_e.v", "_f.u", "_f.v"))
        edge = lambda x, y: F.struct(F.least(x, y).alias("u"), F.greatest(x, y).alias("v"))
        one = F.when(across, edge(a, d)).otherwise(edge(a, c))
        two = F.when(across, edge(c, b)).otherwise(edge(b, d))
        asked = materialise(pairs.select("graph_id", "_k", "_e", "_f", "_c", one.alias("_x"), two.alias("_y")).withColumn(
            "_fit", (F.col("_c") == 2) & (F.col("_x.u") < F.col("_x.v")) & (F.col("_y.u") < F.col("_y.v")) & (F.col("_x") != F.col("_y"))))
        fresh = asked.where("_fit").select("graph_id", "_k", F.explode(F.array("_x", "_y")).alias("_s")).select("graph_id", "_k", "_s.u", "_s.v")
        taken = fresh.join(edges.hint("merge"), ["graph_id", "u", "v"], "left_semi").select("graph_id", "_k")
        twice = fresh.groupBy("graph_id", "u", "v").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
        clash = fresh.join(twice.hint("merge"), ["graph_id", "u", "v"], "left_semi").select("graph_id", "_k")
        bad = taken.unionByName(clash).distinct().withColumn("_bad", F.lit(True))
        moved = asked.join(bad.hint("merge"), ["graph_id", "_k"], "left").withColumn("_go", F.col("_fit") & F.col("_bad").isNull())
        pick = lambda new, old: F.when(F.col("_go"), F.struct(f"{new}.u", f"{new}.v")).otherwise(F.struct(f"{old}.u", f"{old}.v"))
        both = F.when(F.col("_c") == 2, F.array(pick("_x", "_e"), pick("_y", "_f"))).otherwise(F.array(F.struct("_e.u", "_e.v")))
        edges = moved.select("graph_id", F.explode(both).alias("_s")).select("graph_id", "_s.u", "_s.v")
    return edges


def circulant_edges(specs: DataFrame, degree: int = 4, seed: str = "seed") -> DataFrame:
    """A circulant per spec, the start of the switches.

    The nodes stand on a circle in seeded order; each meets those at degree/2
    consecutive distances from a seeded one on, and the opposite one when the
    degree is odd.  This works for every degree below the node count with an
    even product of both; other specs are an error.
    """
    n = F.col("num_nodes")
    wrong = F.concat(F.lit(f"no graph of degree {degree} has this many nodes: "), n.cast("string"))
    fits = (n > degree) & (n * degree % 2 == 0)
    ok = specs.select("graph_id", "num_nodes", F.col(seed).alias("_seed")).where(
        F.when(~fits, F.raise_error(wrong).cast("boolean")).otherwise(True))
    nodes = ok.withColumn("node", F.explode(F.sequence(F.lit(0).cast("bigint"), n - 1)))
    placed = hash_rank(nodes, "node", F.col("_seed"), ["graph_id"], "_pos", "_n")
    distances = F.floor((n - 1) / 2).cast("bigint")
    first = hash_int(row_hash(F.col("_seed"), F.lit("distance")))
    steps = F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(max(degree // 2 - 1, 0)).cast("bigint")),
                        lambda j: 1 + (first + j) % distances) if degree > 1 else F.array().cast("array<bigint>")
    if degree % 2:  # each pair of opposite nodes once
        steps = F.when(F.col("_pos") <= n / 2, F.concat(steps, F.array((n / 2).cast("bigint")))).otherwise(steps)
    arcs = placed.withColumn("_step", F.explode(steps)).withColumn("_at", (F.col("_pos") - 1 + F.col("_step")) % n)
    ends = placed.select("graph_id", F.col("node").alias("_other"), (F.col("_pos") - 1).alias("_at"))
    return arcs.join(ends.hint("merge"), ["graph_id", "_at"]).select(
        "graph_id", F.least("node", "_other").alias("u"), F.greatest("node", "_other").alias("v"))


def _joined_features(vertices: DataFrame, edges: DataFrame, parts: list[DataFrame], known: DataFrame | None = None) -> DataFrame:
    features = degree_stats(vertices, edges, known)
    for part in parts:
        features = features.join(part, "graph_id")
    return features


def structure_by_joins(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """All structural features without spectra by the joins that any graph size allows."""
    vertices, edges = materialise(vertices), materialise(edges)  # every part reads them
    labels, known = materialise(components_by_joins(vertices, edges)), materialise(degrees(vertices, edges))
    return _joined_features(vertices, edges, [
        clustering_by_joins(vertices, edges, known), assortativity_by_joins(vertices, edges, known),
        component_stats(labels).drop("largest_component"), paths_by_joins(vertices, edges, labels)], known)


def graph_structure(vertices: DataFrame, edges: DataFrame, spectra: bool = False) -> DataFrame:
    """All structural features, one row per graph, with the spectral ones on request.

    Small graphs are packed once, so the parts meet on one partitioning.
    """
    few, many = by_size(vertices, edges)
    packed = materialise(small.pack(*few))
    parts = [small.clustering(packed), small.assortativity(packed), small.component_stats(packed),
             small.shortest_paths(packed)] + ([small.spectrum(packed)] if spectra else [])
    if many is not None:
        labels = components_by_joins(*many)
        more = [clustering_by_joins(*many), assortativity_by_joins(*many),
                component_stats(labels).drop("largest_component"), paths_by_joins(*many, labels)]
        more += [iterative_spectrum(*many)] if spectra else []
        parts = [a.unionByName(b) for a, b in zip(parts, more)]
    return _joined_features(vertices, edges, parts)


def graph_features(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """All structural features and the spectral ones."""
    return graph_structure(vertices, edges, spectra=True)


def edge_count_mismatch(edges: DataFrame, declared: DataFrame, column: str = "num_edges") -> DataFrame:
    """Graphs whose recomputed edge count differs from the manifest."""
    counted = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("recomputed"))
    both = declared.select("graph_id", F.col(column).alias("declared")).join(counted, "graph_id", "left")
    return both.withColumn("recomputed", F.coalesce("recomputed", F.lit(0))).where("declared <> recomputed")

