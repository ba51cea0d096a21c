"""Registered queries on graphs: structure, reachability, spectra, cuts, generators."""

from __future__ import annotations

from pyspark.sql import functions as F

from selectra.operators import aggregates, graphs
from selectra.plans.bindings import CUT_NODES, Tables, sql
from selectra.plans.catalog import SQL, query
from selectra.plans.shaping import rounded, rounded_sql


def n_rows():
    return F.count(F.lit(1))


_BASIC = """SELECT graph_id, count(*) AS num_nodes, CAST(sum(degree) // 2 AS BIGINT) AS num_edges,
    CAST(sum(degree) AS DOUBLE) / (count(*) * (count(*) - 1)) AS density, avg(degree) AS average_degree,
    stddev_pop(degree) AS degree_std, min(degree) AS min_degree, max(degree) AS max_degree FROM degrees GROUP BY ALL"""


@query("graph_basic", rounded_sql(sql(f"SELECT graph_id, num_nodes, num_edges, density, average_degree FROM ({_BASIC})", "degrees"),
                                  "density average_degree"))
def _(t: Tables):
    return rounded(graphs.degree_stats(t.vertices(), t.edges()).select(
        "graph_id", "num_nodes", "num_edges", "density", "average_degree"))


@query("agg_degree_stats", rounded_sql(sql(_BASIC, "degrees"), "density average_degree degree_std"))
def _(t: Tables):
    return rounded(graphs.degree_stats(t.vertices(), t.edges()))


@query("triangle_count", sql("""
    SELECT v.graph_id, count(x) AS triangle_count FROM (SELECT DISTINCT graph_id FROM vertices) v
    LEFT JOIN corners c USING (graph_id) GROUP BY ALL""", "vertices", "corners"))
def _(t: Tables):
    return graphs.clustering(t.vertices(), t.edges()).select("graph_id", "triangle_count")


@query("triangle_density", rounded_sql(sql("""
    SELECT graph_id, sum(triangles) / 3.0::DOUBLE / greatest(1, 12 * 11 * 10 / 6) AS triangle_density FROM node_triangles GROUP BY ALL""",
    "node_triangles"), "triangle_density"))
def _(t: Tables):
    return rounded(graphs.clustering(t.vertices(), t.edges()).select("graph_id", "triangle_density"))


@query("local_clustering_avg", rounded_sql(sql("""
    SELECT graph_id, avg(CASE WHEN degree < 2 THEN 0 ELSE 2.0::DOUBLE * triangles / (degree * (degree - 1)) END) AS average_clustering
    FROM node_triangles GROUP BY ALL""", "node_triangles"), "average_clustering"))
def _(t: Tables):
    return rounded(graphs.clustering(t.vertices(), t.edges()).select("graph_id", "average_clustering"))


@query("transitivity", rounded_sql(sql("""
    SELECT graph_id, coalesce(2.0::DOUBLE * sum(triangles) / nullif(sum(degree * (degree - 1)), 0), 0) AS transitivity
    FROM node_triangles GROUP BY ALL""", "node_triangles"), "transitivity"))
def _(t: Tables):
    return rounded(graphs.clustering(t.vertices(), t.edges()).select("graph_id", "transitivity"))


@query("degree_assortativity", rounded_sql(sql("""
    SELECT g.graph_id, coalesce((avg(x * y) - avg(x) * avg(y)) / nullif(stddev_pop(x) * stddev_pop(y), 0), 0) AS degree_assortativity
    FROM (SELECT DISTINCT graph_id FROM vertices) g LEFT JOIN (
      SELECT a.graph_id, CAST(s.degree AS DOUBLE) AS x, CAST(d.degree AS DOUBLE) AS y FROM arcs a
      JOIN degrees s ON s.graph_id = a.graph_id AND s.node = a.a JOIN degrees d ON d.graph_id = a.graph_id AND d.node = a.b) e
    USING (graph_id) GROUP BY ALL""", "degrees"), "degree_assortativity"))
def _(t: Tables):
    return rounded(graphs.assortativity(t.vertices(), t.edges()))


_REACH = """reach(graph_id, source, target) AS (SELECT graph_id, node, node FROM vertices
      UNION SELECT r.graph_id, r.source, a.b FROM reach r JOIN arcs a ON a.graph_id = r.graph_id AND a.a = r.target),
    labels AS (SELECT graph_id, target AS node, min(source) AS component FROM reach GROUP BY ALL)"""


@query("connected_components", rounded_sql(sql("""
    SELECT graph_id, count(*) AS component_count, max(size) / sum(size) AS largest_component_fraction
    FROM (SELECT graph_id, component, CAST(count(*) AS DOUBLE) AS size FROM labels GROUP BY ALL) GROUP BY ALL""",
    "vertices", "arcs", extra=_REACH, recursive=True), "largest_component_fraction"))
def _(t: Tables):
    return rounded(graphs.components_summary(t.vertices(), t.edges()))


@query("component_labels", sql("SELECT graph_id, node, component FROM labels", "vertices", "arcs", extra=_REACH, recursive=True))
def _(t: Tables):
    return graphs.connected_components(t.vertices(), t.edges())


_WALKS = _REACH + """,
    sizes AS (SELECT graph_id, component, count(*) AS size FROM labels GROUP BY ALL),
    big AS (SELECT graph_id, component FROM (SELECT graph_id, component, row_number() OVER (
        PARTITION BY graph_id ORDER BY size DESC, component) AS k FROM sizes) WHERE k = 1),
    walk(graph_id, source, target, d) AS (SELECT graph_id, node, node, 0 FROM labels JOIN big USING (graph_id, component)
      UNION SELECT w.graph_id, w.source, a.b, w.d + 1 FROM walk w JOIN arcs a ON a.graph_id = w.graph_id AND a.a = w.target WHERE w.d < 11),
    shortest AS (SELECT graph_id, source, target, min(d) AS d FROM walk GROUP BY ALL)"""


@query("shortest_paths", rounded_sql(sql("""
    SELECT g.graph_id, avg(s.d) AS average_shortest_path_length, CAST(max(s.d) AS BIGINT) AS diameter
    FROM (SELECT DISTINCT graph_id FROM vertices) g LEFT JOIN shortest s ON s.graph_id = g.graph_id AND s.target > s.source
    GROUP BY ALL""", "vertices", "arcs", extra=_WALKS, recursive=True), "average_shortest_path_length"))
def _(t: Tables):
    return rounded(graphs.shortest_paths(t.vertices(), t.edges()))


@query("adjacency_spectrum")
def _(t: Tables):
    return rounded(graphs.spectrum(t.vertices(), t.edges()).select("graph_id", "spectral_radius", "adjacency_spectral_gap"))


@query("laplacian_spectrum")
def _(t: Tables):
    return rounded(graphs.spectrum(t.vertices(), t.edges()).select("graph_id", "algebraic_connectivity", "laplacian_spectral_radius"))


@query("spectrum_moments", sql("""
    SELECT graph_id, 0::DOUBLE + 0 AS a1, CAST(sum(degree) AS DOUBLE) AS a2, CAST(2 * sum(triangles) AS DOUBLE) AS a3,
           CAST(sum(degree) AS DOUBLE) AS l1, CAST(sum(degree * degree) + sum(degree) AS DOUBLE) AS l2
    FROM node_triangles GROUP BY ALL""", "node_triangles"))
def _(t: Tables):
    """Sums of eigenvalue powers against counts of edges and triangles."""
    return rounded(graphs.eigenvalue_moments(t.vertices(), t.edges()), 5)


@query("feature_reconstruct_check", sql("""
    SELECT g.graph_id, g.declared, coalesce(e.recomputed, 0) AS recomputed FROM (
      SELECT graph_id, count(*) AS declared FROM lines GROUP BY ALL) g
    LEFT JOIN (SELECT graph_id, count(*) AS recomputed FROM edges GROUP BY ALL) e USING (graph_id)
    WHERE g.declared <> coalesce(e.recomputed, 0)""", "edges"))
def _(t: Tables):
    """The raw line count plays the declared edge count; repeated pairs show up as mismatches."""
    declared = t.graph_lines(12).groupBy("graph_id").agg(n_rows().alias("num_edges"))
    return graphs.edge_count_mismatch(t.edges(), declared)


def _sides(t: Tables):
    return t.vertices().withColumn("side", (F.floor((F.col("node") + F.col("graph_id")) / 3) % 2).cast("int"))


_SIDES = "sides AS (SELECT graph_id, node, CAST((node + graph_id) // 3 % 2 AS INTEGER) AS side FROM vertices)"


@query("cut_value", sql("""
    SELECT g.graph_id, count(*) FILTER (a.side <> b.side) AS cut, CAST(0 AS BIGINT) AS invalid_edges, CAST(0 AS BIGINT) AS invalid_nodes
    FROM (SELECT DISTINCT graph_id FROM vertices) g LEFT JOIN edges e ON e.graph_id = g.graph_id
    LEFT JOIN sides a ON a.graph_id = e.graph_id AND a.node = e.u LEFT JOIN sides b ON b.graph_id = e.graph_id AND b.node = e.v GROUP BY ALL""",
    "edges", "vertices", extra=_SIDES))
def _(t: Tables):
    return graphs.cut_value(t.vertices(), t.edges(), _sides(t))


@query("join_edge_attrs", sql("""
    SELECT e.graph_id, e.u, e.v, a.degree AS degree_u, b.degree AS degree_v FROM edges e
    JOIN degrees a ON a.graph_id = e.graph_id AND a.node = e.u JOIN degrees b ON b.graph_id = e.graph_id AND b.node = e.v""",
    "edges", "degrees"))
def _(t: Tables):
    d = graphs.degrees(t.vertices(), t.edges())
    at = lambda end: d.select("graph_id", F.col("node").alias(end), F.col("degree").alias(f"degree_{end}"))
    return t.edges().join(at("u"), ["graph_id", "u"]).join(at("v"), ["graph_id", "v"]).select(
        "graph_id", "u", "v", "degree_u", "degree_v")


_CUTS = """cuts AS (SELECT c.graph_id, c.mask, c.freq, count(e.u) FILTER (
      ((c.mask >> CAST(e.u AS INTEGER)) & 1) <> ((c.mask >> CAST(e.v AS INTEGER)) & 1)) AS cut
    FROM counts10 c LEFT JOIN edges10 e USING (graph_id) GROUP BY ALL)"""


@query("agg_weighted_counts", rounded_sql(sql("""
    SELECT graph_id, CAST(sum(cut * freq) AS DOUBLE) / sum(freq) AS expected, max(cut) AS best, CAST(sum(freq) AS BIGINT) AS total
    FROM cuts GROUP BY ALL""", "counts10", "edges10", extra=_CUTS), "expected"))
def _(t: Tables):
    """Expected and best cut under the measured frequencies of the labellings."""
    cuts = graphs.mask_cut(t.edges(CUT_NODES), t.counts(CUT_NODES))
    return rounded(aggregates.weighted_expectation(cuts, ["graph_id"], "cut", "freq"))


@query("maxcut_exhaustive", sql("""
    SELECT g.graph_id, coalesce(max(cut), 0) AS optimum, coalesce(arg_min(mask, (-cut, mask)), 0) AS best_mask
    FROM (SELECT DISTINCT graph_id FROM vertices10) g LEFT JOIN (
      SELECT graph_id, mask, count(*) FILTER (((mask >> CAST(u AS INTEGER)) & 1) <> ((mask >> CAST(v AS INTEGER)) & 1)) AS cut
      FROM edges10, (SELECT unnest(range(512)) * 2 AS mask) GROUP BY ALL) c USING (graph_id) GROUP BY ALL""",
    "vertices10", "edges10"))
def _(t: Tables):
    return graphs.exact_maxcut(t.vertices(CUT_NODES), t.edges(CUT_NODES))


_PAIRS = """nodes AS (SELECT s.*, unnest(range(num_nodes)) AS node FROM customer_specs s)"""


@query("random_graph_edges", sql("""
    SELECT a.graph_id, a.node AS u, b.node AS v FROM nodes a JOIN nodes b ON a.graph_id = b.graph_id AND a.node < b.node
    WHERE CAST('0x' || substr(md5(CAST(a.seed AS VARCHAR) || '|' || CAST(a.node AS VARCHAR) || '|' || CAST(b.node AS VARCHAR)), 1, 8) AS BIGINT)
          / 4294967296.0::DOUBLE < 0.35::DOUBLE""", "customer_specs", extra=_PAIRS))
def _(t: Tables):
    """One seeded random graph per customer."""
    return graphs.random_edges(t.customer_specs)


_CIRCLES = _PAIRS + """,
    placed AS (SELECT n.*, row_number() OVER (PARTITION BY graph_id
        ORDER BY md5(CAST(seed AS VARCHAR) || '|' || CAST(node AS VARCHAR)), node) - 1 AS pos FROM nodes n),
    steps AS (SELECT graph_id, 1 + (CAST('0x' || substr(md5(CAST(seed AS VARCHAR) || '|distance'), 1, 8) AS BIGINT) + j)
        % ((num_nodes - 1) // 2) AS step FROM customer_specs, (SELECT unnest(range(2)) AS j))"""


SWITCH_ROUNDS = 4


def _switch_sql(r: int) -> str:
    """One round of edge switches: edges of round r to edges of round r + 1."""
    tag = lambda role: f"CAST(s.seed AS VARCHAR) || '|{role}|{r}|'"
    return f"""pos{r} AS (SELECT e.*, s.seed, row_number() OVER (PARTITION BY e.graph_id ORDER BY
        md5({tag("pair")} || CAST(u AS VARCHAR) || '|' || CAST(v AS VARCHAR)), u, v) - 1 AS p FROM circle{r} e JOIN customer_specs s USING (graph_id)),
    pair{r} AS (SELECT s.graph_id, s.p // 2 AS k, s.u AS a, s.v AS b, t.u AS c, t.v AS d,
        CAST('0x' || substr(md5({tag("way")} || CAST(s.p // 2 AS VARCHAR)), 1, 8) AS BIGINT) % 2 = 0 AS across
      FROM pos{r} s LEFT JOIN pos{r} t ON t.graph_id = s.graph_id AND t.p = s.p + 1 WHERE s.p % 2 = 0),
    ask{r} AS (SELECT *, CASE WHEN across THEN least(a, d) ELSE least(a, c) END AS x1, CASE WHEN across THEN greatest(a, d) ELSE greatest(a, c) END AS y1,
        CASE WHEN across THEN least(c, b) ELSE least(b, d) END AS x2, CASE WHEN across THEN greatest(c, b) ELSE greatest(b, d) END AS y2 FROM pair{r}),
    fresh{r} AS (SELECT graph_id, k, unnest([x1, x2]) AS u, unnest([y1, y2]) AS v FROM ask{r}
      WHERE c IS NOT NULL AND x1 < y1 AND x2 < y2 AND NOT (x1 = x2 AND y1 = y2)),
    good{r} AS (SELECT graph_id, k FROM fresh{r} f GROUP BY graph_id, k EXCEPT (
      SELECT graph_id, k FROM fresh{r} SEMI JOIN circle{r} USING (graph_id, u, v)
      UNION SELECT graph_id, k FROM fresh{r} SEMI JOIN (SELECT graph_id, u, v FROM fresh{r} GROUP BY ALL HAVING count(*) > 1) USING (graph_id, u, v))),
    circle{r + 1} AS MATERIALIZED (
      SELECT f.graph_id, f.u, f.v FROM fresh{r} f SEMI JOIN good{r} USING (graph_id, k)
      UNION ALL SELECT graph_id, unnest([a, c]) AS u, unnest([b, d]) AS v FROM pair{r} ANTI JOIN good{r} USING (graph_id, k) WHERE c IS NOT NULL
      UNION ALL SELECT graph_id, a, b FROM pair{r} WHERE c IS NULL)"""


_SWITCHED = _CIRCLES + """,
    circle0 AS MATERIALIZED (SELECT a.graph_id, least(a.node, b.node) AS u, greatest(a.node, b.node) AS v FROM placed a
      JOIN steps s ON s.graph_id = a.graph_id JOIN placed b ON b.graph_id = a.graph_id AND b.pos = (a.pos + s.step) % a.num_nodes),
    """ + ",\n    ".join(_switch_sql(r) for r in range(SWITCH_ROUNDS))


@query("random_regular_edges", sql(f"SELECT graph_id, u, v FROM circle{SWITCH_ROUNDS}", "customer_specs", extra=_SWITCHED))
def _(t: Tables):
    """Seeded regular graphs: circulants after rounds of edge switches."""
    return graphs.regular_edges(t.customer_specs, rounds=SWITCH_ROUNDS)


@query("random_regular_degrees", sql("""
    SELECT graph_id, num_nodes * degree // 2 AS edges, degree AS least, degree AS most
    FROM customer_specs, (SELECT unnest([CAST(3 AS BIGINT), 4, 5]) AS degree) WHERE num_nodes * degree % 2 = 0""", "customer_specs"))
def _(t: Tables):
    """Every spec has its graph: as many edges as its size and degree ask for, and that degree at every node."""
    parts = []
    for degree in (3, 4, 5):
        specs = t.customer_specs.where(F.col("num_nodes") * degree % 2 == 0)
        nodes = specs.select("graph_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("num_nodes") - 1)).alias("node"))
        stats = graphs.degree_stats(nodes, graphs.regular_edges(specs, degree))
        parts.append(stats.select("graph_id", F.col("num_edges").alias("edges"), F.col("min_degree").alias("least"),
                                  F.col("max_degree").alias("most")))
    return parts[0].union(parts[1]).union(parts[2])


@query("agg_entity_overview", sql("""
    SELECT r.n_regionkey AS region, count(DISTINCT s_nationkey) AS families, min(g.num_nodes) AS fewest, max(g.num_nodes) AS most,
           CAST(sum(g.cases) AS BIGINT) AS cases FROM supplier
    JOIN (SELECT l_suppkey AS s_suppkey, count(DISTINCT l_orderkey) AS num_nodes, count(*) AS cases FROM lineitem GROUP BY ALL) g USING (s_suppkey)
    JOIN nation r ON n_nationkey = s_nationkey GROUP BY ALL"""))
def _(t: Tables):
    per = t.read("lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(
        F.countDistinct("l_orderkey").alias("num_nodes"), n_rows().alias("cases"))
    nation = t.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    return per.join(t.read("supplier"), "s_suppkey").join(nation, "s_nationkey").groupBy("region").agg(
        F.countDistinct("s_nationkey").alias("families"), F.min("num_nodes").alias("fewest"),
        F.max("num_nodes").alias("most"), F.sum("cases").alias("cases"))


@query("agg_histogram", sql("""
    SELECT CAST(least(8, floor((m - low) / ((high - low) / 8.0::DOUBLE)) + 1) AS BIGINT) AS bin, count(*) AS rows FROM (
      SELECT m, min(m) OVER () AS low, max(m) OVER () AS high
      FROM (SELECT v.graph_id, count(e.u) AS m FROM (SELECT DISTINCT graph_id FROM vertices) v LEFT JOIN edges e USING (graph_id) GROUP BY ALL))
    GROUP BY ALL""", "edges", "vertices"))
def _(t: Tables):
    return aggregates.histogram(graphs.degree_stats(t.vertices(), t.edges()), "num_edges", 8)


# graphs that grow with the data: hubs, a giant component, long chains ------------------------------

_WIDE_WALK = """walk(graph_id, source, target, d) AS (SELECT graph_id, node, node, 0 FROM wide_vertices
      UNION SELECT w.graph_id, w.source, a.b, w.d + 1 FROM walk w JOIN wide_arcs a ON a.graph_id = w.graph_id AND a.a = w.target
      WHERE w.d < CASE w.graph_id WHEN 0 THEN 6 ELSE 12 END),
    shortest AS (SELECT graph_id, source, target, min(d) AS d FROM walk GROUP BY ALL),
    labels AS (SELECT graph_id, target AS node, min(source) AS component FROM shortest GROUP BY ALL),
    sizes AS (SELECT graph_id, component, count(*) AS size FROM labels GROUP BY ALL),
    big AS (SELECT graph_id, component FROM (SELECT graph_id, component, row_number() OVER (
        PARTITION BY graph_id ORDER BY size DESC, component) AS k FROM sizes) WHERE k = 1)"""


@query("wide_components", sql("SELECT graph_id, node, component FROM labels", "wide_vertices", "wide_arcs", extra=_WIDE_WALK, recursive=True))
def _(t: Tables):
    """Alternating stars on a graph with hubs and a giant component, and on chains."""
    return graphs.components_by_joins(t.wide_vertices, t.wide_edges)


@query("wide_clustering", rounded_sql(sql("""
    SELECT graph_id, CAST(sum(triangles) // 3 AS BIGINT) AS triangle_count,
           sum(triangles) / 3.0::DOUBLE / greatest(1, count(*)::DOUBLE * (count(*) - 1) * (count(*) - 2) / 6) AS triangle_density,
           avg(CASE WHEN degree < 2 THEN 0 ELSE 2.0::DOUBLE * triangles / (degree * (degree - 1)) END) AS average_clustering,
           coalesce(2.0::DOUBLE * sum(triangles) / nullif(sum(degree * (degree - 1)), 0), 0) AS transitivity
    FROM (SELECT v.graph_id, v.node, (SELECT count(*) FROM wide_arcs a WHERE a.graph_id = v.graph_id AND a.a = v.node) AS degree,
                 (SELECT count(*) FROM wide_arcs a JOIN wide_arcs b ON b.graph_id = a.graph_id AND b.a = a.b
                  JOIN wide_arcs c ON c.graph_id = a.graph_id AND c.a = b.b AND c.b = a.a
                  WHERE a.graph_id = v.graph_id AND a.a = v.node) // 2 AS triangles FROM wide_vertices v) GROUP BY ALL""",
    "wide_vertices", "wide_arcs"), "triangle_density average_clustering transitivity"))
def _(t: Tables):
    """Triangles by edges that point to higher degrees, hubs dealt by the part of their neighbours."""
    return rounded(graphs.clustering_by_joins(t.wide_vertices, t.wide_edges))


@query("wide_paths", rounded_sql(sql("""
    SELECT g.graph_id, avg(s.d) AS average_shortest_path_length, CAST(max(s.d) AS BIGINT) AS diameter
    FROM big g JOIN labels l USING (graph_id, component) JOIN shortest s ON s.graph_id = g.graph_id AND s.source = l.node AND s.target > s.source
    GROUP BY ALL""", "wide_vertices", "wide_arcs", extra=_WIDE_WALK, recursive=True), "average_shortest_path_length"))
def _(t: Tables):
    return rounded(graphs.paths_by_joins(t.wide_vertices, t.wide_edges))


@query("graph_diameter", sql("""
    SELECT g.graph_id, CAST(max(s.d) AS BIGINT) AS diameter
    FROM big g JOIN labels l USING (graph_id, component) JOIN shortest s ON s.graph_id = g.graph_id AND s.source = l.node
    GROUP BY ALL""", "wide_vertices", "wide_arcs", extra=_WIDE_WALK, recursive=True))
def _(t: Tables):
    """Diameters by a few searches whose eccentricity bounds close."""
    return graphs.diameters(t.wide_vertices, t.wide_edges).select("graph_id", "diameter")


_WIDE_SIDES = """freqs AS (SELECT CAST(l_linenumber AS BIGINT) AS label, count(*) AS freq FROM lineitem GROUP BY ALL),
    wide_sides AS (SELECT graph_id, node, label, freq, (node * 31 + label * 17) % 7 % 2 AS side FROM wide_vertices, freqs),
    wide_cuts AS (SELECT a.graph_id, a.label, any_value(a.freq) AS freq, count(*) FILTER (a.side <> b.side) AS cut
      FROM wide_edges e JOIN wide_sides a ON a.graph_id = e.graph_id AND a.node = e.u
      JOIN wide_sides b ON b.graph_id = e.graph_id AND b.node = e.v AND b.label = a.label GROUP BY a.graph_id, a.label)"""


@query("agg_weighted_counts_wide", rounded_sql(sql("""
    SELECT graph_id, CAST(sum(cut * freq) AS DOUBLE) / sum(freq) AS expected, max(cut) AS best, CAST(sum(freq) AS BIGINT) AS total
    FROM wide_cuts GROUP BY ALL""", "wide_vertices", "wide_edges", extra=_WIDE_SIDES), "expected"))
def _(t: Tables):
    """The same for graphs of any size: seven labellings, each as often as its line number."""
    freqs = t.read("lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("label")).agg(n_rows().alias("freq"))
    labels = F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(7).cast("bigint")))
    sides = t.wide_vertices.withColumn("label", labels).withColumn(
        "side", (F.col("node") * 31 + F.col("label") * 17) % 7 % 2)
    cuts = graphs.block_cut(t.wide_edges, graphs.label_blocks(sides)).join(freqs, "label")
    return rounded(aggregates.weighted_expectation(cuts, ["graph_id"], "cut", "freq"))


# every part is a checked query of its own; the whole is their join
_STRUCTURE = f"SELECT * FROM ({SQL['agg_degree_stats']})" + "".join(f" JOIN ({SQL[name]}) USING (graph_id)" for name in (
    "triangle_count", "triangle_density", "local_clustering_avg", "transitivity", "degree_assortativity",
    "connected_components", "shortest_paths"))


@query("graph_structure", _STRUCTURE)
def _(t: Tables):
    return rounded(graphs.graph_structure(t.vertices(), t.edges()))


@query("graph_structure_by_joins", _STRUCTURE)
def _(t: Tables):
    """The form for graphs of any size, on the same graphs."""
    return rounded(graphs.structure_by_joins(t.vertices(), t.edges()))


@query("graph_features")
def _(t: Tables):
    """All structural features together; each has its own checked query."""
    return rounded(graphs.graph_features(t.vertices(), t.edges()))
