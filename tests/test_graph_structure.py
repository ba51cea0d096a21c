"""Both forms of every graph operator against brute force, and against each other."""

import itertools
import random

import numpy as np
import pytest

from selectra.operators import graphs


def sample_graphs():
    draw = random.Random(3)
    made = {
        1: (3, [(0, 1), (1, 2), (0, 2)]), 2: (5, [(i, i + 1) for i in range(4)]), 3: (6, [(0, i) for i in range(1, 6)]),
        4: (4, list(itertools.combinations(range(4), 2))), 5: (6, [(0, 1), (1, 2), (0, 2), (3, 4), (4, 5), (3, 5)]),
        6: (5, [(0, 1), (1, 2)]), 7: (1, []), 8: (3, []), 10: (7, [(0, 1), (2, 3), (3, 4), (5, 6)]),
    }
    for g in range(20, 28):
        n = draw.randint(6, 13)
        made[g] = (n, [p for p in itertools.combinations(range(n), 2) if draw.random() < 0.3])
    return made


def big_graphs():
    draw = random.Random(5)
    chain = [(i, i + 1) for i in range(69)]
    blob = [p for p in itertools.combinations(range(75), 2) if draw.random() < 0.08]
    two = [(i, (i + 1)) for i in range(29)] + [(i, i + 1) for i in range(30, 64)] + [(30, 64)]
    return {101: (70, chain), 102: (75, blob), 103: (66, [tuple(sorted(p)) for p in two]),
            104: (64, [(0, i) for i in range(1, 64)] + [(1, 2), (2, 3)])}


def frames(spark, made):
    v = spark.createDataFrame([(g, i) for g, (n, _) in made.items() for i in range(n)], "graph_id bigint, node bigint")
    e = spark.createDataFrame([(g, *p) for g, (_, es) in made.items() for p in es], "graph_id bigint, u bigint, v bigint")
    return v, e


def brute(n, edges):
    a = np.zeros((n, n))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    d = a.sum(0)
    tri = np.diag(np.linalg.matrix_power(a, 3)) / 2
    local = [0.0 if x < 2 else 2 * t / (x * (x - 1)) for x, t in zip(d, tri)]
    dist = np.where(np.eye(n) > 0, 0.0, np.where(a > 0, 1.0, np.inf))
    for k in range(n):
        dist = np.minimum(dist, dist[:, [k]] + dist[[k], :])
    labels = [int(np.flatnonzero(np.isfinite(dist[i]))[0]) for i in range(n)]
    sizes = {c: labels.count(c) for c in sorted(set(labels))}
    big = max(sizes, key=sizes.get)
    inside = [i for i in range(n) if labels[i] == big]
    pairs = [dist[i, j] for i in inside for j in inside if j > i]
    x = np.array([d[u] for u, v in edges] + [d[v] for u, v in edges])
    y = np.array([d[v] for u, v in edges] + [d[u] for u, v in edges])
    assort = 0.0 if not len(x) or x.std() == 0 else np.corrcoef(x, y)[0, 1]
    ea, el = np.linalg.eigvalsh(a), np.linalg.eigvalsh(np.diag(d) - a)
    wedges = (d * (d - 1)).sum() / 2
    return {
        "num_nodes": n, "num_edges": len(edges), "density": 0.0 if n < 2 else len(edges) * 2 / (n * (n - 1)),
        "average_degree": d.mean(), "degree_std": d.std(), "min_degree": d.min(), "max_degree": d.max(),
        "triangle_count": tri.sum() / 3, "triangle_density": tri.sum() / 3 / max(1.0, n * (n - 1) * (n - 2) / 6),
        "average_clustering": np.mean(local), "transitivity": tri.sum() / wedges if wedges else 0.0,
        "degree_assortativity": assort, "component_count": len(sizes), "largest_component_fraction": sizes[big] / n,
        "average_shortest_path_length": np.mean(pairs) if pairs else None, "diameter": max(pairs) if pairs else None,
        "spectral_radius": ea[-1], "adjacency_spectral_gap": ea[-1] - ea[-2] if n > 1 else None,
        "algebraic_connectivity": max(0.0, el[1]) if n > 1 else None, "laplacian_spectral_radius": el[-1],
    }


def compare(rows, made, skip=(), tolerance=1e-9):
    assert {r["graph_id"] for r in rows} == set(made)
    for r in rows:
        expected = brute(*made[r["graph_id"]])
        for name in set(r.asDict()) - {"graph_id"} - set(skip):
            want = expected[name]
            if want is None:
                assert r[name] is None, (r["graph_id"], name)
            else:
                assert r[name] == pytest.approx(want, abs=tolerance), (r["graph_id"], name)


def test_small_graph_features(spark):
    made = sample_graphs()
    compare(graphs.graph_features(*frames(spark, made)).collect(), made)


def test_join_forms_on_small_graphs(spark):
    made = sample_graphs()
    v, e = frames(spark, made)
    for result in (graphs.clustering_by_joins(v, e), graphs.assortativity_by_joins(v, e), graphs.paths_by_joins(v, e),
                   graphs.component_stats(graphs.components_by_joins(v, e)).drop("largest_component")):
        compare(result.collect(), made)


def test_mixed_sizes(spark):
    made = {**big_graphs(), 1: sample_graphs()[1], 5: sample_graphs()[5]}
    del made[101]  # a long chain needs one round per step
    v, e = frames(spark, made)
    for result in (graphs.clustering(v, e), graphs.assortativity(v, e), graphs.components_summary(v, e),
                   graphs.shortest_paths(v, e)):
        compare(result.collect(), made)
    moments = {r["graph_id"]: r for r in graphs.eigenvalue_moments(v, e).collect()}
    for g, (n, edges) in made.items():
        assert moments[g]["a2"] == pytest.approx(2 * len(edges), abs=1e-6)


def test_iterative_spectrum(spark):
    """A dense graph, where the iteration converges quickly; it stops on small steps, so only closeness is asked."""
    draw = random.Random(9)
    made = {1: (30, [p for p in itertools.combinations(range(30), 2) if draw.random() < 0.6])}
    found = graphs.iterative_spectrum(*frames(spark, made), tolerance=5e-2, max_rounds=150, rounds_per_check=10).first()
    expected = brute(*made[1])
    for name in found.asDict():
        if name != "graph_id":
            assert found[name] == pytest.approx(expected[name], rel=0.05), name


def test_component_labels(spark):
    made = {**big_graphs(), 10: sample_graphs()[10]}
    got = {(r["graph_id"], r["node"]): r["component"] for r in graphs.connected_components(*frames(spark, made)).collect()}
    assert got[(103, 29)] == 0 and got[(103, 30)] == 30 and got[(103, 65)] == 65 and got[(101, 69)] == 0
    assert [got[(10, i)] for i in range(7)] == [0, 0, 2, 2, 2, 5, 5]


def test_cut_value_reports_bad_labels(spark):
    v, e = frames(spark, {1: (4, [(0, 1), (1, 2)]), 2: (2, [])})
    labels = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 7), (2, 0, 1), (2, 1, 0)],
                                   "graph_id bigint, node bigint, side int")
    rows = {r["graph_id"]: r for r in graphs.cut_value(v, e, labels).collect()}
    # node 2 has a label outside 0/1, the isolated node 3 has none; graph 2 has no edges
    assert (rows[1]["cut"], rows[1]["invalid_edges"], rows[1]["invalid_nodes"]) == (2, 1, 2)
    assert (rows[2]["cut"], rows[2]["invalid_edges"], rows[2]["invalid_nodes"]) == (0, 0, 0)


def test_mask_cut_of_high_nodes_and_edgeless_graphs(spark):
    edges = spark.createDataFrame([(1, 0, 25), (1, 25, 62), (1, 3, 4)], "graph_id bigint, u bigint, v bigint")
    masks = spark.createDataFrame([(1, 1 << 25 | 1 << 3, 5), (1, 0, 2), (2, 7, 1)], "graph_id bigint, mask bigint, freq bigint")
    got = {(r["graph_id"], r["mask"]): r["cut"] for r in graphs.mask_cut(edges, masks).collect()}
    assert got == {(1, 1 << 25 | 1 << 3): 3, (1, 0): 0, (2, 7): 0}
    with pytest.raises(Exception, match="0 to 62"):
        graphs.mask_cut(edges.selectExpr("graph_id", "u", "v + 1 AS v"), masks).collect()


def test_random_regular(spark):
    schema = "graph_id bigint, num_nodes bigint, seed bigint"
    for degree in (1, 2, 3, 4, 5):
        sizes = [n for n in range(degree + 1, 24) if n * degree % 2 == 0]
        specs = spark.createDataFrame([(n, n, 7 + n) for n in sizes], schema)
        rows = graphs.regular_edges(specs, degree).collect()
        assert len({tuple(r) for r in rows}) == len(rows) and all(r["u"] < r["v"] for r in rows)
        for n in sizes:
            ends = [x for r in rows if r["graph_id"] == n for x in (r["u"], r["v"])]
            assert all(ends.count(i) == degree for i in range(n)) and len(ends) == n * degree
    for nodes, degree in ((4, 4), (5, 3)):
        with pytest.raises(Exception, match="no graph of degree"):
            graphs.regular_edges(spark.createDataFrame([(1, nodes, 7)], schema), degree).collect()


def test_random_edges_density(spark):
    specs = spark.createDataFrame([(i, 20, 0.35, 10000 + i) for i in range(50)],
                                  "graph_id bigint, num_nodes bigint, probability double, seed bigint")
    edges = graphs.random_edges(specs).collect()
    assert all(r["u"] < r["v"] < 20 for r in edges)
    assert abs(len(edges) / (50 * 190) - 0.35) < 0.02


def test_random_edges_of_tiny_graphs(spark):
    specs = spark.createDataFrame([(1, 1, 1.0, 3), (2, 2, 1.0, 3), (3, 0, 1.0, 3)],
                                  "graph_id bigint, num_nodes bigint, probability double, seed bigint")
    assert [tuple(r) for r in graphs.random_edges(specs).collect()] == [(2, 0, 1)]


def star_and_clique(n=2000, clique=30):
    """One hub with very many leaves and a clique among some of them."""
    return n, [(0, i) for i in range(1, n)] + list(itertools.combinations(range(1, clique + 1), 2))


def test_no_task_holds_a_hub(spark, monkeypatch):
    monkeypatch.setattr(graphs, "PART_NODES", 256)
    n, edges = star_and_clique()
    v, e = frames(spark, {1: (n, edges)})
    row = graphs.clustering_by_joins(v, e).first()
    assert row["triangle_count"] == 30 * 29 * 28 // 6 + 30 * 29 // 2
    assert {r["component"] for r in graphs.components_by_joins(v, e).collect()} == {0}
    # the rows that meet on one key while a hub's values are attached
    arcs = graphs.both_ways(e)
    dealt = arcs.withColumn("_part", graphs._part("b")).groupBy("a", "_part").count().agg({"count": "max"}).first()[0]
    assert dealt <= 256
    before = graphs.oriented(e).groupBy("a").count().agg({"count": "max"}).first()[0]
    assert before <= 30  # the hub has nobody before it


def test_alternating_stars(spark):
    made = {1: (200, [(i, i + 1) for i in range(199)]), 2: (50, [(0, i) for i in range(1, 50)]),
            3: (40, [(i, 39) for i in range(39)]), 4: (5, []), 5: (90, [(i, i + 45) for i in range(45)])}
    got = {(r["graph_id"], r["node"]): r["component"] for r in graphs.components_by_joins(*frames(spark, made)).collect()}
    assert {got[(1, i)] for i in range(200)} == {0} and {got[(2, i)] for i in range(50)} == {0}
    assert {got[(3, i)] for i in range(40)} == {0} and [got[(4, i)] for i in range(5)] == list(range(5))
    assert all(got[(5, i)] == got[(5, i + 45)] == i for i in range(45)) and len(got) == 385


def test_few_searches_close_the_diameter(spark):
    draw = random.Random(6)
    tree = [(draw.randrange(max(0, i - 8), i), i) for i in range(1, 70)]
    made = {1: (70, tree), 2: (40, [p for p in itertools.combinations(range(40), 2) if draw.random() < 0.12]),
            3: (12, [(i, i + 1) for i in range(11)]), 4: (4, []), 5: (9, [(i, (i + 1) % 9) if i < 8 else (0, 8) for i in range(9)])}
    rows = {r["graph_id"]: r for r in graphs.diameters(*frames(spark, made)).collect()}
    for g, (n, edges) in made.items():
        assert rows[g]["diameter"] == brute(n, edges)["diameter"], g
    assert rows[1]["searches"] <= 15 and rows[2]["searches"] < 40 and rows[3]["searches"] <= 4


def test_cuts_of_wide_labellings(spark):
    """Two hundred nodes, which no single mask holds."""
    draw = random.Random(12)
    n = 200
    edges = [p for p in itertools.combinations(range(n), 2) if draw.random() < 0.03]
    labellings = {k: [draw.randrange(2) for _ in range(n)] for k in range(5)} | {9: [0] * n}
    _, e = frames(spark, {1: (n, edges)})
    sides = spark.createDataFrame([(g, k, i, s) for g, count in ((1, n), (2, 3)) for k, label in labellings.items()
                                   for i, s in enumerate(label[:count])], "graph_id bigint, label bigint, node bigint, side int")
    got = {(r["graph_id"], r["label"]): r["cut"] for r in graphs.block_cut(e, graphs.label_blocks(sides)).collect()}
    assert got == {(1, k): sum(label[u] != label[v] for u, v in edges) for k, label in labellings.items()} | {
        (2, k): 0 for k in labellings}


def test_switches_reach_other_regular_graphs(spark):
    """Degrees stay, graphs stay simple, and triangles and connectivity vary over the seeds."""
    specs = spark.createDataFrame([(i, 14, 100 + i) for i in range(60)], "graph_id bigint, num_nodes bigint, seed bigint")
    by = {}
    for r in graphs.regular_edges(specs, 2, rounds=6).collect():
        by.setdefault(r["graph_id"], []).append((r["u"], r["v"]))
    pieces, seen = set(), set()
    for edges in by.values():
        assert len(set(edges)) == len(edges) == 14 and all(u < v for u, v in edges)
        f = brute(14, edges)
        assert f["min_degree"] == f["max_degree"] == 2
        pieces.add(f["component_count"])
        seen.add(tuple(sorted(edges)))
    assert len(pieces) > 1 and len(seen) == 60
    cubic = {}
    for r in graphs.regular_edges(specs, 3, rounds=6).collect():
        cubic.setdefault(r["graph_id"], []).append((r["u"], r["v"]))
    features = [brute(14, edges) for edges in cubic.values()]
    assert all(f["min_degree"] == f["max_degree"] == 3 for f in features)
    assert len({f["triangle_count"] for f in features}) > 2


def test_regular_graphs_broadcast_nothing(spark):
    """Rows out of generators look few to the planner; none of these joins may gather a side in the driver."""
    specs = spark.createDataFrame([(i, 14, 100 + i) for i in range(5)], "graph_id bigint, num_nodes bigint, seed bigint")
    for df in (graphs.circulant_edges(specs, 3), graphs.regular_edges(specs, 3, rounds=1)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_paths_through_hubs(spark, monkeypatch):
    """Large components with hubs are counted by distances to the hubs, and give what all searches give."""
    draw = random.Random(11)
    made = {}
    for g in range(4):  # hubs 0 to 2 with most nodes, chains, some random edges and a tail that hangs on one node
        n = 200
        edges = {(h, i) for h in range(3) for i in range(3, 190) if draw.random() < 0.95}
        edges |= {(i, i + 1) for i in range(3, 199) if i % 5 or i >= 189}
        edges |= {tuple(sorted(draw.sample(range(n), 2))) for _ in range(40 * g)}
        made[g] = (n, sorted(edges))
    made[6] = (60, [(i, i + 1) for i in range(59)])  # no hubs
    made[7] = (60, [(0, i) for i in range(1, 60)])
    v, e = frames(spark, made)
    plain = {r["graph_id"]: r for r in graphs.paths_by_joins(v, e).collect()}
    monkeypatch.setattr(graphs, "PART_NODES", 50)
    taken, through = [], graphs._through_hubs
    monkeypatch.setattr(graphs, "_through_hubs", lambda *a: taken.append(through(*a)) or taken[-1])
    for r in graphs.paths_by_joins(v, e).collect():
        want = brute(*made[r["graph_id"]])
        assert r["average_shortest_path_length"] == pytest.approx(want["average_shortest_path_length"])
        assert r == plain[r["graph_id"]] and r["diameter"] == want["diameter"]
    assert {0, 7} <= {r["graph_id"] for r in taken[0].collect()} and 6 not in {r["graph_id"] for r in taken[0].collect()}


def test_graphs_of_one_part_are_joined_at_once(spark, monkeypatch):
    """No node of a graph of one part can be a hub, so nothing is dealt by parts; larger graphs still are."""
    v, e = frames(spark, sample_graphs())
    parts, attach = [], graphs.attach

    def noted(*a, **k):
        parts.append(a[5] if len(a) > 5 else k.get("parts", True))
        return attach(*a, **k)

    monkeypatch.setattr(graphs, "attach", noted)
    whole = {tuple(r) for r in graphs.structure_by_joins(v, e).collect()}
    assert parts and not any(parts)
    parts.clear()
    monkeypatch.setattr(graphs, "PART_NODES", 4)
    monkeypatch.setattr(graphs, "HUBS", 0)
    assert {tuple(r) for r in graphs.structure_by_joins(v, e).collect()} == whole
    assert parts and all(parts)
