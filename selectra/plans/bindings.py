"""The test tables seen as runs, candidates, graphs and cases.

``Tables`` builds the DataFrame side; ``CTES`` holds the same definitions as SQL
for the side-by-side check.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from selectra.operators.aggregates import replicate_means
from selectra.operators.graphs import graph_features
from selectra.operators.learning import line_scorer
from selectra.operators.ranking import running_total
from selectra.operators.selection import fixed_by_case, score_cases
from selectra.operators.splits import entity_split
from selectra.session import materialise
from selectra.sources.readers import nan_to_null
from selectra.sources.registries import expand_budgets

SEED = 2027
CONTEXTS = ("A", "N", "R")
CANDIDATES = tuple(f"C0{i}" for i in range(1, 8))
NODES = 12
CUT_NODES = 10
CELL = ("entity", "context", "candidate", "depth", "optimizer", "shots")


class Tables:
    """All bindings for one data folder; every property is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def runs(self) -> DataFrame:
        line = F.col("l_linenumber").cast("bigint")
        shots = F.when(line <= 4, 256).otherwise(512).cast("bigint")
        runs = F.col("l_quantity").cast("bigint")
        failed = (F.col("l_linestatus") == "O") & (F.col("l_quantity") == 50)
        lost = failed | ((F.col("l_quantity") == 13) & (F.col("l_tax") == 0.04))
        return nan_to_null(self.read("lineitem")).select(
            F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("context"),
            F.concat(F.lit("C0"), line.cast("string")).alias("candidate"),
            F.ceil(line / 3).cast("bigint").alias("depth"),
            F.when(line % 2 == 0, "SPSA").otherwise("COBYLA").alias("optimizer"), shots.alias("shots"),
            F.col("l_orderkey").alias("replicate"), F.col("l_shipdate").alias("measured_at"),
            runs.alias("executions"),
            (shots * runs + F.when((F.col("l_quantity") == 23) & (F.col("l_tax") == 0.03), 1).otherwise(0)).alias("total_cost"),
            F.col("l_extendedprice").alias("price"),
            F.when(~lost, F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("measured"),
            (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("optimum"),
            ((1 - F.col("l_discount")) / (1 + F.col("l_tax"))
             + F.when(F.col("l_quantity") == 7, 1e-6).otherwise(0.0)).alias("quality"),
            F.least(F.lit(1.0), (1 - F.col("l_discount") * 0.5) / (1 + F.col("l_tax"))).alias("best_quality"),
            F.when(failed, "failed").otherwise("success").alias("status"),
            F.when(failed & (F.col("l_tax") == 0.01), "").when(failed & (F.col("l_tax") > 0.01), "timeout").alias("reason"),
            F.when(F.col("l_shipdate") >= "2001-01-01", "1.1").otherwise("1.0").alias("version"))

    @property
    def success(self):
        return F.col("status") == "success"

    @property
    def gap_runs(self) -> DataFrame:
        """Runs in which some entities were never measured in one context."""
        return self.runs.where(~((F.col("entity") % 7 == 0) & (F.col("context") == "R")))

    @property
    def perf(self) -> DataFrame:
        return replicate_means(
            self.runs, CELL, {"quality": "quality", "best_quality": "best_quality", "cost": "total_cost", "price": "price"},
            self.success, digits=9)

    @property
    def entities(self) -> DataFrame:
        return self.read("lineitem").select(F.col("l_suppkey").alias("entity")).distinct()

    @property
    def splits(self) -> DataFrame:
        return entity_split(self.entities, "entity", SEED)

    @cached_property
    def perf_split(self) -> DataFrame:
        """Candidates with their split.  This small table is the materialised point
        of a job: fitting, baselines and scoring all start from it, so that the
        runs are scanned once."""
        return materialise(self.perf.join(self.splits, "entity"))

    def part(self, *names: str) -> DataFrame:
        return self.perf_split.where(F.col("split").isin(*names))

    @property
    def scored(self) -> DataFrame:
        return line_scorer(self.part("train"), "price", "quality")(self.perf_split)

    @property
    def feasible(self) -> DataFrame:
        return expand_budgets(self.scored)

    @property
    def fixed(self) -> DataFrame:
        return fixed_by_case(expand_budgets(self.part("train")))

    @property
    def cases(self) -> DataFrame:
        """Scored cases of all entities, each with its split."""
        return score_cases(self.feasible, self.fixed, case=("entity", "split", "context", "budget"))

    @property
    def test_cases(self) -> DataFrame:
        return self.cases.where("split = 'test'")

    @property
    def features(self) -> DataFrame:
        """One row of pre-execution features per entity."""
        return self.read("lineitem").groupBy(F.col("l_suppkey").alias("entity")).agg(
            F.round(F.avg("l_extendedprice"), 9).alias("f_price"), F.round(F.avg("l_quantity"), 9).alias("f_quantity"),
            F.round(F.avg("l_discount"), 9).alias("f_discount"))

    @property
    def entity_edges(self) -> DataFrame:
        """One graph of twelve nodes per entity, out of its largest runs."""
        a, b = F.col("l_partkey") % NODES, F.col("l_orderkey") % NODES
        return self.read("lineitem").where("l_quantity >= 48").select(
            F.col("l_suppkey").alias("graph_id"), F.least(a, b).cast("bigint").alias("u"),
            F.greatest(a, b).cast("bigint").alias("v")).where("u < v").distinct()

    @cached_property
    def structure(self) -> DataFrame:
        """The structural features of every entity's graph, and its family."""
        vertices = self.entities.select(F.col("entity").alias("graph_id"), F.explode(F.sequence(
            F.lit(0).cast("bigint"), F.lit(NODES - 1).cast("bigint"))).alias("node"))
        features = graph_features(vertices, self.entity_edges).withColumnRenamed("graph_id", "entity")
        family = self.read("supplier").select(F.col("s_suppkey").alias("entity"), F.concat(
            F.lit("F"), (F.col("s_nationkey") % 4).cast("string")).alias("family"))
        return materialise(features.join(family, "entity").na.fill(0.0).na.fill(0))

    def graph_lines(self, nodes: int) -> DataFrame:
        a, b = F.col("l_suppkey") % nodes, F.col("l_partkey") % nodes
        return self.read("lineitem").select(
            F.floor(F.col("l_orderkey") / 8).cast("bigint").alias("graph_id"), F.least(a, b).alias("u"),
            F.greatest(a, b).alias("v"), ((F.col("l_partkey") * 31 + F.col("l_suppkey")) % (1 << nodes)).alias("mask"),
            F.col("l_quantity").cast("bigint").alias("freq"))

    def edges(self, nodes: int = NODES) -> DataFrame:
        return self.graph_lines(nodes).where("u < v").select("graph_id", "u", "v").distinct()

    def vertices(self, nodes: int = NODES) -> DataFrame:
        return self.graph_lines(nodes).select("graph_id").distinct().withColumn(
            "node", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(nodes - 1).cast("bigint"))))

    @cached_property
    def wide_edges(self) -> DataFrame:
        """Two graphs that grow with the suppliers: in graph 0 suppliers meet line numbers (hubs) and the next supplier,
        in graph 1 they form chains of twelve. Kept, because the runs are very many more than these edges."""
        s = F.col("l_suppkey").cast("bigint")
        edge = lambda g, u, v: F.struct(F.lit(g).cast("bigint").alias("graph_id"), F.least(u, v).alias("u"), F.greatest(u, v).alias("v"))
        made = F.filter(F.array(
            F.when(F.col("l_quantity") >= 40, edge(0, F.col("l_linenumber").cast("bigint"), s + 10)),
            F.when(s % 4 != 0, edge(0, s + 10, s + 11)), F.when(s % 12 != 11, edge(1, s, s + 1))), lambda e: e.isNotNull())
        return materialise(self.read("lineitem").select(F.inline(made)).distinct())

    @cached_property
    def wide_vertices(self) -> DataFrame:
        ends = self.wide_edges.select("graph_id", F.explode(F.array("u", "v")).alias("node"))
        return materialise(ends.distinct())

    def counts(self, nodes: int = CUT_NODES) -> DataFrame:
        return self.graph_lines(nodes).groupBy("graph_id", "mask").agg(F.sum("freq").alias("freq"))

    @property
    def nation_units(self) -> DataFrame:
        """Per context and nation: mean quality under one optimizer minus the other."""
        where = self.read("supplier").select(F.col("s_suppkey").alias("entity"), F.col("s_nationkey").alias("unit"))
        nation = self.read("nation").select(F.col("n_nationkey").alias("unit"), F.col("n_regionkey").alias("region"))
        side = lambda o: F.avg(F.when(F.col("optimizer") == o, F.col("quality")))
        return (self.runs.where(self.success).join(where, "entity").join(nation, "unit")
                .groupBy("context", "region", "unit")
                .agg(F.round(side("SPSA") - side("COBYLA"), 9).alias("difference"))
                .withColumn("scope", F.concat_ws("_", "context", F.col("region").cast("string"))))

    @property
    def customer_specs(self) -> DataFrame:
        """Graph specs out of the customers: size, probability and seed per customer."""
        return self.read("customer").select(
            F.col("c_custkey").alias("graph_id"), (F.col("c_nationkey").cast("bigint") % 6 + 8).alias("num_nodes"),
            F.lit(0.35).alias("probability"), (F.col("c_custkey") + 10000).alias("seed"))

    def position_in(self, df: DataFrame, group: str, key: str) -> DataFrame:
        """1-based position of unique keys inside their group, in key order."""
        rows = df.select(group, F.col(key).cast("double").alias(key)).withColumn("_one", F.lit(1))
        return running_total(rows, [group], key, "_one", "before", "total").select(
            group, F.col(key).cast("bigint").alias(key), (F.col("before") + 1).alias("position"))


# (dependencies, body) per named subquery -----------------------------------------------

_CASE = "entity, split, context, budget"
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "runs": ((), """
        SELECT l_suppkey AS entity, l_returnflag AS context, 'C0' || CAST(l_linenumber AS VARCHAR) AS candidate,
               CAST((l_linenumber + 2) // 3 AS BIGINT) AS depth,
               CASE WHEN l_linenumber % 2 = 0 THEN 'SPSA' ELSE 'COBYLA' END AS optimizer,
               CAST(CASE WHEN l_linenumber <= 4 THEN 256 ELSE 512 END AS BIGINT) AS shots,
               l_orderkey AS replicate, l_shipdate AS measured_at, CAST(l_quantity AS BIGINT) AS executions,
               CAST(CASE WHEN l_linenumber <= 4 THEN 256 ELSE 512 END AS BIGINT) * CAST(l_quantity AS BIGINT)
                 + CASE WHEN l_quantity = 23 AND l_tax = 0.03 THEN 1 ELSE 0 END AS total_cost,
               l_extendedprice AS price,
               CASE WHEN (l_linestatus = 'O' AND l_quantity = 50) OR (l_quantity = 13 AND l_tax = 0.04) THEN NULL
                    ELSE l_extendedprice * (1 - l_discount) END AS measured,
               l_extendedprice * (1 + l_tax) AS optimum,
               (1 - l_discount) / (1 + l_tax) + CASE WHEN l_quantity = 7 THEN 1e-6 ELSE CAST(0 AS DOUBLE) END AS quality,
               least(CAST(1 AS DOUBLE), (1 - l_discount * 0.5) / (1 + l_tax)) AS best_quality,
               CASE WHEN l_linestatus = 'O' AND l_quantity = 50 THEN 'failed' ELSE 'success' END AS status,
               CASE WHEN l_linestatus = 'O' AND l_quantity = 50 AND l_tax = 0.01 THEN ''
                    WHEN l_linestatus = 'O' AND l_quantity = 50 AND l_tax > 0.01 THEN 'timeout' END AS reason,
               CASE WHEN l_shipdate >= TIMESTAMP '2001-01-01' THEN '1.1' ELSE '1.0' END AS version
        FROM lineitem"""),
    "gap_runs": (("runs",), "SELECT * FROM runs WHERE NOT (entity % 7 = 0 AND context = 'R')"),
    "perf": (("runs",), """
        SELECT entity, context, candidate, depth, optimizer, shots, round(avg(quality), 9) AS quality,
               round(avg(best_quality), 9) AS best_quality, round(avg(total_cost), 9) AS cost,
               round(avg(price), 9) AS price, count(*) AS n_runs
        FROM runs WHERE status = 'success' GROUP BY ALL"""),
    "entities": ((), "SELECT DISTINCT l_suppkey AS entity FROM lineitem"),
    "splits": (("entities",), """
        SELECT entity, CASE WHEN r <= round_even(n * CAST(0.70 AS DOUBLE), 0) THEN 'train'
                            WHEN r <= round_even(n * CAST(0.70 AS DOUBLE), 0) + round_even(n * CAST(0.15 AS DOUBLE), 0)
                            THEN 'validation' ELSE 'test' END AS split
        FROM (SELECT entity, row_number() OVER (ORDER BY md5('2027|' || CAST(entity AS VARCHAR)), entity) AS r,
                     count(*) OVER () AS n FROM entities)"""),
    "perf_split": (("perf", "splits"), "SELECT * FROM perf JOIN splits USING (entity)"),
    "line": (("perf_split",), """
        SELECT regr_slope(quality, price) AS slope, regr_intercept(quality, price) AS intercept
        FROM perf_split WHERE split = 'train'"""),
    "scored": (("perf_split", "line"), """
        SELECT p.*, round(l.intercept + l.slope * p.price, 12) AS score FROM perf_split p, line l"""),
    "budgets": ((), "SELECT * FROM (VALUES ('B256', 256), ('B512', 512)) b(budget, most)"),
    "feasible": (("scored", "budgets"), "SELECT s.*, b.budget FROM scored s JOIN budgets b ON s.shots <= b.most"),
    "fixed": (("feasible",), """
        SELECT budget, context, candidate AS fixed_candidate, train_mean_quality FROM (
          SELECT *, row_number() OVER (PARTITION BY budget, context ORDER BY train_mean_quality DESC, candidate) AS k
          FROM (SELECT budget, context, candidate, round(avg(quality), 9) AS train_mean_quality
                FROM feasible WHERE split = 'train' GROUP BY ALL)) WHERE k = 1"""),
    "ranked": (("feasible", "fixed"), f"""
        SELECT f.*, x.fixed_candidate,
               row_number() OVER (PARTITION BY {_CASE} ORDER BY score DESC, candidate) AS predicted_rank,
               row_number() OVER (PARTITION BY {_CASE} ORDER BY quality DESC, score DESC, candidate) AS oracle_rank
        FROM feasible f LEFT JOIN fixed x USING (budget, context)"""),
    "cases": (("ranked",), f"""
        SELECT *, greatest(CAST(0 AS DOUBLE), oracle_quality - selected_quality) AS regret,
               selected_candidate = oracle_candidate AS selected_is_oracle, oracle_predicted_rank <= 3 AS oracle_in_top3,
               selected_quality - fixed_quality AS selected_minus_fixed
        FROM (SELECT {_CASE},
                     max(CASE WHEN predicted_rank = 1 THEN candidate END) AS selected_candidate,
                     max(CASE WHEN predicted_rank = 1 THEN shots END) AS selected_cost,
                     max(CASE WHEN predicted_rank = 1 THEN quality END) AS selected_quality,
                     max(CASE WHEN predicted_rank = 1 THEN score END) AS predicted_quality,
                     max(CASE WHEN oracle_rank = 1 THEN candidate END) AS oracle_candidate,
                     max(CASE WHEN oracle_rank = 1 THEN quality END) AS oracle_quality,
                     max(CASE WHEN oracle_rank = 1 THEN predicted_rank END) AS oracle_predicted_rank,
                     avg(quality) AS random_expected_quality, max(fixed_candidate) AS fixed_candidate,
                     max(CASE WHEN candidate = fixed_candidate THEN quality END) AS fixed_quality
              FROM ranked GROUP BY {_CASE})"""),
    "test_cases": (("cases",), "SELECT * FROM cases WHERE split = 'test'"),
    "features": ((), """
        SELECT l_suppkey AS entity, round(avg(l_extendedprice), 9) AS f_price, round(avg(l_quantity), 9) AS f_quantity,
               round(avg(l_discount), 9) AS f_discount FROM lineitem GROUP BY l_suppkey"""),
    "nation_units": (("runs",), """
        SELECT context, n_regionkey AS region, s_nationkey AS unit,
               round(avg(CASE WHEN optimizer = 'SPSA' THEN quality END)
                     - avg(CASE WHEN optimizer = 'COBYLA' THEN quality END), 9) AS difference,
               context || '_' || CAST(n_regionkey AS VARCHAR) AS scope
        FROM runs JOIN supplier ON s_suppkey = entity JOIN nation ON n_nationkey = s_nationkey
        WHERE status = 'success' GROUP BY ALL"""),
    "customer_specs": ((), """
        SELECT c_custkey AS graph_id, CAST(c_nationkey AS BIGINT) % 6 + 8 AS num_nodes,
               CAST(0.35 AS DOUBLE) AS probability, c_custkey + 10000 AS seed FROM customer"""),
}
for _n, _tag in ((NODES, ""), (CUT_NODES, "10")):
    CTES[f"lines{_tag}"] = ((), f"""
        SELECT CAST(floor(l_orderkey / 8) AS BIGINT) AS graph_id, least(l_suppkey % {_n}, l_partkey % {_n}) AS u,
               greatest(l_suppkey % {_n}, l_partkey % {_n}) AS v,
               (l_partkey * 31 + l_suppkey) % {1 << _n} AS mask, CAST(l_quantity AS BIGINT) AS freq FROM lineitem""")
    CTES[f"edges{_tag}"] = ((f"lines{_tag}",), f"SELECT DISTINCT graph_id, u, v FROM lines{_tag} WHERE u < v")
    CTES[f"vertices{_tag}"] = ((f"lines{_tag}",), f"""
        SELECT graph_id, node FROM (SELECT DISTINCT graph_id FROM lines{_tag}), (SELECT unnest(range({_n})) AS node)""")
    CTES[f"counts{_tag}"] = ((f"lines{_tag}",), f"""
        SELECT graph_id, mask, CAST(sum(freq) AS BIGINT) AS freq FROM lines{_tag} GROUP BY ALL""")
CTES["wide_edges"] = ((), """
    SELECT DISTINCT 0::BIGINT AS graph_id, CAST(l_linenumber AS BIGINT) AS u, l_suppkey + 10 AS v FROM lineitem WHERE l_quantity >= 40
    UNION SELECT 0, l_suppkey + 10, l_suppkey + 11 FROM lineitem WHERE l_suppkey % 4 <> 0
    UNION SELECT 1, l_suppkey, l_suppkey + 1 FROM lineitem WHERE l_suppkey % 12 <> 11""")
CTES["wide_vertices"] = (("wide_edges",), "SELECT graph_id, u AS node FROM wide_edges UNION SELECT graph_id, v FROM wide_edges")
CTES["wide_arcs"] = (("wide_edges",), "SELECT graph_id, u AS a, v AS b FROM wide_edges UNION ALL SELECT graph_id, v, u FROM wide_edges")
CTES["arcs"] = (("edges",), "SELECT graph_id, u AS a, v AS b FROM edges UNION ALL SELECT graph_id, v, u FROM edges")
CTES["degrees"] = (("vertices", "arcs"), """
    SELECT v.graph_id, v.node, count(a.b) AS degree FROM vertices v
    LEFT JOIN arcs a ON a.graph_id = v.graph_id AND a.a = v.node GROUP BY ALL""")
CTES["corners"] = (("edges",), """
    SELECT e.graph_id, e.u AS x, e.v AS y, f.v AS z FROM edges e
    JOIN edges f ON f.graph_id = e.graph_id AND f.u = e.v
    JOIN edges g ON g.graph_id = e.graph_id AND g.u = e.u AND g.v = f.v""")
CTES["node_triangles"] = (("corners", "degrees"), """
    SELECT d.graph_id, d.node, d.degree, coalesce(t.c, 0) AS triangles FROM degrees d LEFT JOIN (
      SELECT graph_id, node, count(*) AS c FROM (
        SELECT graph_id, x AS node FROM corners UNION ALL SELECT graph_id, y FROM corners
        UNION ALL SELECT graph_id, z FROM corners) GROUP BY ALL) t USING (graph_id, node)""")


def sql(body: str, *needs: str, extra: str = "", recursive: bool = False) -> str:
    """A statement with the named subqueries it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in CTES[name][0]:
                visit(dep)
            order.append(name)

    for need in needs:
        visit(need)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order]
    if extra:
        parts.append(extra)
    head = f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" if parts else ""
    return head + body
