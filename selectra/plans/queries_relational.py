"""Registered queries: scans, sinks, rules, joins, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from selectra.functions import scalar
from selectra.operators import aggregates, joins, rules, selection
from selectra.plans.bindings import CANDIDATES, CONTEXTS, Tables, sql
from selectra.plans.catalog import query
from selectra.plans.shaping import rounded, rounded_sql
from selectra.session import shared_dir
from selectra.sources import readers, registries, sinks

BIG = "bigint"


def n_rows():
    return F.count(F.lit(1))


# A. Scans, sources, sinks -------------------------------------------------------------

LINE_SCHEMA = StructType([
    StructField("l_orderkey", LongType()), StructField("l_suppkey", LongType()),
    StructField("l_returnflag", StringType()), StructField("l_quantity", DoubleType()),
])


@query("scan_runs", sql("""
    SELECT l_returnflag AS context, count(*) AS n, count(DISTINCT l_suppkey) AS entities,
           round(sum(l_quantity), 6) AS quantity FROM lineitem GROUP BY ALL"""))
def _(t: Tables):
    """Declared schema in, four columns read."""
    df = readers.scan_runs(t.spark, f"{t.folder}/lineitem.parquet", LINE_SCHEMA)
    return df.groupBy(F.col("l_returnflag").alias("context")).agg(
        n_rows().alias("n"), F.countDistinct("l_suppkey").alias("entities"),
        F.round(F.sum("l_quantity"), 6).alias("quantity"))


@query("scan_runs_csv", sql("""
    SELECT context, version, count(*) AS n, CAST(sum(total_cost) AS BIGINT) AS total_cost, count(measured) AS measured
    FROM runs GROUP BY ALL""", "runs"))
def _(t: Tables):
    """A CSV round trip of all runs with a declared schema; the version stays text."""
    cols = ["entity", "context", "candidate", "total_cost", "measured", "version"]
    runs = t.runs.select(*cols)
    [path] = sinks.write_tables({"runs": runs}, shared_dir(t.spark, "csv"), "csv")
    back = readers.scan_runs(t.spark, path, runs.schema)
    return back.groupBy("context", "version").agg(
        n_rows().alias("n"), F.sum("total_cost").alias("total_cost"), F.count("measured").alias("measured"))


@query("scan_union_tagged", sql("""
    SELECT source_file, count(*) AS n, count(entity) AS with_entity, count(DISTINCT context) AS contexts FROM (
      SELECT 'ideal' AS source_file, entity, context FROM runs WHERE context = 'A'
      UNION ALL SELECT 'noisy', entity, context FROM runs WHERE context <> 'A') GROUP BY ALL""", "runs"))
def _(t: Tables):
    parts = {"ideal": t.runs.where("context = 'A'"), "noisy": t.runs.where("context <> 'A'").drop("price")}
    return readers.union_tagged(parts).groupBy("source_file").agg(
        n_rows().alias("n"), F.count("entity").alias("with_entity"), F.countDistinct("context").alias("contexts"))


@query("scan_manifest", sql("""
    SELECT n_name AS nation, count(*) AS entities, min(s_suppkey) AS first_entity, max(s_suppkey) AS last_entity
    FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY ALL"""))
def _(t: Tables):
    suppliers = readers.scan_manifest(t.read("supplier"), ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"])
    nation = t.read("nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("nation"))
    return suppliers.join(nation, "s_nationkey").groupBy("nation").agg(
        n_rows().alias("entities"), F.min("s_suppkey").alias("first_entity"), F.max("s_suppkey").alias("last_entity"))


@query("scan_or_empty", sql("""
    SELECT 'existing' AS target, count(*) AS n FROM lineitem UNION ALL SELECT 'absent', 0"""))
def _(t: Tables):
    there = readers.scan_or_empty(t.spark, f"{t.folder}/lineitem.parquet", LINE_SCHEMA)
    none = readers.scan_or_empty(t.spark, f"{t.folder}/not_written_yet.parquet", LINE_SCHEMA)
    count = lambda df, name: df.agg(F.lit(name).alias("target"), n_rows().alias("n"))
    return count(there, "existing").unionByName(count(none, "absent"))


@query("resolve_aliases", sql("""
    SELECT l_suppkey AS entity, count(*) AS n, round(sum(l_quantity), 6) AS cost FROM lineitem GROUP BY ALL"""))
def _(t: Tables):
    named = readers.resolve_aliases(t.read("lineitem"), {
        "entity": ["graph_id", "supplier", "l_suppkey"], "cost": ["shots", "l_quantity"], "note": ["l_comment"]}, ["note"])
    return named.groupBy("entity").agg(n_rows().alias("n"), F.round(F.sum("cost"), 6).alias("cost"))


_REGISTRY = """registry AS (
    SELECT 'C' || lpad(CAST(row_number() OVER (ORDER BY d, o, s) AS VARCHAR), 2, '0') AS candidate,
           CAST(d AS BIGINT) AS depth, o AS optimizer, CAST(s AS BIGINT) AS shots
    FROM (VALUES (1), (2), (3)) a(d), (VALUES ('COBYLA'), ('SPSA')) b(o), (VALUES (256), (512)) c(s))"""


@query("candidate_registry", rounded_sql(sql("""
    SELECT r.candidate, r.depth, r.optimizer, r.shots, count(u.entity) AS n, avg(u.quality) AS mean_quality
    FROM registry r LEFT JOIN runs u ON u.depth = r.depth AND u.optimizer = r.optimizer AND u.shots = r.shots
    GROUP BY ALL""", "runs", extra=_REGISTRY), "mean_quality"))
def _(t: Tables):
    """The registry numbered in nested order, with what the runs hold for each entry."""
    registry = registries.candidate_registry(t.spark).select(
        "candidate", F.col("depth").cast(BIG).alias("depth"), "optimizer", F.col("shots").cast(BIG).alias("shots"))
    seen = t.runs.groupBy("depth", "optimizer", "shots").agg(n_rows().alias("n"), F.avg("quality").alias("mean_quality"))
    return rounded(registry.join(seen, ["depth", "optimizer", "shots"], "left").select(
        "candidate", "depth", "optimizer", "shots", F.coalesce("n", F.lit(0)).alias("n"), "mean_quality"))


@query("candidate_lookup", sql("""
    SELECT DISTINCT 'C' || lpad(CAST(p_size AS VARCHAR), 2, '0') AS candidate FROM part WHERE p_size > 12"""))
def _(t: Tables):
    """Ids of the table that the registry does not know."""
    asked = t.read("part").select(F.format_string("C%02d", "p_size").alias("candidate"))
    return registries.unknown_candidates(asked, registries.candidate_registry(t.spark))


@query("context_registry", rounded_sql(sql("""
    SELECT c.context, c.description, c.double_error, count(r.entity) AS n, avg(r.quality) AS mean_quality
    FROM (VALUES ('A', CAST(0.0 AS DOUBLE), 'ideal simulation'), ('N', CAST(0.01 AS DOUBLE), 'controlled moderate noise'),
                 ('R', CAST(0.03 AS DOUBLE), 'controlled higher noise')) c(context, double_error, description)
    LEFT JOIN runs r USING (context) GROUP BY ALL""", "runs"), "double_error mean_quality"))
def _(t: Tables):
    rows = [(name, *levels[1:]) for name, levels in zip(CONTEXTS, registries.CONTEXTS)]
    dim = registries.context_registry(t.spark, rows)
    seen = t.runs.groupBy("context").agg(n_rows().alias("n"), F.avg("quality").alias("mean_quality"))
    return rounded(dim.join(seen, "context", "left").select(
        "context", "description", "double_error", F.coalesce("n", F.lit(0)).alias("n"), "mean_quality"))


@query("entity_manifest", sql("""
    SELECT printf('G%04d', row_number() OVER (ORDER BY c_mktsegment, p, c_custkey)) AS graph_id, c_mktsegment AS family,
           CAST(size AS BIGINT) AS num_nodes, row_number() OVER (ORDER BY c_mktsegment, p, c_custkey) + 9999 AS seed,
           CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(0.35 AS DOUBLE) END AS probability,
           CAST(CASE WHEN c_mktsegment <> 'BUILDING' THEN 4 END AS BIGINT) AS degree
    FROM customer, (VALUES (0, 10), (1, 12), (2, 15), (3, 18), (4, 20)) s(p, size)"""))
def _(t: Tables):
    """Families are market segments, instances the customers of a segment."""
    placed = t.position_in(t.read("customer"), "c_mktsegment", "c_custkey")
    return registries.entity_manifest(placed, "c_mktsegment", (10, 12, 15, 18, 20), "position", random_family="BUILDING")


@query("sink_csv", sql("""
    SELECT kind, entity, context, candidate, depth, optimizer, shots, quality, best_quality, cost, price, n_runs
    FROM perf, (SELECT unnest(['csv', 'parquet']) AS kind)""", "perf"))
def _(t: Tables):
    """Write a bundle and read it back: every cell is there again, whatever the format."""
    folder, perf = shared_dir(t.spark, "bundle"), t.perf
    sinks.write_tables({"candidates": perf, "splits": t.splits}, folder, "csv")
    sinks.write_tables({"candidates_by_context": perf}, folder, "parquet", {"candidates_by_context": ["context"]})
    flat = t.spark.read.schema(perf.schema).option("header", True).csv(f"{folder}/candidates")
    parted = t.spark.read.parquet(f"{folder}/candidates_by_context")
    return flat.withColumn("kind", F.lit("csv")).unionByName(parted.withColumn("kind", F.lit("parquet")))


@query("sink_manifest", sql("""
    SELECT count(*) AS rows, count(DISTINCT entity) AS entities, count(DISTINCT candidate) AS candidates,
           string_agg(DISTINCT context, ',' ORDER BY context) AS contexts, false AS test_data_used FROM perf""", "perf"))
def _(t: Tables):
    return sinks.manifest(t.perf, {"entities": "entity", "candidates": "candidate"}, {"contexts": "context"},
                          {"test_data_used": False})


@query("sink_manifest_json", sql("""
    SELECT '{"rows":' || CAST(count(*) AS VARCHAR) || ',"entities":' || CAST(count(DISTINCT entity) AS VARCHAR) || ',"contexts":"'
           || string_agg(DISTINCT context, ',' ORDER BY context) || '"}' AS manifest FROM perf""", "perf"))
def _(t: Tables):
    return sinks.as_json(sinks.manifest(t.perf, {"entities": "entity"}, {"contexts": "context"}))


_TEXTS = "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus".split()
# both engines spell a double by the fewest digits that give it back, alike from a thousandth to ten million
_NUMBERS = "l_quantity l_extendedprice l_discount l_tax".split()
_CELLS = [f"CAST({c} AS VARCHAR)" for c in [*_TEXTS, *_NUMBERS]] + ["CAST(epoch_us(l_shipdate) AS VARCHAR)"]
_HASHED = "sha256(concat_ws(chr(31), {}))".format(", ".join(f"coalesce({c}, chr(0))" for c in _CELLS))


@query("content_fingerprint", sql(f"""
    SELECT count(*) AS rows, sha256(CAST(count(*) AS VARCHAR) || {" || ".join(
        f"'|' || CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))}) AS content_sha256
    FROM (SELECT {_HASHED} AS h FROM lineitem)"""))
def _(t: Tables):
    """All columns: a change of any cell is seen."""
    return sinks.fingerprint(t.read("lineitem").select(*_TEXTS, *_NUMBERS, F.unix_micros(F.col("l_shipdate").cast("timestamp")).alias("at")))


# B. Predicates and rules ------------------------------------------------------------------

_REQUIRED = ["entity", "context", "candidate", "replicate", "status", "quality", "seed"]


@query("rule_required_columns", sql("""
    SELECT "column", status, n FROM (VALUES ('seed', 'missing'), ('best_quality', 'extra'), ('depth', 'extra'),
      ('executions', 'extra'), ('measured', 'extra'), ('measured_at', 'extra'), ('optimizer', 'extra'), ('optimum', 'extra'),
      ('price', 'extra'), ('reason', 'extra'), ('shots', 'extra'), ('total_cost', 'extra'), ('version', 'extra')
    ) v("column", status), (SELECT count(*) AS n FROM lineitem)"""))
def _(t: Tables):
    return rules.counted_column_report(t.runs, _REQUIRED, "n")


_DOMAINS = {"candidate": CANDIDATES[:6], "context": CONTEXTS, "optimizer": ("COBYLA", "SPSA"), "status": ("success",)}


@query("rule_domain", sql("""
    SELECT rule, violations, violations = 0 AS passed FROM (
      SELECT 'candidate' AS rule, count(*) FILTER (candidate NOT IN ('C01','C02','C03','C04','C05','C06')) AS violations FROM runs
      UNION ALL SELECT 'context', count(*) FILTER (context NOT IN ('A','N','R')) FROM runs
      UNION ALL SELECT 'optimizer', count(*) FILTER (optimizer NOT IN ('COBYLA','SPSA')) FROM runs
      UNION ALL SELECT 'status', count(*) FILTER (status <> 'success') FROM runs)""", "runs"))
def _(t: Tables):
    return rules.evaluate(t.runs, {c: rules.in_domain(c, v) for c, v in _DOMAINS.items()})


@query("rule_domain_exact", sql("""
    SELECT string_agg(DISTINCT candidate, ',' ORDER BY candidate) AS observed,
           coalesce(string_agg(DISTINCT candidate, ',' ORDER BY candidate) FILTER (candidate > 'C06'), '') AS unexpected,
           (SELECT string_agg(c, ',') FROM (VALUES ('C01'), ('C02'), ('C03'), ('C04'), ('C05'), ('C06'), ('C08')) v(c)
            WHERE c NOT IN (SELECT candidate FROM runs)) AS missing, false AS passed FROM runs""", "runs"))
def _(t: Tables):
    return rules.observed_set(t.runs, "candidate", [*CANDIDATES[:6], "C08"])


@query("rule_entity_coverage", sql("""
    SELECT CAST(coalesce(r.e, s.e) AS VARCHAR) AS value, CASE WHEN r.e IS NULL THEN 'missing' ELSE 'unexpected' END AS status
    FROM (SELECT DISTINCT l_partkey AS e FROM lineitem) r
    FULL JOIN (SELECT DISTINCT p_partkey AS e FROM part) s ON r.e = s.e
    WHERE r.e IS NULL OR s.e IS NULL"""))
def _(t: Tables):
    """Large id domains, compared as distinct values on both sides."""
    have = t.read("lineitem").select(F.col("l_partkey").alias("id"))
    return rules.domain_difference(have, "id", t.read("part").select(F.col("p_partkey").alias("id")))


@query("rule_unique", sql("""
    SELECT 'run_key' AS rule, count(*) AS duplicated_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS member_rows FROM (
      SELECT count(*) AS n FROM runs GROUP BY entity, candidate, context, replicate HAVING count(*) > 1)
    UNION ALL
    SELECT 'line_key', count(*), CAST(coalesce(sum(n), 0) AS BIGINT) FROM (
      SELECT count(*) AS n FROM runs GROUP BY replicate, candidate HAVING count(*) > 1)""", "runs"))
def _(t: Tables):
    return rules.duplicate_keys(t.runs, ["entity", "candidate", "context", "replicate"], "run_key").unionByName(
        rules.duplicate_keys(t.runs, ["replicate", "candidate"], "line_key"))


def _row_rules(t: Tables):
    ok = t.success
    return {
        "resource_cap": rules.over_cap(ok, "executions", 48),
        "product_accounting": rules.product_mismatch(ok, "shots", "executions", "total_cost"),
        "not_null_when": rules.missing_measurement(ok, ["measured", "optimum", "quality", "executions", "total_cost"]),
        "ratio_consistency": rules.ratio_mismatch(ok, "measured", "optimum", "quality"),
        "ratio_consistency_lenient": rules.ratio_mismatch(ok, "measured", "optimum", "quality", 1e-10, strict=False),
        "failed_needs_reason": rules.failure_without_reason("status", "reason"),
    }


_RULE_SQL = {
    "resource_cap": "status = 'success' AND executions > 48",
    "product_accounting": "status = 'success' AND shots * executions <> total_cost",
    "not_null_when": "status = 'success' AND measured IS NULL",
    "ratio_consistency": "status = 'success' AND NOT coalesce(abs(measured / optimum - quality) < 1e-9, false)",
    "ratio_consistency_lenient": "status = 'success' AND optimum <> 0 AND abs(measured / optimum - quality) > 1e-10",
    "failed_needs_reason": "status = 'failed' AND coalesce(reason, '') = ''",
}


def _report_sql(names):
    parts = [f"SELECT '{n}' AS rule, count(*) FILTER ({_RULE_SQL[n]}) AS violations FROM runs" for n in names]
    return sql("SELECT rule, violations, violations = 0 AS passed FROM (" + " UNION ALL ".join(parts) + ")", "runs")


def _register_rules():
    for key, names in {
        "rule_resource_cap": ["resource_cap"], "rule_product_accounting": ["product_accounting"],
        "rule_not_null_when": ["not_null_when"],
        "rule_ratio_consistency": ["ratio_consistency", "ratio_consistency_lenient"],
        "rule_failed_needs_reason": ["failed_needs_reason"], "validate_contract": list(_RULE_SQL),
    }.items():
        query(key, _report_sql(names))(
            lambda t, names=names: rules.evaluate(t.runs, {n: c for n, c in _row_rules(t).items() if n in names}))


_register_rules()


@query("rule_version", sql("""
    SELECT string_agg(DISTINCT version, ',' ORDER BY version) AS observed,
           coalesce(string_agg(DISTINCT CASE WHEN version <> '1.0' THEN version END, ','), '') AS unexpected,
           CASE WHEN bool_or(version = '1.0') THEN '' ELSE '1.0' END AS missing,
           count(DISTINCT version) = 1 AND bool_or(version = '1.0') AS passed FROM runs""", "runs"))
def _(t: Tables):
    return rules.observed_set(t.runs, "version", ["1.0"])


@query("rule_numeric_coercible", sql("""
    SELECT rule, violations, violations = 0 AS passed FROM (
      SELECT 'l_quantity' AS rule, count(*) FILTER (TRY_CAST(CAST(l_quantity AS VARCHAR) AS DOUBLE) IS NULL) AS violations FROM lineitem
      UNION ALL SELECT 'l_returnflag', count(*) FILTER (TRY_CAST(l_returnflag AS DOUBLE) IS NULL) FROM lineitem
      UNION ALL SELECT 'l_linenumber', count(*) FILTER (TRY_CAST(CAST(l_linenumber AS VARCHAR) AS DOUBLE) IS NULL) FROM lineitem)"""))
def _(t: Tables):
    return rules.evaluate(t.read("lineitem"), {c: rules.not_numeric(c) for c in ("l_quantity", "l_returnflag", "l_linenumber")})


@query("rule_group_cardinality", sql("""
    SELECT entity, context, count(*) AS rows FROM runs GROUP BY ALL HAVING count(*) <> 200""", "runs"))
def _(t: Tables):
    return rules.group_size_violations(t.runs, ["entity", "context"], 200)


@query("rule_total_rows", sql("""
    SELECT count(*) AS rows, count(DISTINCT entity) * 3 * 7 AS expected, count(*) = count(DISTINCT entity) * 3 * 7 AS passed
    FROM perf""", "perf"))
def _(t: Tables):
    return rules.row_count_rule(t.perf, F.countDistinct("entity") * len(CONTEXTS) * len(CANDIDATES))


@query("rule_subset_across_tables", sql("""
    SELECT count(*) FILTER (l.k IS NULL) AS only_left, count(*) FILTER (o.k IS NULL) AS only_right,
           count(*) FILTER (o.k IS NOT NULL AND l.k IS NOT NULL) AS common
    FROM (SELECT DISTINCT o_orderkey AS k FROM orders) o
    FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) l ON o.k = l.k"""))
def _(t: Tables):
    return rules.id_overlap(t.read("orders").select(F.col("o_orderkey").alias("k")),
                            t.read("lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("value_counts", sql("SELECT event_type, count(*) AS rows FROM events GROUP BY ALL"))
def _(t: Tables):
    return rules.value_counts(t.read("events"), "event_type")


@query("filter_success", sql("SELECT context, count(*) AS n FROM runs WHERE status = 'success' GROUP BY ALL", "runs"))
def _(t: Tables):
    return t.runs.where(t.success).groupBy("context").agg(n_rows().alias("n"))


@query("filter_budget", sql("""
    SELECT budget, entity, context, count(*) AS candidates FROM feasible GROUP BY ALL""", "feasible"))
def _(t: Tables):
    return registries.expand_budgets(t.perf).groupBy("budget", "entity", "context").agg(n_rows().alias("candidates"))


_ASKED = """asked AS (SELECT CAST(5 - r_regionkey AS BIGINT) AS position, CAST(r_regionkey * 7 + 1 AS BIGINT) AS c_custkey FROM region
    UNION ALL SELECT 6, 900000000)"""


def _asked(t: Tables):
    regions = t.read("region").select(
        (5 - F.col("r_regionkey")).cast(BIG).alias("position"), (F.col("r_regionkey") * 7 + 1).cast(BIG).alias("c_custkey"))
    nowhere = t.read("region").where("r_regionkey = 0").select(
        F.lit(6).cast(BIG).alias("position"), (F.col("r_regionkey") + 900000000).cast(BIG).alias("c_custkey"))
    return regions.unionByName(nowhere)


@query("select_by_id_list", sql("""
    SELECT position, c_custkey, c_name, CAST(NULL AS VARCHAR) AS problem FROM asked JOIN customer USING (c_custkey)
    UNION ALL SELECT position, c_custkey, NULL, 'unknown id' FROM asked WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)""",
    extra=_ASKED))
def _(t: Tables):
    """A small request list, in request order, with the unknown ids reported."""
    ids, customers = _asked(t), t.read("customer")
    found = selection.select_by_ids(customers, "c_custkey", ids).select("position", "c_custkey", "c_name")
    lost = selection.unknown_ids(customers, "c_custkey", ids).withColumn("problem", F.lit("unknown id"))
    return found.unionByName(lost, allowMissingColumns=True)


@query("select_batch", sql("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 50 OFFSET 50"))
def _(t: Tables):
    return selection.page(t.read("customer").select("c_custkey", "c_name"), ["c_custkey"], 2, 50)


FORBIDDEN = (  # fixed values: outcome columns that may not be features
    "config_id", "depth", "optimizer", "shots_per_circuit", "expected_cut", "best_sampled_cut", "exact_optimum",
    "expected_approximation_ratio", "best_sampled_approximation_ratio", "optimizer_evaluations", "circuit_executions",
    "total_executed_shots", "two_qubit_gates", "circuit_depth", "simulator_runtime_seconds", "optimal_parameters",
    "oracle_config_id", "oracle_utility", "oracle_quality", "oracle_cost",
)


@query("leakage_guard", sql("""
    SELECT unnest(['depth', 'optimizer']) AS leaked, count(*) AS rows FROM perf""", "perf"))
def _(t: Tables):
    perf = t.perf
    leaked = rules.leakage_report(perf, FORBIDDEN)
    return perf.agg(n_rows().alias("rows")).select(F.explode(F.array(*map(F.lit, leaked))).alias("leaked"), "rows")


@query("project_features", sql("""
    SELECT DISTINCT l_suppkey AS entity, s_name, s_nationkey, l_returnflag AS context
    FROM lineitem JOIN supplier ON s_suppkey = l_suppkey"""))
def _(t: Tables):
    lines = t.read("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_returnflag").alias("context"))
    return (lines.distinct().join(t.read("supplier").select("s_suppkey", "s_name", "s_nationkey"), "s_suppkey")
            .withColumnRenamed("s_suppkey", "entity").dropDuplicates(["entity", "context"]))


@query("filter_cases", rounded_sql(sql("""
    SELECT entity, context, budget, selected_candidate, regret FROM cases WHERE budget = 'B512' AND context = 'N'""", "cases"), "regret"))
def _(t: Tables):
    return rounded(selection.filter_cases(t.cases, budget="B512", context="N", entity="ALL").select(
        "entity", "context", "budget", "selected_candidate", "regret"))


# C. Joins -----------------------------------------------------------------------------------

@query("join_many_to_one", rounded_sql(sql("""
    SELECT context, candidate, count(*) AS n, sum(quality * f_price) AS weighted
    FROM perf JOIN features USING (entity) GROUP BY ALL""", "perf", "features"), "weighted", 3))
def _(t: Tables):
    joined = joins.many_to_one(t.perf, t.features, ["entity"])
    return rounded(joined.groupBy("context", "candidate").agg(
        n_rows().alias("n"), F.sum(F.col("quality") * F.col("f_price")).alias("weighted")), 3)


@query("join_one_to_one", rounded_sql(sql("""
    SELECT a.entity, a.context, a.quality AS first_quality, b.quality AS second_quality
    FROM perf a JOIN perf b ON a.entity = b.entity AND a.context = b.context AND a.candidate = 'C01' AND b.candidate = 'C02'""",
    "perf"), "first_quality second_quality"))
def _(t: Tables):
    side = lambda c, n: t.perf.where(F.col("candidate") == c).select("entity", "context", F.col("quality").alias(n))
    return rounded(joins.one_to_one(side("C01", "first_quality"), side("C02", "second_quality"), ["entity", "context"]))


@query("join_anti_missing", sql("""
    SELECT DISTINCT entity, context FROM runs WHERE (entity, context) NOT IN (SELECT entity, context FROM gap_runs)""",
    "gap_runs"))
def _(t: Tables):
    return joins.missing_keys(t.runs, t.gap_runs, ["entity", "context"])


@query("join_lookup_map", rounded_sql(sql("""
    SELECT p.entity, p.context, p.candidate, p.quality - m.m AS centred FROM perf p
    JOIN (SELECT context, avg(quality) AS m FROM perf GROUP BY context) m USING (context)""", "perf"), "centred"))
def _(t: Tables):
    means = t.perf.groupBy("context").agg(F.avg("quality").alias("context_mean"))
    return rounded(joins.lookup(t.perf, means, ["context"], "context_mean").select(
        "entity", "context", "candidate", (F.col("quality") - F.col("context_mean")).alias("centred")))


@query("join_semi_ids", sql("""
    SELECT context, count(*) AS n FROM runs WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY ALL""", "runs"))
def _(t: Tables):
    ids = t.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return joins.semi(t.runs, ids, ["entity"]).groupBy("context").agg(n_rows().alias("n"))


@query("join_theta_budget", sql("""
    SELECT r_name AS budget, count(*) AS n, count(DISTINCT entity) AS entities FROM perf
    JOIN region ON shots <= 100 + 150 * r_regionkey GROUP BY ALL""", "perf"))
def _(t: Tables):
    """Inequality join with a dimension table instead of literals."""
    limits = t.read("region").select(F.col("r_name").alias("budget"), (F.col("r_regionkey") * 150 + 100).alias("most"))
    return joins.within_limit(t.perf, limits, "shots", "most").groupBy("budget").agg(
        n_rows().alias("n"), F.countDistinct("entity").alias("entities"))


@query("join_lookup_choice", rounded_sql(sql("""
    SELECT f.entity, f.context, f.budget, f.candidate, f.quality FROM feasible f
    JOIN fixed x ON f.budget = x.budget AND f.context = x.context AND f.candidate = x.fixed_candidate""", "fixed"), "quality"))
def _(t: Tables):
    return rounded(joins.chosen_only(t.feasible, t.fixed, ["budget", "context"], "candidate", "fixed_candidate").select(
        "entity", "context", "budget", "candidate", "quality"))


@query("join_reuse_params", sql("""
    SELECT g.context, g.entity, g.candidate, b.n AS donors FROM (
      SELECT DISTINCT r.entity, c.context, d.candidate FROM runs r, (VALUES ('N'), ('R')) c(context),
        (SELECT DISTINCT candidate FROM runs) d) g
    JOIN (SELECT entity, candidate, count(*) AS n FROM runs WHERE context = 'A' AND status = 'success' GROUP BY ALL) b
      USING (entity, candidate)
    WHERE (g.entity, g.context, g.candidate) NOT IN (
      SELECT entity, context, candidate FROM gap_runs WHERE status = 'success')""", "gap_runs"))
def _(t: Tables):
    """Cells without a measurement meet the successful rows of the baseline context."""
    from selectra.operators.incremental import expected_grid

    wanted = expected_grid(t.entities, {"context": ("N", "R"), "candidate": CANDIDATES})
    donors = t.runs.where((F.col("context") == "A") & t.success).groupBy("entity", "candidate").agg(n_rows().alias("donors"))
    return joins.reuse_parameters(t.gap_runs, donors, wanted, ["entity", "candidate"], "context", t.success).select(
        "context", "entity", "candidate", "donors")


@query("build_training_table", rounded_sql(sql("""
    SELECT entity, context, f_price, f_quantity, f_discount, label, label_quality FROM (
      SELECT entity, context, candidate AS label, quality AS label_quality,
             row_number() OVER (PARTITION BY entity, context ORDER BY quality DESC, candidate) AS k FROM perf)
    JOIN features USING (entity) WHERE k = 1""", "perf", "features"), "f_price f_quantity f_discount label_quality"))
def _(t: Tables):
    labels = selection.best_row(t.perf, ["entity", "context"], "quality", "candidate").withColumnsRenamed(
        {"candidate": "label", "quality": "label_quality"})
    rows = t.features.join(t.perf.select("entity", "context").distinct(), "entity")
    return rounded(joins.training_table(rows, labels, ["entity", "context"], FORBIDDEN))


# F. Set operations -----------------------------------------------------------------------------

@query("union_all", sql("""
    SELECT split, count(*) AS n FROM (SELECT * FROM perf_split WHERE split = 'train'
      UNION ALL SELECT * FROM perf_split WHERE split = 'validation') GROUP BY ALL""", "perf_split"))
def _(t: Tables):
    return t.part("train").unionByName(t.part("validation")).groupBy("split").agg(n_rows().alias("n"))


@query("except_keys", sql("""
    SELECT DISTINCT entity, context FROM runs EXCEPT SELECT entity, context FROM gap_runs""", "gap_runs"))
def _(t: Tables):
    key = ["entity", "context"]
    return t.runs.select(*key).distinct().join(t.gap_runs.select(*key), key, "left_anti")


@query("intersect_keys", sql("SELECT o_orderkey AS k FROM orders INTERSECT SELECT l_orderkey FROM lineitem"))
def _(t: Tables):
    return t.read("orders").select(F.col("o_orderkey").alias("k")).intersect(
        t.read("lineitem").select(F.col("l_orderkey").alias("k")))


@query("distinct_rows", sql("SELECT DISTINCT l_suppkey AS entity, l_returnflag AS context, l_linestatus AS line FROM lineitem"))
def _(t: Tables):
    return t.read("lineitem").select(
        F.col("l_suppkey").alias("entity"), F.col("l_returnflag").alias("context"), F.col("l_linestatus").alias("line")).distinct()


# G. Scalar functions ------------------------------------------------------------------------------

@query("safe_ratio", rounded_sql(sql("""
    SELECT graph_id, m, f, CASE WHEN f = 0 THEN CASE WHEN m = 0 THEN 1.0::DOUBLE ELSE 0.0 END ELSE m / f END AS ratio FROM (
      SELECT graph_id, CAST(sum(CASE WHEN u = 0 THEN 1 ELSE 0 END) AS BIGINT) AS m,
             CAST(sum(CASE WHEN v = 11 THEN 1 ELSE 0 END) AS BIGINT) AS f FROM edges GROUP BY ALL)""", "edges"), "ratio"))
def _(t: Tables):
    sides = t.edges().groupBy("graph_id").agg(
        F.count_if(F.col("u") == 0).alias("m"), F.count_if(F.col("v") == 11).alias("f"))
    return rounded(sides.withColumn("ratio", scalar.safe_ratio("m", "f")))


@query("make_run_id", sql("""
    SELECT entity || '_' || candidate || '_' || context || '_S' || replicate AS run_id, count(*) AS n FROM runs GROUP BY ALL""", "runs"))
def _(t: Tables):
    key = scalar.run_id("entity", "candidate", "context", "replicate")
    return t.runs.groupBy(key.alias("run_id")).agg(n_rows().alias("n"))


def _vector_text():
    cells = F.transform("embedding", lambda x: F.format_string("%.4f", x.cast("double")))
    return F.concat(F.lit("("), F.concat_ws(", ", cells), F.lit(" ]"))


@query("parse_param_vector", rounded_sql(sql("""
    SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, list_sum([CAST(printf('%.4f', CAST(x AS DOUBLE)) AS DOUBLE) for x in embedding]) AS total
    FROM embeddings"""), "total", 4))
def _(t: Tables):
    parsed = t.read("embeddings").select("vec_id", scalar.parse_vector(_vector_text()).alias("v"))
    return rounded(parsed.select("vec_id", F.size("v").cast(BIG).alias("n"), F.aggregate(
        "v", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query("split_param_halves", rounded_sql(sql("""
    SELECT vec_id, list_sum([CAST(x AS DOUBLE) for x in embedding[1:32]]) AS first_sum,
           list_sum([CAST(x AS DOUBLE) for x in embedding[33:64]]) AS second_sum, len(embedding) = 64 AS complete FROM embeddings"""),
    "first_sum second_sum", 4))
def _(t: Tables):
    first, second, complete = scalar.vector_halves("embedding", F.lit(32))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(t.read("embeddings").select(
        "vec_id", total(first).alias("first_sum"), total(second).alias("second_sum"), complete.alias("complete")), 4)


@query("derive_record", rounded_sql(sql("""
    SELECT entity || '_' || candidate || '_' || context || '_S' || replicate AS run_id, shots AS shots_per_run, total_cost,
           CASE WHEN optimum = 0 THEN 0 ELSE measured / optimum END AS ratio, status, '1.0' AS schema_version FROM runs""", "runs"), "ratio"))
def _(t: Tables):
    return rounded(t.runs.select(
        scalar.run_id("entity", "candidate", "context", "replicate").alias("run_id"), F.col("shots").alias("shots_per_run"),
        "total_cost", scalar.safe_ratio("measured", "optimum").alias("ratio"), "status", F.lit("1.0").alias("schema_version")))


@query("graph_density", rounded_sql(sql("""
    SELECT graph_id, 2.0::DOUBLE * m / (n * (n - 1)) AS density FROM (SELECT graph_id, count(*) AS n FROM vertices GROUP BY ALL)
    JOIN (SELECT v.graph_id, count(e.u) AS m FROM (SELECT DISTINCT graph_id FROM vertices) v LEFT JOIN edges e USING (graph_id) GROUP BY ALL)
    USING (graph_id)""", "edges", "vertices"), "density"))
def _(t: Tables):
    """Of every graph, without edges as well."""
    counted = t.edges().groupBy("graph_id").agg(n_rows().alias("m"))
    sizes = t.vertices().groupBy("graph_id").agg(n_rows().alias("n")).join(counted, "graph_id", "left").na.fill(0, ["m"])
    return rounded(sizes.select("graph_id", scalar.density("n", "m").alias("density")))


@query("clip_bounds", rounded_sql(sql("""
    SELECT context, sum(least(total_cost / 10240.0::DOUBLE, 1)) AS capped,
           sum(CASE WHEN measured IS NOT NULL THEN greatest(measured / optimum - 0.9, 0) END) AS floored FROM runs GROUP BY ALL""", "runs"),
    "capped floored", 4))
def _(t: Tables):
    spent = F.col("total_cost") / 10240.0
    return rounded(t.runs.groupBy("context").agg(
        F.sum(scalar.clip_upper(spent, 1.0)).alias("capped"),
        F.sum(scalar.clip_lower(F.col("measured") / F.col("optimum") - 0.9, 0.0)).alias("floored")), 4)


@query("category_codes", sql("""
    SELECT optimizer, CASE optimizer WHEN 'SPSA' THEN 0 WHEN 'COBYLA' THEN 1 END AS code, context,
           CASE context WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS context_code, count(*) AS n FROM runs GROUP BY ALL""", "runs"))
def _(t: Tables):
    return t.runs.groupBy(
        "optimizer", scalar.category_code("optimizer", ("SPSA", "COBYLA")).alias("code"), "context",
        scalar.category_code("context", CONTEXTS).alias("context_code")).agg(n_rows().alias("n"))


@query("isclose", sql("""
    SELECT context, count(*) FILTER (abs(quality - best_quality) <= 1e-8 + 1e-5 * abs(best_quality)) AS close, count(*) AS n
    FROM runs GROUP BY ALL""", "runs"))
def _(t: Tables):
    return t.runs.groupBy("context").agg(
        F.count_if(scalar.is_close("quality", "best_quality")).alias("close"), n_rows().alias("n"))


@query("bitstring_labels", sql("""
    SELECT graph_id, node, CAST(sum(freq * ((mask >> CAST(node AS INTEGER)) & 1)) AS BIGINT) AS ones, CAST(sum(freq) AS BIGINT) AS total
    FROM counts10, (SELECT unnest(range(10)) AS node) GROUP BY ALL""", "counts10"))
def _(t: Tables):
    """Labels read from the text form, checked against the mask form."""
    nodes = 10
    # the labels are summed per graph, so that the rows are never multiplied by the nodes
    rows = t.graph_lines(nodes).withColumn("bits", F.lpad(F.bin("mask"), nodes, "0"))
    label = lambda node: scalar.bit_label("bits", F.lit(node), F.lit(nodes))
    sums = rows.groupBy("graph_id").agg(F.sum("freq").alias("total"), *[
        F.sum(F.col("freq") * label(node)).alias(f"_{node}") for node in range(nodes)])
    ones = F.array(*[F.struct(F.lit(node).cast(BIG).alias("node"), F.col(f"_{node}").alias("ones")) for node in range(nodes)])
    return sums.select("graph_id", "total", F.inline(ones)).select("graph_id", "node", "ones", "total")


@query("scope_split_label", sql("""
    SELECT budget || '_' || context AS scope, budget, context, true AS is_cell, count(*) AS n FROM cases GROUP BY ALL""", "cases"))
def _(t: Tables):
    labelled = t.cases.select(F.concat_ws("_", F.col("budget"), F.col("context")).alias("scope"))
    budget, context = scalar.split_scope("scope")
    return labelled.groupBy("scope").agg(n_rows().alias("n")).select(
        "scope", budget.alias("budget"), context.alias("context"),
        scalar.is_cell_scope("scope", ("B256", "B512"), CONTEXTS).alias("is_cell"), "n")


@query("regex_scope_match", sql("""
    SELECT scope, n FROM (SELECT budget || '_' || context AS scope, count(*) AS n FROM cases GROUP BY ALL
      UNION ALL SELECT budget, count(*) FROM cases GROUP BY ALL) WHERE regexp_matches(scope, '^(B256|B512)_(A|N)$')""", "cases"))
def _(t: Tables):
    per = aggregates.explode_scopes(t.cases).groupBy("scope").agg(n_rows().alias("n"))
    return per.where(scalar.is_cell_scope("scope", ("B256", "B512"), ("A", "N")))


@query("marginal_gain", rounded_sql(sql("""
    SELECT context, avg(CASE WHEN budget = 'B512' THEN selected_quality END)
                    - avg(CASE WHEN budget = 'B256' THEN selected_quality END) AS gain FROM cases GROUP BY ALL""", "cases"), "gain"))
def _(t: Tables):
    at = lambda b: F.avg(F.when(F.col("budget") == b, F.col("selected_quality")))
    return rounded(t.cases.groupBy("context").agg((at("B512") - at("B256")).alias("gain")))
