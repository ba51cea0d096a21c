"""Registered queries: resumable ingestion, in batch and as streams over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from selectra.operators import dataset, incremental, rules
from selectra.plans.bindings import CANDIDATES, CONTEXTS, SEED, Tables, sql
from selectra.plans.catalog import query
from selectra.plans.shaping import rounded, rounded_sql
from selectra.session import shared_dir
from selectra.streaming import jobs

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
SEQUENCE = ["measured_at", "price", "executions", "quality", "version"]
KEY = ["entity", "candidate", "context", "replicate"]


def n_rows():
    return F.count(F.lit(1))


@query("completed_keys", sql("""
    SELECT entity, context, candidate, replicate FROM (SELECT DISTINCT entity, context, candidate, replicate FROM gap_runs
      WHERE status = 'success')""", "gap_runs"))
def _(t: Tables):
    return incremental.completed_keys(t.gap_runs, ["entity", "context", "candidate", "replicate"], t.success)


@query("completeness_status", sql("""
    SELECT entity, "done_A", "done_N", "done_R", "done_A" >= 7 AND "done_N" >= 7 AND "done_R" >= 7 AS complete FROM (
      SELECT entity, count(DISTINCT candidate) FILTER (context = 'A') AS "done_A", count(DISTINCT candidate) FILTER (context = 'N') AS "done_N",
             count(DISTINCT candidate) FILTER (context = 'R') AS "done_R" FROM gap_runs WHERE status = 'success' GROUP BY entity)""",
    "gap_runs"))
def _(t: Tables):
    return incremental.completeness(t.gap_runs, "entity", "context", ["candidate"], CONTEXTS, len(CANDIDATES), t.success)


@query("missing_work", sql("""
    SELECT e.entity, c.context, d.candidate FROM entities e, (VALUES ('A'), ('N'), ('R')) c(context), (SELECT DISTINCT candidate FROM runs) d
    WHERE (e.entity, c.context, d.candidate) NOT IN (SELECT entity, context, candidate FROM gap_runs WHERE status = 'success')""",
    "entities", "gap_runs"))
def _(t: Tables):
    return incremental.missing_work(t.gap_runs, t.entities, {"context": CONTEXTS, "candidate": CANDIDATES}, "entity", t.success)


@query("ingestion_report", sql("""
    SELECT entity, context, done, expected, missing, failed_rows,
           CASE WHEN missing = 0 THEN 'complete' WHEN context <> 'N' AND NOT opened THEN 'blocked'
                WHEN done = 0 THEN 'not started' ELSE 'incomplete' END AS state
    FROM (SELECT *, max(CASE WHEN context = 'N' AND missing = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY entity) = 1 AS opened FROM (
      SELECT e.entity, c.context, coalesce(d.done, 0) AS done, 7::BIGINT AS expected,
             greatest(7 - coalesce(d.done, 0), 0)::BIGINT AS missing, coalesce(d.failed_rows, 0) AS failed_rows
      FROM entities e CROSS JOIN (VALUES ('N'), ('A'), ('R')) c(context)
      LEFT JOIN (SELECT entity, context, count(DISTINCT candidate) FILTER (status = 'success') AS done,
                        count(*) FILTER (status <> 'success') AS failed_rows FROM gap_runs GROUP BY entity, context) d
        ON d.entity = e.entity AND d.context = c.context))""", "entities", "gap_runs"))
def _(t: Tables):
    """Every entity and context; N comes first, the others wait for it."""
    return incremental.ingestion_report(
        t.gap_runs, t.entities, "entity", "context", ["candidate"], {c: len(CANDIDATES) for c in ("N", "A", "R")}, t.success, "N")


# The learning dataset -------------------------------------------------------------------------

DATASET = dataset.DatasetSpec(
    "entity", "context", "candidate", ("depth", "optimizer", "shots"), "quality", CONTEXTS, len(CANDIDATES),
    {"optimizer": {"COBYLA": 0, "SPSA": 1}, "context": {"A": 0, "N": 1, "R": 2}})

_DATASET = """means AS (SELECT entity, context, candidate, depth, optimizer, shots, avg(quality) AS mean,
      coalesce(stddev_samp(quality), 0) AS std, count(quality) AS n FROM gap_runs WHERE status = 'success' GROUP BY ALL),
    common AS (SELECT entity FROM (SELECT entity, context, count(DISTINCT candidate) AS k FROM means GROUP BY entity, context)
      GROUP BY entity HAVING count(*) FILTER (context IN ('A', 'N', 'R') AND k = 7) = 3),
    assigned AS (SELECT entity, CASE WHEN r <= a THEN 'train' WHEN r <= a + b THEN 'validation' ELSE 'test' END AS split FROM (
      SELECT entity, row_number() OVER (ORDER BY md5('2027|' || CAST(entity AS VARCHAR)), entity) AS r,
             round_even(count(*) OVER () * CAST(0.70 AS DOUBLE), 0) AS a, round_even(count(*) OVER () * CAST(0.15 AS DOUBLE), 0) AS b
      FROM common)),
    dataset AS (SELECT m.*, split, f_price, f_quantity, f_discount, CASE optimizer WHEN 'COBYLA' THEN 0 ELSE 1 END::BIGINT AS optimizer_code,
             CASE context WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END::BIGINT AS context_code
      FROM means m JOIN assigned USING (entity) LEFT JOIN features USING (entity))"""


def _dataset(t: Tables):
    return dataset.build_dataset(t.gap_runs, t.features, DATASET, SEED, t.success)


@query("dataset_build", rounded_sql(sql("SELECT * FROM dataset", "gap_runs", "features", extra=_DATASET),
                                    "mean std f_price f_quantity f_discount"))
def _(t: Tables):
    """Replicate means, features, codes and splits of the entities that were measured everywhere."""
    return rounded(_dataset(t))


@query("dataset_population", sql("""
    SELECT split, count(DISTINCT entity) AS entities, count(*) AS rows, count(*) FILTER (context = 'A') AS "rows_A",
           count(*) FILTER (context = 'N') AS "rows_N", count(*) FILTER (context = 'R') AS "rows_R" FROM dataset GROUP BY split""",
    "gap_runs", "features", extra=_DATASET))
def _(t: Tables):
    return dataset.population_report(_dataset(t), DATASET)


_LAST = """last_rows AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity, candidate, context, replicate
    ORDER BY measured_at DESC, price DESC, executions DESC, quality DESC, version DESC) AS k FROM runs) WHERE k = 1)"""


def _rows(t: Tables):
    return t.runs.select(*KEY, *SEQUENCE)


@query("upsert_last_wins", rounded_sql(sql("""
    SELECT entity, candidate, context, replicate, price, version FROM last_rows""", "runs", extra=_LAST), "price"))
def _(t: Tables):
    """Old and new halves by time; the later row of a key wins."""
    rows = _rows(t)
    late = F.col("measured_at") >= "2000-06-01"
    merged = incremental.upsert(rows.where(~late), rows.where(late), KEY, SEQUENCE)
    return rounded(merged.select(*KEY, "price", "version"))


@query("upsert_table", rounded_sql(sql("""
    SELECT entity, candidate, context, replicate, price, version FROM last_rows""", "runs", extra=_LAST), "price"))
def _(t: Tables):
    """The stored form: three batches merged into a table whose leaves split as it grows, one of them twice."""
    path, rows = shared_dir(t.spark, "runs-table"), _rows(t)
    early, late = F.col("measured_at") < "1999-01-01", F.col("measured_at") >= "2000-06-01"
    for part in (rows.where(early), rows.where(late), rows.where(~early & ~late), rows.where(late)):
        table = incremental.upsert_table(part, path, KEY, SEQUENCE, split_rows=20_000)
    return rounded(table.read().select(*KEY, "price", "version"))


@query("replace_entity", sql("""
    SELECT entity, version, count(*) AS n FROM (
      SELECT entity, version FROM runs WHERE entity NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
      UNION ALL SELECT entity, '2.0' FROM runs WHERE entity IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)) GROUP BY ALL""", "runs"))
def _(t: Tables):
    """Entities of suppliers in debt are measured again and replaced whole."""
    rows = t.runs.select("entity", "version")
    again = t.read("supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("entity"))
    fresh = rows.join(again, "entity", "left_semi").withColumn("version", F.lit("2.0"))
    return incremental.replace_entities(rows, fresh, "entity").groupBy("entity", "version").agg(n_rows().alias("n"))


# Streams -------------------------------------------------------------------------------------

def event_stream(t: Tables):
    schema = t.read("events").schema
    # a glob names one file as well as a folder of files
    stream = jobs.file_stream(t.spark, f"{t.folder}/events.parquet*", schema)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


@query("stream_dedupe", sql("SELECT DISTINCT user_id, event_type FROM events"))
def _(t: Tables):
    return jobs.distinct_keys(event_stream(t), ["user_id", "event_type"], "dedupe")


@query("stream_replicate_agg", rounded_sql(sql("""
    SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, user_id, event_type, count(*) AS n, avg(value) AS mean
    FROM events GROUP BY ALL"""), "mean"))
def _(t: Tables):
    """Daily means per user and type, whenever the events arrive."""
    table = jobs.window_means(event_stream(t), ["user_id", "event_type"], "value", "ts", "means")
    return rounded(table.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "user_id", "event_type", "n", "mean"))


@query("stream_completeness", sql("""
    SELECT user_id, count(DISTINCT event_type) AS items FROM events WHERE event_type IN (SELECT DISTINCT event_type FROM events)
    GROUP BY user_id HAVING count(DISTINCT event_type) = 5"""))
def _(t: Tables):
    return jobs.completeness(event_stream(t), "user_id", "event_type", EVENT_TYPES, "complete")


@query("stream_rule_monitor", sql("""
    SELECT rule, violations, violations = 0 AS passed FROM (
      SELECT 'negative_value' AS rule, count(*) FILTER (value < 0) AS violations FROM events
      UNION ALL SELECT 'unknown_type', count(*) FILTER (event_type NOT IN ('click', 'view')) FROM events
      UNION ALL SELECT 'large_value', count(*) FILTER (value > 20) FROM events)"""))
def _(t: Tables):
    """Violations per micro-batch, added up."""
    checks = {"negative_value": F.col("value") < 0, "unknown_type": rules.in_domain("event_type", ("click", "view")),
              "large_value": F.col("value") > 20}
    report = jobs.monitor_rules(event_stream(t), checks, "monitor")
    return report.groupBy("rule").agg(F.sum("violations").alias("violations")).withColumn("passed", F.col("violations") == 0)


@query("stream_upsert", rounded_sql(sql("""
    SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k
      FROM events) WHERE k = 1"""), "value"))
def _(t: Tables):
    """The latest event per user and type, merged batch by batch into a keyed table."""
    path = shared_dir(t.spark, "latest")
    rows = event_stream(t).select("user_id", "event_type", "ts", "event_id", "value")
    latest = jobs.upsert_stream(rows, path, ["user_id", "event_type"], ["ts", "event_id"], "latest")
    return rounded(latest.select("user_id", "event_type", "value"))
