"""Rules, joins, ingestion and streams on small fixtures."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from selectra.operators import aggregates, dataset, incremental, joins, rules, statistics
from selectra.operators.rules import ContractViolation
from selectra.session import shared_dir
from selectra.sources import readers, sinks
from selectra.streaming import jobs


def test_report_and_fail_fast(spark):
    df = spark.createDataFrame([(1, "success", 4.0, 2.0, 2.0), (2, "failed", None, None, None), (3, "success", 1.0, 0.0, 1.0)],
                               "id bigint, status string, num double, den double, ratio double")
    ok = F.col("status") == "success"
    report = rules.evaluate(df, {"strict": rules.ratio_mismatch(ok, "num", "den", "ratio"),
                                 "lenient": rules.ratio_mismatch(ok, "num", "den", "ratio", strict=False)})
    assert {r["rule"]: r["violations"] for r in report.collect()} == {"strict": 1, "lenient": 0}
    with pytest.raises(ContractViolation, match="strict"):
        rules.raise_on_fail(report)


def test_cardinality_promises(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, x string")
    twice = spark.createDataFrame([(1, 1), (1, 2), (2, 3)], "k bigint, y bigint")
    for broken, reason in ((joins.one_to_one(left, twice, ["k"]), "right side: duplicate rows"),
                           (joins.one_to_one(twice, left, ["k"]), "left side: duplicate rows"),
                           (joins.many_to_one(left, twice, ["k"]), "feature side: duplicate rows"),
                           (joins.many_to_one(left, twice.where("y = 3"), ["k"]), "missing features")):
        for read in (lambda df: df.collect(), lambda df: df.count()):  # whatever is read of it
            with pytest.raises(Exception, match=reason):
                read(broken)
    with pytest.raises(ContractViolation, match="outcome"):
        joins.training_table(left.withColumn("depth", F.lit(1)), left, ["k"], ["depth"])


def test_aliases(spark):
    df = spark.createDataFrame([(1,)], "shots bigint")
    assert readers.resolve_aliases(df, {"cost": ["total", "shots"]}).columns == ["cost"]
    with pytest.raises(ValueError, match="available"):
        readers.resolve_aliases(df, {"cost": ["nothing"]})


def test_csv_keeps_the_version_as_text(spark):
    df = spark.createDataFrame([("1.0", float("nan")), ("1.10", 2.0)], "version string, x double")
    [path] = sinks.write_tables({"t": df}, shared_dir(spark, "csv-test"), "csv")
    back = readers.scan_runs(spark, path, df.schema).orderBy("version").collect()
    assert [tuple(r) for r in back] == [("1.0", None), ("1.10", 2.0)]


def test_fingerprint_sees_multisets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k bigint, v string")
    digest = lambda df: sinks.fingerprint(df).first()["content_sha256"]
    assert digest(a) == digest(a.orderBy(F.desc("k")).repartition(5))
    assert digest(a) != digest(a.distinct()) and digest(a) != digest(a.unionByName(a))


def test_upsert_table_is_idempotent(spark):
    path = shared_dir(spark, "upsert-test")
    rows = lambda *r: spark.createDataFrame(list(r), "k bigint, seq bigint, v string")
    first, second = rows((1, 1, "a"), (2, 1, "b"), (2, 1, "b")), rows((2, 2, "c"), (3, 2, "d"))
    for batch in (first, second, second, first):
        table = incremental.upsert_table(batch, path, ["k"], ["seq"], split_rows=2)
    got = sorted((r["k"], r["v"]) for r in table.read().collect())
    assert got == [(1, "a"), (2, "c"), (3, "d")]


def test_streams_equal_batch_over_several_files(spark):
    folder = shared_dir(spark, "stream-test")
    start = dt.datetime(2024, 1, 1)
    rows = [(i % 4, "abc"[(i // 4) % (3 if i % 4 else 2)], start + dt.timedelta(hours=i), float(i)) for i in range(96)]
    schema = "user bigint, kind string, ts timestamp, value double"
    for part in range(4):
        spark.createDataFrame(rows[part * 24:(part + 1) * 24], schema).coalesce(1).write.mode("append").parquet(folder)
    batch = spark.createDataFrame(rows, schema)
    stream = lambda: jobs.file_stream(spark, folder, batch.schema, files_per_trigger=1)

    unique = jobs.drain_append(jobs.dedupe(stream(), ["user", "kind"], "ts", "10 days"), "t1")
    assert sorted(map(tuple, unique.collect())) == sorted(map(tuple, batch.select("user", "kind").distinct().collect()))

    key = ["window_start", "user"]
    means = jobs.drain_updates(jobs.windowed_means(stream(), ["user"], "value", "ts", "2 days"), "t2", key)
    expected = batch.groupBy(F.window("ts", "1 day")["start"].alias("window_start"), "user").agg(
        F.count("*").alias("n"), F.avg("value").alias("mean"))
    assert sorted(map(str, means.collect())) == sorted(map(str, expected.select(*means.columns).collect()))

    done = jobs.completeness(stream(), "user", "kind", ("a", "b", "c"), "t3")
    assert sorted(r["user"] for r in done.collect()) == [1, 2, 3]
    checked = jobs.monitor_rules(stream(), {"high": F.col("value") > 90}, "t4")
    assert checked.agg(F.sum("violations")).first()[0] == 5


def test_missing_work_and_reuse(spark):
    runs = spark.createDataFrame([(1, "N0", "C1", "success"), (1, "N1", "C1", "success"), (2, "N0", "C1", "failed")],
                                 "entity bigint, context string, candidate string, status string")
    todo = incremental.missing_work(runs, runs.select("entity"), {"context": ["N0", "N1"], "candidate": ["C1"]}, "entity",
                                    F.col("status") == "success")
    assert sorted((r["entity"], r["context"]) for r in todo.collect()) == [(2, "N0"), (2, "N1")]


def test_histogram_takes_the_range_of_the_data_and_keeps_outer_values_apart(spark):
    df = spark.createDataFrame([(-9.0,), (0.0,), (10.0,), (500.0,), (None,)], "x double")
    rows = lambda **k: {r["bin"]: r["rows"] for r in aggregates.histogram(df, "x", 8, **k).collect()}
    assert rows() == {1: 3, 8: 1}
    assert rows(low=0.0, high=64.0) == {0: 1, 1: 1, 2: 1, 9: 1}
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r["bin"]: r["rows"] for r in aggregates.histogram(one, "x", 8).collect()} == {1: 2}


def test_groups_of_nulls_and_scopes_of_zeros_keep_their_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    rows = {r["g"]: r for r in aggregates.describe(df, ["g"], "x").collect()}
    assert rows["a"]["median"] == 2.0 and rows["b"]["n"] == 0 and rows["b"]["median"] is None
    zeros = spark.createDataFrame([("z", 0.0), ("z", 0.0), ("y", 1.0)], "g string, d double")
    ranks = {r["g"]: r for r in statistics.signed_rank(zeros, ["g"], "d").collect()}
    assert ranks["z"]["n"] == 0 and ranks["z"]["z"] is None and ranks["y"]["n"] == 1


def test_aliases_that_are_missing_are_reported_together(spark):
    df = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    assert readers.resolve_aliases(df, {"x": ["q", "b"], "y": ["r"]}, optional=["y"]).columns == ["x"]
    with pytest.raises(ValueError, match="x.*y"):
        readers.resolve_aliases(df, {"x": ["q"], "y": ["r"]})


def test_a_cluster_must_name_its_shared_folder(spark):
    from types import SimpleNamespace

    from selectra.session import shared_root

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", applicationId="a"))
    with pytest.raises(ValueError, match="share"):
        shared_root(far)


def test_stream_totals_equal_the_batch_with_a_late_file(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, 1 + n)
    files = [[(1, day(0), "a", 1.0)], [(1, day(20), "b", 2.0), (2, day(20), "a", 3.0)],
             [(1, day(0), "c", 5.0), (1, day(0), "a", None)], [(2, day(20), "a", 7.0)]]  # the third comes 20 days late
    schema = "user bigint, ts timestamp, kind string, value double"
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: jobs.file_stream(spark, str(tmp_path / "in"), batch.schema, files_per_trigger=1)
    assert set(jobs.distinct_keys(stream(), ["user", "kind"], "d").collect()) == set(
        batch.select("user", "kind").distinct().collect())
    means = {(r["window_start"], r["user"]): (r["n"], r["mean"]) for r in jobs.window_means(
        stream(), ["user"], "value", "ts", "m").collect()}
    assert means == {(day(0), 1): (3, 3.0), (day(20), 1): (1, 2.0), (day(20), 2): (2, 5.0)}
    many = [str(i) for i in range(70)]  # more items than the bits of a mask
    assert jobs.completeness(stream(), "user", "kind", many, "c").count() == 0
    assert [r["user"] for r in jobs.completeness(stream(), "user", "kind", ["a", "b", "c"], "e").collect()] == [1]


@pytest.mark.parametrize("buckets", [256, 3])
def test_pages_are_found_by_counts(spark, monkeypatch, buckets):
    from selectra.operators import selection

    monkeypatch.setattr(selection, "PAGE_BUCKETS", buckets)
    values = [None] * 5 + [7.0] * 40 + [float(i % 23) for i in range(60)]  # nulls, a hot value, ties
    df = spark.createDataFrame([(i, v, str(v)) for i, v in enumerate(values)], "id bigint, x double, t string").repartition(4)
    whole = [i for i, _ in sorted(enumerate(values), key=lambda p: (p[1] is not None, p[1] or 0.0, p[0]))]
    for batch in range(1, 13):
        got = [r["id"] for r in selection.page(df, ["x", "id"], batch, 10).collect()]
        assert got == whole[(batch - 1) * 10:batch * 10], batch
    assert selection.page(df.where("id < 0"), ["x", "id"], 1, 10).count() == 0
    assert [r["id"] for r in selection.page(df, ["t", "id"], 1, 3).collect()] == sorted(range(105), key=lambda i: (str(float(values[i])) if values[i] is not None else "None", i))[:3]


def test_limits_are_few(spark, monkeypatch):
    monkeypatch.setattr(joins, "MOST_LIMITS", 2)
    rows = spark.createDataFrame([(1,), (5,)], "cost bigint")
    limits = spark.createDataFrame([(3,), (9,)], "most bigint")
    assert joins.within_limit(rows, limits, "cost", "most").count() == 3
    with pytest.raises(ValueError, match="more than 2"):
        joins.within_limit(rows, limits.union(limits), "cost", "most")


def test_fingerprint_sees_the_last_digit(spark):
    one = lambda x: sinks.fingerprint(spark.createDataFrame([(x,)], "x double")).first()["content_sha256"]
    assert one(0.1) != one(0.1 + 2 ** -56) and one(1e300) != one(1.0000000000000002e300) and one(None) != one(0.0)


def test_ingestion_report_blocks_contexts_until_the_first_is_complete(spark):
    runs = spark.createDataFrame(
        [("g1", "base", c, "success") for c in "abc"] + [("g1", "noisy", "a", "success"), ("g1", "noisy", "a", "success"),
         ("g1", "noisy", "b", "failed"), ("g2", "base", "a", "success"), ("g2", "noisy", "a", "success"),
         ("g1", "other", "a", "success"), (None, "base", "a", "success")], "g string, x string, c string, status string")
    entities = spark.createDataFrame([("g1",), ("g2",), ("g3",), ("g1",)], "g string")
    report = incremental.ingestion_report(runs, entities, "g", "x", ["c"], {"base": 3, "noisy": 2}, F.col("status") == "success", "base")
    assert sorted(map(tuple, report.collect())) == [
        ("g1", "base", 3, 3, 0, 0, "complete"), ("g1", "noisy", 1, 2, 1, 1, "incomplete"),
        ("g2", "base", 1, 3, 2, 0, "incomplete"), ("g2", "noisy", 1, 2, 1, 0, "blocked"),
        ("g3", "base", 0, 3, 3, 0, "not started"), ("g3", "noisy", 0, 2, 2, 0, "blocked")]
    assert incremental.ingestion_report(runs.limit(0), entities.limit(0), "g", "x", ["c"], {"base": 3}, F.col("status") == "success",
                                        "base").count() == 0


def test_dataset_holds_the_common_population_alone(spark):
    spec = dataset.DatasetSpec("g", "x", "c", ("d",), "y", ("n", "m"), 2, {"x": {"n": 0, "m": 1}})
    runs = spark.createDataFrame(
        [(g, x, c, 1, y, "success") for g in range(20) for x in "nm" for c in "ab" for y in (1.0, 3.0)]
        + [(50, "n", "a", 1, 1.0, "success"), (50, "n", "b", 1, 1.0, "success"), (50, "m", "a", 1, 1.0, "success"),
           (50, "m", "b", 1, 1.0, "failed"), (3, "other", "a", 1, 9.0, "success"), (None, "n", "a", 1, 1.0, "success")],
        "g bigint, x string, c string, d int, y double, status string")
    features = spark.createDataFrame([(g, float(g)) for g in range(1, 20)], "g bigint, f double")
    rows = dataset.build_dataset(runs, features, spec, 7, F.col("status") == "success").collect()
    assert len(rows) == 80 and {r.g for r in rows} == set(range(20))
    assert all((r["mean"], r.n) == (2.0, 2) and abs(r["std"] - 2 ** 0.5) < 1e-12 for r in rows)
    assert all(r.f == (None if r.g == 0 else float(r.g)) and r.x_code == "nm".index(r.x) for r in rows)
    split = {r.g: r.split for r in rows}
    assert sorted(split.values()).count("train") == 14 and list(split.values()).count("validation") == 3
    assert all(split[r.g] == r.split for r in rows)
    assert dataset.build_dataset(runs.limit(0), features, spec, 7).count() == 0


def test_schema_answers_count_their_rows(spark, tables):
    from selectra.plans.catalog import all_queries

    report = all_queries()["rule_required_columns"](spark, tables.folder).collect()
    assert {r["n"] for r in report} == {tables.read("lineitem").count()} and len(report) == 13
    leaked = all_queries()["leakage_guard"](spark, tables.folder).collect()
    assert {(r["leaked"], r["rows"]) for r in leaked} == {(c, tables.perf.count()) for c in ("depth", "optimizer")}
    empty = rules.counted_column_report(spark.createDataFrame([], "a bigint"), ["a"], "n")
    assert empty.columns == ["column", "status", "n"] and empty.collect() == []
