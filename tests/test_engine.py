"""Sources and sinks, reports, variants, decoding of errors and the stream."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import reports, variants
from lacuna.sources import tables
from lacuna.streaming.incremental import windowed_gap

ROOT = "/root/testdata/sf0.001"


def test_csv_keys_keep_leading_zeros(spark, tmp_path):
    rows = [("04013000001", "west", 0.1234565, 0.1, True, None, False, 0.2, True), ("48001000002", "south", 1.0, 0.0, True, 0.5, True, None, False)]
    names = "GEOID string, region string, coverage_gap_score double, transport_gap double, transport_defined boolean, building_gap double, building_defined boolean, poi_gap double, poi_defined boolean"
    df = spark.createDataFrame(rows, names)
    for full in (False, True):
        path = str(tmp_path / f"out{full}")
        tables.export_scores(df, path, full)
        back = tables.read_lines(spark, path).collect()
        assert any(r.value.startswith("04013000001,0.123456") for r in back)
        assert len(back[0].value.split(",")) == (9 if full else 2)
    path = str(tmp_path / "template.csv")
    (tmp_path / "template.csv").write_text("GEOID,region,coverage_gap_score\n04013000001,west,0.5\n")
    assert tables.read_template(spark, path).first().GEOID == "04013000001"


def test_components_partitions_and_provenance(spark, tmp_path):
    df = spark.createDataFrame([("a", "v1", 1), ("b", "v1", 2)], "region string, variant string, n int")
    tables.write_component(df, str(tmp_path / "c"))
    back = spark.read.parquet(str(tmp_path / "c")).where("region = 'a'")
    assert back.count() == 1 and "PartitionFilters: [isnotnull(region" in back._jdf.queryExecution().executedPlan().toString()
    for v in ("x", "y"):
        df.select("n").coalesce(1).write.parquet(str(tmp_path / f"transport_{v}.parquet"))
    got = tables.read_variants(spark, str(tmp_path / "transport_*.parquet"), r"transport_(\w+)\.parquet").select("variant").distinct()
    assert sorted(r.variant for r in got.collect()) == ["x", "y"]
    ids = tables.with_row_ids(spark.read.parquet(str(tmp_path / "transport_x.parquet")))
    assert sorted(r.row for r in ids.collect()) == [0, 1]
    assert tables.first_existing(spark, str(tmp_path / "no"), str(tmp_path / "transport_x.parquet")).count() == 2
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, str(tmp_path / "no"))
    assert ("bbox.xmin", "double", True) in tables.schema_report(spark.createDataFrame([], tables.TRACTS))


def test_scan_prunes_and_pushes_down(spark):
    plan = tables.roads(spark, ROOT).select("ax")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "l_returnflag" in plan and "l_extendedprice" not in plan


def errors(r, n):
    return [r.uniform(-0.02, 0.02) for _ in range(n)]


def test_error_decoding_inverts_a_probe(spark):
    r = random.Random(1)
    for own in (0.0, 0.004, 0.01):
        e, d = [*errors(r, 30), own], 0.01
        after = [*e[:-1], own - d]
        mae = lambda x: sum(map(abs, x)) / len(x)
        rmse = lambda x: (sum(v * v for v in x) / len(x)) ** 0.5
        row = spark.range(1).select(
            reports.decode_mae(F.lit(31), F.lit(mae(e)), F.lit(mae(after)), F.lit(d)).alias("a"),
            reports.decode_rmse(F.lit(31), F.lit(rmse(e)), F.lit(rmse(after)), F.lit(d)).alias("b"),
        ).first()
        assert row.a == pytest.approx(own, abs=1e-9) and row.b == pytest.approx(own, abs=1e-9)
    e = [*errors(r, 30), 0.0]
    moved = [*e[:-1], 0.01]
    s = lambda x: (sum(v * v for v in x) / len(x)) ** 0.5
    assert spark.range(1).select(reports.rows_from_rmse(F.lit(s(e)), F.lit(s(moved)), F.lit(0.01))).first()[0] == pytest.approx(31)


def test_perturbed_rows_stay_in_range(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.9999)], "tid int, s double")
    assert [r.perturbed for r in reports.perturb_rows(df, "tid", "s", {1: 0.1}).orderBy("tid").collect()] == [0.6, 0.9999]
    with pytest.raises(Exception, match="out of range: 2"):
        reports.perturb_rows(df, "tid", "s", {2: 0.1}).collect()
    assert [(r.perturbed, r.flipped) for r in reports.perturb_all(df, "s", 0.01).orderBy("tid").collect()] == [(0.51, False), (0.9899, True)]


def test_reports_on_nulls(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 3.0), (None, 0.0)], "g string, v double")
    assert {r.g: r.n for r in reports.value_counts(df, "g").collect()} == {"a": 2, "b": 1}
    got = {r.column_name: (r.nulls, r.distinct, r.zeros) for r in reports.null_profile(df, ["g", "v"]).collect()}
    assert got["v"] == (1, 3, 1) and got["g"][:2] == (1, 2)
    assert [r.column_name for r in reports.null_profile(df.select("v"), ["v"], only_nulls=True).collect()] == ["v"]
    assert {(r.g, r.o) for r in reports.leave_one_out(df, "g", "v", "o").collect()} == {("a", None), ("a", 1.0), ("b", None), (None, None)}
    assert reports.duplicate_keys(df, "g").first().n_extra == 1
    assert all(not r.ok for r in reports.format_checks(spark.createDataFrame([], "k string, s double"), "k", "s", 5, 11).where("check_name IN ('row_count', 'in_range')").collect())


def test_variants_known_values_and_isolation(spark):
    t, r = tables.tracts(spark, ROOT), tables.roads(spark, ROOT)
    some = variants.SWEEP[:2]
    swept = variants.sweep(t, r, some).cache()
    assert swept.count() == 2 * t.count()
    known = {x.tid: x.transport_gap for x in swept.where("variant = 'base' AND transport_gap > 0 AND transport_gap < 1").limit(2).collect()}
    hits = variants.hits(swept, known).collect()
    assert {h.variant for h in hits} >= {"base"} and hits[0].diff == 0
    swept.unpersist()
    written = {}

    def write(df, name):
        if name == "snap_10":
            raise MemoryError("too large")
        written[name] = df.count()

    told = variants.isolated(t, r, some, write)
    assert told["base"] == "done" and told["snap_10"].startswith("failed: MemoryError") and list(written) == ["base"]


def test_stream_gives_the_batch_result(spark, tmp_path):
    events = spark.read.parquet(f"{ROOT}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), (F.col("user_id") % 2 == 0).alias("in_mapped"), (F.col("user_id") % 3 > 0).alias("in_ref"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_gap(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("gaps").start()
    try:
        q.processAllAvailable()
        got = sorted(map(str, spark.table("gaps").collect()))
    finally:
        q.stop()
    assert got == sorted(map(str, windowed_gap(events).collect())) and got


def test_timed_stages_count_all_rows(spark):
    from lacuna.session import timed

    got = list(timed([("a", lambda: spark.range(7)), ("b", lambda: spark.range(3).where("id > 5"))]))
    assert [(name, rows) for name, rows, _ in got] == [("a", 7), ("b", 0)] and all(s >= 0 for *_, s in got)


def test_ends_proxy_and_probe_cases(spark):
    df = spark.createDataFrame([(k, k / 10) for k in range(6)], "k int, v double")
    got = [(r.k, r.side) for r in reports.ends(df, 2, "k").collect()]
    assert sorted(got) == [(0, "first"), (1, "first"), (4, "last"), (5, "last")]
    row = spark.range(1).select(reports.proxy(*map(F.lit, (0.4, 0.2, 0.0, 0.0, 2.0))).alias("a"), reports.proxy(*map(F.lit, (4.0, 2.0, 0.0, 0.0, 1.0))).alias("b"), reports.proxy(F.lit(None).cast("double"), *map(F.lit, (0.2, 0.0, 0.0, 2.0))).alias("c")).first()
    assert row.a == pytest.approx(0.8) and row.b == 0.0 and row.c is None
    case = lambda step: spark.range(1).select(reports.decode_mae_case(F.lit(10), F.lit(0.0), F.lit(step / 10), F.lit(0.01)).alias("c")).first().c
    assert [tuple(case(s)) for s in (0.01, -0.01, 0.02)] == [(0.0, "at_most"), (0.01, "at_least"), (None, "not_one_row")]
    assert case(0.002).error == pytest.approx(0.004) and case(0.002).case == "exact"
    fixed = reports.fix_and_perturb(df, "k", "v", {1: 0.9}, {1: 0.05, 2: 0.1}).orderBy("k").collect()
    assert [r.perturbed for r in fixed[:3]] == [0.0, pytest.approx(0.95), pytest.approx(0.3)]


def test_line_profile_sees_what_a_reader_of_numbers_would_lose(spark):
    lines = spark.createDataFrame([("GEOID,coverage_gap_score",), ("04013,0.123456",), ("14013,0.1234567",), ("04,1.0E-5",)], "value string")
    got = {r.line: (r.n, r.zeros, r.places, r.fields) for r in tables.line_profile(lines).collect()}
    assert got == {"GEOID,coverage_gap_score": (1, 0, 0, 2), "row": (3, 2, 2, 2)}


def test_small_scores_are_exported_without_an_exponent(spark, tmp_path):
    values = [("a", 0.000254), ("b", 1e-6), ("c", 0.0), ("d", 1.0), ("e", 0.25), ("f", None), ("g", 4e-7), ("h", -0.00012)]
    tables.export_scores(spark.createDataFrame(values, "GEOID string, coverage_gap_score double"), str(tmp_path / "out"))
    lines = tables.read_lines(spark, str(tmp_path / "out"))
    assert sorted(r.value for r in lines.collect())[1:] == ["a,0.000254", "b,0.000001", "c,0.0", "d,1.0", "e,0.25", "f,", "g,0.0", "h,-0.00012"]
    assert {r.line: (r.n, r.places) for r in tables.line_profile(lines).collect()}["row"] == (8, 0)
