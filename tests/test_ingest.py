"""Saved relation: round trip, dynamic month overwrite, bounded file count."""

import glob
import importlib

import pytest
from pyspark.sql import functions as F

from bridgelens import bridge_events, load_bridge_events, save_bridge_events
from bridgelens.config import EVENT_COLUMNS
from bridgelens.session import scratch_path
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers

SF = "/root/testdata/sf0.001"


def _key(r):
    return tuple("" if v is None else str(v) for v in r)


def test_round_trip_and_layout(spark):
    ev = bridge_events(fixture_transfers(spark, SF), fixture_gmp(spark, SF), TEST_ROUTERS)
    path = save_bridge_events(ev)
    back = load_bridge_events(spark, path)
    assert sorted(map(_key, back.select(*EVENT_COLUMNS).collect())) == sorted(map(_key, ev.collect()))
    months = back.select("event_month").distinct().count()
    files = glob.glob(f"{path}/version=*/event_month=*/*.parquet")
    # rebalance keeps files near one per month (never tasks x months)
    assert months <= len(files) <= 2 * months
    assert back.where(F.col("event_month") != F.trunc("event_date", "month")).count() == 0


def test_dynamic_overwrite_replaces_only_given_months(spark):
    ev = bridge_events(fixture_transfers(spark, SF), fixture_gmp(spark, SF), TEST_ROUTERS)
    path = scratch_path(spark, "ingest-test")
    save_bridge_events(ev, path)
    before = load_bridge_events(spark, path).count()
    one_month = ev.where(F.trunc(F.to_date("created_at"), "month") == F.lit("1996-03-01").cast("date"))
    n_month = one_month.count()
    save_bridge_events(one_month.limit(1), path)  # re-ingest March 1996 with a single row
    after = load_bridge_events(spark, path)
    assert after.count() == before - n_month + 1


def _hot_month_events(spark):
    from helpers import facts, transfer

    rows = [transfer(i, "2024-01-15 00:00:00" if i % 3 == 0 else f"20{10 + i % 12}-{1 + i % 12:02d}-02 00:00:00",
                     user=f"u{i}", src=f"c{i % 31}") for i in range(30_000)]
    t, g = facts(spark, rows)
    return bridge_events(t, g, TEST_ROUTERS)


def test_hot_month_split_without_aqe(spark):
    """With AQE off the write falls back to range partitioning on (month,
    day, id): the hot month (all on one day) is still split across tasks."""
    ev = _hot_month_events(spark)
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = save_bridge_events(ev)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    hot = glob.glob(f"{path}/version=*/event_month=2024-01-01/*.parquet")
    assert len(hot) > 1
    assert load_bridge_events(spark, path).where(F.col("event_month") == "2024-01-01").count() == 10_000


def test_hot_month_is_split_across_writers(spark):
    """A month with a third of all rows is written by several tasks (AQE
    splits the oversized rebalance partition), not funnelled into one."""
    ev = _hot_month_events(spark)
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    old = spark.conf.get(key)
    spark.conf.set(key, "64k")
    try:
        path = save_bridge_events(ev)
    finally:
        spark.conf.set(key, old)
    hot = glob.glob(f"{path}/version=*/event_month=2024-01-01/*.parquet")
    assert len(hot) > 1
    assert load_bridge_events(spark, path).where(F.col("event_month") == "2024-01-01").count() == 10_000


def test_ingest_widens_a_day_range_to_whole_months(spark):
    from bridgelens import ingest

    t, g = fixture_transfers(spark, SF), fixture_gmp(spark, SF)
    path = scratch_path(spark, "ingest-range")
    ingest(t, g, path, routers=TEST_ROUTERS)
    full = load_bridge_events(spark, path)
    march = full.where(F.col("event_month") == F.lit("1996-03-01").cast("date")).count()
    total = full.count()
    # re-ingest one day: its whole month is rebuilt, nothing is lost
    ingest(t, g, path, "1996-03-15", "1996-03-15", routers=TEST_ROUTERS)
    again = load_bridge_events(spark, path)
    assert again.where(F.col("event_month") == F.lit("1996-03-01").cast("date")).count() == march
    assert again.count() == total


def test_cli_ingest_and_report(spark):
    from bridgelens.__main__ import main

    t, g = fixture_transfers(spark, SF), fixture_gmp(spark, SF)
    tp, gp = scratch_path(spark, "cli-t"), scratch_path(spark, "cli-g")
    t.write.parquet(tp)
    g.write.parquet(gp)
    ev_path, out = scratch_path(spark, "cli-ev"), scratch_path(spark, "cli-out")
    routers = ",".join(TEST_ROUTERS)
    assert main(["ingest", "--transfers", tp, "--gmp", gp, "--out", ev_path, "--routers", routers], spark) == 0
    assert main(["report", "--events", ev_path, "--out", out, "--start", "1996-03-01", "--end", "1999-08-31",
                 "--unit", "week"], spark) == 0
    kpi_row = spark.read.parquet(f"{out}/kpi").collect()
    assert len(kpi_row) == 1 and kpi_row[0].number_of_transfers > 0
    from bridgelens import source_chains, top_chains
    written = [tuple(r) for r in spark.read.parquet(f"{out}/top10_source_volume").collect()]
    ev = load_bridge_events(spark, ev_path)
    direct = [tuple(r) for r in top_chains(source_chains(ev, "1996-03-01", "1999-08-31"), "volume").collect()]
    assert sorted(written) == sorted(direct) and len(written) == 10


def test_null_created_at_is_kept_in_storage_and_dropped_by_ranges(spark):
    from bridgelens import kpi
    from helpers import facts, transfer

    rows = [transfer(1, "2024-01-05 10:00:00", amount=1, price=10), transfer(2, "2024-01-06 10:00:00", amount=1, price=20)]
    t_null = list(transfer(3, "2024-01-07 10:00:00", amount=1, price=30))
    t_null[1] = None
    t, g = facts(spark, rows + [tuple(t_null)])
    ev = bridge_events(t, g, TEST_ROUTERS)
    path = save_bridge_events(ev)
    back = load_bridge_events(spark, path)
    assert back.count() == 3                                   # the undated row is stored (null partition)
    r = kpi(back, "2024-01-01", "2024-01-31").first()
    assert (r.number_of_transfers, r.volume_of_transfers) == (2, 30.0)   # and excluded by the range


def _statuses(spark, rows):
    from helpers import facts

    return facts(spark, rows)


def test_reingest_drops_months_without_rows(spark):
    """A row that turned failed empties its month; the range must lose that month, others stay."""
    from bridgelens import ingest
    from helpers import transfer

    rows = [transfer(1, "2024-01-05 10:00:00"), transfer(2, "2024-02-05 10:00:00"), transfer(3, "2024-03-05 10:00:00")]
    path = scratch_path(spark, "reingest")
    ingest(*_statuses(spark, rows), path, routers=TEST_ROUTERS)
    assert load_bridge_events(spark, path).count() == 3
    rows[1] = transfer(2, "2024-02-05 10:00:00", status="failed")
    ingest(*_statuses(spark, rows), path, "2024-02-01", "2024-02-29", routers=TEST_ROUTERS)
    assert {r.id for r in load_bridge_events(spark, path).collect()} == {1, 3}
    # an open range covers every month
    rows[0] = transfer(1, "2024-01-05 10:00:00", status="failed")
    ingest(*_statuses(spark, rows), path, routers=TEST_ROUTERS)
    assert {r.id for r in load_bridge_events(spark, path).collect()} == {3}
    # half-open: from March on
    rows[2] = transfer(3, "2024-03-05 10:00:00", status="failed")
    ingest(*_statuses(spark, rows), path, "2024-03-15", None, routers=TEST_ROUTERS)
    assert load_bridge_events(spark, path).count() == 0
    # months that no kept manifest names are gone
    ingest(*_statuses(spark, rows), path, "2024-03-15", None, routers=TEST_ROUTERS)
    assert not glob.glob(f"{path}/version=*/event_month=*")


def test_an_empty_relation_loads(spark):
    from bridgelens import ingest, kpi, time_series
    from helpers import transfer

    path = scratch_path(spark, "empty")
    ingest(*_statuses(spark, [transfer(1, "2024-01-05 10:00:00", status="failed")]), path, routers=TEST_ROUTERS)
    ev = load_bridge_events(spark, path)
    assert ev.count() == 0 and ev.columns == [*EVENT_COLUMNS, "event_date", "event_month"]
    r = kpi(ev, "2024-01-01", "2024-12-31").collect()
    assert len(r) == 1 and r[0].number_of_transfers == 0 and r[0].median_bridged_volume is None
    assert time_series(ev, "2024-01-01", "2024-12-31").collect() == []


def test_days_are_utc_days_under_any_session_zone(spark):
    """Zoned timestamps near midnight and month end: saved and in-plan days agree whatever the zone."""
    from datetime import datetime, timezone

    from bridgelens import time_series
    from helpers import facts, transfer

    when = ["2024-01-31 23:30:00", "2024-02-01 00:10:00", "2024-02-29 23:59:59", "2024-03-01 00:00:00"]
    t, g = facts(spark, [transfer(i, w, price=10 * (i + 1)) for i, w in enumerate(when)])
    utc = [datetime.fromisoformat(w).replace(tzinfo=timezone.utc) for w in when]
    zoned = spark.createDataFrame(list(enumerate(utc)), "id long, at timestamp")
    t = t.drop("created_at").join(zoned, "id").withColumnRenamed("at", "created_at").select(t.columns)
    old, found = spark.conf.get("spark.sql.session.timeZone"), []
    path = scratch_path(spark, "zones")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        save_bridge_events(bridge_events(t, g, TEST_ROUTERS), path)
        for zone in ("UTC", "Asia/Tokyo", "America/Los_Angeles"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            for ev in (bridge_events(t, g, TEST_ROUTERS), load_bridge_events(spark, path)):
                days = time_series(ev, "2024-01-31", "2024-02-29", "day").collect()
                found.append([(str(r.date), r.bridged_volume) for r in days])
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert found == [[("2024-01-31", 10.0), ("2024-02-01", 20.0), ("2024-02-29", 30.0)]] * 6


def test_cli_report_defaults_to_the_pages_range(spark):
    from bridgelens.__main__ import _parser, main
    from helpers import facts, transfer

    t, g = facts(spark, [transfer(1, "2019-01-05 10:00:00"), transfer(2, "2024-05-05 10:00:00")])
    path, out = scratch_path(spark, "cli-range"), scratch_path(spark, "cli-range-out")
    save_bridge_events(bridge_events(t, g, TEST_ROUTERS), path)
    assert main(["report", "--events", path, "--out", out], spark) == 0
    assert spark.read.parquet(f"{out}/kpi").first().number_of_transfers == 1
    assert main(["report", "--events", path, "--out", out + "-all", "--start", "all", "--end", "all"], spark) == 0
    assert spark.read.parquet(f"{out}-all/kpi").first().number_of_transfers == 2
    try:
        _parser().parse_args(["report", "--events", path, "--out", out, "--routers", "x"])
        raise AssertionError("report must not take routers: the relation is filtered already")
    except SystemExit:
        pass


def _month_rows(spark, months, amount):
    from helpers import facts, transfer

    return facts(spark, [transfer(k, f"2024-{m:02d}-05 10:00:00", amount=amount) for k, m in enumerate(months)])


def _amounts(frame):
    return sorted((str(r.event_month), r.amount) for r in frame.select("event_month", "amount").collect())


def test_a_crash_before_the_switch_changes_nothing(spark, monkeypatch):
    from bridgelens import ingest

    plan = importlib.import_module("bridgelens.plans.ingest")
    path = scratch_path(spark, "crash")

    def crash(*_):
        raise RuntimeError("lost driver")

    # before the first manifest: there is no relation, and the next run makes one
    monkeypatch.setattr(plan, "_switch", crash)
    with pytest.raises(RuntimeError):
        ingest(*_month_rows(spark, [1, 2], 1), path, routers=TEST_ROUTERS)
    with pytest.raises(FileNotFoundError):
        load_bridge_events(spark, path)
    monkeypatch.undo()
    ingest(*_month_rows(spark, [1, 2], 1), path, routers=TEST_ROUTERS)
    old = _amounts(load_bridge_events(spark, path))
    assert len(old) == 2
    # a written but not switched version, with one month less, is not seen
    monkeypatch.setattr(plan, "_switch", crash)
    with pytest.raises(RuntimeError):
        ingest(*_month_rows(spark, [2], 7), path, routers=TEST_ROUTERS)
    assert _amounts(load_bridge_events(spark, path)) == old
    monkeypatch.undo()
    # after the switch, but before old months go: the new version is whole
    monkeypatch.setattr(plan, "_retire", crash)
    with pytest.raises(RuntimeError):
        ingest(*_month_rows(spark, [2], 7), path, routers=TEST_ROUTERS)
    assert _amounts(load_bridge_events(spark, path)) == [("2024-02-01", 7.0)]
    monkeypatch.undo()
    for _ in range(3):
        ingest(*_month_rows(spark, [2], 8), path, routers=TEST_ROUTERS)
    assert _amounts(load_bridge_events(spark, path)) == [("2024-02-01", 8.0)]
    assert len(glob.glob(f"{path}/_manifests/*.json")) == plan.KEPT


def test_a_reader_keeps_its_version(spark):
    from bridgelens import ingest

    path = scratch_path(spark, "reader")
    ingest(*_month_rows(spark, [1, 2, 3], 1), path, routers=TEST_ROUTERS)
    reader = load_bridge_events(spark, path)
    ingest(*_month_rows(spark, [2], 5), path, routers=TEST_ROUTERS)
    assert _amounts(reader) == [("2024-01-01", 1.0), ("2024-02-01", 1.0), ("2024-03-01", 1.0)]
    assert _amounts(load_bridge_events(spark, path)) == [("2024-02-01", 5.0)]


def test_saves_at_once_keep_both(spark, monkeypatch):
    """A second save takes the number that the first wanted: the first is put on top of it."""
    from bridgelens import ingest

    plan = importlib.import_module("bridgelens.plans.ingest")
    path = scratch_path(spark, "both")
    ingest(*_month_rows(spark, [1, 2, 3], 1), path, routers=TEST_ROUTERS)
    real, raced = plan._read_manifest, []

    def race(spark_, path_, number):
        found = real(spark_, path_, number)
        if not raced:
            raced.append(number)
            ingest(*_month_rows(spark, [3], 9), path, "2024-03-01", "2024-03-31", routers=TEST_ROUTERS)
        return found

    monkeypatch.setattr(plan, "_read_manifest", race)
    ingest(*_month_rows(spark, [2], 5), path, "2024-02-01", "2024-02-29", routers=TEST_ROUTERS)
    assert _amounts(load_bridge_events(spark, path)) == [("2024-01-01", 1.0), ("2024-02-01", 5.0), ("2024-03-01", 9.0)]
