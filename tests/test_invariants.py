"""Cross-report invariants on the sf0.001 fixture, plus a skewed input."""

import pytest
from pyspark.sql import functions as F

from bridgelens import (bridge_events, destination_chains, kpi, load_bridge_events, refresh, source_chains, time_series,
                        top_chains, write_report)
from bridgelens.functions.labels import with_display_names
from bridgelens.session import scratch_path
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers

from helpers import facts, gmp, transfer

SF = "/root/testdata/sf0.001"
S, E = "1995-01-01", "2001-12-31"


@pytest.fixture(scope="module")
def ev(spark):
    df = bridge_events(fixture_transfers(spark, SF), fixture_gmp(spark, SF), TEST_ROUTERS).cache()
    yield df
    df.unpersist()


@pytest.mark.parametrize("unit", ["month", "week", "day"])
def test_last_running_total_is_sum_of_buckets(ev, unit):
    rows = time_series(ev, S, E, unit).collect()
    assert rows[-1].total_bridged_volume == sum(r.bridged_volume for r in rows if r.bridged_volume is not None)
    assert rows[-1].total_number_of_bridges == sum(r.number_of_bridges for r in rows)


def test_chain_volumes_add_up_to_kpi(ev):
    raw = ev.select(F.sum("amount_usd")).first()[0]
    per_chain = source_chains(ev).agg(F.sum("volume_usd")).first()[0]
    assert abs(per_chain - raw) <= 0.5 * source_chains(ev).count()
    assert kpi(ev).first().volume_of_transfers == round(raw)


def test_distinct_total_at_most_sum_over_chains(ev):
    total = kpi(ev).first().number_of_transfers
    assert total <= destination_chains(ev).agg(F.sum("number_of_transfers")).first()[0]


@pytest.mark.parametrize("by", ["volume", "count"])
def test_top10_is_prefix_of_ordered_report(ev, by):
    rep = source_chains(ev)
    top = top_chains(rep, by).collect()
    col = "volume_usd" if by == "volume" else "number_of_transfers"
    ordered = sorted((r[col] for r in rep.collect() if r[col] is not None), reverse=True)
    assert [r[col] for r in top] == ordered[:10]


def test_refresh_page(spark, ev):
    t, g = fixture_transfers(spark, SF), fixture_gmp(spark, SF)
    page = refresh(t, g, S, E, "week", TEST_ROUTERS, path=scratch_path(spark, "refresh"))
    assert set(page) >= {"kpi", "time_series", "source_chain", "destination_chain", "top10_source_volume"}
    assert page["kpi"].first() == kpi(ev, S, E).first()
    assert page["time_series"].count() == time_series(ev, S, E, "week").count()
    plan = page["top10_source_volume"]._jdf.queryExecution().toString()
    assert "Aggregate" not in plan  # the lists read the finished chain report


def test_refresh_reads_and_writes_only_the_months_of_its_range(spark):
    t, g = fixture_transfers(spark, SF), fixture_gmp(spark, SF)
    path = scratch_path(spark, "refresh-range")
    refresh(t, g, "1996-03-10", "1996-04-20", "day", TEST_ROUTERS, path=path)
    months = {str(r[0]) for r in load_bridge_events(spark, path).select("event_month").distinct().collect()}
    assert months == {"1996-03-01", "1996-04-01"}


def test_report_sink_and_display_names(spark, ev):
    path = write_report(with_display_names(source_chains(ev)), scratch_path(spark, "report"))
    back = spark.read.parquet(path)
    assert back.columns == ["Source Chain", "Number of Transfers", "Number of Users", "Volume of Transfers (USD)"]
    assert back.count() == source_chains(ev).count()


def test_hot_chain_and_hot_month(spark):
    """One chain and one month hold a third of all rows; results stay whole and exact."""
    rows = []
    for i in range(3000):
        hot = i % 3 == 0
        rows.append(transfer(i, "2024-01-15 10:00:00" if hot else f"2024-{2 + i % 10:02d}-0{1 + i % 9} 00:00:00",
                             user=f"u{i % 97}", amount=1, price=1 + i % 50, src="HOT" if hot else f"c{i % 40}"))
    t, g = facts(spark, rows, [gmp(10_000 + i, "2024-01-15 00:00:00", user=f"g{i}") for i in range(50)])
    ev = bridge_events(t, g, TEST_ROUTERS)
    rep = {r.source_chain: r for r in source_chains(ev).collect()}
    assert rep["hot"].number_of_transfers == 1000
    assert rep["hot"].volume_usd == float(sum(1 + i % 50 for i in range(0, 3000, 3)))
    jan = time_series(ev, None, None, "month").first()
    assert jan.number_of_bridges == 1050
    vals = [float(1 + i % 50) for i in range(3000)] + [100.0] * 50
    vals.sort()
    assert kpi(ev).first().median_bridged_volume == round((vals[1524] + vals[1525]) / 2)


def test_page_with_approx_distinct(spark, ev):
    from bridgelens import page
    exact = page(ev, S, E, "month")
    approx = page(ev, S, E, "month", approx_distinct=True)
    e, a = exact["kpi"].first(), approx["kpi"].first()
    assert a.volume_of_transfers == e.volume_of_transfers          # sums stay exact
    assert abs(a.number_of_transfers - e.number_of_transfers) <= 0.1 * e.number_of_transfers
