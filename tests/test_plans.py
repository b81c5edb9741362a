"""Physical-plan checks: pushdown, pruning, no JSON after ingest, top-k."""

import pytest

from bridgelens import bridge_events, load_bridge_events, save_bridge_events, source_chains, time_series, top_chains
from bridgelens.sources import TEST_ROUTERS, fixture_gmp, fixture_transfers
from bridgelens.operators.filters import in_date_range

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def events(spark):
    return bridge_events(fixture_transfers(spark, SF), fixture_gmp(spark, SF), TEST_ROUTERS)


@pytest.fixture(scope="module")
def saved(spark, events):
    return load_bridge_events(spark, save_bridge_events(events))


def test_date_filter_reaches_both_scans(events):
    plan = _plan(in_date_range(events, "1996-03-01", "1999-08-31"))
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line or "FileScan" in line]
    scans = [line for line in pushed if "FileScan" in line]
    assert len(scans) == 2
    for s in scans:
        assert "GreaterThanOrEqual(l_shipdate" in s or "GreaterThanOrEqual(o_orderdate" in s


def test_saved_reports_parse_no_json(saved):
    for df in (time_series(saved, "1996-03-01", "1999-08-31", "week"), source_chains(saved)):
        plan = _plan(df)
        assert "parseJson" not in plan and "variant_get" not in plan


def test_saved_range_prunes_month_partitions(saved):
    plan = _plan(in_date_range(saved, "1996-03-01", "1996-04-15"))
    line = next(l for l in plan.splitlines() if "FileScan" in l)
    assert "PartitionFilters: [isnotnull(event_month" in line and "1996-03-01" in line


def test_column_pruning_on_saved(saved):
    plan = _plan(source_chains(saved))
    line = next(l for l in plan.splitlines() if "FileScan" in l)
    schema = line[line.index("ReadSchema"):]
    assert "raw_asset" not in schema and "fee" not in schema


def test_top10_is_take_ordered(saved):
    assert "TakeOrderedAndProject" in _plan(top_chains(source_chains(saved), "volume"))


def test_router_filter_is_one_regex_and_parses_once(spark):
    from helpers import facts, gmp, transfer
    t, g = facts(spark, [transfer(1, "2024-01-01 00:00:00")], [gmp(2, "2024-01-01 00:00:00")])
    plan = _plan(bridge_events(t, g, TEST_ROUTERS))
    # one regex per row for the router filter, not one test per router
    assert plan.count("RLIKE(sender_address") == 1
    # every document is parsed once: one parse per branch
    assert plan.count("parseJson") == 2
