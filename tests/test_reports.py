"""Report semantics and cross-report invariants."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from bridgelens import (bridge_events, chain_labels, destination_chains, kpi, source_chains,
                        time_series, top_chains)
from bridgelens.sources.fixtures import TEST_ROUTERS

from helpers import facts, gmp, transfer


@pytest.fixture(scope="module")
def small(spark):
    t, g = facts(spark, [
        transfer(1, "2024-01-01 00:00:00", user="a", amount=1, price=10, src="A"),
        transfer(1, "2024-01-15 12:00:00", user="a", amount=1, price=20, src="A"),
        transfer(2, "2024-01-31 23:59:59", user="b", amount=1, price=30, src="B"),
        transfer(3, "2024-02-05 08:00:00", user="b", amount=1, price=40, src="B"),
        transfer(4, "2024-02-29 23:00:00", user="c", amount="x", price=50, src="C"),
        transfer(5, "2024-03-01 00:00:00", user="c", amount=1, price=60, src="C"),
    ], [
        gmp(3, "2024-01-03 00:00:00", user="a", value=5, src=None),
        gmp(6, "2024-02-10 00:00:00", user=None, value=7, src="A"),
    ])
    return bridge_events(t, g, TEST_ROUTERS)


def test_kpi_values_and_inclusive_end(small):
    r = kpi(small, "2024-01-01", "2024-02-29").first().asDict()
    # rows in range: ids 1,1,2,3 (transfers), 4 (amount NULL), 3, 6 (gmp); 2024-03-01 excluded
    assert r["number_of_transfers"] == 5            # 1,2,3,4,6
    assert r["number_of_users"] == 3                # a,b,c (NULL user not counted)
    assert r["volume_of_transfers"] == 112.0        # 10+20+30+40+5+7
    assert r["median_bridged_volume"] == 15.0       # of 5,7,10,20,30,40 -> (10+20)/2
    assert r["maximum_bridged_volume"] == 40.0
    assert r["average_bridged_volume"] == 19.0      # 112/6 = 18.67 -> 19


def test_kpi_median_agrees_with_sparks(small):
    from pyspark.sql import functions as F

    from bridgelens.operators.filters import in_date_range

    e = kpi(small, "2024-01-01", "2024-02-29").first()
    s = in_date_range(small, "2024-01-01", "2024-02-29").agg(F.round(F.median("amount_usd"))).first()[0]
    assert e.median_bridged_volume == s


def test_an_overflowing_product_is_null(spark):
    from helpers import facts, transfer

    t, g = facts(spark, [transfer(1, "2024-01-05 10:00:00", amount=1e200, price=1e200),
                         transfer(2, "2024-01-06 10:00:00", amount=2, price=10)])
    ev = bridge_events(t, g, TEST_ROUTERS)
    r = kpi(ev, "2024-01-01", "2024-01-31").first()
    assert (r.number_of_transfers, r.volume_of_transfers, r.median_bridged_volume) == (2, 20.0, 20.0)
    s = time_series(ev, "2024-01-01", "2024-01-31", "month").first()
    assert (s.bridged_volume, s.total_bridged_volume, s.avg_bridged_volume) == (20.0, 20.0, 20.0)


@pytest.mark.parametrize("text", ["2024-01-15garbage", "2024-01-20 not a date", "2024-13-01", "20240", ""])
def test_garbage_dates_are_refused(small, text):
    with pytest.raises(ValueError):
        kpi(small, text, "2024-12-31")


def test_kpi_empty_range(small):
    r = kpi(small, "2030-01-01", "2030-12-31").collect()
    assert len(r) == 1
    r = r[0]
    assert r.number_of_transfers == 0 and r.number_of_users == 0
    assert r.volume_of_transfers is None and r.median_bridged_volume is None


def test_start_after_end_raises(small):
    with pytest.raises(ValueError):
        kpi(small, "2024-02-01", "2024-01-01")


def test_bad_unit_raises(small):
    with pytest.raises(ValueError):
        time_series(small, None, None, "hour")


def test_time_series_month(small):
    rows = time_series(small, "2024-01-01", "2024-02-29", "month").collect()
    assert [r.date for r in rows] == [date(2024, 1, 1), date(2024, 2, 1)]
    jan, feb = rows
    assert (jan.number_of_bridges, jan.number_of_bridgers, jan.bridged_volume) == (3, 2, 65.0)
    assert (feb.number_of_bridges, feb.number_of_bridgers, feb.bridged_volume) == (3, 2, 47.0)
    # N8: running totals add bucket-level values; id 3 counts in both months
    assert (feb.total_bridged_volume, feb.total_number_of_bridges) == (112.0, 6)
    assert jan.avg_bridge_count_per_user == 1.5
    assert jan.avg_bridged_volume == pytest.approx(65.0 / 4)


def test_time_series_week_starts_monday(small):
    rows = time_series(small, "2024-01-01", "2024-01-31", "week").collect()
    assert all(r.date.weekday() == 0 for r in rows)
    assert rows[0].date == date(2024, 1, 1)


def test_time_series_null_users_give_null_ratio(spark):
    t, g = facts(spark, [], [gmp(1, "2024-01-01 00:00:00", user=None)])
    r = time_series(bridge_events(t, g, TEST_ROUTERS), None, None, "day").first()
    assert r.number_of_bridgers == 0 and r.avg_bridge_count_per_user is None


def test_chain_reports_null_group_and_order(small):
    rows = source_chains(small).collect()
    names = [r.source_chain for r in rows]
    assert None in names                                  # N12
    counts = [r.number_of_transfers for r in rows]
    assert counts == sorted(counts, reverse=True)
    total = sum(r.volume_usd or 0 for r in rows)
    assert total == small.select(F.sum("amount_usd")).first()[0]


def test_top10_ties_and_prefix(spark):
    rows = [transfer(i, "2024-01-01 00:00:00", dst=f"c{i:02d}", amount=1, price=100 if i < 5 else 10)
            for i in range(14)]
    t, g = facts(spark, rows)
    rep = destination_chains(bridge_events(t, g, TEST_ROUTERS))
    top = [r.destination_chain for r in top_chains(rep, "volume").collect()]
    assert top[:5] == ["c00", "c01", "c02", "c03", "c04"]   # ties broken by name
    assert len(top) == 10
    by_count = [r.destination_chain for r in top_chains(rep, "count", 3).collect()]
    assert by_count == ["c00", "c01", "c02"]


def test_chain_labels(small):
    rows = chain_labels(destination_chains(small), "usd").collect()
    assert all(r.volume_label.startswith("$") for r in rows if r.volume_usd is not None)
