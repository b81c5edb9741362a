"""Semantics of the unified relation."""

from pyspark.sql import functions as F

from bridgelens import bridge_events
from bridgelens.config import DEFAULT_ROUTERS, EVENT_COLUMNS
from bridgelens.operators.filters import router_match
from bridgelens.sources.fixtures import TEST_ROUTERS

from helpers import R1, facts, gmp, transfer


def _rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda d: (d["service"], d["id"]))


def test_columns_and_branch_semantics(spark):
    t, g = facts(spark,
                 [transfer(1, "2024-01-01 10:00:00", user="alice", amount=2, price=50, fee=7,
                           src="Ethereum", dst="ARBITRUM")],
                 [gmp(2, "2024-01-01 11:00:00", user="bob", value=300, amount=4, gas=5, gas_usd=2,
                      express=9, src="Ethereum", dst="Arbitrum")])
    ev = bridge_events(t, g, TEST_ROUTERS)
    assert tuple(ev.columns) == EVENT_COLUMNS
    gm, tr = _rows(ev)
    # N2: transfers lower-case chains, GMP keeps case
    assert (tr["source_chain"], tr["destination_chain"]) == ("ethereum", "arbitrum")
    assert (gm["source_chain"], gm["destination_chain"]) == ("Ethereum", "Arbitrum")
    # N3: user is the recipient for transfers, the sender for GMP
    assert tr["user"] == "alice" and gm["user"] == "bob"
    # N5: amount_usd is a product for transfers and the raw value for GMP
    assert tr["amount_usd"] == 100.0 and gm["amount_usd"] == 300.0
    # fee: token units for transfers; gas x usd, else express fee, for GMP
    assert tr["fee"] == 7.0 and gm["fee"] == 10.0
    assert (tr["service"], gm["service"]) == ("Token Transfers", "GMP")
    assert (tr["raw_asset"], gm["raw_asset"]) == ("usdc", "TKN")


def test_fee_falls_back_to_express(spark):
    _, g = facts(spark, [], [gmp(1, "2024-01-01 00:00:00", gas=[1], express=4),
                             gmp(2, "2024-01-01 00:00:00", gas_usd={"a": 1}, express="5"),
                             gmp(3, "2024-01-01 00:00:00", gas=None, express=None)])
    t, _ = facts(spark)
    fees = {r.id: r.fee for r in bridge_events(t, g, TEST_ROUTERS).collect()}
    assert fees == {1: 4.0, 2: 5.0, 3: None}


def test_amount_usd_null_when_either_side_bad(spark):
    t, g = facts(spark, [transfer(1, "2024-01-01 00:00:00", amount=True, price=2),
                         transfer(2, "2024-01-01 00:00:00", amount=3, price=[1]),
                         transfer(3, "2024-01-01 00:00:00", amount="4", price="2.5")])
    got = {r.id: (r.amount, r.amount_usd) for r in bridge_events(t, g, TEST_ROUTERS).collect()}
    assert got == {1: (None, None), 2: (3.0, None), 3: (4.0, 10.0)}


def test_status_and_router_filters(spark):
    t, g = facts(spark, [
        transfer(1, "2024-01-01 00:00:00"),
        transfer(2, "2024-01-01 00:00:00", status="pending"),
        transfer(3, "2024-01-01 00:00:00", simplified="failed"),
        transfer(4, "2024-01-01 00:00:00", sender="x" + R1.upper() + "y"),  # case-insensitive containment
        transfer(5, "2024-01-01 00:00:00", sender="0xffff"),
        transfer(6, "2024-01-01 00:00:00", sender=None),                    # NULL never matches
    ], [
        gmp(7, "2024-01-01 00:00:00", contract=R1.upper()),
        gmp(8, "2024-01-01 00:00:00", contract="0xdead"),
        gmp(9, "2024-01-01 00:00:00", contract=None),
        gmp(10, "2024-01-01 00:00:00", status="pending"),
    ])
    assert sorted(r.id for r in bridge_events(t, g, TEST_ROUTERS).collect()) == [1, 4, 7]


def test_default_routers_are_the_dashboard_contracts(spark):
    df = spark.createDataFrame([(a.lower(),) for a in DEFAULT_ROUTERS] + [("0x0",)], "a string")
    assert df.where(router_match(F.col("a"), DEFAULT_ROUTERS)).count() == len(DEFAULT_ROUTERS)


def test_union_keeps_duplicates_and_shared_ids(spark):
    t, g = facts(spark, [transfer(1, "2024-01-01 00:00:00"), transfer(1, "2024-01-01 00:00:00")],
                 [gmp(1, "2024-01-01 00:00:00")])
    ev = bridge_events(t, g, TEST_ROUTERS)
    assert ev.count() == 3
    assert ev.select(F.count_distinct("id")).first()[0] == 1  # N4: distinct across services


def test_outer_and_branch_date_filters_agree(spark):
    t, g = facts(spark, [transfer(1, "2024-01-31 23:59:59"), transfer(2, "2024-02-01 00:00:00"),
                         transfer(3, "2023-12-31 23:59:59")],
                 [gmp(4, "2024-01-01 00:00:00"), gmp(5, "2024-02-01 00:00:01")])
    a = bridge_events(t, g, TEST_ROUTERS, "2024-01-01", "2024-01-31", filter_in_branches=True)
    b = bridge_events(t, g, TEST_ROUTERS, "2024-01-01", "2024-01-31", filter_in_branches=False)
    assert sorted(r.id for r in a.collect()) == sorted(r.id for r in b.collect()) == [1, 4]


def test_normalize_gmp_chains_option(spark):
    t, g = facts(spark, [], [gmp(1, "2024-01-01 00:00:00", src="Ethereum", dst="Arbitrum")])
    r = bridge_events(t, g, TEST_ROUTERS, normalize_gmp_chains=True).first()
    assert (r.source_chain, r.destination_chain) == ("ethereum", "arbitrum")


def test_variant_input_is_accepted(spark):
    t, g = facts(spark, [transfer(1, "2024-01-01 00:00:00", amount=2, price=3)])
    tv = t.withColumn("data", F.parse_json("data"))
    assert bridge_events(tv, g, TEST_ROUTERS).first().amount_usd == 6.0
