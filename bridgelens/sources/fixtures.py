"""Bridge fact tables derived from the TPC-H-style test data.

``transfers`` gets one row per ``lineitem`` row and ``gmp`` one row per
``orders`` row, with a JSON ``data`` column built from literals and integer
casts only (so any SQL engine produces byte-identical text).  Every numeric
path cycles through numbers, numeric text, other text, booleans, nulls, arrays
and objects, which exercises the guarded parsing.  The rules are in
FIXTURES.md; the oracle SQL in ``bridgelens.oracle`` mirrors them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgelens.sources.tables import read_table

# --- Fixed values: test router contracts R1..R5 -------------------------------
TEST_ROUTERS: tuple[str, ...] = (
    "0x" + "a1" * 20,
    "0x" + "b2" * 20,
    "0x" + "c3" * 20,
    "0x" + "d4" * 20,
    "0x" + "e5" * 20,
)


def _s(c: Column) -> Column:
    return c.cast("bigint").cast("string")


def _q(c: Column) -> Column:
    """JSON string literal around text that needs no escaping."""
    return F.concat(F.lit('"'), c, F.lit('"'))


def _pick(key: Column, cases: dict[int, Column], default: Column) -> Column:
    out = None
    for k, v in cases.items():
        out = (F.when(key == k, v) if out is None else out.when(key == k, v))
    return out.otherwise(default)


def transfers_from(lineitem: DataFrame) -> DataFrame:
    l = F.col
    r1, r2 = TEST_ROUTERS[0], TEST_ROUTERS[1]
    qty = _s(l("l_quantity"))
    amount = _pick(l("l_orderkey") % 11, {
        0: F.lit("[1,2]"), 1: F.lit('{"x":1}'), 2: F.lit("null"), 3: F.lit("true"),
        4: F.lit('"abc"'), 5: _q(qty)}, qty)
    fee = F.when(l("l_linenumber") == 1, F.lit("[]")).otherwise(_s(l("l_linenumber")))
    price = F.when(l("l_partkey") % 13 == 0, F.lit("[]")).otherwise(
        _s(F.round(l("l_extendedprice") * 100)))
    data = F.concat(
        F.lit('{"send":{"original_source_chain":'), _q(F.concat(F.lit("Nation_"), _s(l("l_suppkey") % 25))),
        F.lit(',"original_destination_chain":'), _q(F.concat(F.lit("NATION_"), _s(l("l_partkey") % 25))),
        F.lit(',"amount":'), amount,
        F.lit(',"fee_value":'), fee,
        F.lit('},"link":{"price":'), price,
        F.lit(',"asset":'), _q(F.concat(F.lit("a"), _s(l("l_partkey") % 7))),
        F.lit("}}"),
    )
    sender = _pick(l("l_suppkey") % 4, {
        0: F.lit("0x" + r1[2:].upper()),
        1: F.lit("pre" + r2 + "post"),
        2: F.lit("0xffff")}, F.lit(None).cast("string"))
    return lineitem.select(
        l("l_orderkey").alias("id"),
        l("l_shipdate").alias("created_at"),
        F.concat(F.lit("u"), _s(l("l_suppkey"))).alias("recipient_address"),
        sender.alias("sender_address"),
        F.when(l("l_linestatus") == "F", "executed").otherwise("pending").alias("status"),
        F.when(l("l_returnflag") == "N", "failed").otherwise("received").alias("simplified_status"),
        data.alias("data"),
    )


def gmp_from(orders: DataFrame) -> DataFrame:
    o = F.col
    key, cust = o("o_orderkey"), o("o_custkey")
    value = _pick(key % 9, {0: F.lit("[]"), 1: F.lit('"n/a"'), 2: F.lit("false")},
                  _s(F.round(o("o_totalprice") * 100)))
    gas = _pick(key % 5, {0: F.lit("{}"), 1: F.lit('"x"')}, _s(cust))
    usd = F.when(key % 7 == 0, F.lit("[]")).otherwise(F.lit("3"))
    express = F.when(key % 3 == 0, F.lit("null")).otherwise(_s(key % 100))
    contract = F.when(cust % 3 == 0, F.lit(TEST_ROUTERS[2].upper())).otherwise(F.lit("0xdead"))
    data = F.concat(
        F.lit('{"call":{"chain":'), _q(F.concat(F.lit("Nation_"), _s(cust % 25))),
        F.lit(',"returnValues":{"destinationChain":'), _q(F.concat(F.lit("nation_"), _s(key % 25))),
        F.lit('},"transaction":{"from":'), _q(F.concat(F.lit("u"), _s(cust))),
        F.lit('}},"value":'), value,
        F.lit(',"amount":'), _s(cust),
        F.lit(',"symbol":'), _q(F.concat(F.lit("s"), _s(cust % 5))),
        F.lit(',"gas":{"gas_used_amount":'), gas,
        F.lit('},"gas_price_rate":{"source_token":{"token_price":{"usd":'), usd,
        F.lit('}}},"fees":{"express_fee_usd":'), express,
        F.lit('},"approved":{"returnValues":{"contractAddress":'), _q(contract),
        F.lit("}}}"),
    )
    return orders.select(
        key.alias("id"),
        o("o_orderdate").alias("created_at"),
        F.when(o("o_orderstatus") == "O", "pending").otherwise("executed").alias("status"),
        F.lit("received").alias("simplified_status"),
        data.alias("data"),
    )


def transfers_from_events(events: DataFrame) -> DataFrame:
    """Token transfers with real times of day, one per ``events`` row.

    Chains come from the event type and the user, the amount from ``props.k``
    and the price from ``value`` in cents; 'error' events are sent by a
    non-router address.  Used to check day buckets and inclusive end dates.
    """
    e = F.col
    k = _s(F.get_json_object(e("props"), "$.k").cast("bigint"))
    data = F.concat(
        F.lit('{"send":{"original_source_chain":'), _q(e("event_type")),
        F.lit(',"original_destination_chain":'), _q(F.concat(F.lit("Chain_"), _s(e("user_id") % 7))),
        F.lit(',"amount":'), k,
        F.lit(',"fee_value":1},"link":{"price":'), _s(F.round(e("value") * 100)),
        F.lit(',"asset":"e"}}'),
    )
    return events.select(
        e("event_id").alias("id"),
        e("ts").alias("created_at"),
        F.concat(F.lit("u"), _s(e("user_id"))).alias("recipient_address"),
        F.when(e("event_type") == "error", F.lit("0xffff"))
        .otherwise(F.lit(TEST_ROUTERS[1].upper())).alias("sender_address"),
        F.lit("executed").alias("status"),
        F.lit("received").alias("simplified_status"),
        data.alias("data"),
    )


def fixture_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers_from(read_table(spark, sf_dir, "lineitem"))


def fixture_gmp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gmp_from(read_table(spark, sf_dir, "orders"))


def fixture_event_transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transfers_from_events(read_table(spark, sf_dir, "events"))
