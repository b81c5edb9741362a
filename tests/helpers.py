"""Small hand-made fact tables for unit tests (the registered queries use the test data)."""

from __future__ import annotations

import json
from datetime import datetime

from bridgelens.sources.fixtures import TEST_ROUTERS

R1 = TEST_ROUTERS[0]

T_SCHEMA = ("id bigint, created_at timestamp_ntz, recipient_address string, sender_address string, "
            "status string, simplified_status string, data string")
G_SCHEMA = "id bigint, created_at timestamp_ntz, status string, simplified_status string, data string"


def ts(s: str) -> datetime:
    return datetime.fromisoformat(s)


def transfer(id, when, user="u1", amount=1, price=100, fee=1, src="Eth", dst="Arb",
             sender=R1, status="executed", simplified="received", asset="usdc"):
    data = {"send": {"original_source_chain": src, "original_destination_chain": dst,
                     "amount": amount, "fee_value": fee}, "link": {"price": price, "asset": asset}}
    return (id, ts(when), user, sender, status, simplified, json.dumps(data))


def gmp(id, when, user="g1", value=100, amount=1, gas=2, gas_usd=3, express=None, src="Ethereum",
        dst="arbitrum", contract=R1, status="executed", simplified="received", symbol="TKN"):
    data = {"call": {"chain": src, "returnValues": {"destinationChain": dst}, "transaction": {"from": user}},
            "amount": amount, "value": value, "symbol": symbol, "gas": {"gas_used_amount": gas},
            "gas_price_rate": {"source_token": {"token_price": {"usd": gas_usd}}},
            "fees": {"express_fee_usd": express}, "approved": {"returnValues": {"contractAddress": contract}}}
    return (id, ts(when), status, simplified, json.dumps(data))


def facts(spark, transfers=(), gmps=()):
    return (spark.createDataFrame(list(transfers), T_SCHEMA), spark.createDataFrame(list(gmps), G_SCHEMA))
