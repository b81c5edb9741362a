"""Per-service projections onto the unified event columns.

Each branch filters to completed records through the routers, then reads its
fields from the semi-structured ``data`` column with guarded numbers.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import VariantType

from bridgelens import config as C
from bridgelens.functions.json import json_text, with_variant
from bridgelens.functions.numbers import safe_number, safe_product
from bridgelens.operators.filters import DateLike, completed, in_date_range, router_match


def _texts(df: DataFrame, keep: list[str], paths: dict[str, str]) -> DataFrame:
    """Project each JSON path once into its own text column.

    Later expressions read those columns; as the extraction is not cheap,
    Catalyst keeps this projection instead of inlining it into every use.
    """
    return df.select(*keep, *[json_text("data", p).alias(n) for n, p in paths.items()])


def _matched_texts(df: DataFrame, keep: list[str], paths: dict[str, str], matched: Column) -> DataFrame:
    """``_texts`` of the rows that match, read above the scan: test and extraction share one generator, which no
    filter passes and no scan takes over, so a row that does not match costs the test alone."""
    fields = F.array(F.struct(*[json_text("data", p).alias(n) for n, p in paths.items()]))
    return df.select(*keep, F.inline(F.when(matched, fields)))


def transfer_events(
    transfers: DataFrame,
    routers: Iterable[str] = C.DEFAULT_ROUTERS,
    start: DateLike = None,
    end: DateLike = None,
    *,
    paths_in_scan: bool = True,
) -> DataFrame:
    """Token-transfer branch: chains lower-cased, user = recipient, fee in token units.

    ``paths_in_scan``: a scan of stored VARIANT reads the wanted paths, of every row; otherwise it reads the
    documents and the paths are taken from the rows that pass, which is cheaper for small unshredded documents.
    """
    t = in_date_range(transfers, start, end)
    t = t.where(completed() & router_match(F.col("sender_address"), routers))
    t = with_variant(t.select("created_at", "recipient_address", "id", "data"))
    keep, paths = ["created_at", "recipient_address", "id"], {
        "_src": C.T_SOURCE_CHAIN, "_dst": C.T_DESTINATION_CHAIN, "_amount": C.T_AMOUNT,
        "_price": C.T_PRICE, "_fee": C.T_FEE, "_asset": C.T_ASSET,
    }
    t = _texts(t, keep, paths) if paths_in_scan else _matched_texts(t, keep, paths, F.lit(True))
    amount = safe_number(F.col("_amount"))
    return t.select(
        F.col("created_at"),
        F.lower("_src").alias("source_chain"),
        F.lower("_dst").alias("destination_chain"),
        F.col("recipient_address").alias("user"),
        amount.alias("amount"),
        safe_product(amount, safe_number(F.col("_price"))).alias("amount_usd"),
        safe_number(F.col("_fee")).alias("fee"),
        F.col("id"),
        F.lit(C.SERVICE_TRANSFERS).alias("service"),
        F.col("_asset").alias("raw_asset"),
    )


def gmp_contract(data) -> Column:
    return json_text(data, C.G_CONTRACT)


def gmp_events(
    gmp: DataFrame,
    routers: Iterable[str] = C.DEFAULT_ROUTERS,
    start: DateLike = None,
    end: DateLike = None,
    normalize_chains: bool = False,
    *,
    paths_in_scan: bool = True,
) -> DataFrame:
    """Message-passing branch: chains as stored, user = sender, fee in USD.

    ``normalize_chains=True`` lower-cases the chains like the transfers branch
    (off by default: the dashboard keeps their case).  ``paths_in_scan`` as in ``transfer_events``.
    """
    g = in_date_range(gmp, start, end).where(completed())
    paths = {
        "_src": C.G_SOURCE_CHAIN, "_dst": C.G_DESTINATION_CHAIN, "_user": C.G_USER,
        "_amount": C.G_AMOUNT, "_value": C.G_VALUE, "_gas": C.G_GAS_USED, "_gas_usd": C.G_GAS_USD,
        "_express": C.G_EXPRESS_FEE, "_symbol": C.G_SYMBOL,
    }
    g = g.select("created_at", "id", "data")
    stored = isinstance(g.schema["data"].dataType, VariantType)
    if stored and paths_in_scan:
        # stored VARIANT: the scan reads the contract and the wanted paths only
        g = _texts(g.where(router_match(gmp_contract(F.col("data")), routers)), ["created_at", "id"], paths)
    else:
        # JSON text: a document whose text holds neither a router nor an escape
        # cannot match, so it is not parsed.  For the others a Filter on the
        # parsed document would be pushed below the parse and parse it twice;
        # testing and extracting in one generator keeps a single parse.
        if not stored:
            text = F.col("data")
            g = with_variant(g.where(router_match(text, routers) | F.contains(text, F.lit("\\"))))
        g = _matched_texts(g, ["created_at", "id"], paths, router_match(gmp_contract(F.col("data")), routers))
    src, dst = F.col("_src"), F.col("_dst")
    if normalize_chains:
        src, dst = F.lower(src), F.lower(dst)
    fee = F.coalesce(safe_product(safe_number(F.col("_gas")), safe_number(F.col("_gas_usd"))),
                     safe_number(F.col("_express")))
    return g.select(
        F.col("created_at"),
        src.alias("source_chain"),
        dst.alias("destination_chain"),
        F.col("_user").alias("user"),
        safe_number(F.col("_amount")).alias("amount"),
        safe_number(F.col("_value")).alias("amount_usd"),
        fee.alias("fee"),
        F.col("id"),
        F.lit(C.SERVICE_GMP).alias("service"),
        F.col("_symbol").alias("raw_asset"),
    )


def union_services(*branches: DataFrame) -> DataFrame:
    """UNION ALL by column name; duplicates are kept."""
    out = branches[0]
    for b in branches[1:]:
        out = out.unionByName(b)
    return out.select(*C.EVENT_COLUMNS)
