"""Registered queries: one per operator / report of the inventory.

Each builder takes ``(spark, sf_dir)``, derives the two fact tables from the
given test tables (whole tables, no sampling) and returns a DataFrame whose
columns match the oracle SQL of the same name in ``bridgelens.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bridgelens import config as C
from bridgelens.functions.json import json_kind, json_text, with_variant
from bridgelens.functions.labels import with_display_names
from bridgelens.functions.numbers import safe_number, safe_product
from bridgelens.operators.extract import gmp_contract, transfer_events
from bridgelens.operators.filters import completed, router_match
from bridgelens.operators.quantile import exact_median_by
from bridgelens.oracle import EVENT_RANGE, RANGE
from bridgelens.plans import (
    bridge_events, chain_labels, destination_chains, ingest, kpi, kpi_labels, load_bridge_events,
    save_bridge_events, source_chains, time_series, top_chains, write_report,
)
from bridgelens.session import scratch_path
from bridgelens.sources import read_gmp, read_transfers, store_variant
from bridgelens.sources.fixtures import TEST_ROUTERS, fixture_event_transfers, fixture_gmp, fixture_transfers

Builder = Callable[[SparkSession, str], DataFrame]


def _facts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return fixture_transfers(spark, sf), fixture_gmp(spark, sf)


def events(spark: SparkSession, sf: str, **kw) -> DataFrame:
    t, g = _facts(spark, sf)
    return bridge_events(t, g, TEST_ROUTERS, **kw)


def _event_transfers(spark: SparkSession, sf: str) -> DataFrame:
    """Transfers branch over facts with real times of day (from ``events``)."""
    return transfer_events(fixture_event_transfers(spark, sf), TEST_ROUTERS)


def saved_events(spark: SparkSession, sf: str) -> DataFrame:
    """Build once, save partitioned by month in the shared scratch folder, read back."""
    return load_bridge_events(spark, save_bridge_events(events(spark, sf)))


def _num(path: str):
    return safe_number(json_text("data", path))


def _scan(which: str) -> Builder:
    def run(spark, sf):
        t, g = _facts(spark, sf)
        df = t if which == "transfers" else g
        return df.select("id", "status", F.to_date("created_at").alias("created_date"))
    return run


def filter_status(spark, sf):
    """F1 and F2 on both facts."""
    done = [df.where(completed()).select("id", F.lit(s).alias("service")) for df, s in zip(_facts(spark, sf), C.SERVICES)]
    return done[0].unionByName(done[1]).groupBy("service", "id").agg(F.count(F.lit(1)).alias("n_rows"))


def filter_router_transfers(spark, sf):
    t, _ = _facts(spark, sf)
    return t.where(router_match(F.col("sender_address"), TEST_ROUTERS)).select("id", "sender_address")


def filter_router_gmp(spark, sf):
    _, g = _facts(spark, sf)
    g = with_variant(g.select("id", "data"))
    contract = gmp_contract(F.col("data"))
    return g.where(router_match(contract, TEST_ROUTERS)).select("id", contract.alias("contract_address"))


def filter_date_outer(spark, sf):
    return events(spark, sf, start=RANGE[0], end=RANGE[1], filter_in_branches=False)


def filter_date_branch(spark, sf):
    return events(spark, sf, start=RANGE[0], end=RANGE[1], filter_in_branches=True)


def json_path(spark, sf):
    """Every path read by the reports, as text, one row per (record, path)."""
    t, g = _facts(spark, sf)

    def long(df: DataFrame, service: str, paths) -> DataFrame:
        df = with_variant(df.select("id", "data"))
        pairs = F.array(*[F.struct(F.lit(p).alias("path"), json_text("data", p).alias("value")) for p in paths])
        return df.select("id", F.lit(service).alias("service"), F.inline(pairs))

    return long(t, C.SERVICE_TRANSFERS, C.TRANSFER_PATHS).unionByName(long(g, C.SERVICE_GMP, C.GMP_PATHS))


# The number sites of both facts (P4, P5).
NUMBER_PATHS = {
    C.SERVICE_TRANSFERS: (C.T_AMOUNT, C.T_PRICE, C.T_FEE),
    C.SERVICE_GMP: (C.G_AMOUNT, C.G_VALUE, C.G_GAS_USED, C.G_GAS_USD, C.G_EXPRESS_FEE),
}


def _number_sites(name: str, read) -> Builder:
    """One row per (record, number path) of both facts with ``read(path)``."""
    def run(spark, sf):
        out = None
        for df, (service, paths) in zip(_facts(spark, sf), NUMBER_PATHS.items()):
            df = with_variant(df.select("id", "data"))
            pairs = F.array(*[F.struct(F.lit(p).alias("path"), read(p).alias(name)) for p in paths])
            part = df.select("id", F.lit(service).alias("service"), F.inline(pairs))
            out = part if out is None else out.unionByName(part)
        return out
    return run


def reingest_bridge_events(spark, sf):
    """Build the relation, then rebuild one month from facts whose gmp rows of it all
    failed and whose transfers stand: the stored relation must follow exactly."""
    t, g = _facts(spark, sf)
    path = scratch_path(spark, "reingest")
    ingest(t, g, path, routers=TEST_ROUTERS)
    day = F.to_date("created_at")
    month = day.between(F.lit("1996-03-01").cast("date"), F.lit("1996-03-31").cast("date"))
    gone = day.between(F.lit("1997-05-01").cast("date"), F.lit("1997-05-31").cast("date"))
    failed = F.when(month | gone, F.lit("failed")).otherwise(F.col("simplified_status"))
    g2 = g.withColumn("simplified_status", failed)
    t2 = t.withColumn("simplified_status", F.when(gone, F.lit("failed")).otherwise(F.col("simplified_status")))
    ingest(t2, g2, path, "1996-03-05", "1996-03-20", TEST_ROUTERS)
    ingest(t2, g2, path, "1997-05-01", "1997-05-31", TEST_ROUTERS)
    return load_bridge_events(spark, path).drop(C.EVENT_DATE, C.EVENT_MONTH)


def bridge_events_variant(spark, sf):
    """The relation over stored facts whose ``data`` is VARIANT, through the fact readers."""
    t, g = store_variant(spark, dict(zip(("transfers", "gmp"), _facts(spark, sf))))
    return bridge_events(read_transfers(spark, t), read_gmp(spark, g), TEST_ROUTERS, paths_in_scan=False)


def report_sink(spark, sf):
    """S3: a finished report written by the executors and read back."""
    path = write_report(source_chains(events(spark, sf)), scratch_path(spark, "report"))
    return spark.read.parquet(path)


def display_names(spark, sf):
    """P18: the chain report under the page's column headers."""
    return with_display_names(source_chains(events(spark, sf)))


def amount_usd_query(spark, sf):
    t, _ = _facts(spark, sf)
    return with_variant(t.select("id", "data")).select(
        "id", safe_product(_num(C.T_AMOUNT), _num(C.T_PRICE)).alias("amount_usd"))


def fee_coalesce(spark, sf):
    _, g = _facts(spark, sf)
    fee = F.coalesce(safe_product(_num(C.G_GAS_USED), _num(C.G_GAS_USD)), _num(C.G_EXPRESS_FEE))
    return with_variant(g.select("id", "data")).select("id", fee.alias("fee"))


def normalize_chain(spark, sf):
    t, _ = _facts(spark, sf)
    t = with_variant(t.select("data"))
    chains = t.select(F.explode(F.array(json_text("data", C.T_SOURCE_CHAIN),
                                        json_text("data", C.T_DESTINATION_CHAIN))).alias("original_chain"))
    return chains.select("original_chain", F.lower("original_chain").alias("normalized_chain")).distinct()


def _by_service(*measures: Callable[[], object]) -> Builder:
    """Group the whole relation by service; measures are built lazily (a
    Column needs a live session)."""
    def run(spark, sf):
        return events(spark, sf).groupBy("service").agg(*[m() for m in measures])
    return run


def agg_median(spark, sf):
    """Exact median per service, each found by distributed selection (no value map in one task)."""
    med = exact_median_by(events(spark, sf), "service", "amount_usd")
    return med.select("service", F.round("median").alias("median_bridged_volume"))


def _ts(unit: str, *cols: str) -> Builder:
    def run(spark, sf):
        ts = time_series(events(spark, sf), RANGE[0], RANGE[1], unit)
        return ts.select(*cols) if cols else ts
    return run


def _kpi(spark, sf):
    return kpi(events(spark, sf), RANGE[0], RANGE[1])


def _top(chain: str, by: str) -> Builder:
    def run(spark, sf):
        report = (source_chains if chain == "source" else destination_chains)(events(spark, sf))
        return top_chains(report, by, 10)
    return run


def queries() -> dict[str, Builder]:
    return {
        "scan_transfers": _scan("transfers"),
        "scan_gmp": _scan("gmp"),
        "filter_status": filter_status,
        "filter_router_transfers": filter_router_transfers,
        "filter_router_gmp": filter_router_gmp,
        "filter_date_outer": filter_date_outer,
        "filter_date_branch": filter_date_branch,
        "json_path": json_path,
        "json_kind": _number_sites("kind", lambda p: json_kind("data", p)),
        "safe_number": _number_sites("value", _num),
        "amount_usd": amount_usd_query,
        "fee_coalesce": fee_coalesce,
        "normalize_chain": normalize_chain,
        "union_services": _by_service(lambda: F.count(F.lit(1)).alias("n_rows")),
        "bridge_events": lambda spark, sf: events(spark, sf),
        "agg_distinct_ids": _by_service(lambda: F.count_distinct("id").alias("number_of_transfers")),
        "agg_distinct_users": _by_service(lambda: F.count_distinct("user").alias("number_of_users")),
        "agg_volume": _by_service(lambda: F.round(F.sum("amount_usd")).alias("volume_usd")),
        "agg_median": agg_median,
        "agg_max": _by_service(lambda: F.round(F.max("amount_usd")).alias("maximum_bridged_volume")),
        "agg_avg": _by_service(lambda: F.round(F.avg("amount_usd")).alias("average_bridged_volume"),
                               lambda: F.avg("amount_usd").alias("avg_bridged_volume")),
        "avg_bridges_per_user": _ts("month", "date", "avg_bridge_count_per_user"),
        "running_volume": _ts("month", "date", "bridged_volume", "total_bridged_volume"),
        "running_count": _ts("month", "date", "number_of_bridges", "total_number_of_bridges"),
        "kpi": _kpi,
        "kpi_labels": lambda spark, sf: kpi_labels(_kpi(spark, sf)),
        "time_series_month": _ts("month"),
        "time_series_week": _ts("week"),
        "time_series_day": _ts("day"),
        "source_chain": lambda spark, sf: source_chains(events(spark, sf)),
        "destination_chain": lambda spark, sf: destination_chains(events(spark, sf)),
        "source_chain_ranged": lambda spark, sf: source_chains(
            events(spark, sf, start=RANGE[0], end=RANGE[1]), RANGE[0], RANGE[1]),
        "destination_chain_ranged": lambda spark, sf: destination_chains(
            events(spark, sf, start=RANGE[0], end=RANGE[1]), RANGE[0], RANGE[1]),
        "source_chain_labels": lambda spark, sf: chain_labels(source_chains(events(spark, sf)), "si"),
        "destination_chain_labels": lambda spark, sf: chain_labels(destination_chains(events(spark, sf)), "usd"),
        "top10_source_volume": _top("source", "volume"),
        "top10_source_count": _top("source", "count"),
        "top10_destination_volume": _top("destination", "volume"),
        "top10_destination_count": _top("destination", "count"),
        "events_time_series_day": lambda spark, sf: time_series(
            _event_transfers(spark, sf), EVENT_RANGE[0], EVENT_RANGE[1], "day"),
        "events_time_series_week": lambda spark, sf: time_series(
            _event_transfers(spark, sf), EVENT_RANGE[0], EVENT_RANGE[1], "week"),
        "events_kpi": lambda spark, sf: kpi(_event_transfers(spark, sf), EVENT_RANGE[0], EVENT_RANGE[1]),
        "report_sink": report_sink,
        "display_names": display_names,
        "reingest_bridge_events": reingest_bridge_events,
        "bridge_events_variant": bridge_events_variant,
        "saved_bridge_events": lambda spark, sf: saved_events(spark, sf).drop(C.EVENT_DATE, C.EVENT_MONTH),
        "kpi_saved": lambda spark, sf: kpi(saved_events(spark, sf), RANGE[0], RANGE[1]),
        "time_series_day_saved": lambda spark, sf: time_series(saved_events(spark, sf), RANGE[0], RANGE[1], "day"),
    }
