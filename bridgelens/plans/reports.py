"""The dashboard's reports as DataFrames over ``bridge_events``.

Every report takes the event relation (built in-plan or read back from the
saved, date-partitioned table) plus the inclusive day range.  Nothing here
collects rows; the exact median reads bounded histograms only (see
``operators.quantile``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.config import EVENT_MONTH
from bridgelens.session import job_description, remove_path, scratch_path
from bridgelens.functions.labels import count_label, si_label, usd_label
from bridgelens.operators import measures as M
from bridgelens.operators.buckets import bucket, check_unit
from bridgelens.operators.filters import DateLike, event_day, in_date_range
from bridgelens.operators.quantile import exact_median, median_stats
from bridgelens.operators.topk import top_k
from bridgelens.operators.windows import running_sum

# Types of the KPI measures other than the median, in aggregate order.
_KPI_TYPES = (
    ("number_of_transfers", "bigint"), ("number_of_users", "bigint"), ("volume_of_transfers", "double"),
    ("maximum_bridged_volume", "double"), ("average_bridged_volume", "double"),
)
KPI_COLUMNS = (
    "number_of_transfers", "number_of_users", "volume_of_transfers",
    "median_bridged_volume", "maximum_bridged_volume", "average_bridged_volume",
)


def kpi_measures(approx_distinct: bool = False) -> list:
    """The KPI aggregates other than the median."""
    return [
        M.distinct_ids(approx_distinct),
        M.distinct_users(approx_distinct),
        M.volume("volume_of_transfers"),
        M.max_volume(),
        M.avg_volume(),
    ]


def kpi(events: DataFrame, start: DateLike = None, end: DateLike = None, *,
        approx_distinct: bool = False) -> DataFrame:
    """Headline figures, always one row.

    This call is eager: it runs its jobs and returns a frame of literals.  One aggregate returns every measure
    plus the count/min/max that start the median search (fixed-size buffers;
    a median or sketch aggregate is kept out of it on purpose, as next to the
    two distinct counts Spark's Expand rewrite would give every (id, user)
    group its own buffer), then a few histogram passes over the amount column
    finish the median (see ``operators.quantile``).  On input that is not the
    saved relation (raw facts, JSON parsed in-plan) the three needed columns
    are stored in the shared scratch folder for those passes and removed after
    them, so each document is parsed once even if executors are lost.
    """
    ev = in_date_range(events, start, end)
    aggs = kpi_measures(approx_distinct)
    spark = ev.sparkSession
    narrow, stored = ev.select("id", "user", "amount_usd"), None
    if EVENT_MONTH not in events.columns:
        stored = scratch_path(spark, "kpi-columns")
        with job_description(spark, "KPI columns"):
            narrow.write.parquet(stored)
        narrow = spark.read.schema(narrow.schema).parquet(stored)
    try:
        with job_description(ev.sparkSession, "KPI measures"):
            row = narrow.agg(*aggs, *median_stats("amount_usd")).first()
        med = exact_median(narrow, "amount_usd", stats=row)
    finally:
        if stored:
            remove_path(spark, stored)
    # a one-row frame built in the JVM (no Python worker round trip)
    return ev.sparkSession.range(1).select(
        *[F.lit(row[n]).cast(t).alias(n) for n, t in _KPI_TYPES],
        F.round(F.lit(med).cast("double")).alias("median_bridged_volume"),
    ).select(*KPI_COLUMNS)


def kpi_labels(kpi_row: DataFrame) -> DataFrame:
    """The KPI row as display text ($ and thousands, unit words)."""
    return kpi_row.select(
        usd_label(F.col("volume_of_transfers")).alias("bridged_volume"),
        count_label(F.col("number_of_transfers"), "Txns").alias("total_bridges"),
        count_label(F.col("number_of_users"), "Addresses").alias("total_bridgers"),
        usd_label(F.col("median_bridged_volume")).alias("median_bridged_volume"),
        usd_label(F.col("maximum_bridged_volume")).alias("maximum_bridged_volume"),
        usd_label(F.col("average_bridged_volume")).alias("average_bridged_volume"),
    )


def time_series(events: DataFrame, start: DateLike = None, end: DateLike = None,
                unit: str = "month", *, approx_distinct: bool = False) -> DataFrame:
    """Per bucket (ascending): distinct bridges and bridgers, rounded volume,
    running totals of both, bridges per user and the unrounded mean volume.

    Aggregate first (partial aggregation + shuffle on the bucket), then run the
    two cumulative sums over the small per-bucket result.  Running totals add
    the *rounded* bucket volumes and bucket-level distinct counts.
    """
    u = check_unit(unit)
    ev = in_date_range(events, start, end)
    per_bucket = ev.groupBy(bucket(event_day(ev), u).alias("date")).agg(
        M.distinct_ids(approx_distinct).alias("number_of_bridges"),
        M.distinct_users(approx_distinct).alias("number_of_bridgers"),
        F.round(F.sum("amount_usd")).alias("bridged_volume"),
        F.avg("amount_usd").alias("avg_bridged_volume"),
    )
    return per_bucket.select(
        "date",
        "number_of_bridges",
        "number_of_bridgers",
        "bridged_volume",
        running_sum("bridged_volume").alias("total_bridged_volume"),
        running_sum("number_of_bridges").alias("total_number_of_bridges"),
        M.per_user(F.col("number_of_bridges"), F.col("number_of_bridgers")).alias("avg_bridge_count_per_user"),
        "avg_bridged_volume",
    ).orderBy("date")


def chain_report(events: DataFrame, chain: str, start: DateLike = None, end: DateLike = None, *,
                 approx_distinct: bool = False) -> DataFrame:
    """Per chain: distinct transfers and users, rounded USD volume; by count desc.

    A NULL chain is a group of its own.
    """
    if chain not in ("source_chain", "destination_chain"):
        raise ValueError("chain must be 'source_chain' or 'destination_chain'")
    ev = in_date_range(events, start, end)
    return ev.groupBy(chain).agg(
        M.distinct_ids(approx_distinct), M.distinct_users(approx_distinct), M.volume("volume_usd")
    ).orderBy(F.desc("number_of_transfers"), F.asc_nulls_first(chain))


def source_chains(events: DataFrame, start: DateLike = None, end: DateLike = None, **kw) -> DataFrame:
    return chain_report(events, "source_chain", start, end, **kw)


def destination_chains(events: DataFrame, start: DateLike = None, end: DateLike = None, **kw) -> DataFrame:
    return chain_report(events, "destination_chain", start, end, **kw)


def top_chains(report: DataFrame, by: str = "volume", k: int = 10) -> DataFrame:
    """Top-``k`` rows of a chain report by 'volume' or 'count'."""
    chain = "source_chain" if "source_chain" in report.columns else "destination_chain"
    return top_k(report, chain, by, k)


def chain_labels(report: DataFrame, style: str = "si") -> DataFrame:
    """Chain report plus bar-label text.

    'si' : volume as ``32G`` (two significant digits) and the count as is;
    'usd': volume as ``$1,234`` and the count with thousands separators.
    """
    if style == "si":
        return report.select("*", si_label(F.col("volume_usd")).alias("volume_label"),
                             F.col("number_of_transfers").cast("string").alias("count_label"))
    if style == "usd":
        return report.select("*", usd_label(F.col("volume_usd")).alias("volume_label"),
                             count_label(F.col("number_of_transfers")).alias("count_label"))
    raise ValueError("style must be 'si' or 'usd'")
