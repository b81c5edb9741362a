"""Materialise ``bridge_events`` once, partitioned by event month.

Reports then scan a flat, typed table: no JSON is parsed again, only the
needed columns are read, a day range prunes whole month folders and, since
rows are sorted by day inside every file, skips row groups within a month.
Months (not days) keep the file count proportional to the data: a day
partition would write one small file per task and day.  This
replaces the dashboard's per-argument result cache with a table every
consumer shares.

The relation has versions.  A save writes its months into a folder of its own,
``version=<name>/event_month=<day>``, which no reader looks at yet.  A manifest,
``_manifests/<number>.json``, then names the version of every month and the schema;
it is written aside and renamed to the next number, and that one rename
switches all months at once.  A reader takes the manifest with the highest number and
so sees all of a save or nothing of it.
"""

from __future__ import annotations

import calendar
import json
import uuid
from datetime import date
from typing import Iterable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bridgelens.config import DEFAULT_ROUTERS, EVENT_COLUMNS, EVENT_DATE, EVENT_MONTH
from bridgelens.operators.filters import DateLike, check_range, created_day
from bridgelens.plans.events import bridge_events
from bridgelens.session import file_system, job_description, remove_path, scratch_path

#: Folder of the manifests, and how many of the newest keep their months: whoever has just
#: loaded the relation may go on reading while the next save switches it.
MANIFESTS, KEPT = "_manifests", 2


def save_bridge_events(events: DataFrame, path: str | None = None, *,
                       covers: tuple[DateLike, DateLike] | None = None,
                       max_records_per_file: int = 5_000_000, cluster: bool = True) -> str:
    """Write ``events`` under ``path`` (default: a new folder in the shared
    checkpoint dir) partitioned by ``event_month``; returns the path.

    ``cluster=True`` adds a REBALANCE on the month before the write: rows are
    hash-partitioned by month and AQE then splits any oversized partition (a
    month holding a third of all rows goes to many tasks) and merges small
    ones to ``spark.sql.adaptive.advisoryPartitionSizeInBytes``.  Each task
    thus writes a few right-sized files whatever the arrival order of the
    facts; the cost is one shuffle of the flat event rows (not of the JSON
    facts) and no sampling pass.  Without AQE a rebalance would leave one task
    per month, so then the rows are range-partitioned on (month, day, id)
    instead: a sampling pass, but a hot day is still split by ``id``.
    ``cluster=False`` skips the shuffle and only sorts inside each task, which
    suits facts that arrive in time order.

    The months that occur in ``events`` are replaced, so each must be complete.
    ``covers`` says that ``events`` holds every row of the months that this range
    touches (open sides: all): then its months that have no rows any more are
    dropped in the same switch; ``ingest`` does this.  A run that fails before the
    switch changes nothing that readers see, and task retries are safe under Spark's
    commit protocol.  Of several saves at once each switches its own months, one after another.
    """
    spark = events.sparkSession
    path = path or scratch_path(spark, "bridge_events")
    rows = write_layout(events, cluster)
    version = uuid.uuid4().hex[:12]
    with job_description(spark, f"save bridge_events to {path}"):
        (rows.write
            .option("maxRecordsPerFile", max_records_per_file)
            .partitionBy(EVENT_MONTH)
            .parquet(f"{path}/version={version}"))
    written = _month_folders(spark, f"{path}/version={version}")
    number = _switch(spark, path, version, written, rows.schema, covers)
    _retire(spark, path, number - KEPT)
    return path


def _month_folders(spark: SparkSession, folder: str) -> list[str]:
    """The names of the month partitions in a version's folder."""
    fs, where = file_system(spark, folder)
    names = [status.getPath().getName() for status in fs.listStatus(where)]
    return sorted(name for name in names if name.startswith(f"{EVENT_MONTH}="))


def _manifest_numbers(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the manifests under ``path``, ascending."""
    fs, where = file_system(spark, f"{path}/{MANIFESTS}")
    names = [status.getPath().getName().split(".") for status in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(parts[0]) for parts in names if parts[0].isdigit() and parts[1:] == ["json"])


def _read_manifest(spark: SparkSession, path: str, number: int) -> dict:
    """``months`` (partition name -> version) and ``schema`` of one manifest."""
    fs, where = file_system(spark, f"{path}/{MANIFESTS}/{number}.json")
    stream = fs.open(where)
    try:
        return json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
    finally:
        stream.close()


def _switch(spark: SparkSession, path: str, version: str, written: list[str], schema: StructType,
            covers: tuple[DateLike, DateLike] | None) -> int:
    """Add the manifest in which ``version`` holds the ``written`` months; returns its number.

    The rename refuses a number that another save has taken in the meantime; the
    manifest is then made again on top of that one.
    """
    fs, aside = file_system(spark, f"{path}/{MANIFESTS}/{uuid.uuid4().hex}.tmp")
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    no_overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    while True:
        numbers = _manifest_numbers(spark, path)
        last = numbers[-1] if numbers else 0
        months = _read_manifest(spark, path, last)["months"] if numbers else {}
        months = {m: v for m, v in months.items() if not (covers and _covers(m, *covers))}
        months.update(dict.fromkeys(written, version))
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"months": months, "schema": schema.jsonValue()}).encode()))
        out.close()
        _, target = file_system(spark, f"{path}/{MANIFESTS}/{last + 1}.json")
        try:
            files.rename(aside.makeQualified(fs.getUri(), fs.getWorkingDirectory()), target.makeQualified(fs.getUri(), fs.getWorkingDirectory()), no_overwrite)
            return last + 1
        except Py4JJavaError:
            if not fs.exists(target):
                raise


def _retire(spark: SparkSession, path: str, number: int) -> None:
    """Remove the manifests up to ``number``, and first the months that only they name."""
    numbers = _manifest_numbers(spark, path)
    named = {n: _read_manifest(spark, path, n)["months"] for n in numbers}
    needed = {(m, v) for n in numbers if n > number for m, v in named[n].items()}
    for n in (n for n in numbers if n <= number):
        for month, version in named[n].items():
            if (month, version) not in needed:
                remove_path(spark, f"{path}/version={version}/{month}")
        remove_path(spark, f"{path}/{MANIFESTS}/{n}.json")


def _covers(month: str, start: DateLike, end: DateLike) -> bool:
    """Whether [start, end], widened to whole months, holds the month; undated rows belong to the open range only."""
    s, e = month_bounds(start, end)
    value = month.partition("=")[2]
    if value.startswith("__HIVE"):
        return s is None and e is None
    day = date.fromisoformat(value)
    return (s is None or day >= s) and (e is None or day <= e)


def write_layout(events: DataFrame, cluster: bool = True) -> DataFrame:
    """The rows exactly as ``save_bridge_events`` writes them: day and month
    columns added, clustered by month (see there) and sorted by day per task."""
    spark = events.sparkSession
    day = created_day(events)
    flat = events.select(*EVENT_COLUMNS, day.alias(EVENT_DATE), F.trunc(day, "month").alias(EVENT_MONTH))
    if cluster:
        if spark.conf.get("spark.sql.adaptive.enabled", "true").lower() == "true":
            flat = flat.hint("rebalance", EVENT_MONTH)
        else:
            flat = flat.repartitionByRange(EVENT_MONTH, EVENT_DATE, "id")
    return flat.sortWithinPartitions(EVENT_MONTH, EVENT_DATE)


def month_bounds(start: DateLike, end: DateLike) -> tuple[date | None, date | None]:
    """Widen [start, end] to whole months (open sides stay open)."""
    s, e = check_range(start, end)
    if s is not None:
        s = s.replace(day=1)
    if e is not None:
        e = e.replace(day=calendar.monthrange(e.year, e.month)[1])
    return s, e


def ingest(transfers: DataFrame, gmp: DataFrame, path: str, start: DateLike = None, end: DateLike = None,
           routers: Iterable[str] = DEFAULT_ROUTERS, **kw) -> str:
    """Build ``bridge_events`` for the months touching [start, end] and
    replace exactly those months under ``path`` (all months when open), in one switch.

    The range is widened to whole months first, because the saved relation is
    replaced a month at a time: a day range alone would drop the other days
    of its months.  Only the facts of those months are read (the range reaches
    both scans).
    """
    s, e = month_bounds(start, end)
    return save_bridge_events(bridge_events(transfers, gmp, routers, s, e), path, covers=(s, e), **kw)


def load_bridge_events(spark: SparkSession, path: str) -> DataFrame:
    """The saved relation with ``event_date`` and ``event_month``, so day
    filters prune partitions and row groups; it may be empty.  All of it comes from one manifest."""
    numbers = _manifest_numbers(spark, path)
    if not numbers:
        raise FileNotFoundError(f"no saved bridge_events under {path}")
    manifest = _read_manifest(spark, path, numbers[-1])
    schema = StructType.fromJson(manifest["schema"])
    columns = [*EVENT_COLUMNS, EVENT_DATE, EVENT_MONTH]
    folders = [f"{path}/version={version}/{month}" for month, version in sorted(manifest["months"].items())]
    if not folders:
        return spark.createDataFrame([], schema).select(*columns)
    return spark.read.schema(schema).option("basePath", path).parquet(*folders).select(*columns)


def write_report(report: DataFrame, path: str, fmt: str = "parquet") -> str:
    """Sink for a finished report (the dashboard's fetch step): the result is
    written by the executors, never gathered on the driver."""
    report.write.mode("overwrite").format(fmt).save(path)
    return path
