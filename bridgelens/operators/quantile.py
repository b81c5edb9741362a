"""Exact median without gathering the values in one place.

``percentile``/``median`` keep a value->count map per group and merge all maps
of a global aggregate in a single task; a GK sketch (``percentile_approx``)
also funnels one summary per map task into one final task.  Neither survives
hundreds of thousands of tasks.  Here exact order statistics are found by
histogram refinement built only from ``groupBy``/``count``:

1. one aggregate returns count, min and max (partials are three numbers);
2. each round buckets the remaining candidates into ``buckets`` ranges of a
   monotone, log-scaled value space and returns (count, min, max) per bucket,
   with the shuffle keyed by bucket, so no task merges more than its share;
3. cumulative counts locate every wanted rank: a rank on a bucket edge is that
   bucket's min or max, a bucket whose min equals its max answers all its
   ranks (a value holding a third of the rows ends the search at once), and
   otherwise the search narrows to that bucket's [min, max], a range predicate
   that reaches the Parquet scan.

The search ends by itself: a bracket [lo, hi] with lo < hi either gets new
ends inside it, or, when the scaled map cannot separate its values, is cut at
a value between lo and hi; either way it holds fewer distinct values than before.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bridgelens.session import job_description, remove_path, scratch_path

_X = "__x"
DEFAULT_BUCKETS = 1024


def _scaled(x):
    """Monotone map that spreads heavy-tailed amounts evenly: sign(x)*log1p(|x|)."""
    return F.signum(x) * F.log1p(F.abs(x))


def _order_statistics(values: DataFrame, n: int, lo_v: float, hi_v: float, ranks: list[int],
                      buckets: int) -> list[float]:
    """Exact ``ranks`` (0-based, ascending) of the non-null column ``__x``,
    whose count, min and max are ``n``, ``lo_v`` and ``hi_v``."""
    x = F.col(_X)
    found: dict[int, float] = {}
    # pending searches: (candidates, rank offset, size, min, max, ranks inside)
    work = [(values, 0, n, lo_v, hi_v, sorted(set(ranks)))]
    rounds = 0
    while work:
        cand, offset, size, lo, hi, want = work.pop()
        if lo == hi:
            found.update({k: float(lo) for k in want})
            continue
        rounds += 1
        f_lo, f_hi = math.copysign(math.log1p(abs(lo)), lo), math.copysign(math.log1p(abs(hi)), hi)
        idx = F.floor((_scaled(x) - F.lit(f_lo)) / F.lit(f_hi - f_lo) * buckets).cast("int") \
            if f_hi > f_lo else F.lit(0)
        idx = F.least(F.greatest(idx, F.lit(0)), F.lit(buckets - 1))
        with job_description(cand.sparkSession, f"exact median: histogram round {rounds} over {size} values"):
            hist = sorted(
                (r["b"], r["c"], r["mn"], r["mx"])
                for r in cand.groupBy(idx.alias("b")).agg(
                    F.count(F.lit(1)).alias("c"), F.min(_X).alias("mn"), F.max(_X).alias("mx")).collect())
        if len(hist) == 1 and hist[0][2] == lo and hist[0][3] == hi:
            # the scaled map cannot separate these values any more: split by value instead
            mid = lo + (hi - lo) * 0.5 if math.isfinite(hi - lo) else lo * 0.5 + hi * 0.5
            if not lo <= mid < hi:  # adjacent doubles: split off the smallest value
                mid = lo
            below = cand.where(x <= mid)
            r = below.agg(F.count(F.lit(1)).alias("c"), F.max(_X).alias("mx")).first()
            above = cand.where(x > mid).agg(F.min(_X).alias("mn")).first()["mn"]
            hist = [(0, r["c"], lo, r["mx"]), (1, size - r["c"], above, hi)]
            ranges = [(x <= mid), (x > mid)]
        else:
            ranges = None
        start = offset
        for pos, (b, c, mn, mx) in enumerate(hist):
            inside = [k for k in want if start <= k < start + c]
            rest = []
            for k in inside:
                if k == start:
                    found[k] = float(mn)
                elif k == start + c - 1:
                    found[k] = float(mx)
                else:
                    rest.append(k)
            if rest:
                cond = ranges[pos] if ranges else (x >= mn) & (x <= mx)
                work.append((cand.where(cond), start, c, mn, mx, rest))
            start += c
    return [found[k] for k in ranks]


def median_stats(column: str) -> list:
    """Aggregate columns (``__n``, ``__lo``, ``__hi``, ``__nan``) that start the
    search; fixed-size buffers, so they can join any other aggregate."""
    x = F.col(column).cast("double")
    return [F.count(x).alias("__n"), F.min(x).alias("__lo"), F.max(x).alias("__hi"),
            F.count(F.when(F.isnan(x), 1)).alias("__nan")]


def exact_median(df: DataFrame, column: str, *, buckets: int = DEFAULT_BUCKETS, stats=None):
    """Interpolated median (``percentile_cont(0.5)``) of ``column``; None if no value.

    Matches Spark ``median`` and DuckDB ``median``: for an even count the
    result is ``a + (b - a) * 0.5`` of the two middle values.  ``stats`` is a
    row holding the ``median_stats`` columns when another aggregate already
    computed them (saves the first pass).  Values must be finite (guarded
    amounts always are); NaN or infinity raises ``ValueError``.
    """
    values = df.select(F.col(column).cast("double").alias(_X)).where(F.col(_X).isNotNull())
    with job_description(df.sparkSession, f"exact median of {column}"):
        if stats is None:
            stats = values.agg(*median_stats(_X)).first()
        n = stats["__n"]
        if not n:
            return None
        if stats["__nan"] or not (math.isfinite(stats["__lo"]) and math.isfinite(stats["__hi"])):
            raise ValueError(f"exact_median needs finite values; {column} holds NaN or infinity")
        lo, hi = (n - 1) // 2, n // 2
        a, b = _order_statistics(values, n, stats["__lo"], stats["__hi"], [lo, hi], buckets)
    return a + (b - a) * 0.5


def exact_median_by(df: DataFrame, key: str, column: str, *, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Exact median of ``column`` per value of ``key`` (NULL is a key of its own), as ``(key, median)``.

    All groups are narrowed in the same rounds, each one job over the values: the
    open brackets are a table keyed by group and wanted rank, and only the number
    of open ones reaches the driver.  The counting is keyed by (group, rank,
    bucket), so a group holding a third of all rows is spread over tasks.  The
    narrow values and the rounds' brackets are stored in the shared scratch
    folder and removed at the end, but for the last, which is the result.
    A group without values has a NULL median.
    """
    spark = df.sparkSession
    stored: list[str] = []

    def store(part: DataFrame, name: str) -> DataFrame:
        stored.append(scratch_path(spark, name))
        part.write.parquet(stored[-1])
        return spark.read.schema(part.schema).parquet(stored[-1])

    with job_description(spark, f"exact median of {column} by {key}"):
        values = store(df.select(F.col(key).alias("__k"), F.col(column).cast("double").alias(_X)), "median-values")
        stats = values.groupBy("__k").agg(*median_stats(_X))
        n = F.col("__n")
        ranks = F.array_distinct(F.array(F.floor((n - 1) / 2), F.floor(n / 2)))
        brackets = stats.select(
            "__k", F.explode(F.when(n > 0, ranks).otherwise(F.array(F.lit(0).cast("bigint")))).alias("__r"),
            F.lit(0).cast("bigint").alias("__at"), F.col("__lo").alias("lo"), F.col("__hi").alias("hi"),
            F.lit(False).alias("stuck"), (F.col("__nan") > 0).alias("bad"))
        brackets = store(brackets, "median-brackets")
        infinite = (F.abs("lo") == float("inf")) | (F.abs("hi") == float("inf"))
        if brackets.where(F.col("bad") | infinite).limit(1).count():
            raise ValueError(f"exact_median needs finite values; {column} holds NaN or infinity")
        while brackets.where("lo < hi").limit(1).count():
            brackets = store(_narrower(values, brackets, buckets), "median-brackets")
    for path in stored[:-1]:
        remove_path(spark, path)
    low, high = F.min("lo"), F.max("lo")
    return brackets.groupBy(F.col("__k").alias(key)).agg((low + (high - low) * 0.5).alias("median"))


def _narrower(values: DataFrame, brackets: DataFrame, buckets: int) -> DataFrame:
    """The brackets after one more round; closed ones (lo = hi, or no values) stay."""
    x, lo, hi = F.col(_X), F.col("lo"), F.col("hi")
    open_ = brackets.where("lo < hi").withColumnRenamed("__k", "__bk")
    inside = values.join(open_, values["__k"].eqNullSafe(open_["__bk"]) & (x >= lo) & (x <= hi)).drop("__bk")
    share = (_scaled(x) - _scaled(lo)) / (_scaled(hi) - _scaled(lo))
    by_scale = F.least(F.greatest(F.floor(share * buckets), F.lit(0)), F.lit(buckets - 1)).cast("int")
    middle = lo * 0.5 + hi * 0.5
    middle = F.when((middle >= lo) & (middle < hi), middle).otherwise(lo)  # adjacent doubles: split off the smallest
    by_value = F.when(x <= middle, 0).otherwise(1)
    flat = F.col("stuck") | (_scaled(hi) <= _scaled(lo))
    group = ["__k", "__r", "__at", "lo", "hi"]
    counted = inside.groupBy(*group, F.when(flat, by_value).otherwise(by_scale).alias("__b")).agg(
        F.count(F.lit(1)).alias("__c"), F.min(_X).alias("__mn"), F.max(_X).alias("__mx"))
    before = F.sum("__c").over(Window.partitionBy("__k", "__r").orderBy("__b")) - F.col("__c") + F.col("__at")
    r, c, mn, mx, start = (F.col(n) for n in ("__r", "__c", "__mn", "__mx", "__start"))
    hit = counted.withColumn("__start", before).where((start <= r) & (r < start + c))
    new_lo = F.when(r == start, mn).when(r == start + c - 1, mx).otherwise(mn)
    new_hi = F.when(r == start, mn).when(r == start + c - 1, mx).otherwise(mx)
    narrowed = hit.select("__k", "__r", start.cast("bigint").alias("__at"), new_lo.alias("__l"), new_hi.alias("__h"),
                          ((new_lo == lo) & (new_hi == hi)).alias("stuck"), F.lit(False).alias("bad"))
    narrowed = narrowed.withColumnsRenamed({"__l": "lo", "__h": "hi"}).select(brackets.columns)
    return brackets.where("NOT coalesce(lo < hi, false)").unionByName(narrowed)
