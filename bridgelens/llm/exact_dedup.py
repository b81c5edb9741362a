"""Exact duplicates with a split of heavy hitters.

Texts are equal when their digests are: the SHA-256 of the text with every run of white space as one
space.  One pass over the texts stores (id, digest, row); texts do not move after it.

1. Misra-Gries counters find the frequent digests.  Each task keeps COUNTERS counters (the batched form
   of Misra-Gries that Spark's ``approx_top_k_accumulate`` keeps: when all are taken, their median is
   subtracted from each), GROUPS groups of tasks combine theirs, then the groups.  A counter is wrong by less
   than 3.5 / COUNTERS of all rows, so every digest of 1 / SHARE of the rows or more is among the first LISTED.
2. The rows of those digests are counted exactly, combined before they move, and those that do hold
   1 / SHARE of all rows (at most SHARE of them, whatever the input) are the winners, with the
   row that stays.  They are broadcast, and decide all their rows where these lie.
3. The remaining digests, each with less than 1 / SHARE of the rows, are grouped and joined by ordinary shuffles.

Only DataFrame functions are used.

Defined results: null and empty texts are equal; of equal texts the row with the smallest id stays, and of rows
repeated with that id exactly one; a null id is larger than any other, so such a row stays only where no row of its
group has an id (``keep_id`` is null then); an empty table gives an empty result; other columns
of the input may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import free_name, materialize

#: Counters of a task, and the digests with the largest counts that are verified.
COUNTERS, LISTED = 4096, 1024
#: A digest with 1 / SHARE of all rows or more is decided by broadcast.
SHARE = 500
#: Groups of tasks whose counters are combined before the last step.
GROUPS = 256
#: Runs of white space that are not one space already.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def text_digest(text: Column) -> Column:
    """32 bytes that tell a text up to the length and kind of its white space."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " "), 256))


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, row) of every row of ``docs``, stored; ``row`` numbers the rows apart."""
    rows = docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row"))
    return materialize(rows, "digests")


def first_of_group() -> list[Column]:
    """The row that stays and the number of rows, as aggregates."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    return [first.alias("first"), F.count("*").alias("group_size")]


def frequent(rows: DataFrame) -> DataFrame:
    """(mark) of at most LISTED digests, among them all with 1 / SHARE of ``rows`` or more."""
    group = F.pmod(F.spark_partition_id(), F.lit(GROUPS)).alias("tasks")
    counted = rows.select(group, F.xxhash64("digest").alias("mark")).groupBy("tasks")
    counted = counted.agg(F.expr(f"approx_top_k_accumulate(mark, {COUNTERS})").alias("counters"))
    # grouped by a key, though there is one group: an aggregate without one starts empty counters, which do not combine
    combined = counted.groupBy(F.pmod("tasks", F.lit(1))).agg(F.expr(f"approx_top_k_combine(counters, {COUNTERS})").alias("counters"))
    return combined.select(F.explode(F.expr(f"approx_top_k_estimate(counters, {LISTED})")).alias("top")).select(F.col("top.item").alias("mark"))


def winners(rows: DataFrame) -> DataFrame:
    """(digest, first, group_size) of the digests that hold 1 / SHARE of ``rows`` or more: at most SHARE rows, stored."""
    total = rows.count()
    listed = rows.withColumn("mark", F.xxhash64("digest")).join(F.broadcast(frequent(rows)), "mark")
    found = listed.groupBy("digest").agg(*first_of_group())
    return materialize(found.where(F.col("group_size") * SHARE >= total), "winners")


def decided(joined: DataFrame) -> DataFrame:
    """The result's columns from rows joined with their groups; a row without a group is one of its own."""
    alone = F.col("first").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digests(docs)
    heavy = winners(rows)
    there = rows.join(F.broadcast(heavy), "digest")
    rest = rows.join(F.broadcast(heavy), "digest", "left_anti")
    return decided(there).unionByName(decided(rest.join(copies(rest), "digest", "left")))


def copies(rest: DataFrame) -> DataFrame:
    """(digest, first, group_size) of the digests that several rows of ``rest`` have, stored."""
    return materialize(rest.groupBy("digest").agg(*first_of_group()).where("group_size > 1"), "copies")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without its copies, with its own columns.

    Rows with a winner's digest are decided where they lie, and of the others only those meet that have copies;
    of rows repeated with one id and text any one stays.
    """
    rows = digests(docs)
    heavy = winners(rows)
    more = copies(rows.join(F.broadcast(heavy), "digest", "left_anti"))
    mark, first = free_name(docs, "digest"), free_name(docs, "first")
    whole = docs.withColumn(mark, text_digest(F.col("text")))
    rest = whole.join(F.broadcast(heavy.select(F.col("digest").alias(mark))), mark, "left_anti")

    def stays(side: DataFrame, groups: DataFrame) -> DataFrame:
        met = side.join(groups, mark).where(F.col("doc_id").eqNullSafe(F.col(f"{first}.doc_id")))
        return met.dropDuplicates([mark])

    def named(groups: DataFrame) -> DataFrame:
        return groups.select(F.col("digest").alias(mark), F.col("first").alias(first))

    out = stays(whole, F.broadcast(named(heavy))).unionByName(stays(rest, named(more)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns).union(rest.join(named(more), mark, "left_anti").select(*columns))


#: The same result in DuckDB's SQL over the table documents.
ORACLE_SQL = r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id,
       min(doc_id) OVER same AS keep_id,
       count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept,
       text_sha256
FROM digests
WINDOW same AS (PARTITION BY text_sha256)
"""
