"""Sharding by histogram sort: splitters come from exact counts, then every row moves once.

Rows are ordered by (key, tie): ``key`` is a hash of the text, so that equal texts lie together, and
``tie`` a hash of the id, so that a group of equal texts larger than a shard can still be split.
The first round counts the exact bytes below 1024 candidate boundaries in every part of the input
(one aggregation, combined before it moves).  A splitter is done when a boundary is within
tolerance of its share of the bytes; for the others, the next round probes 1024 boundaries inside
the one interval that holds it, until all are done or the intervals are single places.

Only DataFrame functions are used.  The driver holds counts of the probes (1024 for each open
splitter), never rows.

Defined results: a null text has no bytes and weighs the fixed 8; null ids and repeated rows are
rows like others (rows equal in id and text may lie in either order); an empty table gives an
empty result; other columns of the input stay, but for those named like a result (size, text_crc32, shard, slot).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bridgelens.llm.common import free_name, materialize

SHARDS = 24
#: A splitter is done when it is this near to its share, as a part of a shard.
TOLERANCE = 0.001
#: Bits of the key and of the tie, and those that a round adds.
BITS, ROUND_BITS = 60, 10
#: Slots are numbered in 2^12 slices of the key's range; a slice with more than HOT times the mean
#: (one hot text) is numbered in 2^6 slices of the tie's range.
SLICE_BITS, HOT, HOT_BITS = 12, 4, 6
ROW_BYTES = 8


#: Names of the place's two parts in narrow tables.
KEY, TIE = "__key", "__tie"


def sized(docs: DataFrame, key: str = KEY, tie: str = TIE) -> DataFrame:
    """``docs`` with size, text_crc32, and its place in the order as the columns ``key`` and ``tie``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    low = F.lit((1 << BITS) - 1)
    return docs.withColumns(
        {
            "size": (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long"),
            "text_crc32": F.crc32(F.encode(text, "UTF-8")),
            key: F.xxhash64(text).bitwiseAND(low),
            tie: F.xxhash64(F.lit("tie"), F.col("doc_id")).bitwiseAND(low),
        }
    )


def prefix(level: int) -> tuple[Column, Column]:
    """The first ROUND_BITS * level bits of the place, as a part of the key and a part of the tie."""
    known = ROUND_BITS * level
    if known <= BITS:
        return F.shiftright(F.col("__key"), BITS - known), F.lit(0).cast("long")
    return F.col("__key"), F.shiftright(F.col("__tie"), 2 * BITS - known)


def begins(key: int, tie: int, level: int) -> int:
    """The first place under a prefix."""
    known = ROUND_BITS * level
    return key << (2 * BITS - known) if known <= BITS else (key << BITS) + (tie << (2 * BITS - known))


def splitters(rows: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> list[int]:
    """Ascending places that divide ``rows`` (size, __key, __tie) into shards of near equal bytes."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total or shards < 2:
        return []
    slack = max(1, int(tolerance * total / shards))
    done: list[int] = []
    # open splitters: the prefix that holds them -> (bytes before it, the goals inside)
    open_: dict[tuple[int, int], tuple[int, list[int]]] = {(0, 0): (0, [total * k // shards for k in range(1, shards)])}
    level, inside = 0, rows
    while open_:
        level += 1
        if level > 1:
            key, tie = prefix(level - 1)
            inside = rows.where(reduce(lambda a, b: a | b, [(key == k) & (tie == t) for k, t in open_]))
        key, tie = prefix(level)
        counted = inside.groupBy(key.alias("k"), tie.alias("t")).agg(F.sum("size").alias("bytes")).collect()
        under: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for r in sorted(counted, key=lambda r: (r["k"], r["t"])):
            place = begins(r["k"], r["t"], level)
            mother = (place >> (2 * BITS - ROUND_BITS * (level - 1)), 0) if ROUND_BITS * (level - 1) <= BITS else (r["k"], r["t"] >> ROUND_BITS)
            under.setdefault(mother, []).append((r["k"], r["t"], r["bytes"]))
        still: dict[tuple[int, int], tuple[int, list[int]]] = {}
        for mother, (before, goals) in open_.items():
            cells, at = under[mother], before
            ends = []
            for k, t, size in cells:
                ends.append((at, at + size, k, t))
                at += size
            for goal in goals:
                low, high, k, t = next(x for x in ends if goal <= x[1])
                near_low, near_high = goal - low, high - goal
                last = ROUND_BITS * level >= 2 * BITS
                if last or min(near_low, near_high) <= slack:
                    start = begins(k, t, level)
                    done.append(start if near_low <= near_high else start + (1 << (2 * BITS - ROUND_BITS * level)))
                else:
                    still.setdefault((k, t), (low, []))[1].append(goal)
        open_ = still
    return sorted(done)


def below(places: list[int], key: str = KEY, tie: str = TIE) -> Column:
    """How many of the ascending ``places`` lie at or before the row: a balanced tree of comparisons."""

    def tree(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        at = divmod(places[middle], 1 << BITS)
        reached = (F.col(key) > F.lit(at[0])) | ((F.col(key) == F.lit(at[0])) & (F.col(tie) >= F.lit(at[1])))
        return F.when(reached, tree(middle + 1, high)).otherwise(tree(low, middle))

    return tree(0, len(places))


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``docs`` (all, unless given) with size, text_crc32, shard and slot.

    Splitters come from a stored narrow table.  The rows then move once, to the tasks that number their
    slice, and are stored with those numbers; a slice's first slot follows from the stored counts of the slices before it:
    at most 2^12 slices, 2^6 parts of each of at most 2^12 / HOT hot ones, and 2^6 deals of each part that is
    still as hot (rows equal in id and text), whatever the input.
    """
    names = [c for c in (docs.columns if columns is None else columns) if c not in ("size", "text_crc32", "shard", "slot")]
    kept = [F.col(f"`{c}`") for c in names]
    # the caller's columns move along, so the helpers take names that are free
    key, tie, slice_, fine, deal, slot, first = (free_name(docs, x) for x in (KEY, TIE, "__slice", "__fine", "__deal", "__slot", "__first"))
    rows = sized(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("size", "text_crc32", "shard", "slot")]), key, tie)
    narrow = materialize(rows.select("size", F.col(key).alias(KEY), F.col(tie).alias(TIE)), "shard-sizes")
    cuts = splitters(narrow, shards, tolerance)
    slice_of = lambda k: F.shiftright(F.col(k), BITS - SLICE_BITS)
    part_of = lambda t: F.shiftright(F.col(t), BITS - HOT_BITS)
    per_slice = {r["s"]: r["n"] for r in narrow.groupBy(slice_of(KEY).alias("s")).agg(F.count("*").alias("n")).collect()}
    many = HOT * max(64, sum(per_slice.values()) / 2**SLICE_BITS)
    hot = [s for s, n in per_slice.items() if n > many]
    hotter: list[int] = []
    if hot:
        cell = F.shiftleft(slice_of(KEY), HOT_BITS) + part_of(TIE)
        per_part = narrow.where(slice_of(KEY).isin(hot)).groupBy(cell.alias("c")).agg(F.count("*").alias("n")).where(F.col("n") > many)
        hotter = [r["c"] for r in per_part.collect()]
    part = F.when(slice_of(key).isin(hot), part_of(tie)).otherwise(F.lit(0)) if hot else F.lit(0)
    dealt = F.when((F.shiftleft(slice_of(key), HOT_BITS) + part_of(tie)).isin(hotter), F.floor(F.rand(10) * 2**HOT_BITS)).otherwise(F.lit(0)) if hotter else F.lit(0)
    where = {"shard": below(cuts, key, tie).cast("int"), slice_: slice_of(key).cast("int"), fine: part.cast("int"), deal: dealt.cast("int")}
    place = list(where)
    inside = Window.partitionBy(*place).orderBy(key, tie, "doc_id")
    numbered = rows.withColumns(where).withColumn(slot, F.row_number().over(inside) - 1)
    numbered = materialize(numbered.select(*kept, "size", "text_crc32", *place, slot), "shard-rows")
    before = Window.partitionBy("shard").orderBy(slice_, fine, deal).rowsBetween(Window.unboundedPreceding, -1)
    counts = numbered.groupBy(*place).agg(F.count("*").alias("n"))
    firsts = counts.withColumn(first, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long")).drop("n")
    out = numbered.join(F.broadcast(firsts), place)
    return out.select(*kept, "size", "text_crc32", "shard", (F.col(slot) + F.col(first)).alias("slot"))
