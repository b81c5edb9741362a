"""MinHash near-duplicates by an LSH forest.

Documents with one set of shingles are one node.  Every node has TREES signatures of DEPTH
min-hashes; each tree is the order of all nodes by their signature there.  Neighbours in that order
that share LEAST values or more lie in one region.  In a small region all pairs are candidates; a
region with more than REGION nodes (a crowd) is taken one value deeper, as often as it takes, and its
neighbours stay candidates.  So the depth follows the crowd.  Many copies of one original may each be
close to it and not to one another; so every node of a crowd is also a candidate with the crowd's hub.
The original follows the most common values in almost every tree, a copy only in some: the node that does
so most often, over all trees, is the hub.

What these links leave of a crowd in more than one component is compared exactly: of two similar sets
with shingles in one order, rare ones first, the beginnings share a shingle.  How long a beginning must be follows
from both sizes, so sets meet by shingle and classes of sizes, and a template that many texts share without
being similar lies behind the beginnings.  A region that a task's edge may cut is taken like a crowd.

Every candidate is confirmed on the full sets; links within what earlier links already connect
need no confirmation, as only connections are asked for.  A pair at similarity 0.75 shares
3 values in one of 20 trees at least with probability 1 - 2e-5, at 0.8 with 1 - 6e-7.

Defined results: texts without words have no shingles and are linked with nothing; with fewer
words than a shingle, the whole sequence is the one shingle; a null id has a null component and is kept; rows
are told apart by id and text, so rows of one id with different texts are in one component only if their texts are.
Of a group, ``keep_one`` keeps one row: with the smallest id, and of rows repeated with id and text any one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import free_name, map_arrow, materialize, mix64, text_slices, texts, worker_state
from bridgelens.llm.components import components

SHINGLE = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
TREES, DEPTH, LEAST = 20, 6, 3
#: Nodes of a region whose pairs are all candidates.
REGION = 24
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


class _WordHashes(dict):
    """word -> 64-bit hash, remembered while there is room."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


def shingle_set(raw: bytes) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = raw.translate(_UPPER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = worker_state("word hashes", _WordHashes)
    codes = np.array([hashes[w] for w in words], dtype=np.uint64)
    width = min(SHINGLE, len(words))
    n = len(words) - width + 1
    h = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n])
    return np.unique(h)


_RANDOM = np.random.default_rng(20240617)
_MASKS = _RANDOM.integers(0, 1 << 32, size=TREES * DEPTH, dtype=np.uint32)
_FACTORS = _RANDOM.integers(0, 1 << 31, size=TREES * DEPTH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hashes: the least image under as many bijections of 32-bit numbers."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, dtype=np.uint32)
    for start in range(0, len(low), 2048):
        part = low[start : start + 2048, None] ^ _MASKS
        part *= _FACTORS
        np.minimum(out, part.min(axis=0), out=out)
    return out


def text_mark():
    """Tells texts of one id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, digest, signature): one row per input row; equal sets have equal digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            sizes, digests, found = [], [], []
            for raw in texts(part.column("text")):
                s = shingle_set(raw)
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                found.append(signature(s).astype(">u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "mark", "n_shingles", "digest", "signature"])

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_mark().alias("mark"), "text"), run, "doc_id long, mark long, n_shingles long, digest binary, signature binary")


def shared_values(keys: np.ndarray) -> np.ndarray:
    """Longest common prefix (in values) of each signature with the one before it; 0 for the first."""
    if not len(keys):
        return np.zeros(0, dtype=np.int64)
    same = keys[1:] == keys[:-1]
    return np.concatenate([[0], np.cumprod(same, axis=1).sum(axis=1)])


def region_pairs(lcp: np.ndarray, least: int, low: int, high: int, out: list[tuple[int, int, int]]) -> None:
    """Candidates (row, row, round) of the sorted rows low..high-1, which share ``least`` values.

    Round 1: pairs of neighbours, and in a small region of each row with the first; round 2: all other
    pairs of a small region.
    """
    todo = [(low, high, least)]
    while todo:
        low, high, depth = todo.pop()
        if high - low <= REGION:
            hubs = list(range(low, high))
        else:
            starts = [low] + [k for k in range(low + 1, high) if lcp[k] <= depth]
            hubs = starts
            if depth >= DEPTH:  # signatures that are equal throughout
                hubs = list(range(low, high))
            else:
                todo += [(a, b, depth + 1) for a, b in zip(starts, [*starts[1:], high], strict=True) if b - a > 1]
        out += [(a, b, 1) for a, b in zip(hubs, hubs[1:], strict=False)]
        if len(hubs) <= REGION:
            out += [(hubs[0], b, 1) for b in hubs[2:]]
            out += [(hubs[i], hubs[j], 2) for i in range(1, len(hubs)) for j in range(i + 2, len(hubs))]


def agreement(lcp: np.ndarray, low: int, high: int) -> np.ndarray:
    """For the sorted rows low..high-1, which share LEAST values: how many more values each shares with the
    most common ones, taken one after another."""
    out, a, b = np.zeros(high - low, dtype=np.int64), low, high
    for depth in range(LEAST, DEPTH):
        starts = np.concatenate([[a], a + 1 + np.flatnonzero(lcp[a + 1 : b] <= depth), [b]])
        most = int(np.argmax(np.diff(starts)))
        a, b = int(starts[most]), int(starts[most + 1])
        out[a - low : b - low] += 1
    return out


def crowds_of(tree: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, agreement) of every row in a region with more than REGION nodes, or one at either end of the
    rows, which may go on beyond; rows sorted by (tree, key)."""
    lcp = shared_values(keys)
    lcp[1:][tree[1:] != tree[:-1]] = 0
    edges = np.flatnonzero(lcp < LEAST)
    found = [(np.arange(low, high), agreement(lcp, int(low), int(high))) for low, high in zip(edges, [*edges[1:], len(lcp)], strict=True) if high - low > REGION or low == 0 or high == len(lcp)]
    if not found:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def candidates_of(tree: np.ndarray, keys: np.ndarray, nodes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate pairs (a < b, round) among rows sorted by (tree, key)."""
    lcp = shared_values(keys)
    lcp[1:][tree[1:] != tree[:-1]] = 0
    edges = np.flatnonzero(lcp < LEAST)
    out: list[tuple[int, int, int]] = []
    for low, high in zip(edges, [*edges[1:], len(lcp)], strict=True):
        if high - low > 1:
            region_pairs(lcp, LEAST, int(low), int(high), out)
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 3
    i, j, r = np.array(out, dtype=np.int64).T
    close = 100 * np.minimum(sizes[i], sizes[j]) >= SIMILARITY * np.maximum(sizes[i], sizes[j])
    i, j, r = i[close], j[close], r[close]
    a, b = np.minimum(nodes[i], nodes[j]), np.maximum(nodes[i], nodes[j])
    return a[a != b], b[a != b], r[a != b]


#: Rows of an order that are looked at together; what crosses their edge is joined by the edges' own pass.
RUN_ROWS = 200_000
_PAIRS = "a long, b long, round int, tree int, key binary, n_shingles long"


def _arrays(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    keys = np.frombuffer(b"".join(batch.column("key").to_pylist()), dtype=">u4").reshape(-1, DEPTH)
    return batch.column("tree").to_numpy(), keys, batch.column("node").to_numpy(), batch.column("n_shingles").to_numpy()


def forest_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b, round) of ``nodes`` (node, n_shingles, signature), and the rows of crowds (tree, key, node).

    Each order is dealt out by ranges of the whole (tree, signature, node), so that a crowded region
    spreads over tasks; every task also hands on the first and last row it saw, and those meet in
    a second pass that links regions across the tasks' edges.  The rows of crowds are handed on as
    well; a hub for each is the maximum of an aggregation, so a crowd is never gathered anywhere.
    """
    width = 4 * DEPTH

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            found = part.column("signature").to_pylist()
            keys = [s[k * width : (k + 1) * width] for s in found for k in range(TREES)]
            rows = np.repeat(np.arange(len(found)), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(found))), pa.array(keys, pa.binary()), part.column("node").take(pa.array(rows)), part.column("n_shingles").take(pa.array(rows))], names=["tree", "key", "node", "n_shingles"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def look() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            tree, keys, nodes, sizes = _arrays(rows)
            a, b, r = candidates_of(tree, keys, nodes, sizes)
            ends = rows.take(pa.array([0, len(tree) - 1]))
            none = pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.binary()), pa.nulls(len(a), pa.int64())
            main = pa.table([pa.array(a), pa.array(b), pa.array(r.astype(np.int32)), *none], names=["a", "b", "round", "tree", "key", "n_shingles"])
            edge = pa.table([ends.column("node"), pa.nulls(2, pa.int64()), pa.nulls(2, pa.int32()), ends.column("tree"), ends.column("key"), ends.column("n_shingles")], names=main.column_names)
            row, agrees = crowds_of(tree, keys)
            there = rows.take(pa.array(row))
            begin = [k[: 4 * LEAST] for k in there.column("key").to_pylist()]
            crowd = pa.table([there.column("node"), pa.nulls(len(row), pa.int64()), pa.array(agrees.astype(np.int32)), there.column("tree"), pa.array(begin, pa.binary()), there.column("n_shingles")], names=main.column_names)
            return pa.concat_tables([main, edge, crowd]).combine_chunks().to_batches()[0]

        for part in batches:
            held.append(part)
            if sum(p.num_rows for p in held) >= RUN_ROWS:
                yield look()
                held = []
        if sum(p.num_rows for p in held):
            yield look()

    def join_edges(edges: pa.Table) -> pa.Table:
        edges = edges.sort_by([("tree", "ascending"), ("key", "ascending"), ("node", "ascending")])
        a, b, r = candidates_of(*_arrays(edges))
        return pa.table([a, b, r.astype(np.int32)], names=["a", "b", "round"])

    rows = map_arrow(nodes.select("node", "n_shingles", "signature"), spread, "tree int, key binary, node long, n_shingles long")
    rows = rows.repartitionByRange(F.col("tree"), F.col("key"), F.col("node")).sortWithinPartitions("tree", "key", "node")
    found = materialize(map_arrow(rows, pairs, _PAIRS), "forest-pairs")
    edges = found.where("b IS NULL AND round IS NULL").select("tree", "key", F.col("a").alias("node"), "n_shingles")
    more = edges.groupBy("tree").applyInArrow(join_edges, "a long, b long, round int")
    main = found.where("b IS NOT NULL").select("a", "b", "round")
    crowds = found.where("b IS NULL AND round IS NOT NULL")
    pairs = main.union(more).union(hub_pairs(crowds)).groupBy("a", "b").agg(F.min("round").alias("round"))
    return pairs, crowds.select("tree", "key", F.col("a").alias("node"))


#: A crowd with 1 / SHARE of all crowds' rows or more is met by broadcast (at most SHARE crowds, whatever the input).
SHARE = 1000


def join_crowds(rows: DataFrame, crowds: DataFrame, total: int) -> DataFrame:
    """The stored ``rows`` (tree, key, ...) joined with the stored ``crowds`` (tree, key, n: its rows, ...): the largest
    crowds where their rows lie, the others by an ordinary join.  ``total`` is the number of rows."""
    large = F.col("n") * SHARE >= total
    great = F.broadcast(crowds.where(large))
    rest = rows.join(great.select("tree", "key"), ["tree", "key"], "left_anti")
    return rows.join(great, ["tree", "key"]).unionByName(rest.join(crowds.where(~large), ["tree", "key"]))


def hub_pairs(crowds: DataFrame) -> DataFrame:
    """(a, b, round) of each row of ``crowds`` (a, round: its agreement, tree, key, n_shingles) with its crowd's hub."""
    votes = crowds.groupBy("a").agg(F.sum(F.col("round") + 1).alias("votes"))
    rows = materialize(crowds.join(votes, "a").select("tree", "key", "a", "n_shingles", "votes"), "crowd-votes")
    best = F.max(F.struct("votes", (-F.col("a")).alias("least"), F.col("n_shingles").alias("size")))
    hubs = rows.groupBy("tree", "key").agg(best.alias("hub"), F.count("*").alias("n"))
    hubs = materialize(hubs.select("tree", "key", (-F.col("hub.least")).alias("hub"), F.col("hub.size").alias("size"), "n"), "hubs")
    met = join_crowds(rows, hubs, rows.count())
    close = 100 * F.least("n_shingles", "size") >= SIMILARITY * F.greatest("n_shingles", "size")
    pairs = met.where((F.col("a") != F.col("hub")) & close)
    return pairs.select(F.least("a", "hub").alias("a"), F.greatest("a", "hub").alias("b"), F.lit(1).alias("round")).distinct()


#: Bits of the filter that tells which documents are candidates at all (4 MB, whatever the input), and
#: the share of set bits beyond which a join tells it instead.
FILTER_BITS, FULL = 1 << 25, 0.3


def key_filter(keys: DataFrame, *columns: str) -> np.ndarray | None:
    """A bit for each place that the hash of a key in ``keys`` falls on; None if too many are set."""
    places = keys.select(F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS)).alias("place"))
    words = places.groupBy(F.expr("place DIV 32").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(place % 32 AS INT)))").alias("bits"))
    found = words.toPandas()
    out = np.zeros(FILTER_BITS // 32, dtype=np.uint32)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return out if np.bitwise_count(out).sum() <= FULL * FILTER_BITS else None


def shingle_sets(docs: DataFrame, named: DataFrame) -> DataFrame:
    """(doc_id, mark, shingles): the full sets of the rows that ``named`` (doc_id, mark) names, and of a few more;
    rows repeated in a task once.

    Their texts are not moved: a filter of fixed size, broadcast, drops the others as they are read.
    """
    named = named.distinct()
    bits = key_filter(named, "doc_id", "mark")
    docs = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_mark().alias("mark"), "text")
    if bits is None:
        docs = docs.join(named, ["doc_id", "mark"], "left_semi")
    docs = docs.withColumn("place", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(FILTER_BITS)))
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for part in text_slices(batches, "text"):
            if sent.value is not None:
                place = part.column("place").to_numpy()
                part = part.filter(pa.array((sent.value[place >> 5] >> (place & 31).astype(np.uint32)) & 1 == 1))
            keys = list(zip(part.column("doc_id").to_pylist(), part.column("mark").to_pylist(), strict=True))
            new = [k for k, key in enumerate(keys) if key not in seen and not seen.add(key)]
            part = part.take(pa.array(new, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("mark"), pa.array([shingle_set(x).tobytes() for x in texts(part.column("text"))], pa.binary())], names=["doc_id", "mark", "shingles"])

    return map_arrow(docs, sets, "doc_id long, mark long, shingles binary")


def confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough; ``nodes`` (node, doc_id, mark) names a row
    of ``docs`` for each."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            keep = []
            for x, y in zip(part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                left, right = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * both >= SIMILARITY * (len(left) + len(right) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("a").filter(mask), part.column("b").filter(mask)], names=["a", "b"])

    named = materialize(pairs.join(nodes.select(F.col("node").alias("a"), F.struct("doc_id", "mark").alias("left_row")), "a").join(nodes.select(F.col("node").alias("b"), F.struct("doc_id", "mark").alias("right_row")), "b"), "named-pairs")
    found = materialize(shingle_sets(docs, named.select("left_row.*").union(named.select("right_row.*"))), "shingle-sets")
    left = found.select(F.struct("doc_id", "mark").alias("left_row"), F.col("shingles").alias("left"))
    right = found.select(F.struct("doc_id", "mark").alias("right_row"), F.col("shingles").alias("right"))
    return map_arrow(named.join(left, "left_row").join(right, "right_row").select("a", "b", "left", "right"), check, "a long, b long")


def _bounds(growth: float = 1.05) -> np.ndarray:
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * growth)))
    return np.array(out, dtype=np.int64)


#: The least size of each class of sizes.
BOUNDS = _bounds()
#: Cells of the counts that order shingles (4 MB as levels, whatever the input); any order gives the same links.
CELLS = 1 << 22


def class_of(size: int) -> int:
    return int(np.searchsorted(BOUNDS, size, side="right")) - 1


def levels_of(sets: DataFrame) -> np.ndarray:
    """How common the shingles of each cell are: 0 for one set at most, else the bits of the count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, dtype=np.int64)
        for part in batches:
            for raw in part.column("shingles").to_pylist():
                np.add.at(total, (np.frombuffer(raw, dtype=np.uint64) & np.uint64(CELLS - 1)).astype(np.int64), 1)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(total[cell], pa.int64())], names=["cell", "n"])

    found = map_arrow(sets.select("shingles"), count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).where("n > 1").toPandas()
    out = np.zeros(CELLS, dtype=np.uint8)
    out[found["cell"].to_numpy(dtype=np.int64)] = np.frexp(found["n"].to_numpy(dtype=np.float64))[1]
    return out


def beginnings(shingles: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, side, rest) by which a set meets each set it may be similar to: a shingle of its beginning with both
    classes of sizes, which of them is its own (2: both), and how many of its shingles come from there on."""
    n = len(shingles)
    level = levels[(shingles & np.uint64(CELLS - 1)).astype(np.int64)]
    order = np.lexsort((shingles, level))
    shingles, shared = shingles[order], level[order] > 0
    own, least = class_of(n), -(-SIMILARITY * n // 100)
    keys, sides, rests = [], [], []
    for other in range(class_of(least), class_of(100 * n // SIMILARITY) + 1):
        both = -(-SIMILARITY * (n + max(least, int(BOUNDS[other]))) // (100 + SIMILARITY))  # shingles in common
        at = np.flatnonzero(shared[: max(0, n - both + 1)])
        salt = (min(own, other) * len(BOUNDS) + max(own, other) + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF
        keys.append(mix64(shingles[at] + np.uint64(salt)))
        sides.append(np.full(len(at), 2 if own == other else int(own > other), dtype=np.int32))
        rests.append(n - at)
    return np.concatenate(keys).view(np.int64), np.concatenate(sides), np.concatenate(rests)


#: Rows of a meeting that one task compares with the others of the meeting.
MEETING_ROWS = 2048


def crowd_pairs(crowds: DataFrame, docs: DataFrame, rows_of: DataFrame, first: DataFrame) -> DataFrame | None:
    """Candidates (a, b) of the rows of ``crowds`` (tree, key, node) that ``first`` (node, component) leaves in more
    than one component: all that can be similar; None if there are no such crowds.  ``rows_of`` (node, doc_id, mark)
    names a row of ``docs`` for each node."""
    weights = first.groupBy("component").agg(F.count("*").alias("weight"))
    known = first.join(weights, "component").select("node", "component", "weight")
    placed = crowds.join(known, "node", "left").select("tree", "key", "node", F.coalesce("component", "node").alias("component"), F.coalesce("weight", F.lit(1)).alias("weight"))
    placed = materialize(placed, "crowds")
    parted = placed.groupBy("tree", "key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high")
    parted = materialize(parted.select("tree", "key", "n"), "parted-crowds")
    nodes = materialize(join_crowds(placed, parted, placed.count()).select("node", "component", "weight").distinct(), "crowd-nodes")
    if nodes.isEmpty():
        return None
    nodes = nodes.join(rows_of, "node")
    sets = shingle_sets(docs, nodes.select("doc_id", "mark")).join(nodes, ["doc_id", "mark"]).dropDuplicates(["node"])
    sets = materialize(sets.select("node", "component", "weight", "shingles"), "crowd-sets")
    sent = docs.sparkSession.sparkContext.broadcast(levels_of(sets))

    def meeting(bits: np.ndarray | None) -> DataFrame:
        own = docs.sparkSession.sparkContext.broadcast(bits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "shingles", 1 << 20):
                found = [beginnings(np.frombuffer(x, dtype=np.uint64), sent.value) for x in part.column("shingles").to_pylist()]
                row = pa.array(np.repeat(np.arange(len(found)), [len(x[0]) for x in found]))
                size = np.array([len(x) // 8 for x in part.column("shingles").to_pylist()], dtype=np.int64)[row.to_numpy()]
                columns = [np.concatenate([x[k] for x in found]) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(size, pa.int64()), *[part.column(c).take(row) for c in ("node", "component", "weight")]], names=["meet", "side", "rest", "size", "node", "component", "weight"])

        rows = map_arrow(sets, run, "meet long, side int, rest long, size long, node long, component long, weight long")
        if own.value is None:
            return rows
        place = F.pmod(F.xxhash64("meet"), F.lit(FILTER_BITS))

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                at = part.column("place").to_numpy()
                yield part.filter(pa.array((own.value[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1)).drop_columns(["place"])

        return map_arrow(rows.withColumn("place", place), named, rows.schema)

    # of a meeting's rows those of its largest component need not be compared with one another
    largest = F.max(F.struct("weight", "component")).alias("largest")
    met = F.count("*").alias("n"), largest, F.min("component").alias("low"), F.max("component").alias("high")
    mixed = meeting(None).groupBy("meet").agg(*met).where("low < high")
    mixed = materialize(mixed.select("meet", F.col("largest.component").alias("most"), F.expr(f"n DIV {MEETING_ROWS} + 1").alias("parts")), "meetings")
    rows = materialize(meeting(key_filter(mixed, "meet")).drop("weight").join(mixed, "meet"), "meeting-rows")
    # a large meeting's rows are dealt out in parts, and each part is given all that it is compared with
    x = rows.where("component <> most").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("x")
    y = rows.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).alias("y")
    fits = (100 + SIMILARITY) * F.least("x.rest", "y.rest") >= SIMILARITY * (F.col("x.size") + F.col("y.size"))
    sides = ((F.col("x.side") == 2) & (F.col("y.side") == 2)) | (F.col("x.side") + F.col("y.side") == 1)
    pairs = x.join(y, (F.col("x.meet") == F.col("y.meet")) & (F.col("x.part") == F.col("y.part"))).where((F.col("x.component") != F.col("y.component")) & sides & fits)
    return pairs.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


#: Numbers of classes whose smallest id another class has as well: above all ids.
SECOND = 1 << 62


def classes_of(known: DataFrame) -> DataFrame:
    """(digest, node, doc_id, mark) of each distinct set of ``known``, stored: the first of its rows by id, and a number, that
    id where no other class has it (rows of one id may have different texts)."""
    found = known.groupBy("digest").agg(F.min(F.struct("doc_id", "mark")).alias("row"))
    found = materialize(found.select("digest", "row.doc_id", "row.mark"), "classes")
    shared = found.groupBy("doc_id").agg(F.min("digest").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = F.col("first").isNotNull() & (F.col("digest") != F.col("first"))
    node = F.when(again, F.lit(SECOND) + F.monotonically_increasing_id()).otherwise(F.col("doc_id"))
    return materialize(found.join(shared, "doc_id", "left").select("digest", node.alias("node"), "doc_id", "mark"), "class-numbers")


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_shingles, component_id, first): one row per row of ``docs``; ``first`` is the (doc_id, mark) that
    stays of its group, null for rows without words or id."""
    rows = materialize(signatures(docs), "signatures")
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = classes_of(known)
    at = ["digest", "doc_id", "mark"]
    nodes = known.join(classes, at).select("node", "n_shingles", "signature").dropDuplicates(["node"])
    pairs, crowds = forest_pairs(nodes)
    pairs = materialize(pairs, "candidates")
    node_docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows_of = classes.select("node", "doc_id", "mark")
    links = materialize(confirmed(pairs.where("round = 1").select("a", "b"), node_docs, rows_of), "links-1")
    first = materialize(components(links), "components-1")
    a = first.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    b = first.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    rest = pairs.where("round = 2").join(a, "a", "left").join(b, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
    if (met := crowd_pairs(crowds, node_docs, rows_of, first)) is not None:
        rest = rest.union(met).distinct()
    more = materialize(confirmed(materialize(rest, "candidates-2"), node_docs, rows_of), "links-2")
    whole = materialize(components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "components-2")
    # the first row of a component is that of its smallest node, unless classes share ids
    placed = classes.join(whole, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if classes.where(F.col("node") >= SECOND).isEmpty():
        heads = classes.select(F.col("node").alias("component"), F.struct("doc_id", "mark").alias("first"))
    else:
        heads = placed.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    named = placed.select("digest", "component").join(heads, "component").select("digest", "first")
    # equal sets may be a third of all rows: the join's other side has one row for them, so Spark may split it
    out = rows.join(named, "digest", "left").withColumn("first", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("first")))
    return out.select("doc_id", "mark", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"), "first")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_shingles, component_id, kept."""
    found = grouped(docs).select("doc_id", "n_shingles", "component_id")
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group stays (the smallest id), with its own columns; rows without an id or words stay."""
    found = materialize(grouped(docs).where("first IS NOT NULL"), "groups")
    own = F.struct("doc_id", "mark")
    gone = found.where(own != F.col("first")).select("doc_id", "mark").distinct()
    again = found.where(own == F.col("first")).groupBy("doc_id", "mark").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    key, mark = free_name(docs, "key"), free_name(docs, "mark")
    marked = docs.withColumns({key: F.col("doc_id").cast("long"), mark: text_mark()})

    def named(keys: DataFrame) -> DataFrame:
        return keys.select(F.col("doc_id").alias(key), F.col("mark").alias(mark))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    kept = marked.join(named(gone), [key, mark], "left_anti")
    again = materialize(again, "repeated-rows")
    if again.isEmpty():
        return kept.select(*columns)
    once = kept.join(named(again), [key, mark], "left_semi").dropDuplicates([key, mark])
    return kept.join(named(again), [key, mark], "left_anti").unionByName(once).select(*columns)


#: The result of ``near_duplicates`` with its fixed parameters, in DuckDB's SQL over the table documents.
ORACLE_SQL = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split WHERE len(w) >= 5
), runs AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER d || ' ' || lead(word, 2) OVER d || ' ' || lead(word, 3) OVER d || ' ' || lead(word, 4) OVER d AS shingle
  FROM placed WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), own AS (
  SELECT DISTINCT doc_id, shingle FROM runs WHERE shingle IS NOT NULL
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM split WHERE len(w) BETWEEN 1 AND 4
), shingles AS (
  SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM own
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, (SELECT count(*) FROM own WHERE own.doc_id = split.doc_id) AS n_shingles, component_id, doc_id = component_id AS kept
FROM split JOIN least ON doc_id = a
"""
