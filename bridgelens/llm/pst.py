"""Language-model scoring by a probabilistic suffix tree.

A text is read as its lower-cased words (A-Z only), joined by one space and closed by an end
symbol; symbols are bytes.  From all training texts come the counts of every (DEPTH + 1)-byte
stretch.  A context of 1..DEPTH bytes is kept if it occurs LEAST times or more and if its next-symbol
distribution diverges from that of its suffix, so the tree goes on growing with the training texts.  A kept
context's distribution is its counts, smoothed by the distribution of its longest kept suffix, the more the
more symbols follow it; the root's is smoothed over all byte values.

The tree is a table: contexts are counted, tested and stored by Spark, and each block of documents receives
the kept contexts that occur in its own texts, as it receives the training counts of its own words.  So neither
the tree nor the vocabulary is ever gathered in one place.  A block looks up each of its distinct stretches once: the
symbol's probability in the longest kept suffix of what stands before it, from the root down.

Defined results: a null or empty text is its end token alone; a null id counts as the text '' when
it is dealt to the training side; repeated rows count and are scored each; without training texts
N and V are 0 and the model is uniform.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import map_arrow, materialize, pack, text_slices, texts, unpack, worker_state

DEPTH = 5
#: Occurrences from which a context is tested.
LEAST = 64
#: Divergence (nats) of a context from its suffix at which it is kept.
DIVERGENCE = 0.002
#: Weight of the suffix's distribution in a context's, as a count for each symbol seen after the context.
SMOOTHING = 3.0
#: Bytes of text (about) in a block of documents that is scored together.
BLOCK_BYTES = 32 << 20
PAD, END = 0xFF, 0xFE  # never bytes of UTF-8
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_UPPER).split()


def symbols(rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All symbols of the texts, DEPTH pads before each, and where each text's pads begin."""
    pad, end = bytes([PAD]) * DEPTH, bytes([END])
    parts = [pad + b" ".join(x) + end for x in rows]
    sizes = np.array([len(x) for x in parts], dtype=np.int64)
    return np.frombuffer(b"".join(parts), dtype=np.uint8), np.cumsum(sizes) - sizes


def stretches(buffer: np.ndarray) -> np.ndarray:
    """At every symbol, the DEPTH symbols before it and itself as one number (of no use at pads)."""
    code, have = buffer.astype(np.int64), 1
    while have < DEPTH + 1:  # twice as many symbols at a time, or as many as are missing
        step = min(have, DEPTH + 1 - have)
        code = code[:-step] << (8 * step) | code[step:] & ((1 << (8 * step)) - 1)
        have += step
    return code


def is_training():
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) != 2


def counts_of(training: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(code, n) of every stretch and (word, c) of every word in the training texts, stored; both are counted in one pass,
    and in each task before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: Counter[bytes] = Counter()

        def merged() -> tuple[np.ndarray, np.ndarray]:
            at, distinct = pd.factorize(np.concatenate([c for c, _ in held]))
            return distinct, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64)

        def out(code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(code), pa.nulls(len(code), pa.binary()), pa.array(n)], names=["code", "word", "n"])

        def out_words() -> pa.RecordBatch:
            row = pa.RecordBatch.from_arrays([pa.nulls(len(seen), pa.int64()), pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], names=["code", "word", "n"])
            seen.clear()
            return row

        for part in text_slices(batches, "text"):
            rows = [words(x) for x in texts(part.column("text"))]
            for row in rows:
                seen.update(row)
            buffer = symbols(rows)[0]
            at, distinct = pd.factorize(stretches(buffer)[buffer[DEPTH:] != PAD])
            held.append((distinct, np.bincount(at)))
            if sum(len(c) for c, _ in held) > 4_000_000:
                held = [merged()]
                if len(held[0][0]) > 2_000_000:  # counts may be handed on in parts
                    yield out(*held.pop())
            if len(seen) > 1_000_000:
                yield out_words()
        if held:
            yield out(*merged())
        yield out_words()

    found = map_arrow(training.select("text"), run, "code long, word binary, n long")
    found = materialize(found.groupBy("code", "word").agg(F.sum("n").alias("n")), "pst-counts")
    return found.where("code IS NOT NULL").select("code", "n"), found.where("word IS NOT NULL").select("word", F.col("n").alias("c"))


#: A context with what follows it: for each symbol, by symbol, eight bytes, of which the first is the symbol and the rest its count.
CONTEXTS = "depth int, context long, total long, follows binary"


def contexts(counts: DataFrame, depth: int, least: int) -> DataFrame:
    """(depth, context, total, symbols, counts) of the contexts of ``depth`` bytes that occur ``least`` times or more, from
    (code, n) of depth + 1 bytes."""
    code = F.col("code")
    follows = F.array_sort(F.collect_list(F.struct(code.bitwiseAND(255).cast("int").alias("symbol"), "n")))
    found = counts.groupBy(F.shiftright(code, 8).alias("context")).agg(F.sum("n").alias("total"), follows.alias("follows")).where(F.col("total") >= least)
    return found.select(F.lit(depth).alias("depth"), "context", "total", F.col("follows.symbol").alias("symbols"), F.col("follows.n").alias("counts"))


def diverging(longer: DataFrame, shorter: DataFrame, depth: int, divergence: float = DIVERGENCE) -> DataFrame:
    """Those of the contexts of ``depth`` bytes whose distribution diverges from their suffix's (whatever follows a
    context follows its suffix, which is no rarer, so the suffix is there)."""
    suffix = F.col("context").bitwiseAND((1 << (8 * (depth - 1))) - 1).alias("suffix")
    above = shorter.select(F.col("context").alias("suffix"), F.col("total").alias("all"), F.map_from_arrays("symbols", "counts").alias("above"))
    joined = longer.withColumn("suffix", suffix).join(above, "suffix")
    # sum of n / total * ln((n / total) / (m / all)), where m is the suffix's count of the same symbol
    terms = F.zip_with("symbols", "counts", lambda s, n: n * (F.log(n.cast("double")) - F.log(F.element_at(F.col("above"), s).cast("double"))))
    total = F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)
    diverges = total / F.col("total") - F.log(F.col("total").cast("double")) + F.log(F.col("all").cast("double"))
    return joined.where(diverges >= divergence).select(*longer.columns)


def packed(found: DataFrame) -> DataFrame:
    """Contexts as CONTEXTS."""
    each = F.zip_with("symbols", "counts", lambda s, n: F.concat(F.lpad(F.hex(s), 2, "0"), F.lpad(F.hex(n), 14, "0")))
    return found.select("depth", "context", "total", F.unhex(F.array_join(each, "")).alias("follows"))


def learn(training: DataFrame, least: int = LEAST, divergence: float = DIVERGENCE, counts: DataFrame | None = None) -> DataFrame:
    """The kept contexts of the training texts, the root among them, as CONTEXTS, stored."""
    counts = counts_of(training)[0] if counts is None else counts
    levels = []
    for d in range(DEPTH, -1, -1):
        if d < DEPTH:
            counts = counts.groupBy(F.col("code").bitwiseAND(F.lit((1 << (8 * (d + 1))) - 1)).alias("code")).agg(F.sum("n").alias("n"))
            counts = materialize(counts, f"pst-{d}") if d else counts
        levels.append(materialize(contexts(counts, d, least if d else 0), f"pst-contexts-{d}"))
    levels = levels[::-1]
    kept = levels[0]
    for d in range(1, DEPTH + 1):
        kept = kept.union(diverging(levels[d], levels[d - 1], d, divergence))
    return materialize(packed(kept), "pst-kept")


class Tree:
    """Some kept contexts, fit for looking up stretches: the root and, of each depth, sorted contexts and what follows them."""

    def __init__(self, root: np.ndarray) -> None:
        """``root``: how often each byte value occurs."""
        self.root = (root + 1.0) / (root.sum() + 257)
        self.levels: list[tuple[np.ndarray, ...]] = []
        #: stretches that were looked up, in order, and their results
        self.seen, self.found = np.zeros(0, dtype=np.int64), np.zeros(0)

    def add(self, context: np.ndarray, total: np.ndarray, size: np.ndarray, symbols_: np.ndarray, counts: np.ndarray) -> None:
        """The next depth: each context, its count, how many symbols follow it, and all those with their counts."""
        order = np.argsort(context, kind="stable")
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        key = np.repeat(place, size) << 8 | symbols_
        by = np.argsort(key, kind="stable")
        self.levels.append((context[order], total[order].astype(np.float64), SMOOTHING * size[order], key[by], counts[by].astype(np.float64)))

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each stretch after those before it."""
        symbol = code & 255
        p = self.root[symbol]
        for d, (context, total, weight, key, count) in enumerate(self.levels, 1):
            if not len(context):
                continue
            mine = code >> 8 & ((1 << 8 * d) - 1)
            at = np.minimum(np.searchsorted(context, mine), len(context) - 1)
            kept = np.flatnonzero(context[at] == mine)
            at, want = at[kept], at[kept] << 8 | symbol[kept]
            found = np.minimum(np.searchsorted(key, want), len(key) - 1)
            n = np.where(key[found] == want, count[found], 0.0)
            p[kept] = (n + weight[at] * p[kept]) / (total[at] + weight[at])
        return np.log10(p)

    def score(self, buffer: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 probability of each text in ``buffer`` (as ``symbols`` made it); every distinct stretch is looked up once."""
        if not len(begins):
            return np.zeros(0)
        at, distinct = pd.factorize(stretches(buffer))
        out = np.zeros(len(buffer))
        out[DEPTH:] = self.looked_up(distinct)[at]
        out[buffer == PAD] = 0
        return np.add.reduceat(out, begins)

    def looked_up(self, code: np.ndarray) -> np.ndarray:
        """``log10`` of distinct stretches; what a block's earlier texts had is remembered."""
        order = np.argsort(code)
        code = code[order]
        place = np.searchsorted(self.seen, code)
        known = np.zeros(len(code), dtype=bool)
        if len(self.seen):
            known = self.seen[np.minimum(place, len(self.seen) - 1)] == code
        value = np.empty(len(code))
        value[known] = self.found[place[known]]
        new = code[~known]
        value[~known] = self.log10(new)
        self.seen, self.found = np.insert(self.seen, place[~known], new), np.insert(self.found, place[~known], value[~known])
        out = np.empty(len(code))
        out[order] = value
        return out


def unpacked(follows: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The symbols that follow some contexts, with their counts."""
    both = np.frombuffer(follows, dtype=">u8").astype(np.uint64)
    return (both >> np.uint64(56)).astype(np.int64), (both & np.uint64((1 << 56) - 1)).astype(np.int64)


def tree_of(depth: np.ndarray, context: np.ndarray, total: np.ndarray, size: np.ndarray, follows: bytes, root: np.ndarray) -> Tree:
    """The tree of some kept contexts (all but the root; ``size``: how many symbols follow each) and the root's counts."""
    tree, (symbol, count), of = Tree(root), unpacked(follows), np.repeat(depth, size)
    for d in range(1, DEPTH + 1):
        mine, each = depth == d, of == d
        tree.add(context[mine], total[mine], size[mine], symbol[each], count[each])
    return tree


def root_counts(kept: DataFrame) -> np.ndarray:
    """How often each byte value occurs (256 numbers)."""
    out = np.zeros(256)
    for r in kept.where("depth = 0").select("follows").collect():
        symbol, n = unpacked(r["follows"])
        out[symbol] = n
    return out


def wanted(blocks: DataFrame) -> DataFrame:
    """(block, depth, key) of what a block needs to be told of: its distinct words (depth 0) and its distinct contexts of
    each depth, as eight bytes; each once for a block and slice of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[set[bytes], list[np.ndarray]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for block, (found, codes) in held.items():
                yield rows(block, 0, pa.array(list(found), pa.binary()))
                longer = pd.unique(np.concatenate(codes))
                for d in range(DEPTH, 0, -1):
                    longer = pd.unique(longer & ((1 << 8 * d) - 1))
                    keys = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8), len(longer), [None, pa.py_buffer(longer.astype(">i8").tobytes())])
                    yield rows(block, d, keys.cast(pa.binary()))
            held.clear()

        def rows(block: int, depth: int, keys: pa.Array) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, dtype=np.int64)), pa.array(np.full(n, depth, dtype=np.int32)), keys], names=["block", "depth", "key"])

        for part in text_slices(batches, "text"):
            number, distinct = pd.factorize(part.column("block").to_numpy())
            raw = texts(part.column("text"))
            for k, block in enumerate(distinct.tolist()):
                mine = [words(raw[i]) for i in np.flatnonzero(number == k)]
                buffer = symbols(mine)[0]
                found, codes = held.setdefault(block, (set(), []))
                found.update(*mine)
                codes.append(pd.unique(stretches(buffer)[buffer[DEPTH:] != PAD] >> 8))
            if sum(len(found) + sum(map(len, codes)) for found, codes in held.values()) > 4_000_000:
                yield from out()
        yield from out()

    # with all columns: the rows are those that are scored, and Spark moves the texts once for both
    return map_arrow(blocks, run, "block long, depth int, key binary")


def loads(known: DataFrame) -> DataFrame:
    """(block, load): the rows of ``known`` (block, depth, key, total, follows), many of a block in one value."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def bytes_of(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Buffer]:
            values = column.combine_chunks()
            ends = np.frombuffer(values.buffers()[1], dtype=np.int32)[values.offset : values.offset + len(values) + 1]
            return ends, values.buffers()[2]

        def out() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held).sort_by([("block", "ascending"), ("depth", "ascending")])
            block, depth, total = (rows.column(c).to_numpy() for c in ("block", "depth", "total"))
            (key_at, keys), (follows_at, follows) = bytes_of(rows.column("key")), bytes_of(rows.column("follows"))
            part = lambda at, raw, a, b: raw[int(at[a]) : int(at[b])].to_pybytes() if at[b] > at[a] else b""
            heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            found = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(block)], strict=True):
                w = a + int(np.searchsorted(depth[a:b], 1))  # words, then contexts
                told = part(key_at, keys, a, w), np.diff(key_at[a : w + 1]).astype("<i4"), total[a:w].astype("<i8")
                more = depth[w:b].astype(np.uint8), part(key_at, keys, w, b), total[w:b].astype("<i8"), (np.diff(follows_at[w : b + 1]) // 8).astype("<i4"), part(follows_at, follows, w, b)
                found.append(pack(*told, *more))
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(block[heads]), pa.array(found, pa.binary())], names=["block", "load"])

        for part in batches:
            held.append(part)
            if sum(x.num_rows for x in held) > 500_000:
                yield from out()
        if sum(x.num_rows for x in held):
            yield from out()

    return map_arrow(known, run, "block long, load binary")


def told(values: list[bytes], root: np.ndarray) -> tuple[list[bytes], np.ndarray, Tree]:
    """The words with their counts, and the tree, that a block's loads hold."""
    parts = list(zip(*(unpack(x, "raw", "<i4", "<i8", "u1", ">i8", "<i8", "<i4", "raw") for x in values), strict=True)) or [()] * 8
    join = lambda k, kind: np.concatenate([np.zeros(0, dtype=kind), *parts[k]]).astype(kind)
    raw, ends = b"".join(parts[0]), np.concatenate([[0], np.cumsum(join(1, np.int64))])
    found = [raw[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
    return found, join(2, np.int64), tree_of(join(3, np.int64), join(4, np.int64), join(5, np.int64), join(6, np.int64), b"".join(parts[7]), root)


class Scores(dict):
    """Words with their base scores; others have ``missing``."""

    missing = 0.0

    def __missing__(self, word: bytes) -> float:
        return self.missing


def score(docs: DataFrame, kept: DataFrame | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): held_out, n_tokens, n_known, train_tokens, base_score, score."""
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    training = narrow.where(is_training())
    counts, vocabulary = counts_of(training)
    kept = learn(training, counts=counts) if kept is None else kept
    root = root_counts(kept)
    n_words, n_kinds = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = training.count()
    train_tokens, kinds = n_words + n_train, n_kinds + (n_train > 0)
    base = math.log10(train_tokens + kinds + 1)
    end_score = math.log10(n_train + 1) - base
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(16, -(-int(total) // block_bytes))
    blocks = narrow.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks))).withColumn("held_out", ~is_training())
    blocks = blocks.repartition(n_blocks, "block")
    # words and contexts are joined in one go, by a hash first
    as_words = vocabulary.select(F.lit(0).alias("depth"), F.col("word").alias("key"), F.col("c").alias("total"), F.lit(b"").alias("follows"))
    as_contexts = kept.where("depth > 0").select("depth", F.unhex(F.lpad(F.hex("context"), 16, "0")).alias("key"), "total", "follows")
    asked = wanted(blocks).withColumn("hash", F.xxhash64("depth", "key"))
    answer = as_words.union(as_contexts).withColumn("hash", F.xxhash64("depth", "key"))
    known = loads(asked.join(answer, ["hash", "depth", "key"]).select("block", "depth", "key", "total", "follows"))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        worker_state("blocks", dict)  # drops what another operator has kept
        found, often, tree = told(right.column("load").to_pylist(), root)
        count = Scores(zip(found, (np.log10(often + 1.0) - base).tolist(), strict=True))
        count.missing = -base
        out = []
        for part in text_slices(left.to_batches(), "text"):
            rows = [words(x) for x in texts(part.column("text"))]
            scores, n_known, base_scores = tree.score(*symbols(rows)), [], []
            for row in rows:
                each = list(map(count.__getitem__, row))
                n_known.append(len(each) - each.count(count.missing) + (n_train > 0))  # a known word scores more
                base_scores.append(math.fsum(each) + end_score)
            out.append(
                pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array([len(r) + 1 for r in rows], pa.int64()), pa.array(n_known, pa.int64()), pa.array([train_tokens] * len(rows), pa.int64()), pa.array(base_scores, pa.float64()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.Table.from_batches(out, schema=pa.schema([left.schema.field("doc_id"), left.schema.field("held_out"), *[(c, pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")], ("base_score", pa.float64()), ("score", pa.float64())]))

    return blocks.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
