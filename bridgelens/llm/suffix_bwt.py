"""Repeated-passage removal by merging Burrows-Wheeler transforms of text shards.

A byte goes if a SPAN-byte string over it also starts in a document with a smaller id.

1. Every SPAN-byte window has one anchor, the smallest-hashed GRAM-byte string in it.  Equal windows
   have equal anchors at equal places, so a window can occur twice only if its anchor does.  Blocks
   of documents send the short hashes of their anchors to cells; cells answer which are shared, and by how many.
2. A stretch of windows around one shared anchor is a piece (up to 2 * SPAN - GRAM bytes); each block
   sends its distinct pieces to the cell of their anchor, with the smallest id that has them.  The pieces of an
   anchor that very many blocks share are divided by their windows' distance from the anchor, and go to the
   cell of the bytes that all windows of a part have in common; so no phrase gathers in one cell all that surrounds it.
3. A cell lays the pieces of anchors that have several out in shards, and builds each shard's Burrows-Wheeler
   transform.  The shards are merged by refining their interleave: it begins as "all of shard 1, then all of
   shard 2, ...", and each round reads the transforms' symbols in its order, two at a time, and deals them by a stable
   counting sort; the row that an entry goes to follows from rank counts in its own shard's transform, so
   nothing here looks at the text, and no suffix is sorted anew.  A round also shows where neighbours
   begin to differ.  An interval whose rows are all of one shard needs no further round, as the shard's own order
   and common prefixes hold for it, and it is retired; what is left after SPAN symbols are the repeated intervals
   across shards.  Each interval's smallest id goes back.
4. A block marks its windows whose smallest id is smaller than the document's, and cuts.

Equal texts are one document with the smallest of their ids; a larger id loses all of its bytes if there are SPAN of them.

Defined results: null and empty texts lose nothing; rows without an id lose nothing and take nothing
from others; rows repeated with one id are one document if their texts are equal (equal ids are not smaller ids).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import give_back, map_arrow, materialize, mix64, text_slices, worker_state

SPAN, GRAM = 50, 20
#: Bytes of text (about) in a block of documents, which is also what a cell handles.
BLOCK_BYTES = 6 << 20
#: Bytes of a hash that cells compare anchors by (equal short hashes only cost work).
SHORT = 5
#: Rows of a shard (ranks fit 16 bits), and bytes of the shards that are merged together: a cell's
#: anchors are independent of one another, and small sets stay in a processor's cache.
SHARD_ROWS, MERGE_BYTES = 1 << 16, 1 << 18
#: From how many blocks on an anchor's windows are divided, and into how many parts (31: every distance of its own).
LEVELS = ((64, 2), (4096, 8), (262_144, SPAN - GRAM + 1))
CUT = 0xFF  # never a byte of UTF-8
_CHUNK = 1 << 17
#: Values that answers are gathered by, and that a block's marks are counted by, at a time.
_VALUES = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit sum of the GRAM bytes from each place on, each with a power of its own (by doubling: 1, 2, 4, 8, 16, then 4 more)."""
    with np.errstate(over="ignore"):
        h, factor, four = data.astype(np.uint64) + np.uint64(1), _ODD, None
        for step in (1, 2, 4, 8):
            if step == 4:
                four = h
            longer = h[:-step] * factor
            longer += h[step:]
            h, factor = longer, factor * factor
        n = len(data) - GRAM + 1
        h = h[:n] * np.uint64(pow(int(_ODD), 4, 1 << 64))
        h += four[16 : 16 + n]
        return h


def priorities(sums: np.ndarray) -> np.ndarray:
    """32 mixed bits of each sum, which windows choose their anchor by."""
    with np.errstate(over="ignore"):
        x = sums >> np.uint64(32)
        x ^= sums
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x >>= np.uint64(32)
        return x.astype(np.uint32)


def first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` 32-bit values the place of the first of the smallest, by doubling: the places
    (below 1 << 32) follow the values in one number, so that one minimum finds both and the first of equal ones wins."""
    least, have = (values.astype(np.uint64) << np.uint64(32)) | np.arange(len(values), dtype=np.uint64), 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[step:], least[:-step])
        have += step
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int32)


def pieces(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of all texts: owner, first window, last window, anchor hash, anchor (places in the joined
    texts); and the texts' begins."""
    sizes = np.array([len(x) for x in rows], dtype=np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    data = np.frombuffer(b"".join(rows), dtype=np.uint8)
    found = []
    width = SPAN - GRAM + 1
    for low in range(0, len(data) - SPAN + 1, _CHUNK):
        part = data[low : low + _CHUNK + SPAN - 1]
        h = gram_hashes(part)
        at = first_least(priorities(h), width)
        n = len(at)
        # pieces begin where the anchor changes and where texts do; what begins behind a text's last window is none
        a, b = np.searchsorted(begins, [low, low + n - 1], side="right") - 1
        texts = np.concatenate([begins[a : b + 1], begins[a + 1 : b + 2] - SPAN + 1]) - low
        new = np.zeros(n, dtype=bool)
        np.not_equal(at[1:], at[:-1], out=new[1:])
        new[0] = True
        new[texts[(texts >= 0) & (texts < n)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], n) - 1
        owner = np.searchsorted(begins, low + first, side="right") - 1
        whole = low + first + SPAN <= begins[owner + 1]
        first, last, owner = first[whole], last[whole], owner[whole]
        if not len(first):
            continue
        # the sums are mixed once more, as the anchor is the smallest of many, before cells are dealt by them
        found.append((owner, low + first, low + last, mix64(h[at[first]] ^ _ODD), low + at[first].astype(np.int64)))
    if not found:
        return *(np.zeros(0, dtype=np.int64) for _ in range(3)), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), begins
    owner, first, last, anchor, place = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1]) | (first[1:] != last[:-1] + 1)])  # pieces cut by a chunk's end
    heads = np.flatnonzero(new)
    tails = np.concatenate([heads[1:], [len(owner)]]) - 1
    return owner[heads], first[heads], last[tails], anchor[heads], place[heads], begins


def level_of(blocks: np.ndarray) -> np.ndarray:
    """How finely an anchor is divided that so many blocks have."""
    return np.searchsorted([least for least, _ in LEVELS], blocks, side="right").astype(np.uint8)


def divide(first: np.ndarray, last: np.ndarray, place: np.ndarray, anchor: np.ndarray, level: np.ndarray, joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, first window, last window, mark) of the pieces' parts, by piece; the mark tells where a part meets those it may share windows with."""
    whole = np.flatnonzero(level == 0)
    found = [(whole, first[whole], last[whole], anchor[whole])]
    for v, (_, parts) in enumerate(LEVELS, 1):
        here = np.flatnonzero(level == v)
        edges = [(SPAN - GRAM + 1) * k // parts for k in range(parts + 1)]
        for near, far in zip(edges, edges[1:], strict=False) if len(here) else ():  # windows that begin near .. far - 1 bytes before the anchor
            a, b = np.maximum(first[here], place[here] - far + 1), np.minimum(last[here], place[here] - near)
            some = a <= b
            piece = here[some]
            found.append((piece, a[some], b[some], anchor[piece] ^ fingerprints(joined, place[piece] - near, place[piece] - far + 1 + SPAN)))
    piece, a, b, mark = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(piece, kind="stable")
    return piece[order], a[order], b[order], mark[order]


def divided(first: int, last: int, place: int, anchor: int, level: int, joined: bytes) -> list[tuple[int, int, int]]:
    """``divide`` for one piece: (first window, last window, mark) of its parts."""
    one = [np.array([x], dtype=np.int64) for x in (first, last, place)]
    _, a, b, mark = divide(*one, np.array([anchor], dtype=np.uint64), np.array([level], dtype=np.uint8), joined)
    return list(zip(a.tolist(), b.tolist(), mark.tolist(), strict=True))


def cells_of(anchor: np.ndarray, n_cells: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(n_cells) >> np.uint64(32)).astype(np.int64)


def short_of(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64((1 << (8 * SHORT)) - 1)).astype(np.int64)


def short_bytes(values: np.ndarray) -> np.ndarray:
    """A row of SHORT bytes for each value."""
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :SHORT]


def short_values(rows: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(rows), 8), dtype=np.uint8)
    wide[:, :SHORT] = rows[:, :SHORT]
    return wide.reshape(-1).view("<i8")


def shared_anchors(values: np.ndarray, sender: np.ndarray, senders: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the values that ``senders`` (numbered, ascending) have sent, those that were sent twice or more: for each of its
    senders once, by sender and value, with their level; and where each sender's begin.  One sort, whatever the number of senders."""
    order = np.argsort(values, kind="stable")
    value, who = values[order], sender[order]
    new = np.concatenate([[True], value[1:] != value[:-1]])[: len(value)]
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(value)))
    keep = np.repeat(count > 1, count)
    keep[1:] &= new[1:] | (who[1:] != who[:-1])
    value, who, level = value[keep], who[keep], np.repeat(level_of(count), count)[keep]
    order = np.argsort(who, kind="stable")
    return value[order], level[order], np.searchsorted(who[order], np.arange(senders + 1))


class Shard:
    """Pieces laid end to end, each closed by CUT, with the Burrows-Wheeler order of the rotations of single pieces.

    ``rows``: the places of the rotations in their order; ``transform``: of each row the two symbols before it;
    ``group``: of each row the number of its run of rows with SPAN equal symbols.
    """

    def __init__(self, texts: list[bytes]) -> None:
        sizes = np.array([len(x) + 1 for x in texts], dtype=np.int64)
        ends = np.cumsum(sizes)
        self.begins = ends - sizes
        self.data = np.frombuffer(bytes([CUT]).join(texts) + bytes([CUT]), dtype=np.uint8)
        n = len(self.data)
        self.owner = np.repeat(np.arange(len(texts)), sizes)
        follow = np.arange(1, n + 1, dtype=np.int32)
        follow[ends - 1] = self.begins
        before = np.empty(n, dtype=np.int32)
        before[follow] = np.arange(n, dtype=np.int32)
        self.rows, self.group = self._order(follow, before, int(sizes.max()))
        one = before[self.rows]
        self.transform = (self.data[before[one]].astype(np.uint16) << 8) | self.data[one]

    def _order(self, follow: np.ndarray, before: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """All rotations in order, by ranks of 2, 4, 8, ... symbols: the order by the second half is the last order,
        taken that many symbols before, and one stable sort by the first half does the rest.  Twice the longest
        piece tells any two rotations of different pieces apart."""
        key = (self.data.astype(np.uint16) << 8) | self.data[follow]
        order = np.argsort(key, kind="stable").astype(np.int32)
        first = key[order]
        new = np.zeros(len(key), dtype=bool)
        np.not_equal(first[1:], first[:-1], out=new[1:])
        ahead, back, have = follow[follow], before[before], 2
        small = np.uint16 if len(key) <= 1 << 16 else np.int64
        same = None  # whether a row's first SPAN symbols are those of the row before it, as far as it is known
        while True:
            ranked = np.cumsum(new, dtype=small)
            rank = np.empty(len(key), dtype=small)
            rank[order] = ranked
            single = int(ranked[-1]) == len(key) - 1
            if have <= SPAN < 2 * have:
                rest = np.arange(len(key), dtype=np.int32)
                for _ in range(SPAN - have):
                    rest = follow[rest]
                same = rank, rank[rest]
            if single or have >= 2 * longest:
                break
            order = back[order]
            first = rank[order]
            place = np.argsort(first, kind="stable")
            order, first = order[place], first[place]
            second = rank[ahead[order]]
            np.not_equal(first[1:], first[:-1], out=new[1:])
            new[1:] |= second[1:] != second[:-1]
            ahead, back, have = ahead[ahead], back[back], 2 * have
        if same is None:  # all differ within fewer symbols
            return order, np.arange(len(key))
        a, b = same[0][order], same[1][order]
        return order, np.concatenate([[0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1]))])


def interleave(transforms: list[np.ndarray], symbols: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Merge shards by their transforms alone: (row, interval) of the rows, numbered through all shards, of those
    intervals of equal first ``symbols`` symbols that rows of several shards share."""
    begins = np.concatenate([[0], np.cumsum([len(x) for x in transforms])])
    n = int(begins[-1])
    shard = np.repeat(np.arange(len(transforms), dtype=np.int32), np.diff(begins))
    two = np.concatenate(transforms)
    # the row two symbols longer: rows with equal symbols keep their order, those with smaller ones come before
    longer = np.empty(n, dtype=np.int32)
    for begin, transform in zip(begins.tolist(), transforms, strict=False):
        longer[begin + np.argsort(transform, kind="stable")] = np.arange(begin, begin + len(transform), dtype=np.int32)
    row, interval = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.int32)
    for _ in range(symbols // 2):
        key = two[row]
        order = np.argsort(key, kind="stable")  # a radix sort for 16 bits
        key, old = key[order], interval[order]
        row = longer[row[order]]
        first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (old[1:] != old[:-1])]))
        size = np.diff(np.append(first, len(row)))
        # an interval's rows come by shard, so its ends tell whether there are several
        mixed = shard[row[first]] != shard[row[first + size - 1]]
        row = row[np.repeat(mixed, size)]
        interval = np.repeat(np.arange(int(mixed.sum()), dtype=np.int32), size[mixed])
        if not len(row):
            break
    return row, interval


def least_ids(texts: list[bytes], ids: np.ndarray, shard_rows: int = SHARD_ROWS) -> list[np.ndarray]:
    """For each text, the smallest id among all that have the window, for each of its windows."""
    fill = np.cumsum([len(x) + 1 for x in texts])
    cuts = [0]
    while cuts[-1] < len(texts):
        base = int(fill[cuts[-1] - 1]) if cuts[-1] else 0
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(fill, base + shard_rows, side="right"))))
    shards = [Shard(texts[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    least = []
    for shard, a in zip(shards, cuts, strict=False):
        own = ids[a + shard.owner[shard.rows]]
        first = np.flatnonzero(np.concatenate([[True], shard.group[1:] != shard.group[:-1]]))
        least.append(np.minimum.reduceat(own, first)[shard.group])
    found = np.concatenate(least)
    if len(shards) > 1:
        row, interval = interleave([x.transform for x in shards])
        if len(row):
            first = np.flatnonzero(np.concatenate([[True], interval[1:] != interval[:-1]]))
            found[row] = np.minimum.reduceat(found[row], first)[interval]
    out, begin = [], 0
    for shard, a, b in zip(shards, cuts, cuts[1:], strict=False):
        at = np.empty(len(shard.rows), dtype=np.int64)
        at[shard.rows] = found[begin : begin + len(shard.rows)]
        out += [at[k : k + len(x) - SPAN + 1] for k, x in zip(shard.begins.tolist(), texts[a:b], strict=True)]
        begin += len(shard.rows)
    return out


def merged_least_ids(texts: list[bytes], marks: np.ndarray, ids: np.ndarray, merge_bytes: int = MERGE_BYTES) -> list[np.ndarray]:
    """``least_ids`` in sets of about ``merge_bytes``; a mark's texts are in one set, and a text without others has only its own id."""
    order = np.argsort(marks, kind="stable")
    ranked = marks[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.append(first, len(order)))
    alone = order[first[size == 1]]
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
    windows = np.array([len(texts[k]) - SPAN + 1 for k in alone.tolist()], dtype=np.int64)
    flat, ends = np.repeat(ids[alone], windows), np.cumsum(windows)
    for k, a, b in zip(alone.tolist(), (ends - windows).tolist(), ends.tolist(), strict=True):
        out[k] = flat[a:b]
    order, size = order[np.repeat(size > 1, size)], size[size > 1]
    fill = np.cumsum([len(texts[k]) for k in order.tolist()]) // merge_bytes
    cuts, last = [0], 0
    for k in np.cumsum(size).tolist():
        if k < len(order) and fill[k - 1] > last:
            cuts.append(k)
            last = fill[k - 1]
    for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
        some = order[a:b].tolist()
        for k, found in zip(some, least_ids([texts[k] for k in some], ids[some]) if some else [], strict=True):
            out[k] = found
    return out


def collapse(docs: DataFrame, n_blocks: int) -> DataFrame:
    """(block, digest, doc_id, text): in each task every distinct text once, at its first place; a later
    copy only if its id is smaller, and then without text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for part in text_slices(batches, "text"):
            out: list[tuple[int, bytes, int, bytes | None]] = []
            for key, raw in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                digest = hashlib.md5(raw).digest()
                known = seen.get(digest)
                if known is None or key < known:
                    seen[digest] = key
                    out.append((int.from_bytes(digest[:6], "little") % n_blocks, digest, key, raw if known is None else None))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)], names=["block", "digest", "doc_id", "text"])

    usable = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("text") > 0)).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(usable, run, "block long, digest binary, doc_id long, text binary").repartition(n_blocks, "block")


def nodes_of(block: pa.Table) -> tuple[list[bytes], np.ndarray, list[bytes]]:
    """The distinct texts of a block: digests, smallest ids, texts (in the order of the ids)."""
    worker_state("blocks", dict)  # drops what another operator has kept
    ids: dict[bytes, int] = {}
    found: dict[bytes, bytes] = {}
    for digest, key, raw in zip(block.column("digest").to_pylist(), block.column("doc_id").to_pylist(), block.column("text").to_pylist(), strict=True):
        ids[digest] = min(key, ids.get(digest, key))
        if raw is not None:
            found[digest] = raw
    digests = sorted(ids, key=lambda d: (ids[d], d))
    return digests, np.array([ids[d] for d in digests], dtype=np.int64), [found[d] for d in digests]


_ROW = "cell long, block long, load binary"


def _rows(cells: list[int] | pa.Array, blocks: list[int] | pa.Array, loads: list[bytes] | pa.Array) -> pa.Table:
    return pa.table([x if isinstance(x, (pa.Array, pa.ChunkedArray)) else pa.array(x, t) for x, t in ((cells, pa.int64()), (blocks, pa.int64()), (loads, pa.binary()))], names=["cell", "block", "load"])


def heads_of(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal ones begin, and the end."""
    return np.append(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]), len(ordered))


def ranges(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begins[0], begins[0] + 1, ... (sizes[0] numbers), begins[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def cut_up(rows: np.ndarray, heads: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary value for each of the stretches that begin at ``heads`` (the last is the end)."""
    data = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(heads) - 1, [None, pa.py_buffer((heads * rows.shape[1]).astype(np.int32)), pa.py_buffer(data)])


def laid_out(loads: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """What ``cut_up`` made: all rows, and how many each value had."""
    return np.frombuffer(b"".join(loads.to_pylist()), dtype=np.uint8).reshape(-1, width), pc.binary_length(loads).to_numpy().astype(np.int64) // width


def pack_all(heads: np.ndarray, arrays: list[np.ndarray], rest: bytes, rest_heads: np.ndarray) -> list[bytes]:
    """A compressed value for each stretch of the ``arrays``, with its part of ``rest``; the values share one compressor."""
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    fields = [(x.tobytes(), x.itemsize) for x in arrays]
    out = []
    for a, b, c, d in zip(heads[:-1].tolist(), heads[1:].tolist(), rest_heads[:-1].tolist(), rest_heads[1:].tolist(), strict=True):
        out.append(squeeze(b"".join([(b - a).to_bytes(4, "little"), *[x[a * w : b * w] for x, w in fields], rest[c:d]])))
    return out


def unpack_all(loads: list[bytes], *kinds: str) -> tuple[np.ndarray, list[np.ndarray], list[bytes]]:
    """What ``pack_all`` made: the sizes of the stretches, the arrays laid end to end, and the parts of the rest."""
    import zstandard

    spread = zstandard.ZstdDecompressor().decompress
    widths = [np.dtype(x).itemsize for x in kinds]
    sizes, fields, rest = [], [[] for _ in kinds], []
    for load in loads:
        raw = spread(load)
        n, at = int.from_bytes(raw[:4], "little"), 4
        sizes.append(n)
        for field, width in zip(fields, widths, strict=True):
            field.append(raw[at : at + n * width])
            at += n * width
        rest.append(raw[at:])
    return np.array(sizes, dtype=np.int64), [np.frombuffer(b"".join(x), dtype=kind) for x, kind in zip(fields, kinds, strict=True)], rest


def lean(run: Callable) -> Callable:
    """``run`` for groups of one or (cogroups) two tables; the worker gives back what each call has freed."""

    def one(table: pa.Table) -> pa.Table:
        out = run(table)
        give_back()
        return out

    def two(table: pa.Table, answers: pa.Table) -> pa.Table:
        out = run(table, answers)
        give_back()
        return out

    return two if run.__code__.co_argcount == 2 else one


def removals(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_text: bool = False) -> DataFrame:
    """Per distinct text with an id: digest, node (its smallest id), n_removed, n_spans, kept_sha256 (and the kept text)."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_cells = max(16, -(-int(total) // block_bytes))
    blocks = collapse(docs, n_cells)

    def send_anchors(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        owner, _, _, anchor, _, _ = pieces(nodes_of(table)[2])
        order = np.argsort(anchor, kind="stable")  # an anchor's owners stay in their order
        owner, anchor = owner[order], anchor[order]
        # once for a block, twice if several of its texts have it: whoever counts two knows it is shared
        once = np.concatenate([[True], anchor[1:] != anchor[:-1]])[: len(anchor)]
        other = np.flatnonzero(~once & np.concatenate([[False], owner[1:] != owner[:-1]])[: len(anchor)])
        once[other[heads_of(anchor[other])[:-1]]] = True
        anchor = anchor[once]
        cell = cells_of(anchor, n_cells)
        heads = heads_of(cell)
        return _rows(pa.array(cell[heads[:-1]]), [block] * (len(heads) - 1), cut_up(short_bytes(short_of(anchor)), heads))

    def share(table: pa.Table) -> pa.Table:
        sent, sizes = laid_out(table.column("load"), SHORT)
        value, level, heads = shared_anchors(short_values(sent), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), len(sizes))
        keep = np.flatnonzero(np.diff(heads))
        loads = cut_up(np.concatenate([short_bytes(value), level[:, None]], axis=1), np.append(heads[keep], heads[-1]))
        return _rows(table.column("cell").take(pa.array(keep)), table.column("block").take(pa.array(keep)), loads)

    def send_pieces(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not answers.num_rows or not table.num_rows:
            return _rows([], [], [])
        block = table.column("block")[0].as_py()
        _, ids, rows = nodes_of(table)
        owner, first, last, anchor, place, _ = pieces(rows)
        got, sizes = laid_out(answers.column("load"), SHORT + 1)
        shared = (np.repeat(answers.column("cell").to_numpy(), sizes) << (8 * SHORT)) | short_values(got)
        order = np.argsort(shared, kind="stable")
        shared, level = shared[order], got[order, SHORT]
        code = (cells_of(anchor, n_cells) << (8 * SHORT)) | short_of(anchor)
        at = np.minimum(np.searchsorted(shared, code), len(shared) - 1)
        mine = np.flatnonzero(shared[at] == code)
        joined = b"".join(rows)
        level = level[at[mine]]
        piece, x, y, marks = divide(first[mine], last[mine], place[mine], anchor[mine], level, joined)
        texts = [joined[a:b] for a, b in zip(x.tolist(), (y + SPAN).tolist(), strict=True)]
        # the texts come by ascending id, so the first of equal pieces has the smallest: it is the one that is put in last
        some = np.fromiter(dict(zip(reversed(texts), range(len(texts) - 1, -1, -1), strict=True)).values(), dtype=np.int64)
        piece, marks = piece[some], marks[some]
        levels = level[piece]
        # a divided piece's mark is dealt by another mix of it
        cell = cells_of(np.where(levels > 0, mix64(marks), marks), n_cells)
        order = np.argsort(cell, kind="stable")
        piece, some, heads = piece[order], some[order], heads_of(cell[order])
        parts = [texts[k] for k in some.tolist()]
        size = np.array([len(t) for t in parts], dtype="<u2")
        ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
        loads = pack_all(heads, [marks[order], anchor[mine[piece]], levels[order], ids[owner[mine[piece]]], size], b"".join(parts), ends[heads])
        return _rows(pa.array(cell[order][heads[:-1]]), [block] * len(loads), loads)

    def merge_cell(table: pa.Table) -> pa.Table:
        sizes, (marks, anchor, level, ids, lengths), rest = unpack_all(table.column("load").to_pylist(), "<u8", "<u8", "u1", "<i8", "<u2")
        raw, ends = b"".join(rest), np.cumsum(lengths, dtype=np.int64)
        sent = [raw[a:b] for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        del raw, rest
        number = {text: k for k, text in enumerate(dict.fromkeys(sent))}
        texts = list(number)
        mine = np.fromiter(map(number.__getitem__, sent), dtype=np.int64, count=len(sent))
        del number, sent
        home, least = np.empty(len(texts), dtype=np.uint64), np.full(len(texts), np.iinfo(np.int64).max)
        home[mine] = marks
        np.minimum.at(least, mine, ids)
        found = merged_least_ids(texts, home, least)
        # a run of one id is sent as one number
        flat = np.concatenate(found)
        begins = np.cumsum([0, *map(len, found[:-1])])
        single = np.minimum.reduceat(flat, begins) == np.maximum.reduceat(flat, begins)
        counts = np.where(single, 1, np.diff(np.append(begins, len(flat))))
        prints = np.array([fingerprint(x) for x in texts], dtype="<u8")
        heads = np.concatenate([[0], np.cumsum(sizes)])
        ends = np.concatenate([[0], np.cumsum(counts[mine])])
        loads, low = [], 0
        while low < len(sizes):  # a few blocks' answers at a time
            high = max(low + 1, int(np.searchsorted(ends[heads], ends[heads[low]] + _VALUES, side="right")) - 1)
            a, b = heads[low], heads[high]
            some = mine[a:b]
            values = flat[ranges(begins[some], counts[some])].astype("<i8").tobytes()
            loads += pack_all(heads[low : high + 1] - a, [anchor[a:b], level[a:b], prints[some], counts[some].astype("<u2")], values, 8 * (ends[heads[low : high + 1]] - ends[a]))
            low = high
        return _rows(table.column("cell"), table.column("block"), loads)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        digests, ids, rows = nodes_of(table) if table.num_rows else ([], np.zeros(0, dtype=np.int64), [])
        joined = b"".join(rows)
        covered = np.zeros(len(joined) + 1, dtype=np.int8)  # at most SPAN windows are over a byte
        begins = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
        if answers.num_rows and rows:
            _, (known, level, prints, counts), rest = unpack_all(answers.column("load").to_pylist(), "<u8", "u1", "<u8", "<u2")
            values = np.frombuffer(b"".join(rest), dtype="<i8")
            del rest
            known, at = np.unique(known, return_index=True)
            level = level[at]
            order = np.argsort(prints, kind="stable")
            prints, counts, starts = prints[order], counts[order].astype(np.int64), (np.cumsum(counts, dtype=np.int64) - counts)[order]
            owner, first, last, anchor, place, _ = pieces(rows)
            at = np.minimum(np.searchsorted(known, anchor), len(known) - 1)
            mine = np.flatnonzero(known[at] == anchor)
            piece, x, y, _ = divide(first[mine], last[mine], place[mine], anchor[mine], level[at[mine]], joined)
            own = fingerprints(joined, x, y + SPAN)
            at = np.minimum(np.searchsorted(prints, own), len(prints) - 1)
            there = np.flatnonzero(prints[at] == own)
            x, y, me, count, start = x[there], y[there], ids[owner[mine[piece[there]]]], counts[at[there]], starts[at[there]]
            whole = np.flatnonzero(count == 1)
            whole = whole[values[start[whole]] < me[whole]]
            np.add.at(covered, x[whole], 1)
            np.add.at(covered, y[whole] + SPAN, -1)
            other = np.flatnonzero(count > 1)
            steps = np.cumsum(count[other]) // _VALUES
            for some in np.split(other, heads_of(steps)[1:-1]):
                n = count[some]
                window = ranges(x[some], n)[values[ranges(start[some], n)] < np.repeat(me[some], n)]
                np.add.at(covered, window, 1)
                np.add.at(covered, window + SPAN, -1)
        gone = np.cumsum(covered[:-1], dtype=np.int8, out=covered[:-1]) > 0
        data = np.frombuffer(joined, dtype=np.uint8)
        heads = gone.copy()  # of the stretches that go
        heads[1:] &= ~gone[:-1]
        heads[begins[:-1]] = gone[begins[:-1]]
        removed, spans = (np.add.reduceat(x, begins[:-1], dtype=np.int64) if rows else [] for x in (gone, heads))
        sums, kept = [], []
        for raw, n, a, b in zip(rows, list(removed), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
            if n:
                raw = data[a:b][~gone[a:b]].tobytes()
            sums.append(hashlib.sha256(raw).hexdigest())
            if with_text:
                kept.append(raw.decode("utf-8", "ignore"))  # a cut may leave a part of a character
        columns = [pa.array(digests, pa.binary()), pa.array(ids), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sums, pa.string())]
        names = ["digest", "node", "n_removed", "n_spans", "kept_sha256"]
        if with_text:
            columns, names = [*columns, pa.array(kept, pa.string())], [*names, "kept"]
        return pa.table(columns, names=names)

    shared = blocks.groupBy("block").applyInArrow(lean(send_anchors), _ROW).groupBy("cell").applyInArrow(lean(share), _ROW)
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(lean(send_pieces), _ROW)
    answers = sent.groupBy("cell").applyInArrow(lean(merge_cell), _ROW)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(lean(cut), "digest binary, node long, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def fingerprint(text: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(text)


def fingerprints(joined: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``fingerprint`` of many stretches of ``joined``."""
    import xxhash

    of = xxhash.xxh3_64_intdigest
    return np.array([of(joined[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], dtype=np.uint64)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256."""
    found = materialize(removals(docs), "removals")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.md5(text)).alias("digest"), F.when(F.col("doc_id").isNull() | (F.octet_length(text) == 0), F.sha2(text, 256)).alias("own"))
    copy = (F.col("doc_id") > F.col("node")) & (F.col("n_bytes") >= SPAN)
    return (
        rows.join(found, "digest", "left")
        .withColumn("node", F.when(F.col("own").isNull(), F.col("node")))
        .select(
            "doc_id",
            "n_bytes",
            F.when(copy, F.col("n_bytes")).when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("n_removed")).alias("n_removed"),
            F.when(copy, F.lit(1)).when(F.col("node").isNull(), F.lit(0)).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
            F.when(copy, F.sha2(F.lit(""), 256)).when(F.col("node").isNull(), F.col("own")).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        )
    )


def cut_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut from their texts; a document that loses all of its text goes.

    Its own columns stay; n_chars, if it is there, follows the text.  Rows without an id or text stay as they are.
    """
    found = removals(docs, with_text=True).select("digest", "node", "kept")
    has = F.col("doc_id").isNotNull() & (F.coalesce(F.octet_length("text"), F.lit(0)) > 0)
    others = [c for c in docs.columns if c != "text"]
    narrow = docs.where(has).select(*[F.col(f"`{c}`").alias(f"__{c}") for c in others], F.octet_length("text").alias("n_bytes"), F.unhex(F.md5("text")).alias("digest"))
    copy = (F.col("__doc_id") > F.col("node")) & (F.col("n_bytes") >= SPAN)
    kept = narrow.join(found, "digest").where(~copy & (F.col("kept") != "")).withColumn("__text", F.col("kept"))
    if "n_chars" in others:
        kept = kept.withColumn("__n_chars", F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return kept.select(*[F.col(f"__{c}").alias(c) for c in docs.columns]).union(docs.where(~has))


#: The result of ``repeated_passages`` with its fixed parameters, in DuckDB's SQL over the table documents.
ORACLE_SQL = r"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents
), parts AS (
  SELECT doc_id, n, h, unnest(range(0, n - 49, 200)) AS low FROM texts WHERE n >= 50
), short AS (
  SELECT doc_id, low, least(200, n - 49 - low) AS size, h[2 * low + 1:2 * low + 498] AS part FROM parts
), places AS (
  SELECT doc_id, low, part, unnest(range(size)) AS j FROM short
), windows AS (
  SELECT doc_id, low + j AS k, md5(part[2 * j + 1:2 * j + 100]) AS w FROM places
), firsts AS (
  SELECT w, min(doc_id) AS least FROM windows GROUP BY w HAVING count(*) > 1
), gone AS (
  SELECT doc_id, k, k - lag(k, 1, -100) OVER (PARTITION BY doc_id ORDER BY k) > 50 AS new FROM windows JOIN firsts USING (w) WHERE least < doc_id
), numbered AS (
  SELECT doc_id, k, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY k) AS span FROM gone
), spans AS (
  SELECT doc_id, span, min(k) AS a, max(k) + 50 AS b FROM numbered GROUP BY doc_id, span
), cut AS (
  SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id
), kept AS (
  SELECT doc_id, n, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
         CASE WHEN n_spans IS NULL THEN h ELSE
           array_to_string(list_transform(range(n_spans + 1), lambda i: h[2 * (CASE WHEN i = 0 THEN 0 ELSE ends[i] END) + 1:2 * (CASE WHEN i = n_spans THEN n ELSE starts[i + 1] END)]), '') END AS rest
  FROM texts LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n::BIGINT AS n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""
