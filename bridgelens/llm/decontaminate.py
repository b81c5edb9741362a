"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared in lower case with every run of white space as one space.  A document leaks an item if a window
of WINDOW characters of the item, anywhere in it, occurs in the document with at most EDITS edits; of an
item shorter than that the whole must occur, with edits in proportion, and one of less than SHORTEST characters
says so little that only a document which consists of it leaks it.

The index holds the item's q-grams at every STEP-th character (its seeds), so each edit spoils at most
GRAM / STEP of them, and a window of m characters with at most e edits shares at least
(m - GRAM + 1) / STEP - e * GRAM / STEP seeds with the document, whose diagonals (place in the document
less place in the item) lie within e of each other.  So the seeds that a text shares with the benchmark are counted in
overlapping bands of diagonals, BAND + e wide with a new band every BAND; stretches of a band that meet the
bound within a window's length are regions.  In a region all q-grams are compared, not the seeds alone: a window shares
m - GRAM + 1 - e * GRAM of them or more, and those that do are verified by an alignment inside the band.

The benchmark is sent to the tasks in parts of at most PART_BYTES, one after another, however large it
is; a part's index takes 3 to 6 bytes for each of its characters, by the widest of them, and twice as much while it is made.

Defined results: null or empty texts match nothing, and nor do such items; rows repeated with one id are
reported once per item; a document or item without an id is reported with a null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import map_arrow, mix64, text_slices, worker_state

#: Length of the q-grams and the step between those that are indexed, in characters; STEP divides GRAM.
GRAM, STEP = 8, 4
#: Length of the windows that are looked for, and the edits that each may have.
WINDOW, EDITS = 50, 3
#: Diagonals between the beginnings of two bands.
BAND = 16
SHORTEST = 20
PART_BYTES = 64 << 20
#: Hits that are counted at a time.
HITS = 2_000_000
_WALL = 0xFFFFFFFF  # no character; stands between texts


def normal(text: str | None) -> np.ndarray:
    """The characters that are compared."""
    return np.frombuffer(" ".join((text or "").lower().split()).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def grams(chars: np.ndarray, q: int = GRAM) -> np.ndarray:
    """A 32-bit hash of the q characters from each place on."""
    n = len(chars) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    with np.errstate(over="ignore"):
        h = np.zeros(n, dtype=np.uint64)
        for k in range(q):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += chars[k : k + n]
        return (mix64(h) >> np.uint64(32)).astype(np.uint32)


def budget(m: int) -> int:
    """The edits allowed in a window of m characters."""
    return m * EDITS // WINDOW


def least_seeds(m: int) -> int:
    """The seeds that a window of m characters shares with a text that holds it within its budget."""
    return (m - GRAM + 1) // STEP - budget(m) * GRAM // STEP


class Index:
    """The characters of some benchmark items, and where their seeds are."""

    def __init__(self, items: list[tuple[int | None, str | None]]) -> None:
        #: items that are matched whole
        self.whole: dict[bytes, list[int | None]] = {}
        self.items: list[int | None] = []
        sizes, parts, seeds, begin = [], [], [], 0
        for key, text in items:
            chars = normal(text)
            if len(chars) < SHORTEST:
                if len(chars):
                    self.whole.setdefault(chars.tobytes(), []).append(key)
                continue
            mine = grams(chars)[::STEP].astype(np.uint64) << np.uint64(32)
            seeds.append(mine | np.arange(begin, begin + STEP * len(mine), STEP, dtype=np.uint64))
            # as few bytes as the characters need
            parts.append(chars.astype(np.uint8 if (most := chars.max()) < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32))
            self.items.append(key)
            sizes.append(len(chars))
            begin += len(chars)
        self.size = np.array(sizes, dtype=np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.chars = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint8)
        self.window = np.minimum(self.size, WINDOW)
        self.edits = self.window * EDITS // WINDOW
        self.least = (self.window - GRAM + 1) // STEP - self.edits * GRAM // STEP
        del parts
        both = np.concatenate(seeds or [np.zeros(0, dtype=np.uint64)])
        del seeds
        both.sort()
        self.place = both.astype(np.uint32)
        both >>= np.uint64(32)
        self.hash = both.astype(np.uint32)
        #: a first, coarse test of a hash
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[self.hash >> np.uint32(10)] = True

    def item_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def hits(self, chars: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(place in the text, place in the items) of every seed that they share, about HITS at a time; as many
        characters as a window may take are looked at again with the next ones."""
        h = grams(chars)
        at = np.flatnonzero(self.maybe[h >> np.uint32(10)])
        low = np.searchsorted(self.hash, h[at], side="left")
        count = np.searchsorted(self.hash, h[at], side="right") - low
        at, low, count = at[count > 0], low[count > 0], count[count > 0]
        ends = np.cumsum(count)
        first = 0
        while first < len(at):
            base = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(at, at[first] + 4 * WINDOW)), int(np.searchsorted(ends, base + HITS, side="right")))
            n = count[first:last]
            entry = np.repeat(low[first:last] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield np.repeat(at[first:last], n), self.place[entry].astype(np.int64)
            if last == len(at):
                return
            first = int(np.searchsorted(at, at[last] - 2 * WINDOW))

    def regions(self, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(band, place in the text, first and last place in the items) of the first and last seed of each stretch
        that meets its item's bound."""
        out = []
        for at, place in self.hits(chars):
            item = self.item_at(place)
            diagonal = at - place + len(self.chars)  # not negative
            band, early = diagonal // BAND, diagonal % BAND < self.edits[item]  # lies in the band before, too
            band, at, place, item = (np.concatenate([x, y[early]]) for x, y in ((band, band - 1), (at, at), (place, place), (item, item)))
            # hits in a band that has too few of them anywhere go first, by counts of hashed bands
            bits = max(8, len(band).bit_length() + 1)
            cell = (mix64(band) >> np.uint64(64 - bits)).astype(np.int64)
            may = np.bincount(cell, minlength=1 << bits)[cell] >= self.least[item]
            band, at, place, item = band[may], at[may], place[may], item[may]
            order = np.lexsort((at, band, item))
            band, at, place, item = band[order], at[order], place[order], item[order]
            for least in np.unique(self.least[item]).tolist():
                first = np.flatnonzero(self.least[item] == least)
                first = first[first + least - 1 < len(at)]
                last = first + least - 1
                same = (item[first] == item[last]) & (band[first] == band[last])
                near = at[last] - at[first] <= self.window[item[first]] + self.edits[item[first]] - GRAM
                first, last = first[same & near], last[same & near]
                out.append((band[first], at[first], place[first], place[last]))
        if not out:
            return (np.zeros(0, dtype=np.int64),) * 4
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def windows(self, chars: np.ndarray, band: np.ndarray, low: np.ndarray, high: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, window's place in the items, q-grams) of the windows that begin in low..high of each region and share
        enough q-grams with the text inside its band."""
        out = []
        for m in np.unique(self.window[item]).tolist():
            group = np.flatnonzero(self.window[item] == m)
            grams_, need = m - GRAM + 1, m - GRAM + 1 - budget(m) * GRAM
            for some in np.array_split(group, -(-len(group) // 512)):
                first, count = low[some], high[some] - low[some] + 1
                length = int(count.max()) + m - 1
                place = first[:, None] + np.arange(length)
                inside = place < (high[some] + m)[:, None]
                pattern = self.chars[np.minimum(place, len(self.chars) - 1)]
                begin = first + band[some] * BAND - len(self.chars)
                at = begin[:, None] + np.arange(length + BAND + EDITS)
                text = np.where((at >= 0) & (at < len(chars)), chars[np.clip(at, 0, len(chars) - 1)], np.uint32(_WALL))
                shared = np.zeros((len(some), length - GRAM + 1), dtype=bool)
                for k in range(BAND + EDITS):  # one diagonal of the band after another
                    same = (text[:, k : k + length] == pattern) & inside
                    step = 1
                    while step < GRAM:  # runs of 1, 2, 4, ... equal characters
                        same = same[:, :-step] & same[:, step:]
                        step *= 2
                    shared |= same
                sums = np.concatenate([np.zeros((len(some), 1), dtype=np.int64), np.cumsum(shared, axis=1)], axis=1)
                found = sums[:, grams_:] - sums[:, :-grams_]
                row, start = np.nonzero((found >= need) & (np.arange(found.shape[1]) < count[:, None]))
                out.append((some[row], first[row] + start, found[row, start]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def verify(self, chars: np.ndarray, start: np.ndarray, size: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits of the ``size`` characters of the items from ``start`` on against the text inside a band, and
        where that alignment ends in the text.

        Row i holds, for each diagonal of the band and EDITS more on either side, the edits of the first
        i characters of the window against a stretch of text that begins anywhere in the band.
        """
        edits, ends = np.full(len(start), WINDOW, dtype=np.int64), np.zeros(len(start), dtype=np.int64)
        width = BAND + 3 * EDITS + 1
        steps = np.arange(width)
        begin = start + band * BAND - len(self.chars) - EDITS
        for m in np.unique(size).tolist():
            group = np.flatnonzero(size == m)
            for some in np.array_split(group, -(-len(group) // 2048)):
                at = begin[some][:, None] + np.arange(m + width)
                text = np.where((at >= 0) & (at < len(chars)), chars[np.clip(at, 0, len(chars) - 1)], np.uint32(_WALL))
                pattern = self.chars[start[some][:, None] + np.arange(m)]
                row = np.zeros((len(some), width), dtype=np.int32)
                for i in range(m):
                    new = row + (text[:, i : i + width] != pattern[:, i : i + 1])
                    np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
                    row = np.minimum.accumulate(new - steps, axis=1) + steps
                best = row.argmin(axis=1)
                edits[some] = row[np.arange(len(some)), best]
                ends[some] = begin[some] + m + best
        return edits, ends

    def search(self, rows: list[np.ndarray]) -> list[tuple[int, int | None, int, int, int, int]]:
        """(text, item's id, confirmed windows, start, end, edits of the best) for every leaked item of every text.

        Of each region the window that shares most is verified first; then, for a text and an item of which none was
        confirmed, all that share enough.
        """
        out = [(k, key, 1, 0, len(r), 0) for k, r in enumerate(rows) if 0 < len(r) < SHORTEST for key in self.whole.get(r.tobytes(), ())]
        if not len(self.hash):
            return out
        wall = np.array([_WALL], dtype=np.uint32)
        chars = np.concatenate([x for r in rows for x in (r, wall)]) if rows else np.zeros(0, dtype=np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(r) + 1 for r in rows])])
        band, at, low, high = self.regions(chars)
        if not len(band):
            return out
        item, text = self.item_at(low), np.searchsorted(begins, at, side="right") - 1
        size = self.window[item]
        # the windows of an item that hold a region's seeds; other seeds of the band may stand between them
        first, last, wide = self.begin[item], self.begin[item] + self.size[item] - size, BAND + EDITS
        earliest, latest = np.clip(high + GRAM - size, first, last), np.clip(low, first, last)
        lowest, highest = np.maximum(first, np.minimum(earliest, latest) - wide), np.minimum(last, np.maximum(earliest, latest) + wide)
        # regions of a band that begin within one window's length are one
        order = np.lexsort((lowest, at // WINDOW, band, item, text))
        key = np.stack([text, item, band, at // WINDOW])[:, order]
        heads = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        text, item, band = (x[order][heads] for x in (text, item, band))
        lowest, highest = np.minimum.reduceat(lowest[order], heads), np.maximum.reduceat(highest[order], heads)
        found: dict[tuple[int, int], dict[int, tuple[int, int]]] = {}

        def confirm(region: np.ndarray, start: np.ndarray) -> None:
            _, one = np.unique(np.stack([start, band[region], text[region]]), axis=1, return_index=True)
            start, region = start[one], region[one]
            edits, ends = self.verify(chars, start, self.window[item[region]], band[region])
            good = edits <= self.edits[item[region]]
            for t, i, s, end, cost in zip(text[region[good]].tolist(), item[region[good]].tolist(), start[good].tolist(), ends[good].tolist(), edits[good].tolist(), strict=True):
                mine = found.setdefault((t, i), {})
                mine[s] = min(mine.get(s, (cost, end)), (cost, end))

        region, start, shared = self.windows(chars, band, lowest, highest, item)
        if len(region):
            most = np.lexsort((start, -shared, region))
            confirm(region[most][one := np.unique(region[most], return_index=True)[1]], start[most][one])
            known = np.array(sorted(t * len(self.items) + i for t, i in found), dtype=np.int64)
            rest = ~np.isin(text[region] * len(self.items) + item[region], known)
            confirm(region[rest], start[rest])
        for (t, i), mine in found.items():
            begin, m = int(begins[t]), int(self.window[i])
            low_, high_ = (f(end for _, end in mine.values()) - begin for f in (min, max))
            out.append((t, self.items[i], len(mine), max(0, low_ - m), high_, min(cost for cost, _ in mine.values())))
        return out


def benchmark_parts(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator:
    """The benchmark's items as broadcast values of a bounded size, one after another."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    n_parts = max(1, -(-int(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // part_bytes))
    for part in range(n_parts):
        some = items.where(F.pmod(F.xxhash64("text"), F.lit(n_parts)) == part).collect()
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, [(r["item_id"], r["text"]) for r in some]))


def index_of(sent) -> Index:
    """The index of a part, made once per Python worker."""
    key, rows = sent.value
    return worker_state(("index", key), lambda: Index(rows))


def leaks(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, n_segments, start, end, edits) for each document that holds a part of an item;
    places count characters of the normalised text."""
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    ddl = f"doc_id {doc_kind}, item_id {item_kind}, n_segments int, start long, end long, edits int"
    out = None
    for sent in benchmark_parts(benchmark, part_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = index_of(sent)
            for batch in text_slices(batches, "text", 1 << 20):
                found = index.search([normal(t) for t in batch.column("text").to_pylist()])
                if found:
                    text, item, n, low, high, edits = zip(*found, strict=True)
                    ids = pa.array(item)
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(text)), ids if ids.type != pa.null() else ids.cast(pa.int64()), pa.array(n, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(edits, pa.int32())], names=["doc_id", "item_id", "n_segments", "start", "end", "edits"])

        mine = map_arrow(docs.select("doc_id", "text"), run, ddl)
        out = mine if out is None else out.union(mine)
    best = F.struct("edits", "start", "end", "n_segments")
    return out.groupBy("doc_id", "item_id").agg(F.min(best).alias("m")).select("doc_id", "item_id", "m.n_segments", "m.start", "m.end", "m.edits")


def drop_leaking(docs: DataFrame, benchmark: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no part of a benchmark item, with their own columns, in one narrow pass a part."""
    for sent in benchmark_parts(benchmark, part_bytes):

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = index_of(sent)
            for batch in text_slices(batches, "text", 1 << 20):
                leaking = {x[0] for x in index.search([normal(t) for t in batch.column("text").to_pylist()])}
                yield batch.filter(pa.array([k not in leaking for k in range(batch.num_rows)]))

        docs = map_arrow(docs, run, docs.schema)
    return docs
