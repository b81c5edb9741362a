"""Best-fit packing by minimum bin slack.

Every bin is filled by the fullest combination of piece lengths still available, found by subset
sums in one big integer (bit s: the sum s can be reached) and removed before the next bin.  Pieces
of one length are interchangeable, so the search works on the histogram of lengths, which has at
most ``capacity`` entries at any size of input, and takes a combination as often as the counts allow.
Spark then numbers the pieces of each length and looks their place up in that plan.

Defined results: a null or empty text is one piece that holds only the end id; a text is cut only
if it alone is longer than ``capacity``; repeated rows are packed each; a null id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bridgelens.llm.common import map_arrow, materialize, text_slices
from bridgelens.llm.tokenizing import encoder, tokenizer_path

CAPACITY = 2048
END = 0
#: Pieces that one task numbers together.
NUMBERED = 500
#: Distinct stretches that a worker's encoder remembers at a pipeline's end, when an executor's JVM has
#: grown and Spark hands tasks to its idle workers in turn, so that each of them comes to hold an encoder.
REMEMBERED = 300_000


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, remember: int | None = None) -> DataFrame:
    """Whole texts as id pieces: doc_id, piece, start, length, ids_crc32 (and the ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False, remember).encode
        end = np.array([END], dtype="<u4").tobytes()
        for part in text_slices(batches, "text"):
            rows, number, start, length, crc, ids = [], [], [], [], [], []
            for i, raw in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                raw += end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    cut = raw[at : at + 4 * capacity]
                    rows.append(i)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    if with_ids:
                        ids.append(cut)
            columns = [part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


def fullest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How often to take each length for the fullest bin, the longest lengths first.

    The longest available length seeds the bin (as it must go somewhere, and fits least often);
    subset sums over the others, each as often as it is there and fits, find the least slack.
    """
    lengths = sorted(counts, reverse=True)
    seed = lengths[0]
    room = capacity - seed
    mask, goal = (1 << (room + 1)) - 1, 1 << room
    reach, steps = 1, []
    for x in lengths:
        if x > room:
            continue
        left = min(counts[x] - (x == seed), room // x)
        take = 1
        while left > 0 and not reach & goal:  # binary parts of the count
            k = min(take, left)
            more = (reach | reach << (k * x)) & mask
            steps.append((x, k, reach))
            reach, left, take = more, left - k, take * 2
        if reach & goal:
            break
    at = reach.bit_length() - 1
    chosen = {seed: 1}
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            chosen[x] = chosen.get(x, 0) + k
            at -= k * x
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Combinations and how often each is taken, until no piece is left."""
    left, out = {x: n for x, n in counts.items() if n}, []
    while left:
        chosen = fullest(left, capacity)
        times = min(left[x] // k for x, k in chosen.items())
        for x, k in chosen.items():
            left[x] -= k * times
            if not left[x]:
                del left[x]
        out.append((chosen, times))
    return out


def places(combinations: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, per bin, first bin, offset in the bin): ranks from there on go there."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for chosen, times in combinations:
        offset = 0
        for x, k in chosen.items():
            found.setdefault(x, []).append((ranks.get(x, 0), k, first, offset))
            ranks[x] = ranks.get(x, 0) + k * times
            offset += k * x
        first += times
    return {x: np.array(rows, dtype=np.int64) for x, rows in found.items()}


def pack(found: DataFrame, capacity: int = CAPACITY, numbered: int = NUMBERED) -> DataFrame:
    """``found`` with sequence_id and offset; it must be a stored table (its rows are read twice)."""
    kept = found.withColumn("__mix", F.xxhash64("doc_id", "piece", "start", "ids_crc32"))
    counts = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = places(plan(counts, capacity))
    # Hot lengths (full pieces above all) are numbered in parts: a part's first number follows from the parts' counts.
    split = {x: -(-n // numbered) for x, n in counts.items()}
    parts = F.lit(1)
    if any(k > 1 for k in split.values()):
        parts = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for x, k in sorted(split.items()) if k > 1 for v in (x, k)]), F.col("length")), F.lit(1))
    kept = kept.withColumn("__part", F.pmod(F.col("__mix"), parts.cast("long")))
    firsts = kept.groupBy("length", "__part").agg(F.count("*").alias("__n"))
    firsts = firsts.withColumn("__first", F.sum("__n").over(Window.partitionBy("length").orderBy("__part")) - F.col("__n")).drop("__n")
    rank = F.row_number().over(Window.partitionBy("length", "__part").orderBy("__mix", "doc_id", "piece")) - 1
    ranked = kept.withColumn("__rank", rank).join(firsts, ["length", "__part"]).withColumn("__rank", F.col("__rank") + F.col("__first"))
    names = [c for c in found.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lengths, ranks = part.column("length").to_numpy(), part.column("__rank").to_numpy()
            sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
            for x in np.unique(lengths):
                rows, mine = where[int(x)], np.flatnonzero(lengths == x)
                row = rows[np.searchsorted(rows[:, 0], ranks[mine], side="right") - 1]
                place = ranks[mine] - row[:, 0]
                sequence[mine] = row[:, 2] + place // row[:, 1]
                offset[mine] = row[:, 3] + place % row[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in found.schema)
    return map_arrow(ranked.select(*names, "__rank"), run, f"{ddl}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, remember: int | None = None) -> DataFrame:
    """Every document of ``docs`` (doc_id, text) as packed pieces."""
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    return pack(materialize(pieces(docs, path, capacity, with_ids, remember), "pieces"), capacity)
