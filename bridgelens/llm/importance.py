"""Importance resampling towards a target: hashed n-gram features over a head-tail vocabulary.

Features of a text are its runs of 1 to ``max_n`` consecutive words, joined by a space; a feature's bucket
is the CRC-32 of its bytes modulo the number of buckets.  The most frequent words (the head) are broadcast
with their CRC states, and for max_n > 1 the most frequent pairs with their buckets.  The CRC of a longer run
goes on from the state of the run before it, so a run that begins with a head word, and
a pair that is in the head, is not hashed from its first byte; words outside the head (the tail) take a direct
CRC.  Both give the same buckets, so the head's size only changes the work.

1. Words (and pairs) of all documents are counted, combined in each task before they move; the head is all that
   reach the least count that no more than HEAD of them reach, found from a histogram of the counts.
2. Each document's buckets are found once and stored, two or four bytes a feature.
3. Bucket totals of documents and target give each bucket's gain; a document's weight is the mean of its gains.
4. Gumbel noise from a hash of the id makes the highest scores a draw without replacement.  The score that the
   last drawn document has follows from counts of scores; only rows that reach it are sorted, dealt out by
   ranges, and numbered from the ranges' counts.

Defined results: a null text has no words; a text without words has weight 0; a null id hashes as if it had no
digits, and comes after others in a tie; rows equal in score and id are drawn in any order, each with its own rank;
an empty target has no features (T = 0); an empty table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import map_arrow, materialize, text_slices, texts

BUCKETS, MAX_N, SEED = 10_000, 1, 2024
#: Of 100 documents with LEAST_WORDS words or more, so many are drawn.
PERCENT, LEAST_WORDS = 10, 20
#: Entries of the head at most, and the longest that it holds, in bytes: it takes HEAD * LONGEST bytes at most (4 MB).
HEAD, LONGEST = 1 << 16, 64
#: Classes of counts in the histogram for each doubling (the driver holds at most 64 times as many numbers).
CLASSES = 16
#: Distinct entries that a task counts before it hands them on.
HELD = 500_000

#: Bytes of words stay (A-Z as a-z), others become spaces.
_WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_WORDS).split()


class Vocabulary:
    """CRC states of words and buckets of pairs, from the head or directly."""

    def __init__(self, head_words: list[bytes], head_pairs: list[bytes], buckets: int) -> None:
        self.buckets = buckets
        self.state = {w: zlib.crc32(w) for w in head_words}
        self.pair = {p: zlib.crc32(p) % buckets for p in head_pairs}

    def features(self, words: list[bytes], max_n: int) -> np.ndarray:
        """The buckets of all runs of 1 to ``max_n`` of the words."""
        known, crc = self.state.get, zlib.crc32
        states = [s if (s := known(w)) is not None else crc(w) for w in words]
        found = [np.array(states, dtype=np.int64) % self.buckets]
        for n in range(2, max_n + 1):
            ends = words[n - 1 :]
            if n == 2 and self.pair:
                of = self.pair.get
                pairs = [of(a + b" " + b) for a, b in zip(words, ends, strict=False)]
                if max_n == 2:
                    found.append(np.array([crc(b" " + b, s) % self.buckets if p is None else p for p, s, b in zip(pairs, states, ends, strict=False)], dtype=np.int64))
                    continue
            states = [crc(b" " + b, s) for s, b in zip(states, ends, strict=False)]
            found.append(np.array(states, dtype=np.int64) % self.buckets)
        return np.concatenate(found)


def head(docs: DataFrame, n: int, size: int = HEAD) -> list[bytes]:
    """The most frequent runs of ``n`` words (of at most LONGEST bytes) by their exact counts: all from some count on, at most ``size``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            short = [(w, k) for w, k in counts.items() if len(w) <= LONGEST]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in short], pa.binary()), pa.array([k for _, k in short], pa.int64())], names=["entry", "n"])

        for part in text_slices(batches, "text"):
            for raw in texts(part.column("text")):
                words = words_of(raw)
                counts.update(words if n == 1 else map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    found = map_arrow(docs.select("text"), count, "entry binary, n long").groupBy("entry").agg(F.sum("n").alias("n"))
    found = materialize(found.select("entry", F.floor(F.log2("n") * CLASSES).cast("int").alias("class")), "word-classes")
    least, listed = None, 0
    for r in sorted(found.groupBy("class").agg(F.count("*").alias("n")).collect(), key=lambda r: -r["class"]):
        listed += r["n"]
        if listed > size:
            break
        least = r["class"]
    return [] if least is None else [bytes(r["entry"]) for r in found.where(F.col("class") >= least).select("entry").collect()]


def featured(docs: DataFrame, vocabulary: Vocabulary, max_n: int) -> DataFrame:
    """(doc_id, n_words, n_features, buckets) of each row of ``docs`` (doc_id, text)."""
    kind = np.dtype("<u2") if vocabulary.buckets <= 1 << 16 else np.dtype("<u4")
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            n_words, found = [], []
            for raw in texts(part.column("text")):
                words = words_of(raw)
                n_words.append(len(words))
                found.append(sent.value.features(words, max_n).astype(kind))
            columns = [pa.array(n_words, pa.int64()), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n_words", "n_features", "buckets"])

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, buckets binary")


def totals(features: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket; tasks send at most ``buckets`` rows each."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(buckets, dtype=np.int64)
        for part in text_slices(batches, "buckets"):
            mine += np.bincount(np.frombuffer(b"".join(part.column("buckets").to_pylist()), dtype=kind), minlength=buckets)
        at = np.flatnonzero(mine)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(mine[at])], names=["bucket", "n"])

    found = map_arrow(features.select("buckets"), count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 * ln of how much likelier each bucket is in the target, smoothed by one, rounded down."""
    buckets, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + buckets) / (float(a + 1) * float(t + buckets)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(key: int | None, seed: int) -> int:
    """1000 * Gumbel noise of an id, rounded down."""
    h = int.from_bytes(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()[:4], "big")
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(features: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of each row of ``features``."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"
    sent = features.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "buckets"):
            weight = []
            for n, raw in zip(part.column("n_features").to_pylist(), part.column("buckets").to_pylist(), strict=True):
                weight.append(int(sent.value[np.frombuffer(raw, dtype=kind)].sum()) // n if n else 0)
            score = [w + noise(key, seed) for w, key in zip(weight, part.column("doc_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_words"), part.column("n_features"), pa.array(weight, pa.int64()), pa.array(score, pa.int64())], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return map_arrow(features, run, f"doc_id {features.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``rows`` (doc_id, n_words, score, ...), stored, with rank: 1, 2, 3... for the drawn ones, else null.

    The driver holds one number for each distinct score (whole numbers within a few times 10^4) and for
    each range of the sorted rows.
    """
    able = F.col("n_words") >= least_words
    per_score = sorted(((r["score"], r["n"]) for r in rows.where(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    drawn = percent * sum(n for _, n in per_score) // 100
    least, above = None, 0
    for score, n in per_score:
        if above >= drawn:
            break
        least, above = score, above + n
    if least is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    reached = able & (F.col("score") >= least)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("dealt")]
    # rows equal in score and id may be many; a stored random number spreads them
    best = materialize(rows.where(reached).withColumn("dealt", F.rand(17)), "best-scores")
    number = F.monotonically_increasing_id()
    best = best.repartitionByRange(*order).sortWithinPartitions(*order)
    best = materialize(best.withColumns({"range": F.shiftright(number, 33), "place": number.bitwiseAND((1 << 33) - 1)}), "sorted-scores")
    before, begins = 0, []
    for r in sorted(best.groupBy("range").agg(F.count("*").alias("n")).collect(), key=lambda r: r["range"]):
        begins.append((r["range"], before))
        before += r["n"]
    first = rows.sparkSession.createDataFrame(begins, "range long, first long")
    rank = F.col("first") + F.col("place") + 1
    numbered = best.join(F.broadcast(first), "range").withColumn("rank", F.when(rank <= drawn, rank))
    others = rows.where(~F.coalesce(reached, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return others.unionByName(numbered.select(others.columns))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, max_n: int = MAX_N, seed: int = SEED, percent: int = PERCENT, least_words: int = LEAST_WORDS, head_size: int = HEAD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text), drawn towards ``target`` (text): doc_id, n_words, n_features, weight, score, rank."""
    pairs = head(docs, 2, head_size) if max_n > 1 else []
    vocabulary = Vocabulary(head(docs, 1, head_size), pairs, buckets)
    features = materialize(featured(docs, vocabulary, max_n), "features")
    wanted = featured(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), vocabulary, max_n)
    gain = gains(totals(features, buckets), totals(wanted, buckets))
    return ranked(materialize(scored(features, gain, seed), "scores"), percent, least_words)


#: The same result with the fixed parameters, in DuckDB's SQL over documents and benchmark (CRC-32 by its table).
ORACLE_SQL = r"""
WITH crc_table AS (
  SELECT list(list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                          lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), found AS (
  SELECT 's' AS side, doc_id AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
  FROM documents
  UNION ALL
  SELECT 't', item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
  FROM benchmark
), counted AS (
  SELECT side, id, word, count(*) AS n FROM found GROUP BY ALL
), words AS (
  SELECT DISTINCT word, hex(encode(word)) AS h FROM counted
), buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                               lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % 10000 AS bucket
  FROM words, crc_table
), totals AS (
  SELECT bucket, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM counted JOIN buckets USING (word) GROUP BY bucket
), sums AS (
  SELECT coalesce(sum(s), 0)::DOUBLE AS ss, coalesce(sum(t), 0)::DOUBLE AS tt FROM totals
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (ss + 10000) / ((coalesce(s, 0) + 1)::DOUBLE * (tt + 10000))))::BIGINT AS gain FROM totals, sums
), weights AS (
  SELECT id AS doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM counted JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 's' GROUP BY id
), scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM documents d LEFT JOIN weights USING (doc_id)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
         count(*) FILTER (n_features >= 20) OVER () AS able
  FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * able // 100 THEN place END AS rank
FROM ranked
"""
