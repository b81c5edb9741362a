"""Fill-in-the-middle: documents rearranged as prefix, suffix and middle.

A text is cut at two of its unit borders, drawn from a hash of its id.  Units are code points, or what a
pattern matches from left to right (the rest between matches counts as units of their own).  The cuts are
found without a list of all units: the text's UTF-8 bytes are divided into blocks of BLOCK bytes, and two Fenwick
trees hold how many units and how many code points begin in each.  A descent by halving steps finds the
block that holds a wanted unit; the border is then located inside that block alone.  The code points of each
part are the tree's sums before its block and a count inside it.

Forms: ``plain`` (the text), ``psm`` (<P>prefix<S>suffix<M>middle) and ``spm`` (<S>suffix<P>prefix<M>middle).

Defined results: a null text is empty; empty texts and texts that hold a sentinel are plain; a null id
hashes as if it had no digits; repeated rows give equal results; parts may be empty; an empty
table gives an empty result; other columns of the input are left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import map_arrow, text_slices, texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 1
#: Of 100 documents so many are rearranged, and of 100 rearranged ones so many begin with the suffix.
RATE, SPM_RATE = 90, 20
#: Bytes of a text that share a counter.
BLOCK = 1024
#: Of each byte whether a code point begins there.
_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])


class Fenwick:
    """Counts of consecutive blocks: sums of the first blocks, and the block that holds the n-th thing."""

    def __init__(self, counts: np.ndarray) -> None:
        """Each place adds its sum to the next place that covers it, all places of one size at a time."""
        self.size = len(counts)
        tree = np.concatenate([[0], counts]).astype(np.int64)
        step = 1
        while step < len(tree):
            to = np.arange(2 * step, len(tree), 2 * step)
            tree[to] += tree[to - step]
            step *= 2
        self.tree = tree

    def before(self, block: int) -> int:
        """What the blocks before ``block`` hold."""
        total = 0
        while block:
            total += int(self.tree[block])
            block &= block - 1
        return total

    def find(self, n: int) -> tuple[int, int]:
        """(block, rest): the block of the thing number ``n`` (from 0), and its number there."""
        block, step = 0, 1 << self.size.bit_length() >> 1
        while step:
            if block + step <= self.size and self.tree[block + step] <= n:
                block += step
                n -= int(self.tree[block])
            step >>= 1
        return block, n


class Blocks:
    """A text's bytes with the counts of units and of code points that begin in each block."""

    def __init__(self, raw: bytes, unit: re.Pattern | None = None, block: int = BLOCK) -> None:
        self.raw, self.block = raw, block
        self.data = np.frombuffer(raw, dtype=np.uint8)
        heads = _HEAD[self.data]
        starts = np.arange(0, len(raw), block)
        chars = np.add.reduceat(heads, starts, dtype=np.int64) if len(raw) else np.zeros(0, dtype=np.int64)
        self.points = Fenwick(chars)
        self.begins: np.ndarray | None = None
        if unit is None:
            self.units, self.n = self.points, int(chars.sum())
        else:
            self.begins = np.flatnonzero(heads)[unit_starts(raw.decode("utf-8", "surrogatepass"), unit)]
            self.units, self.n = Fenwick(np.bincount(self.begins // block, minlength=len(starts))), len(self.begins)

    def border(self, unit: int) -> int:
        """The byte where unit number ``unit`` begins (the end of the text for the number of units)."""
        if unit >= self.n:
            return len(self.raw)
        block, rest = self.units.find(unit)
        low = block * self.block
        if self.begins is None:
            return low + int(np.flatnonzero(_HEAD[self.data[low : low + self.block]])[rest])
        return int(self.begins[np.searchsorted(self.begins, low) + rest])

    def chars_before(self, at: int) -> int:
        """Code points that begin before byte ``at``."""
        block = at // self.block
        return self.points.before(block) + int(_HEAD[self.data[block * self.block : at]].sum())


def unit_starts(text: str, unit: re.Pattern) -> np.ndarray:
    """The code points where units begin: matches from left to right, and what lies between them."""
    starts, at = [], 0
    for m in unit.finditer(text):
        if m.end() == m.start():
            continue
        if m.start() > at:
            starts.append(at)
        starts.append(m.start())
        at = m.end()
    if at < len(text):
        starts.append(at)
    return np.array(starts, dtype=np.int64)


def draws(key: int | None, seed: int) -> list[int]:
    """The first four 32-bit numbers of the SHA-256 of ``seed:key``."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12)]


def rearranged(key: int | None, raw: bytes, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: re.Pattern | None = None) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, prefix_chars, middle_chars, output) of one text."""
    blocks = Blocks(raw, unit)
    h = draws(key, seed)
    if not raw or h[2] % 100 >= rate or any(mark.encode() in raw for mark in (PREFIX, SUFFIX, MIDDLE)):
        return blocks.n, "plain", None, None, raw
    low, high = sorted((h[0] % (blocks.n + 1), h[1] % (blocks.n + 1)))
    a, b = blocks.border(low), blocks.border(high)
    before = blocks.chars_before(a)
    prefix, middle, suffix = PREFIX.encode() + raw[:a], MIDDLE.encode() + raw[a:b], SUFFIX.encode() + raw[b:]
    spm = h[3] % 100 < spm_rate
    output = suffix + prefix + middle if spm else prefix + suffix + middle
    return blocks.n, "spm" if spm else "psm", before, blocks.chars_before(b) - before, output


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, unit: str | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars, output (the new text).

    ``unit`` is a pattern of units; without one, units are code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = None if unit is None else re.compile(unit, re.S)
        for part in text_slices(batches, "text"):
            made = [rearranged(key, raw, seed, rate, spm_rate, pattern) for key, raw in zip(part.column("doc_id").to_pylist(), texts(part.column("text")), strict=True)]
            n, form, prefix, middle, output = zip(*made, strict=True)
            columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from: no part holds a sentinel, so the output is cut at them and put in order."""
    part = F.split(output, "<[PSM]>", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


#: The digests of the result with its fixed parameters, in DuckDB's SQL over the table documents.
ORACLE_SQL = r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS body, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents
), drawn AS (
  SELECT doc_id, body, n,
         least(CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1), CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1)) AS a,
         greatest(CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1), CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(body, '<P>') OR contains(body, '<S>') OR contains(body, '<M>')
                OR CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 >= 90 THEN 'plain'
              WHEN CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), parts AS (
  SELECT *, substring(body, 1, a) AS p, substring(body, a + 1, b - a) AS m, substring(body, b + 1) AS s FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN body WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(body) AS restored_sha256
FROM parts
"""
