"""Token-id files of independent zstandard frames with a trailing seek table and checksums.

File layout (one file per range of ids, documents in ascending doc_id order):
  - per document one zstandard frame of its ids, little-endian unsigned 32-bit integers, with the
    frame's own content checksum;
  - one skippable frame (magic 0x184D2A5E) with, per document, compressed size, decompressed size
    and xxh64 low word of the ids (12 bytes each), then the number of frames (4 bytes), a
    descriptor byte (0x80: checksums are there) and the magic 0x8F92EAB1, as the public seekable
    format has it.
A reader fetches the tail, then only the frames it wants.

Files are written under a fresh name per attempt, so a lost or repeated task never damages one;
the manifest, itself a table, names those that count.

Defined results: a null or empty text is one document holding only the end id; documents without
an id come first (as one range with the smallest ids), repeated rows keep one frame each, ties
in doc_id are put in order of their texts.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bridgelens.llm.common import map_arrow, materialize, text_slices
from bridgelens.llm.tokenizing import encoder, tokenizer_path
from bridgelens.session import scratch_path

END = 0
#: Fixed values of the seekable format: magics, the trailer's size, the entry's size, the checksum flag.
SKIPPABLE, SEEKABLE, TRAILER, ENTRY, WITH_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 9, 12, 0x80
#: Bytes of text (about) that go to one file.
FILE_TEXT_BYTES = 24 << 20
#: Files are handed to readers in runs of so many documents.
READ_DOCS = 4096


def filesystem(uri: str):
    """The store that holds ``uri`` and the path in it (any scheme that Arrow can open)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def checksum(raw: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class Writer:
    """Appends documents to one file; ``close`` adds the seek table."""

    def __init__(self, folder: str) -> None:
        import zstandard

        self.fs, base = filesystem(folder)
        self.fs.create_dir(base, recursive=True)
        self.name = f"ids-{uuid.uuid4().hex}.zst"
        self.out = self.fs.open_output_stream(f"{base}/{self.name}", compression=None)
        self.zstd = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True)
        self.entries: list[bytes] = []

    def add(self, ids: bytes) -> None:
        frame = self.zstd.compress(ids)
        self.out.write(frame)
        self.entries.append(struct.pack("<III", len(frame), len(ids), checksum(ids)))

    def close(self) -> None:
        table = b"".join(self.entries)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + TRAILER) + table + struct.pack("<IBI", len(self.entries), WITH_CHECKSUMS, SEEKABLE))
        self.out.close()


class Reader:
    """Opens a file by its tail and decompresses only the frames asked for."""

    def __init__(self, folder: str, name: str) -> None:
        import zstandard

        store, base = filesystem(folder)
        self.file = store.open_input_file(f"{base}/{name}")
        size = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(TRAILER, size - TRAILER))
        if magic != SEEKABLE or flags != WITH_CHECKSUMS:
            raise ValueError(f"{name} has no seek table")
        table = self.file.read_at(n * ENTRY, size - TRAILER - n * ENTRY)
        self.table = np.frombuffer(table, dtype="<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.zstd = zstandard.ZstdDecompressor()

    def counts(self) -> np.ndarray:
        """Ids of each document."""
        return self.table[:, 1] // 4

    def read(self, start: int, stop: int) -> Iterator[bytes]:
        """The ids of documents start..stop-1; a damaged frame raises."""
        raw = self.file.read_at(int(self.at[stop] - self.at[start]), int(self.at[start]))
        for k in range(start, stop):
            frame = raw[self.at[k] - self.at[start] : self.at[k + 1] - self.at[start]]
            ids = self.zstd.decompress(frame)
            if len(ids) != self.table[k, 1] or checksum(ids) != self.table[k, 2]:
                raise ValueError(f"frame {k} is damaged")
            yield ids


def write_ids(docs: DataFrame, folder: str, tokenizer: str | None = None, file_text_bytes: int = FILE_TEXT_BYTES) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order under ``folder``.

    Returns the manifest: one row per run of at most READ_DOCS documents of a file, in order
    (range_no, file_no, file, first document in the file, doc_ids, n_tokens).
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()
    narrow = docs.select("doc_id", "text")
    total = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = narrow.repartitionByRange(max(1, -(-int(total) // file_text_bytes)), F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ranges = ranges.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text").withColumn("range_no", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, True).encode
        end = np.array([END], dtype="<u4").tobytes()
        writer, rows, range_no, file_no, first, held, tokens, ids = None, [], 0, 0, 0, [], 0, 0

        def flush() -> None:
            nonlocal first, held, tokens
            if held:
                rows.append((range_no, file_no, writer.name, first, held, tokens))
                first, held, tokens = first + len(held), [], 0

        for part in text_slices(batches, "text"):
            range_no = part.column("range_no")[0].as_py()
            for key, raw in zip(part.column("doc_id").to_pylist(), encode([t or "" for t in part.column("text").to_pylist()]), strict=True):
                if writer is None:
                    writer, first, ids = Writer(folder), 0, 0
                raw += end
                writer.add(raw)
                held.append(key)
                tokens += len(raw) // 4
                ids += len(raw)
                if len(held) >= READ_DOCS:
                    flush()
                if ids >= 8 * file_text_bytes:
                    flush()
                    writer.close()
                    writer, file_no = None, file_no + 1
        if writer is not None:
            flush()
            writer.close()
        if rows:
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), None, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if k is not None else pa.array(c) for c, k in zip(columns, kinds, strict=True)], names=["range_no", "file_no", "file", "first", "doc_ids", "n_tokens"])

    return materialize(map_arrow(ranges, run, f"range_no int, file_no int, file string, first long, doc_ids array<{kind}>, n_tokens long"), "ids-manifest")


def read_ids(manifest: DataFrame, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (and the ids).

    The manifest has a row for thousands of documents, so its running sum of tokens is short.
    """
    kind = manifest.schema["doc_ids"].dataType.elementType.simpleString()
    order = Window.orderBy("range_no", "file_no", "first")
    starts = manifest.select("range_no", "file_no", "first", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("start"))
    runs = manifest.join(starts, ["range_no", "file_no", "first"]).select("file", "first", "doc_ids", "start")
    runs = runs.repartition(F.col("file"), F.col("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                keys = part.column("doc_ids").flatten()
                first, at = part.column("first")[0].as_py(), part.column("start")[0].as_py()
                reader = Reader(folder, part.column("file")[0].as_py())
                counts = reader.counts()[first : first + len(keys)]
                starts = at + np.cumsum(counts) - counts
                step = READ_DOCS if not with_ids else 256
                for a in range(0, len(keys), step):
                    b = min(a + step, len(keys))
                    raws, crcs = [], []
                    for raw in reader.read(first + a, first + b):
                        crcs.append(zlib.crc32(raw))
                        if with_ids:
                            raws.append(raw)
                    columns = [keys.slice(a, b - a), pa.array(starts[a:b]), pa.array(counts[a:b]), pa.array(crcs, pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns, names = [*columns, pa.array(raws, pa.binary())], [*names, "ids"]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(runs, run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def fetch(spark: SparkSession, manifest: DataFrame, folder: str, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of the documents asked for: only their frames are read."""
    hits = manifest.select("file", "first", F.posexplode("doc_ids").alias("k", "doc_id")).where(F.col("doc_id").isin(doc_ids)).collect()
    return {r["doc_id"]: np.frombuffer(next(Reader(folder, r["file"]).read(r["first"] + r["k"], r["first"] + r["k"] + 1)), dtype="<u4") for r in hits}


def encode_and_read_back(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_ids(write_ids(docs, folder, tokenizer), folder)
