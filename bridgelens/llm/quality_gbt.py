"""Quality rules: gradient-boosted trees over document statistics.

Each document's statistics come from its whole text, in one narrow pass.  The trees are grown
on a bounded sample of labelled rows (``SAMPLE_ROWS``), the rows whose id hashes lowest, so
the same labels always give the same sample.  They are flattened into numpy node arrays and
score whole column batches at once.  Chosen features are monotonic: more symbols, repeated
words or repeated lines can only lower the score.

Defined results: a null or empty text has no words (``base_failed``); null ids and repeated rows
are kept as rows of their own; labels that are null or name no document are ignored, and labels and labelled
documents that are repeated count once; without labels of both kinds there is no model and the base rule alone decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bridgelens.llm.common import map_arrow, materialize, mix64, text_slices, texts, worker_state

#: Documented bound of the training sample: of the labels, and of the rows (statistics only) that reach the driver.
SAMPLE_ROWS = 20_000
#: A document is kept at this probability of good quality or more.
KEEP_AT = 0.5
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_distinct", "n_lines", "n_digits", "n_upper", "n_punct", "max_word", "n_one_char")
#: feature -> (numerator, denominator, monotonic direction); a null denominator is the logarithm of the numerator.
FEATURES = {
    "log_words": ("n_words", None, 0),
    "word_length": ("word_chars", "n_words", 0),
    "symbols_per_word": ("n_symbols", "n_words", -1),
    "dup_line_share": ("n_dup_lines", "n_lines", -1),
    "repeat_share": ("n_repeat_words", "n_words", -1),
    "distinct_share": ("n_distinct", "n_words", 0),
    "digits_per_char": ("n_digits", "word_chars", 0),
    "upper_per_char": ("n_upper", "word_chars", 0),
    "punct_per_word": ("n_punct", "n_words", 0),
    "one_char_share": ("n_one_char", "n_words", 0),
    "longest_word": ("max_word", None, 0),
}
STATS_DDL = ", ".join(f"{c} long" for c in BASE + MORE)


def exact_repeats(codes: np.ndarray, docs: np.ndarray, width: int) -> np.ndarray:
    """Starts of windows that occur twice or more in their document.  Window numbers come by rank
    doubling (1, 2, 4, 8 words), so equal numbers mean equal windows, without hash errors."""
    n = len(codes)
    rank = np.unique(docs * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
    step = 1
    while step < width:
        rank = np.unique(rank[:-step] * (n + 1) + rank[step:], return_inverse=True)[1]
        step *= 2
    whole = docs[: n - width + 1] == docs[width - 1 :]
    often = np.bincount(rank[whole], minlength=int(rank.max()) + 1) > 1
    return np.flatnonzero(whole & often[rank])


def repeated_words(codes: np.ndarray, docs: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Marks words inside a ``width``-word window that occurs twice or more in its document.

    ``codes`` are word numbers, ``docs`` ascending document numbers.  A rolling hash names the
    documents that may repeat a window (equal windows have equal hashes, so none is missed);
    those alone go through the exact comparison.
    """
    n = len(codes)
    covered = np.zeros(n, dtype=bool)
    if n < width:
        return covered
    h = mix64((docs.astype(np.uint64) << np.uint64(40)) ^ codes.astype(np.uint64))
    step = 1
    while step < width:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        step *= 2
    h = h[docs[: n - width + 1] == docs[width - 1 :]]
    owner = docs[: n - width + 1][docs[: n - width + 1] == docs[width - 1 :]]
    order = np.sort(h)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return covered
    at = np.minimum(np.searchsorted(twice, h), len(twice) - 1)
    maybe = np.isin(docs, np.unique(owner[twice[at] == h]))
    part = np.flatnonzero(maybe)
    starts = exact_repeats(codes[part], docs[part], width) if len(part) >= width else np.zeros(0, dtype=np.int64)
    edge = np.zeros(len(part) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    covered[part] = np.cumsum(edge[:-1]) > 0
    return covered


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL, _DIGIT, _UPPER, _PUNCT, _HEAD = (np.zeros(256, dtype=bool) for _ in range(5))
_SYMBOL[list(SYMBOLS)] = True
_DIGIT[0x30:0x3A] = True
_UPPER[0x41:0x5B] = True
_PUNCT[list(b".,;:!?")] = True
_HEAD[:] = [b & 0xC0 != 0x80 for b in range(256)]


def statistics(rows: list[bytes]) -> dict[str, np.ndarray]:
    """The statistics of each text, from its whole bytes."""
    worker_state("statistics", dict)  # drops what another operator has kept
    n = len(rows)
    out = {c: np.zeros(n, dtype=np.int64) for c in BASE + MORE}
    number: dict[bytes, int] = {}
    codes, owner = [], []
    for i, raw in enumerate(rows):
        words = raw.split()
        out["n_words"][i] = len(words)
        if not words:
            continue
        codes += [number.setdefault(w, len(number)) for w in words]
        owner.append(np.full(len(words), i))
        distinct = set(words)
        out["n_distinct"][i] = len(distinct)
        out["max_word"][i] = len(max(distinct, key=len))
        out["n_one_char"][i] = sum(len(w) == 1 for w in words)
        counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
        out["word_chars"][i] = counts[_HEAD].sum() - counts[_SPACE].sum()
        for name, kind in (("n_symbols", _SYMBOL), ("n_digits", _DIGIT), ("n_upper", _UPPER), ("n_punct", _PUNCT)):
            out[name][i] = counts[kind].sum()
        lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
        out["n_lines"][i] = len(lines)
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    if codes:
        docs = np.concatenate(owner)
        out["n_repeat_words"][:] = np.bincount(docs, weights=repeated_words(np.array(codes), docs), minlength=n)
    return out


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, statistics): one row per input row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            stats = statistics(texts(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, stats.values())], names=["doc_id", *stats])

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, {STATS_DDL}")


def feature_matrix(stats: dict[str, np.ndarray]) -> np.ndarray:
    columns = []
    for top, bottom, _ in FEATURES.values():
        x = np.asarray(stats[top], dtype=np.float64)
        columns.append(np.log1p(x) if bottom is None else x / np.maximum(np.asarray(stats[bottom], dtype=np.float64), 1))
    return np.stack(columns, axis=1)


class Forest:
    """Trees flattened into node arrays; a leaf points to itself."""

    def __init__(self) -> None:
        self.base = 0.0
        self.roots: list[int] = []
        self.feature: list[int] = []
        self.threshold: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.depth = 0

    def add(self) -> int:
        k = len(self.value)
        for part, x in ((self.feature, 0), (self.threshold, 0.0), (self.left, k), (self.right, k), (self.value, 0.0)):
            part.append(x)
        return k

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality: all rows and trees step one level at a time."""
        out = np.full(len(x), self.base)
        if not self.roots or not len(x):
            return out
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        rows = np.arange(len(x))[:, None]
        at = np.tile(np.array(self.roots), (len(x), 1))
        for _ in range(self.depth):
            at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
        return out + value[at].sum(axis=1)


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, least: int = 8) -> Forest:
    """Boosted trees for logistic loss over binned features, with monotonic constraints.

    A split on a constrained feature is taken only if its children's values are in order, and the
    middle between them bounds everything below either child, so the whole tree is monotonic.
    """
    forest = Forest()
    forest.depth = depth
    share = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    forest.base = float(np.log(share / (1 - share)))
    directions = [d for _, _, d in FEATURES.values()]
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T, strict=True)], axis=1)
    score = np.full(len(y), forest.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, np.maximum(p * (1 - p), 1e-9)
        root = forest.add()
        forest.roots.append(root)
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, low, high = todo.pop()
            best = (1e-6, None)
            gs, hs = g[rows].sum(), h[rows].sum()
            mine = float(np.clip(gs / (hs + l2), low, high))
            if level < depth and len(rows) >= 2 * least:
                for f, cut in enumerate(cuts):
                    if not len(cut):
                        continue
                    b = binned[rows, f]
                    size = len(cut) + 1
                    gl, hl = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                    vl, vr = np.clip(gl / (hl + l2), low, high), np.clip((gs - gl) / (hs - hl + l2), low, high)
                    gain = 2 * vl * gl - vl**2 * (hl + l2) + 2 * vr * (gs - gl) - vr**2 * (hs - hl + l2) - (2 * mine * gs - mine**2 * (hs + l2))
                    gain[(nl < least) | (len(rows) - nl < least)] = -1
                    if directions[f]:
                        gain[(vr - vl) * directions[f] < 0] = -1
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (gain[k], (f, k, float(vl[k]), float(vr[k])))
            if best[1] is None:
                forest.value[node] = rate * mine
                score[rows] += rate * mine
                continue
            f, k, vl, vr = best[1]
            forest.feature[node], forest.threshold[node] = f, float(cuts[f][k])
            sides = []
            for inside, up in ((binned[rows, f] <= k, False), (binned[rows, f] > k, True)):
                lo, hi = low, high
                if directions[f]:
                    middle = (vl + vr) / 2
                    lo, hi = (max(lo, middle), hi) if up == (directions[f] > 0) else (lo, min(hi, middle))
                child = forest.add()
                sides.append(child)
                todo.append((child, rows[inside], level + 1, lo, hi))
            forest.left[node], forest.right[node] = sides
    return forest


def label_sample(labels: DataFrame, sample_rows: int = SAMPLE_ROWS, label_col: str = "quality") -> DataFrame:
    """(label_id, label) of the ``sample_rows`` distinct labels whose ids hash lowest."""
    known = labels.where(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("label_id"), F.col(label_col).cast("double").alias("label")).distinct()
    return known.orderBy(F.xxhash64("label_id"), "label_id", "label").limit(sample_rows)


def training_rows(stats: DataFrame, sample: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(label, statistics) of the sampled labels' documents, at most ``sample_rows``: rows of one label that are equal in
    all statistics count once, however often they are repeated, and the lowest by a hash stay."""
    columns = ["label_id", "label", *BASE, *MORE]
    met = stats.join(F.broadcast(sample), stats["doc_id"] == sample["label_id"]).select(*columns).distinct()
    return met.orderBy(F.xxhash64(*columns), *columns).limit(sample_rows).select("label", *BASE, *MORE)


def train(stats: DataFrame, sample: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Forest | None:
    """Grow the trees on the sampled labels' documents; None without labels of both kinds."""
    rows = training_rows(stats, sample, sample_rows).toPandas()
    rows = rows.sort_values(list(rows.columns), kind="stable")
    y = (rows["label"].to_numpy() > 0).astype(np.float64)
    if len(y) == 0 or y.min() == y.max():
        return None
    return grow(feature_matrix({c: rows[c].to_numpy() for c in BASE + MORE}), y)


def judge(stats: dict[str, np.ndarray], forest: Forest | None, keep_at: float = KEEP_AT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base_failed, kept, probability of good quality) of each row of statistics."""
    failed = (stats["n_words"] < 20) | (100 * stats["n_repeat_words"] > 30 * stats["n_words"])
    p = np.ones(len(failed)) if forest is None else 1 / (1 + np.exp(-forest.score(feature_matrix(stats))))
    return failed, ~failed & (p >= keep_at), p


def quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """Statistics, ``base_failed``, the model's probability ``score`` and the verdict ``kept`` of each row of ``docs``."""
    stats = materialize(document_statistics(docs), "quality-stats")
    forest = train(stats, label_sample(labels, sample_rows), sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            s = {c: part.column(c).to_numpy(zero_copy_only=False) for c in BASE + MORE}
            failed, kept, p = judge(s, forest, keep_at)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(part.column(c) for c in BASE), pa.array(failed), pa.array(kept), pa.array(p)],
                names=["doc_id", *BASE, "base_failed", "kept", "score"],
            )

    kind = stats.schema["doc_id"].dataType.simpleString()
    ddl = ", ".join(f"{c} long" for c in BASE)
    return map_arrow(stats, run, f"doc_id {kind}, {ddl}, base_failed boolean, kept boolean, score double")


def keep_good(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, keep_at: float = KEEP_AT) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns: one narrow pass, after the trees are grown on the
    sampled documents alone."""
    sample = materialize(label_sample(labels, sample_rows), "label-sample")
    some = docs.join(F.broadcast(sample.select("label_id").distinct()), docs["doc_id"] == F.col("label_id"), "left_semi")
    forest = train(document_statistics(some), sample, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            yield part.filter(pa.array(judge(statistics(texts(part.column("text"))), forest, keep_at)[1]))

    return map_arrow(docs, run, docs.schema)
