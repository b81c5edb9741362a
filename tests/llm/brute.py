"""Plain versions of what the operators promise, for small inputs."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
VOWELS = "the of and to in ing er on re at en nd st ha es ou is it al or ti as te et ng le".split()


def prose(rng: random.Random, n: int) -> str:
    """Invented words, so that texts do not repeat each other by chance."""
    words = ["".join(rng.choices(VOWELS, k=rng.randint(1, 4))) for _ in range(n)]
    return " ".join(w.capitalize() + "." if k % 11 == 10 else w for k, w in enumerate(words))


DOCS = "doc_id long, text string, lang string, source string, n_chars long, `shard` string, digest string, __key string"


def documents(spark, rows):
    """A documents table with further columns, some named like the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "d", "k") for i, t in rows], DOCS)


def corpus(seed: int = 7, n: int = 60) -> list[tuple[int | None, str | None]]:
    """Clean texts, exact and near copies, shared passages, short, empty, null and long texts."""
    rng = random.Random(seed)
    base = [prose(rng, rng.randint(30, 150)) for _ in range(n)]
    shared = prose(rng, 60)
    texts: list[str | None] = list(base)
    texts += base[:4] + [base[0]] * 5
    for t in base[4:10]:
        words = t.split()
        words[rng.randrange(len(words))] = "changed"
        texts.append(" ".join(words))
    texts += [f"{a} {shared} {b}" for a, b in zip(base[10:16], base[16:22], strict=True)]
    texts += ["", None, "one two", "One  TWO", "one", "   \n\t ", "é" * 200, "word " * 3000, "\x00\x01 nul", prose(rng, 8000)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows: list[tuple[int | None, str | None]] = [(i, texts[k]) for i, k in enumerate(order)]
    return [*rows, (None, base[0]), (None, None), rows[3], rows[3]]


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def repeats(rows) -> dict[tuple[int | None, str | None], tuple]:
    """(doc_id, text) -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        if i is not None:
            for k in range(len(raw) - 49):
                w = raw[k : k + 50]
                first[w] = min(i, first.get(w, i))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        if i is not None:
            for k in range(len(raw) - 49):
                if first[raw[k : k + 50]] < i:
                    gone[k : k + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out[i, t] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def cut_plainly(rows) -> list[tuple[int, str]]:
    """(doc_id, text) with the repeated passages cut; documents that lose all of their text go."""
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(i, first.get(raw[k : k + 50], i))
    out = []
    for i, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first[raw[k : k + 50]] < i:
                gone[k : k + 50] = b"\x01" * 50
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode("utf-8", "ignore")
        if kept:
            out.append((i, kept))
    return out


def shingles(text: str | None) -> frozenset:
    w = (text or "").encode().translate(UPPER).split()
    k = min(5, len(w))
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if w else frozenset()


def near_components(rows) -> dict[tuple[int | None, str | None], tuple]:
    """(doc_id, text) -> (n_shingles, component_id, kept): rows are told apart by id and text."""
    sets = list({(i, t): (i, t, shingles(t)) for i, t in rows if i is not None and shingles(t)}.values())
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, _, s) in enumerate(sets):
        for j, (_, _, z) in enumerate(sets[:a]):
            both = len(s & z)
            if 100 * both >= 75 * (len(s) + len(z) - both):
                x, y = root(a), root(j)
                parent[max(x, y)] = min(x, y)
    least: dict[int, int] = {}
    for a, (i, _, _) in enumerate(sets):
        least[root(a)] = min(i, least.get(root(a), i))
    out = {(i, t): (len(shingles(t)), i, True) for i, t in rows}
    for a, (i, t, s) in enumerate(sets):
        out[i, t] = (len(s), least[root(a)], i == least[root(a)])
    return out


def held_out(i) -> bool:
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


def base_scores(rows):
    """(N, {(doc_id, text): (n_tokens, n_known, base_score)})."""
    count: Counter = Counter()
    docs = 0
    for i, t in rows:
        if not held_out(i):
            count.update((t or "").encode().translate(UPPER).split())
            docs += 1
    n, v = sum(count.values()) + docs, len(count) + (docs > 0)
    out = {}
    for i, t in rows:
        w = (t or "").encode().translate(UPPER).split()
        known = sum(count[x] > 0 for x in w) + (docs > 0)
        score = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w) + math.log10((docs + 1) / (n + v + 1))
        out[i, t] = (len(w) + 1, known, score)
    return n, out


def quality_base(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    w = words(text)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often = Counter(windows)
    covered = {k + j for k, x in enumerate(windows) if often[x] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    chars = sum(len(x.decode()) for x in w)
    return len(w), chars, sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)
