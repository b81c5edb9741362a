"""Token ids of whole texts by the tokenizers library, computed once per distinct stretch of text.

Both public tokenizers split a text before they merge, and no piece of that split reaches from a
non-space over a following white space, nor from a letter or digit over a following comma or full
stop, as long as the letter is still one after normalisation (some become a letter and a mark, and the
mark joins the comma).  So a text may be cut at those places, and the ids of the whole are those of its cuts, joined.
Texts with white space outside ASCII, where libraries differ on what white space is, are encoded
whole.  Arrow cuts, numbers and gathers the stretches; Python and the library meet the distinct ones of a step
only.  Tests compare the result with the library's own on whole texts.
"""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from bridgelens.llm.common import worker_state

#: Distinct stretches that a worker remembers; beyond half of it, those not met since the last time are forgotten
#: (results do not change).
CACHE = 1_000_000
#: Longer stretches are encoded, but not remembered.
LONG = 64
#: Code points of texts (about) that are cut and encoded at a time; a single longer text is a step of its own.
STEP = 1 << 20
#: New stretches that the library gets as one text, where its ids show where each begins; fewer go one by one.
RUN = 64

_ODD = "[\x01-\x04\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: White space (where there is no odd one) at an end or next to another.
_LOOSE = r"[ \t\n\r][ \t\n\r]|\A[ \t\n\r]|[ \t\n\r]\z"
_STRETCH = re.compile(r"\s*\S+|\s+")
#: Letters that end in a mark once they are normalised (NFC, then lower case).
_MARKED = "".join(c for c in map(chr, range(0x80, 0x30000)) if unicodedata.decomposition(c) and c.isalnum() and not unicodedata.normalize("NFC", c).lower()[-1].isalnum())
_COMMA = re.compile(rf", (?<=[^\W_{_MARKED}], )")
_STOP = re.compile(rf"[.] (?<=[^\W_{_MARKED}][.] )")
#: Marks of stretches that do not follow a space: comma, full stop, line end, and a stretch after a line end.
_MARKS = {"\x01": ",", "\x02": ".", "\x03": "\n"}
_AFTER_LINE = "\x04"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """``encode(texts)``: for each text its ids as little-endian unsigned 32-bit integers.

    ``keeps_space``: white space is part of the ids (byte-level), else it only separates.
    ``remember``: how many distinct stretches are remembered (CACHE if None).
    """

    def __init__(self, path: str, keeps_space: bool, remember: int | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        resize = getattr(self.library.model, "_resize_cache", None)
        if resize is not None:
            resize(0)  # it is asked for each stretch once, so its own memory would only cost time
        vocabulary = self.library.get_vocab()
        #: the ids that begin with a space (byte-level), else those that end a word
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[k for x, k in vocabulary.items() if (x.startswith("\u0120") if keeps_space else x.endswith("</w>"))]] = True
        self.keeps_space = keeps_space
        self.remember = remember
        #: the ids of stretches by their mark or, without one, as they stand after a space
        self.known: dict[str, bytes] = {}
        #: what was known the last time; a stretch that is met again moves back
        self.before: dict[str, bytes] = {}

    def _marked(self, text: str) -> str:
        """The text with its stretches apart by spaces, marked where they did not follow one."""
        if not self.keeps_space:
            return _STOP.sub(" . ", _COMMA.sub(" , ", text))
        text = _AFTER_LINE + text.replace("\n", " \x03 " + _AFTER_LINE)
        return _STOP.sub(" \x02 ", _COMMA.sub(" \x01 ", text))

    def _cut(self, texts: list[str]) -> tuple[pa.Array, list[int], np.ndarray]:
        """The stretches of all texts one after another, the texts' order in them, and where each text's begin and the last's end."""
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _ODD)
        other = pc.or_(odd, pc.match_substring_regex(column, _LOOSE)) if self.keeps_space else odd
        plain, others = pc.indices_nonzero(pc.invert(other)).to_pylist(), pc.indices_nonzero(other).to_pylist()
        apart = pa.array([self._marked(texts[k]) for k in plain], pa.large_string())
        apart = pc.split_pattern(apart, " ") if self.keeps_space else pc.ascii_split_whitespace(apart)
        stretches, counts = [apart.flatten()], [pc.list_value_length(apart).to_numpy()]
        if others:
            listed = [[_AFTER_LINE + x for x in ([texts[k]] if odd[k].as_py() else _STRETCH.findall(texts[k]))] for k in others]
            stretches.append(pa.array([x for parts in listed for x in parts], pa.large_string()))
            counts.append(np.array([len(parts) for parts in listed]))
        return pa.concat_arrays(stretches), plain + others, np.concatenate([[0], np.cumsum(np.concatenate(counts), dtype=np.int64)])

    def _surface(self, part: str) -> str:
        """What the library is asked to encode for a stretch."""
        if part[:1] == _AFTER_LINE:
            return part[1:]
        return (_MARKS.get(part) or " " + part) if self.keeps_space else part

    def encode(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        start, held = 0, 0
        for k, text in enumerate(texts, 1):
            held += len(text)
            if held >= STEP or k == len(texts):
                out += self._encode(texts[start:k])
                start, held = k, 0
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        stretches, order, ends = self._cut(texts)
        coded = stretches.dictionary_encode()
        ids = pa.array(self._ids(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(coded.indices)
        _, places, raw = ids.buffers()
        raw = memoryview(raw or b"")
        at = np.frombuffer(places, dtype=np.int64, count=len(ids) + 1)[ends].tolist()
        out = [b""] * len(texts)
        for k, start, stop in zip(order, at, at[1:], strict=False):
            out[k] = bytes(raw[start:stop])
        return out

    def _ids(self, stretches: list[str]) -> list[bytes]:
        """The ids of distinct stretches."""
        if len(self.known) > (self.remember or CACHE) // 2:
            self.known, self.before = {}, self.known
        known, before = self.known, self.before
        out = list(map(known.get, stretches))
        new = [k for k, raw in enumerate(out) if raw is None]
        if before:
            for k in new:
                raw = out[k] = before.get(stretches[k])
                if raw is not None:
                    known[stretches[k]] = raw
            new = [k for k in new if out[k] is None]
        found = dict(self._ask([stretches[k] for k in new]))
        for k in new:
            raw = out[k] = found[stretches[k]]
            if len(stretches[k]) <= LONG:
                known[stretches[k]] = raw
        return out

    def _ask(self, new: list[str]) -> Iterator[tuple[str, bytes]]:
        """New stretches and what the library gives for them.  A run of stretches costs it about half of what they cost alone."""
        joined, alone = [], []
        for x in new:
            (joined if self._joins(x) else alone).append(x)
        runs = [joined[a : a + RUN] for a in range(0, len(joined) - RUN + 1, RUN)]
        alone += joined[RUN * len(runs) :]
        for run, x in zip(runs, self.library.encode_batch_fast([" " + " ".join(run) for run in runs], add_special_tokens=False), strict=True):
            ids = np.array(x.ids, dtype="<u4")
            at = np.unique(np.concatenate([[0], np.flatnonzero(self.edge[ids]) + (not self.keeps_space), [len(ids)]])).tolist()
            if len(at) == len(run) + 1:
                raw = ids.tobytes()
                yield from zip(run, (raw[4 * start : 4 * stop] for start, stop in zip(at, at[1:], strict=False)), strict=True)
            else:
                alone += run
        for x, found in zip(alone, self.library.encode_batch_fast([self._surface(x) for x in alone], add_special_tokens=False), strict=True):
            yield x, array("I", found.ids).tobytes()

    def _joins(self, part: str) -> bool:
        """Whether the library's ids of a text show where this stretch begins and ends.  Byte-level, it stands after a space,
        so that its first id begins with the space, and no other does; else it is one word of ASCII letters, and its last id ends it."""
        return len(part) <= LONG and (part[:1] > _AFTER_LINE if self.keeps_space else part.isascii() and part.isalpha())


def encoder(path: str, keeps_space: bool, remember: int | None = None) -> Encoder:
    """One encoder per Python worker, so that what it remembers serves all its tasks."""
    return worker_state(("encoder", path, keeps_space, remember), lambda: Encoder(path, keeps_space, remember))
