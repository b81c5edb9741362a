"""Token counts by a finite-state machine compiled from the vocabulary of a sentencepiece BPE model.

In BPE the encoding of a prefix of a text, cut at one of the tokens' ends, is that prefix's own
encoding, and two neighbouring tokens stand if and only if the merges of their joined letters give
those two back.  So the last token of every prefix is unique, and it follows from the last
tokens of a few earlier prefixes.  A state holds what the future can depend on:
  - the longest suffix of the text read that begins some vocabulary piece,
  - the last token and the relative token count at each place inside that suffix.
A transition reads one character and emits the change of the token count (it may be negative, as
a longer token replaces shorter ones).  States are compiled when a text first needs them.

A text is cut into chunks.  A chunk maps the state before it to the state behind it and a count;
behind its first synchronising character (white space after a letter, or a character outside the
vocabulary) the map is constant.  Maps compose associatively, by a prefix scan.

Defined results: null and empty texts have no tokens; ids may be null or repeated, rows are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bridgelens.llm.common import byte_lengths, map_arrow, text_slices, worker_state
from bridgelens.llm.tokenizing import tokenizer_path

LIMIT = 4096
#: Characters of a chunk.
CHUNK = 1 << 14
#: Compiled states that a worker keeps; beyond it, it starts compiling anew (results do not change).
STATES = 400_000
SPACE = "▁"


@dataclass(frozen=True)
class ChunkMap:
    """head: characters before the first place where the state is known; then ``count`` tokens more
    and the state ``out``, or None if no place is known and the whole chunk is head."""

    head: str
    count: int
    out: dict | None


class Transducer:
    """``model_file`` is a sentencepiece BPE model with byte fallback and without normalisation rules."""

    def __init__(self, model_file: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        self.beginnings = {p[:k] for p in self.score for k in range(1, len(p))}
        #: no piece has white space behind another character, so such white space always starts a token
        self.space_starts = all(SPACE not in p.lstrip(SPACE) for p in self.score)
        self._pairs: dict[tuple[str | None, str], bool] = {}
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.empty = self._state("", (None,), (0,))

    def _state(self, live: str, tokens: tuple, counts: tuple) -> dict:
        key = (live, tokens, counts)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {"": key}
        return state

    def merges(self, text: str) -> list[str]:
        """The BPE of a few characters: the best-scored neighbours merge first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, before: str | None, token: str) -> bool:
        key = (before, token)
        known = self._pairs.get(key)
        if known is None:
            known = self._pairs[key] = self.merges((before or "") + token) == ([token] if before is None else [before, token])
        return known

    def _compile(self, state: dict, c: str) -> tuple[dict, int]:
        """Adds the transition of ``state`` on the character ``c``."""
        live, tokens, counts = state[""]
        x = SPACE if c == " " else c
        if x not in self.score:
            step = (self.empty, len(c.encode()))
        elif x == SPACE and self.space_starts and state is not self.empty and live.strip(SPACE) + (tokens[-1] or "").strip(SPACE):
            after, count = self.empty.get(c) or self._compile(self.empty, c)
            step = (after, count)
        else:
            text, m = live + x, len(live)
            for start in range(m + 1):
                token = text[start:]
                if token in self.score and self._stands(tokens[start], token):
                    break
            count = counts[start] + 1
            keep = next(k for k in range(m + 2) if k == m + 1 or text[k:] in self.beginnings)
            tokens, counts = (*tokens, token)[keep:], (*(n - count for n in counts), 0)[keep:]
            text = text[keep:]
            # places from which no piece can reach the future are blank, so that states that act alike are one
            ahead = [k == len(text) or text[k:] in self.beginnings for k in range(len(text) + 1)]
            tokens = tuple([t if yes else "" for t, yes in zip(tokens, ahead, strict=True)])
            counts = tuple([n if yes else 0 for n, yes in zip(counts, ahead, strict=True)])
            step = (self._state(text, tokens, counts), count)
        state[c] = step
        return step

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        count = 0
        compile_ = self._compile
        for c in text:
            step = state.get(c) or compile_(state, c)
            state = step[0]
            count += step[1]
        return state, count

    def chunk_map(self, text: str) -> ChunkMap:
        """The map of one chunk, without knowing the state before it."""
        for k, c in enumerate(text):
            if c not in self.score and c != " ":
                state, count = self.run(self.empty, text[k + 1 :])
                return ChunkMap(text[:k], count + len(c.encode()), state)
            if k and self.space_starts and (c == " " or c == SPACE) and text[k - 1] != " " and text[k - 1] != SPACE:
                state, count = self.run(self.empty, text[k:])
                return ChunkMap(text[:k], count, state)
        return ChunkMap(text, 0, None)

    def compose(self, first: ChunkMap, then: ChunkMap) -> ChunkMap:
        """The map of two neighbouring chunks; associative."""
        if first.out is None:
            return ChunkMap(first.head + then.head, then.count, then.out)
        state, count = self.run(first.out, then.head)
        return ChunkMap(first.head, first.count + count + then.count, state if then.out is None else then.out)

    def scan(self, maps: list[ChunkMap]) -> ChunkMap:
        """Composes neighbours pairwise until one map is left (the upward half of a prefix scan;
        the total needs no downward half)."""
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0]

    def count(self, text: str, chunk: int = CHUNK) -> int:
        """Tokens of a whole text; an empty one has none."""
        if not text:
            return 0
        if len(self.states) > STATES:
            self._forget()
        text = " " + text
        if len(text) <= chunk:
            return self.run(self.empty, text)[1]
        whole = self.scan([self.chunk_map(text[k : k + chunk]) for k in range(0, len(text), chunk)])
        return self.run(self.empty, whole.head)[1] + whole.count


def transducer(model_file: str) -> Transducer:
    """One machine per Python worker: states compiled for one task serve the next."""
    return worker_state(("transducer", model_file), lambda: Transducer(model_file))


def token_counts(docs: DataFrame, model_file: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): n_bytes, n_tokens, over_limit."""
    path = model_file or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = transducer(path).count
        for part in text_slices(batches, "text"):
            tokens = np.array([count(t or "") for t in part.column("text").to_pylist()], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(byte_lengths(part.column("text"))), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
