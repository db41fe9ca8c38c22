"""Token counts under a BPE vocabulary of pieces, by rank-synchronous merging of ragged arrays.

Texts are cut into pre-tokens (the spaces before a word and the word); no piece of the vocabulary holds a space
after another character, so no merge crosses such a cut. Pre-tokens not counted before are merged together as one
ragged array: in each round every sequence that can still merge applies its lowest-ranked pair, the leftmost of
equals, all at once. A symbol that is no piece counts as its UTF-8 bytes (byte fallback). Before merging, a
pre-token is cut wherever no piece of the vocabulary holds the two adjacent characters together, so that sequences
stay short; what is still long is merged with a priority queue, which gives the same result.

Defined results: a null or empty text has 0 bytes and 0 tokens. Every row of the input gives one row; columns
beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import arrow, column_bytes

SPACE = "▁"
#: Pre-tokens remembered by a worker, symbols up to which a sequence is not cut, and above which it is merged on its own.
REMEMBERED, SHORT, LONG = 1 << 20, 32, 256
_RUNS = re.compile(r" *[^ ]+| +")
_LOADED: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts tokens as the model's library does, without begin and end tokens."""

    def __init__(self, model_file: str):
        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces = [model.id_to_piece(i) for i in plain]
        scores = np.array([model.get_score(i) for i in plain])
        order = np.unique(-scores)
        self.ids = {p: i for i, p in enumerate(pieces)}
        self.rank = np.searchsorted(order, -scores).astype(np.int64)
        self.chars = {c for p in pieces for c in p}
        self.inside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
        left, right, merged = [], [], []
        for p, i in self.ids.items():
            for at in range(1, len(p)):
                if (a := self.ids.get(p[:at])) is not None and (b := self.ids.get(p[at:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(i)
        keys = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        at = np.argsort(keys)
        self.keys, self.merged = keys[at], np.array(merged, np.int64)[at]
        self.pairs = dict(zip(self.keys.tolist(), self.merged.tolist(), strict=True))
        self.known: dict[str, int] = {}

    def _cut(self, word: str) -> tuple[int, list[list[int]]]:
        """Tokens of characters that cannot merge, and the sequences of symbols that might."""
        fixed, parts, run = 0, [], []
        for i, c in enumerate(word):
            if i and word[i - 1 : i + 1] not in self.inside and run:
                parts.append(run)
                run = []
            if (symbol := self.ids.get(c)) is not None:
                run.append(symbol)
            else:  # a character that only occurs inside pieces, or in none, falls back to bytes
                if c in self.chars:
                    raise ValueError(f"the vocabulary holds {c!r} inside pieces only")
                if run:
                    parts.append(run)
                    run = []
                fixed += len(c.encode())
        if run:
            parts.append(run)
        return fixed + sum(len(p) == 1 for p in parts), [p for p in parts if len(p) > 1]

    def _queue(self, symbols: list[int]) -> int:
        """Symbols left of one long sequence, merged through a priority queue."""
        n = len(symbols)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), n
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) < n and (m := self.pairs.get(symbols[i] << 32 | symbols[j])) is not None:
                heapq.heappush(heap, (int(self.rank[m]), i, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            if symbols[i] != a or (j := after[i]) >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j], after[i] = self.pairs[a << 32 | b], -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            alive -= 1
            offer(before[i])
            offer(i)
        return alive

    def merge(self, sequences: list[list[int]]) -> np.ndarray:
        """Symbols left of each sequence."""
        left = np.array([len(s) for s in sequences], np.int64)
        for i in np.flatnonzero(left > LONG):
            left[i] = self._queue(list(sequences[i]))
        short = [i for i, s in enumerate(sequences) if len(s) <= LONG]
        owner = np.repeat(np.array(short, np.int64), [len(sequences[i]) for i in short])
        symbols = np.array([x for i in short for x in sequences[i]], np.int64)
        most = np.iinfo(np.int64).max
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            found = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(found, self.rank[self.merged[at]], most)
            rank = np.append(rank, most)
            starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(owner)))
            hit = np.flatnonzero((rank == np.repeat(best, sizes)) & (rank < most))
            first = hit[np.concatenate([[True], owner[hit][1:] != owner[hit][:-1]])] if len(hit) else hit
            symbols[first] = self.merged[at[first]]
            keep = np.repeat(best < most, sizes)  # sequences without a pair are done
            done = starts[best == most]
            left[owner[done]] = sizes[best == most]
            keep[first + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if len(symbols):
            left[owner[0]] = 1
        return left

    def learn(self, words: list[str]) -> None:
        """Count the given pre-tokens (spaces as SPACE) and remember the counts."""
        fixed, flat, owner = [], [], []
        for i, word in enumerate(words):
            symbols = list(map(self.ids.get, word))
            n, parts = (0, [symbols]) if len(symbols) <= SHORT and None not in symbols else self._cut(word)
            fixed.append(n)
            flat += parts
            owner += [i] * len(parts)
        total = np.array(fixed, np.int64)
        if flat:
            np.add.at(total, np.array(owner), self.merge(flat))
        self.known.update(zip(words, total.tolist(), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        cut = []
        for text in texts:
            spaced = " " + text.replace(SPACE, " ")
            plain = "  " not in spaced and spaced[-1] != " "
            cut.append([SPACE + w for w in spaced[1:].split(" ")] if plain else [w.replace(" ", SPACE) for w in _RUNS.findall(spaced)] if text else [])
        if len(self.known) > REMEMBERED:
            self.known.clear()
        if missing := {w for words in cut for w in words if w not in self.known}:
            self.learn(list(missing))
        known = self.known
        return [sum([known[w] for w in words]) for words in cut]


def counter(model_file: str) -> PieceCounter:
    """The worker's counter of a model file, loaded once."""
    if model_file not in _LOADED:
        _LOADED[model_file] = PieceCounter(model_file)
    return _LOADED[model_file]


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096, group: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than limit tokens) of every whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(model_file)
        for batch in batches:
            texts = batch.column("text")
            n_bytes = np.diff(column_bytes(texts)[1])
            n_tokens: list[int] = []
            for i in range(0, len(texts), group):
                n_tokens += pieces.count([t or "" for t in texts.slice(i, group).to_pylist()])
            tokens = pa.array(n_tokens, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_bytes, pa.int64()), tokens, pa.compute.greater(tokens, limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(arrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"))
