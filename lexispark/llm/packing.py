"""Packing documents into token windows of fixed capacity by Karmarkar-Karp multiway differencing.

Each task tokenizes its rows, cuts full windows off long documents and packs what remains in blocks of bounded size.
A block's remainders start as partial partitions with one item each. The two partitions of largest spread are merged
again and again, the fullest window of one with the emptiest of the other, until one partition into near-equal windows
is left. Without cutting, the window count rises until no window exceeds the capacity. With cutting (the default),
what exceeds a window is cut off and fills the others; what is left over goes to the next block, and at the end of a
task into further windows whose lengths are powers of two, which need no padding. Nothing is shuffled.

Defined results: a null or empty text has one token, the end token. Repeated rows are packed as often as they occur.
sequence_id is the partition's number times 2**32 plus a counter, so a task that runs again gives the same rows. An
empty table gives an empty result; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import arrow, column_bytes, picked, word_spans

#: Words and chunks of text whose ids a worker remembers.
REMEMBERED = 1 << 20
#: Words kept in a dictionary before they join the sorted arrays.
RECENT = 1 << 16
_LOADED: dict[str, WordIds] = {}
_PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Items 0..n-1 in k lists of near-equal size sums (Karmarkar-Karp)."""
    if k == 1 or not sizes:
        return [list(range(len(sizes)))] + [[] for _ in range(k - 1)]
    follow = np.full(len(sizes), -1, np.int64)
    heap = []
    for i, size in enumerate(sizes):  # (-spread, number, sums ascending, first item, last item); None: one item
        heap.append((-size, i, None, i, i))
    heapq.heapify(heap)
    number = len(sizes)

    def opened(entry: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if entry[2] is not None:
            return entry[2:]
        sums, head, tail = np.zeros(k, np.int64), np.full(k, -1, np.int64), np.full(k, -1, np.int64)
        sums[-1], head[-1], tail[-1] = -entry[0], entry[3], entry[4]
        return sums, head, tail

    while len(heap) > 1:
        a, ahead, atail = opened(heapq.heappop(heap))
        b, bhead, btail = (x[::-1] for x in opened(heapq.heappop(heap)))
        both = (ahead >= 0) & (bhead >= 0)
        follow[atail[both]] = bhead[both]
        sums, head, tail = a + b, np.where(ahead >= 0, ahead, bhead), np.where(btail >= 0, btail, atail)
        order = np.argsort(sums, kind="stable")
        sums = sums[order] - sums[order[0]]
        heapq.heappush(heap, (-int(sums[-1]), number, sums, head[order], tail[order]))
        number += 1
    lists = []
    for i in opened(heap[0])[1].tolist():
        lists.append([])
        while i >= 0:
            lists[-1].append(i)
            i = int(follow[i])
    return lists


def windows_whole(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of whole items; the count rises while any window exceeds the capacity."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        found = differencing(sizes, k)
        if max(sum(sizes[i] for i in w) for w in found) <= capacity:
            return found
        k += max(1, k // 64)


Piece = tuple[int, int, int]  # item, start in the item, length


def windows_cut(items: list[Piece], capacity: int) -> tuple[list[list[Piece]], list[Piece]]:
    """Full windows of pieces, and the pieces left over, which are shorter than the capacity together."""
    k = sum(p[2] for p in items) // capacity
    if not k:
        return [], items
    full, open_, over = [], [], []
    for found in differencing([p[2] for p in items], k):
        window, room = [], capacity
        for item, start, length in (items[i] for i in sorted(found)):
            if take := min(room, length):
                window.append((item, start, take))
            if take < length:
                over.append((item, start + take, length - take))
            room -= take
        (open_ if room else full).append((window, room))
    for window, room in open_:
        while room:
            item, start, length = over.pop()
            take = min(room, length)
            window.append((item, start, take))
            if take < length:
                over.append((item, start + take, length - take))
            room -= take
    return [w for w, _ in full + open_], over


def power_windows(items: list[Piece], capacity: int) -> list[list[Piece]]:
    """The last pieces of a task in windows whose lengths are powers of two."""
    left, found = sum(p[2] for p in items), []
    rest = items[::-1]
    while left:
        room = min(capacity, 1 << (left.bit_length() - 1))
        left -= room
        found.append([])
        while room:
            item, start, length = rest.pop()
            take = min(room, length)
            found[-1].append((item, start, take))
            if take < length:
                rest.append((item, start + take, length - take))
            room -= take
    return found


class WordIds:
    """Token ids of whole texts.

    This vocabulary drops white space and merges within words only, so the ids of a text are those of its words in
    order. Words are told apart by 64-bit hashes and encoded once; a batch looks up its different words and gathers
    their ids as arrays. Words are lower-cased first, as the vocabulary's normaliser does, and trailing punctuation, a
    pre-token of its own, is encoded apart, so that fewer words differ. New words of letters only are pre-tokens
    already and go straight to the library's model, in its byte alphabet; their ids are told apart by the tokens that
    end a word. Texts with special strings, or with characters beyond Latin letters, whose lower case and composition
    depend on what stands around, are encoded by the whole tokenizer, between spaces.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.model = Tokenizer(self.tokenizer.model)
        suffix = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.table = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, [*range(0xDF, 0xF7), *range(0xF8, 0x100)])})
        self._forget()

    def _forget(self) -> None:
        self.chunks: dict[str, bytes] = {"": b""}  # of texts for the whole tokenizer, and of punctuation
        self.recent: dict[int, int] = {}  # a word's hash and its number
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # the same, sorted, of most words
        self.begin, self.count, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.flat, self.filled = np.zeros(1 << 18, np.uint32), 0

    def _whole(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks as they are, by the whole tokenizer."""
        if missing := list({c for c in chunks if c not in self.chunks}):
            for chunk, got in zip(missing, self.tokenizer.encode_batch(missing, add_special_tokens=False), strict=True):
                self.chunks[chunk] = np.array(got.ids, "<u4").tobytes()
        return [self.chunks[c] for c in chunks]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of different lower-case words."""
        cores, tails, letters, rest = [], {}, {}, []
        for i, w in enumerate(words):
            if not w[-1].isalnum():
                n = len(w.rstrip(_MARKS))
                if n < len(w) and (not n or w[n - 1].isalnum()):
                    tails[i] = w[n:]
                    w = w[:n]
            cores.append(w)
            if w.isalpha() and (w.isascii() or _PLAIN.fullmatch(w)):
                letters[w] = b""
            elif w:
                rest.append(w)
        if letters:
            mapped = [w if w.isascii() else w.translate(self.table) for w in letters]
            ids = np.array(self.model.encode_batch_fast([mapped], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) * 4 + 4
            if len(cuts) != len(letters):
                raise ValueError("the vocabulary doesn't mark the ends of words")
            data, cuts = ids.tobytes(), [0, *cuts.tolist()]
            letters = dict(zip(letters, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))
        letters.update(zip(rest, self._whole(rest), strict=True))
        letters[""] = b""
        out = [letters[w] for w in cores]
        for i, tail in zip(tails, self._whole(list(tails.values())), strict=True):
            out[i] += tail
        return out

    def _remember(self, hashes: list[int], ids: list[bytes]) -> None:
        data, n = np.frombuffer(b"".join(ids), "<u4"), len(ids)
        count = np.array([len(x) // 4 for x in ids], np.int64)
        while self.used + n > len(self.begin):
            self.begin, self.count = np.concatenate([self.begin, self.begin]), np.concatenate([self.count, self.count])
        while self.filled + len(data) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.filled : self.filled + len(data)] = data
        self.begin[self.used : self.used + n] = self.filled + np.cumsum(count) - count
        self.count[self.used : self.used + n] = count
        self.recent.update(zip(hashes, range(self.used, self.used + n), strict=True))
        self.used += n
        self.filled += len(data)
        if len(self.recent) > RECENT:
            names = np.concatenate([self.names, np.fromiter(self.recent, np.uint64, len(self.recent))])
            order = np.argsort(names)
            self.names = names[order]
            self.numbers = np.concatenate([self.numbers, np.fromiter(self.recent.values(), np.int64, len(self.recent))])[order]
            self.recent = {}

    def _numbers(self, names: np.ndarray) -> np.ndarray:
        """Numbers of words by their hashes; -1 for new ones."""
        out = np.full(len(names), -1, np.int64)
        if len(self.names):
            at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
            out = np.where(self.names[at] == names, self.numbers[at], -1)
        rest = np.flatnonzero(out < 0)
        out[rest] = [self.recent.get(x, -1) for x in names[rest].tolist()]
        return out

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Of each text its ids, as little-endian unsigned 32-bit numbers; null is empty."""
        if self.used + len(self.chunks) > REMEMBERED:
            self._forget()
        buf, offsets = column_bytes(texts)
        h, start, end, rows = word_spans(buf, offsets)
        beyond = buf >= 0xCC  # the first byte of characters from U+0300 on
        beyond[:-1] |= (buf[:-1] == ord("<")) & (buf[1:] == ord("|"))
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(beyond), side="right") - 1)
        if len(odd):
            owner = np.repeat(np.arange(len(texts)), np.diff(rows))
            keep = ~np.isin(owner, odd)
            rows = np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=len(texts)))])
            h, start, end = h[keep], start[keep], end[keep]
        names, first, which = np.unique(h, return_index=True, return_inverse=True)
        at = self._numbers(names)
        new = np.flatnonzero(at < 0)
        if len(new):
            raw = buf.tobytes()
            words = [raw[a:z].decode().lower() for a, z in zip(start[first[new]].tolist(), end[first[new]].tolist(), strict=True)]
            at[new] = np.arange(self.used, self.used + len(new))
            self._remember(names[new].tolist(), self._words(words))
        at = at[which] if len(names) else np.zeros(0, np.int64)
        count = self.count[at]
        has = count > 0
        ids = picked(self.flat, self.begin[at[has]], count[has])
        cuts = np.concatenate([[0], np.cumsum(count)])[rows].tolist()
        out = [ids[a:z].tobytes() for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
        for i in odd.tolist():
            out[i] = b"".join(self._whole(texts[i].as_py().split(" ")))
        return out


PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, tokenizer_file: str, end_id: int, capacity: int = 4096, block: int = 1 << 20, group: int = 1024, whole: bool = False) -> DataFrame:
    """Pieces of all documents, each id in exactly one piece; block is the number of tokens packed at once.

    whole: what remains of a document after its full windows is not cut again; the window count rises instead.
    """

    def windows(items: list[Piece]) -> tuple[list[list[Piece]], list[Piece]]:
        if not whole:
            return windows_cut(items, capacity)
        return [[items[i] for i in w] for w in windows_whole([p[2] for p in items], capacity) if w], []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_file not in _LOADED:
            _LOADED[tokenizer_file] = WordIds(tokenizer_file)
        words, end = _LOADED[tokenizer_file], np.array([end_id], "<u4").tobytes()
        partition = TaskContext.get().partitionId() << 32
        counter, held, items, waiting, next_item = 0, {}, [], 0, 0  # held: doc_id and ids of the items in hand

        def rows(found: list[list[Piece]]) -> pa.RecordBatch:
            nonlocal counter
            out = []
            for window in found:
                offset = 0
                for item, start, length in window:
                    doc_id, ids = held[item]
                    out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, partition + counter, offset))
                    offset += length
                counter += 1
            columns = zip(*out, strict=True) if out else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in PACKED.split(", ")])

        for batch in batches:
            ids_of, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for at in range(0, len(texts), group):
                for doc_id, ids in zip(ids_of[at : at + group], words.encode(texts.slice(at, group)), strict=True):
                    ids += end
                    held[next_item] = doc_id, ids
                    n = len(ids) // 4
                    if whole := n // capacity:
                        yield rows([[(next_item, i * capacity, capacity)] for i in range(whole)])
                    if n % capacity:
                        items.append((next_item, whole * capacity, n % capacity))
                        waiting += n % capacity
                    next_item += 1
                    if waiting >= block:
                        found, items = windows(items)
                        yield rows(found)
                        waiting = sum(p[2] for p in items)
                        held = {i: held[i] for i, _, _ in items}
        found, items = windows(items)
        yield rows(found + power_windows(items, capacity))

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows_in.transform(arrow(work, PACKED))
