"""Induced sorting of suffixes with common-prefix values, through disk-backed queues.

The symbols of a text are whole numbers; the last one is 0 and occurs once. A suffix is of type S if it is smaller than
the suffix after it, else of type L; an S suffix after an L suffix is a seed. The steps:

1. Seed substrings (from a seed to the next one) are sorted and named; the names form the reduced text.
2. The order of the seeds is that of the suffixes of the reduced text: found by the same procedure, recursively, or, once
   the reduced text is small enough, by prefix doubling in memory.
3. Seeds enter the queues of their first symbols. Queues are emptied in ascending order; each suffix taken out hands its
   predecessor, if of type L, to that one's queue, which thereby receives its suffixes in order. A second pass in
   descending order does the same for type S.

A priority queue by (first symbol, rank of the rest) is thus kept as one first-in-first-out queue for each symbol, which
spills to disk beyond a limit. Tuples in a queue hold a position and the common-prefix length with the tuple before it:
1 more than the smallest value that passed since then. Values are capped at depth; order beyond depth symbols is not
needed by the caller, so sorting may stop there. Tuples move in blocks as arrays.
"""

from __future__ import annotations

import heapq
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np

#: Tuples moved at once; names up to which the reduced text is sorted in memory; bytes a queue holds before it spills.
STEP, BASE, HELD = 1 << 15, 1 << 26, 1 << 20


class Queue:
    """First in, first out: blocks of (position, common prefix), spilled to a file beyond HELD bytes."""

    def __init__(self, folder: str, name: str):
        self.path, self.blocks, self.held, self.spilled, self.size = f"{folder}/{name}", [], 0, [], 0

    def push(self, at: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.append((at, lcp))
        self.held += at.nbytes + lcp.nbytes
        self.size += len(at)
        if self.held > HELD:
            self._spill()

    def _spill(self) -> None:
        with open(self.path, "ab") as out:
            for at, lcp in self._merged():
                self.spilled.append((out.tell(), len(at)))
                out.write(at.tobytes())
                out.write(lcp.tobytes())
        self.blocks, self.held = [], 0

    def _merged(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if self.blocks:
            at, lcp = (np.concatenate(x) for x in zip(*self.blocks, strict=True))
            for i in range(0, len(at), STEP):
                yield at[i : i + STEP], lcp[i : i + STEP]

    def _read(self, place: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        with open(self.path, "rb") as data:
            data.seek(place[0])
            return np.frombuffer(data.read(8 * place[1]), np.int64), np.frombuffer(data.read(2 * place[1]), np.uint16)

    def take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Empties the queue; what is pushed meanwhile comes at the end."""
        while self.spilled or self.blocks:
            spilled, self.spilled = self.spilled, []
            blocks = list(self._merged())
            self.blocks, self.held = [], 0
            for place in spilled:
                yield self._read(place)
            yield from blocks

    def backward(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks from the last to the first, each in its own order; empties the queue."""
        blocks = list(self._merged())
        self.blocks, self.held = [], 0
        yield from blocks[::-1]
        while self.spilled:
            yield self._read(self.spilled.pop())


class _Queues:
    """The queues of one pass and, for each, the smallest common-prefix value since it last received a tuple."""

    def __init__(self, folder: str, label: str, symbols: int, depth: int):
        self.folder, self.label, self.depth = folder, label, depth
        self.open: dict[int, Queue] = {}
        self.since = np.zeros(symbols, np.uint16)
        self.fresh: list[int] = []  # symbols whose queue was opened since the caller last looked

    def pass_on(self, lcp: np.ndarray, chosen: np.ndarray, at: np.ndarray, target: np.ndarray) -> None:
        """A block of suffixes passes with values lcp; those at indexes chosen hand on the suffixes at to queues target."""
        if not len(chosen):
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        order = np.argsort(target, kind="stable")
        chosen, at, target = chosen[order], at[order], target[order]
        first = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]]))
        names, ends = target[first], np.append(first[1:], len(target))
        value = np.empty(len(chosen), np.uint16)
        inner = np.ones(len(chosen), bool)
        inner[first] = False
        b = np.flatnonzero(inner)
        if len(b):  # minima over (previous index, own index], by a table of minima over powers of two
            lo, hi = chosen[b - 1] + 1, chosen[b] + 1
            level = np.frexp((hi - lo).astype(np.float64))[1] - 1
            found, table = np.empty(len(b), np.uint16), lcp
            for k in range(int(level.max()) + 1):
                if k:
                    half = 1 << (k - 1)
                    table = np.minimum(table[:-half], table[half:])
                which = np.flatnonzero(level == k)
                found[which] = np.minimum(table[lo[which]], table[hi[which] - (1 << k)])
            value[b] = found
        ahead = np.minimum.accumulate(lcp)
        value[first] = np.minimum(ahead[chosen[first]], self.since[names])
        np.minimum(self.since, ahead[-1], out=self.since)
        behind = np.append(np.minimum.accumulate(lcp[::-1])[::-1], np.uint16(self.depth))
        self.since[names] = behind[chosen[ends - 1] + 1]
        value = np.minimum(value, self.depth - 1) + np.uint16(1)
        for name, i, j in zip(names.tolist(), first.tolist(), ends.tolist(), strict=True):
            if name not in self.open:
                self.open[name] = Queue(self.folder, f"{self.label}{name}")
                self.fresh.append(name)
                value[i] = 0  # nothing of this symbol stands before it
            self.open[name].push(at[i:j], value[i:j])


def types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is of type S."""
    n = len(text)
    differs = np.flatnonzero(text[:-1] != text[1:])  # a run takes the type of its last symbol
    at = np.searchsorted(differs, np.arange(n - 1))
    small = np.empty(n, bool)
    small[:-1] = (text[:-1] < text[1:])[differs[at]]
    small[-1] = True
    return small


def common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """Common-prefix lengths of pairs of suffixes, capped at depth; text ends with a symbol that occurs once."""
    out = np.zeros(len(a), np.uint16)
    live = np.arange(len(a))
    wide = text.dtype == np.uint8
    if wide:
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        words = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), (len(text) + 1,), (1,)) if len(text) else None
    step = 8 if wide else 1
    done = 0
    n = len(text)
    while len(live) and done < depth:
        i, j = a[live] + done, b[live] + done
        if wide:
            inside = np.maximum(i, j) < n
            same = inside.copy()
            x = words[np.minimum(i, n)] ^ words[np.minimum(j, n)]
            same &= x == 0
            part = ~same
            low = x[part] & (~x[part] + np.uint64(1))  # its lowest set bit lies in the first byte that differs
            bits = np.frexp(low.astype(np.float64))[1] - 1
            out[live[part]] = np.minimum(depth, done + np.where(x[part] == 0, 0, np.maximum(bits, 0) // 8))
            live = live[same]
        else:
            same = text[i] == text[j]
            out[live[~same]] = done
            live = live[same]
        done += step
    out[live] = depth
    return out


def _names(text: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Of each seed substring its rank: the number of seeds whose substring is smaller. Equal ones have equal ranks."""
    n = len(seeds)
    length = np.append(np.diff(seeds) + 1, 1)
    wide = text.dtype == np.uint8
    step = 8 if wide else 1
    pad = np.uint64(255) if wide else np.uint64(np.iinfo(np.int64).max)
    rank = np.zeros(n, np.int64)
    live = np.arange(n)
    done = 0
    while len(live):
        key = np.zeros(len(live), np.uint64)
        for j in range(done, done + step):
            inside = j < length[live]
            symbol = np.where(inside, text[np.minimum(seeds[live] + j, len(text) - 1)].astype(np.uint64), pad)
            key = key << np.uint64(8) | symbol if wide else symbol
        order = np.lexsort((key, rank[live])) if done else np.argsort(key, kind="stable")
        live, key = live[order], key[order]
        base = rank[live]
        group = np.concatenate([[True], base[1:] != base[:-1]])
        fresh = group | np.concatenate([[True], key[1:] != key[:-1]])
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(group, at, 0))
        own = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[live] = base + own - start
        done += step
        edges = np.append(np.flatnonzero(fresh), len(live))
        many = np.repeat(np.diff(edges) > 1, np.diff(edges))
        live = live[many & (length[live] >= done)]
    return rank


def _doubled(rank: np.ndarray, seeds: np.ndarray, depth: int) -> np.ndarray:
    """Order of the reduced text's suffixes, by prefix doubling of ranks until depth symbols of the text are covered."""
    n, h = len(rank), 1
    rank = np.append(rank, -1)
    sizes = np.bincount(rank[:n], minlength=n)
    live = np.flatnonzero(sizes[rank[:n]] > 1)
    end = np.append(seeds, np.iinfo(np.int64).max)
    while len(live):
        key = (rank[live].astype(np.uint64) << np.uint64(32)) | (rank[np.minimum(live + h, n)] + 1).astype(np.uint64)
        by = np.argsort(key, kind="stable")
        live, key = live[by], key[by]
        base = rank[live]
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.concatenate([[True], base[1:] != base[:-1]])
        at = np.arange(len(live))
        start = np.maximum.accumulate(np.where(group, at, 0))
        own = np.maximum.accumulate(np.where(fresh, at, 0))
        rank[live] = base + own - start
        h *= 2
        edges = np.append(np.flatnonzero(fresh), len(live))
        many = np.repeat(np.diff(edges) > 1, np.diff(edges))
        live = live[many]
        live = live[end[np.minimum(live + h, n)] - seeds[live] < depth]
    return np.argsort(rank[:n], kind="stable")


def _induce(text: np.ndarray, seeds: np.ndarray, shared: np.ndarray, depth: int, folder: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, from the sorted seeds and their common prefixes."""
    symbols = int(text.max()) + 1
    first = text[seeds]
    cuts = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]])) if len(seeds) else np.zeros(0, np.int64)
    ranges = {int(first[a]): (int(a), int(z)) for a, z in zip(cuts, np.append(cuts[1:], len(seeds)), strict=True)}

    def border(a: int, b: int) -> int:
        return int(common(text, np.array([a]), np.array([b]), depth)[0])

    def step(queues: _Queues, at: np.ndarray, lcp: np.ndarray, symbol: int, rising: bool, equal: bool) -> None:
        before = text[at - 1]
        take = (before > symbol) if rising else (before < symbol)
        if equal:
            take |= before == symbol
        chosen = np.flatnonzero(take & (at > 0))
        queues.pass_on(lcp, chosen, at[chosen] - 1, before[chosen].astype(np.int64))

    rising, runs, heap = _Queues(folder, "rising", symbols, depth), {}, sorted(ranges)
    while heap:
        c = heapq.heappop(heap)
        last = None
        if c in rising.open:
            runs[c] = Queue(folder, f"run{c}")
            for at, lcp in rising.open[c].take():
                runs[c].push(at, lcp)
                last = int(at[-1])
                step(rising, at, lcp, c, True, True)
        a, z = ranges.get(c, (0, 0))
        for i in range(a, z, STEP):
            at, lcp = seeds[i : min(z, i + STEP)], shared[i : min(z, i + STEP)].copy()
            if i == a:
                lcp[0] = 0 if last is None else border(last, int(at[0]))
            step(rising, at, lcp, c, True, False)
        for name in rising.fresh:
            if name not in ranges and name != c:
                heapq.heappush(heap, name)
        rising.fresh = []

    falling, heap = _Queues(folder, "falling", symbols, depth), sorted(-c for c in runs)
    while heap:
        c = -heapq.heappop(heap)
        last = None
        if c in falling.open:
            for at, lcp in falling.open[c].take():
                yield at, lcp
                last = int(at[-1])
                step(falling, at, lcp, c, False, True)
        above = None  # of the L suffix before, its value with the next smaller one
        for at, lcp in runs[c].backward() if c in runs else ():
            down = np.empty_like(lcp)
            down[1:] = lcp[:0:-1]
            down[0] = above if above is not None else 0 if last is None else border(last, int(at[-1]))
            above = lcp[0]
            at = at[::-1]
            yield at, down
            step(falling, at, down, c, False, False)
        for name in falling.fresh:
            if name not in runs and name != c:
                heapq.heappush(heap, -name)
        falling.fresh = []
    yield np.array([len(text) - 1]), np.zeros(1, np.uint16)


def sorted_suffixes(text: np.ndarray, depth: int, folder: str | None = None, base: int | None = None, lcp: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, in blocks: positions, and common prefixes with the suffix taken before.

    text: uint8 symbols below 255, or int64 symbols; the last is 0, which occurs once. Order and values hold up to depth
    symbols. Files lie in folder (a temporary one, private to this call, by default) and are removed at the end.
    """
    if folder is None:
        with tempfile.TemporaryDirectory(prefix="lexispark-") as own:
            yield from sorted_suffixes(text, depth, own, base, lcp)
        return
    if len(text) == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.uint16)
        return
    small = types(text)
    seeds = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    names = _names(text, seeds)
    if len(seeds) <= (BASE if base is None else base):
        order = _doubled(names, seeds, depth)
    else:
        deeper = tempfile.mkdtemp(dir=folder)
        # the last seed is the end symbol, whose name is the smallest and occurs once
        order = np.concatenate([at for at, _ in sorted_suffixes(names, depth, deeper, base, False)])[::-1]
        shutil.rmtree(deeper)
    seeds = seeds[order]
    shared = np.zeros(len(seeds), np.uint16)
    if lcp:
        shared[1:] = common(text, seeds[:-1], seeds[1:], depth)
    yield from _induce(text, seeds, shared, depth, folder)
