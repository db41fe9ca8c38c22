"""Removal of long byte strings that occur more than once, by suffix and common-prefix arrays.

Every string of `length` bytes has an anchor: the position of the smallest hash among its `gram`-byte substrings. Equal
strings have equal anchors at equal places, so only starts whose anchors have equal hashes need comparing. Consecutive
starts with the same anchor form a run; its text (its starts' strings) belongs to the class of the anchor's hash.

1. Runs are counted by (anchor hash, hash of the run's text), packed in numpy before they are exchanged. A hash seen
   once needs nothing more; in a class with a single text every start occurs as often as the text.
2. The different texts of the other classes are exchanged by class, each with its occurrences. Classes are concatenated
   into shards and sorted by external induced sorting (induced.py); a start is repeated if its suffix shares `length`
   bytes with a neighbour, or if its run's text occurs more than once. Very frequent classes are split by the start's
   distance from the anchor and the bytes all starts of such a part share, so no task gets all of one.
3. The spans covered by repeated starts are exchanged by document, merged and kept as sorted arrays, which workers map
   to take the spans out of the texts.

Defined results: texts are UTF-8 bytes, a null text is empty; strings never cross documents; copies of a row are
documents of their own. A text shorter than `length` keeps everything. Every input row gives one row; an empty table
gives none. Columns beside doc_id and text are ignored by summary, and kept by without_repeats whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch, shuffle_partitions
from .files import listed, mapped, put
from .induced import sorted_suffixes
from .textops import BLOCK, arrow, column_bytes, mix64, picked, powers, span_hashes

GRAM = 50
#: Runs and bytes a task gathers before it sends them on; bytes sorted at once; occurrences from which a class is split, and the starts of a part.
FLUSH_RUNS, FLUSH_BYTES, SHARD, HOT, PART = 1 << 21, 1 << 24, 1 << 23, 4096, 16
_MULTIPLE = np.uint32(1 << 31)
_COLUMNS = ["target", "kind", "key", "hash", "size", "text", "region", "doc", "lo", "hi"]
_PACKED = "target int, kind int, " + ", ".join(f"{c} binary" for c in _COLUMNS[2:])


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _row(target: int, kind: int, **arrays: np.ndarray) -> tuple:
    return (target, kind, *(arrays[c].tobytes() if c in arrays else None for c in _COLUMNS[2:]))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=_COLUMNS)


def _joined(rows: list[tuple], column: str, kind: type) -> np.ndarray:
    at = _COLUMNS.index(column)
    return np.concatenate([np.frombuffer(r[at], kind) for r in rows])


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    target, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[0] != target and rows:
                yield target, rows
                rows = []
            target = row[0]
            rows.append(row)
    if rows:
        yield target, rows


def row_keys(ids: list[int | None], buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """64-bit keys of rows; rows that agree in doc_id and text share a key, and lose the same spans."""
    data = memoryview(np.ascontiguousarray(buf))
    found = [hashlib.blake2b(data[a:z], digest_size=8, salt=b"null" if i is None else int(i).to_bytes(8, "little", signed=True)).digest() for i, a, z in zip(ids, offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(found), np.uint64)


@dataclass
class Runs:
    """Maximal runs of starts with the same anchor: first and last start, anchor, anchor's hash, hash of the text, row."""

    lo: np.ndarray
    hi: np.ndarray
    anchor: np.ndarray
    name: np.ndarray
    text: np.ndarray
    row: np.ndarray


def runs(buf: np.ndarray, offsets: np.ndarray, length: int, gram: int = GRAM) -> Iterator[tuple[Runs, callable]]:
    """Runs of starts, block by block, with a function that hashes stretches of the block's bytes."""
    width = length - gram + 1
    bits = np.uint64(int(BLOCK + length).bit_length())
    for base in range(0, len(buf), BLOCK):
        stop = min(len(buf), base + BLOCK)
        part = buf[base : min(len(buf), stop + length - 1)]
        n = len(part)
        if n < length:
            continue
        count = min(stop - base, n - length + 1)
        some = slice(max(0, int(np.searchsorted(offsets, base, side="right")) - 1), int(np.searchsorted(offsets, stop)) + 1)
        bounds = offsets[some]
        start = np.maximum(bounds[:-1], base) - base
        end = np.minimum(np.minimum(bounds[1:] - length + 1, stop) - base, count)
        has = end > start
        if not has.any():
            continue
        inside = np.zeros(count + 1, np.int8)
        np.add.at(inside, start[has], 1)
        np.add.at(inside, end[has], -1)
        inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
        up, down = powers(n + 1)
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        h = mix64((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
        key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
        key = np.concatenate([key, np.full(-len(key) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
        ahead = np.minimum.accumulate(key, axis=1).ravel()
        behind = np.minimum.accumulate(key[:, ::-1], axis=1)[:, ::-1].ravel()
        at = (np.minimum(behind[:count], ahead[width - 1 : width - 1 + count]) & np.uint64((1 << int(bits)) - 1)).astype(np.int64)
        differs = at[1:] != at[:-1]
        lo = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | differs]))
        hi = np.flatnonzero(inside & np.concatenate([~inside[1:] | differs, [True]]))

        def stretch(a: np.ndarray, z: np.ndarray, part=part, base=base) -> np.ndarray:
            """Hashes of bytes [a, z)."""
            return span_hashes(part, a - base, z - a)

        # anchors are minima, so their hashes are small: mixed again, they spread over the buckets
        yield Runs(lo + base, hi + base, at[lo] + base, mix64(h[at[lo]]), stretch(lo + base, hi + base + length), np.searchsorted(offsets, lo + base, side="right") - 1), stretch


def _count(length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            name, text = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.lexsort((text, name))
            name, text = name[order], text[order]
            first = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])]))
            n = np.diff(np.append(first, len(name))).astype(np.uint32)
            name, text = name[first], text[first]
            cuts = np.searchsorted(bucket_of(name, buckets), np.arange(buckets + 1))
            return _batch([_row(b, 0, key=name[cuts[b] : cuts[b + 1]], hash=text[cuts[b] : cuts[b + 1]], size=n[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist()])

        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for found, _ in runs(buf, offsets, length):
                held.append((found.name, found.text))
                size += len(found.name)
                if size >= FLUSH_RUNS:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return work


def _classes(folder: str):
    """Keeps the anchor hashes that occur more than once, with their number and whether with different texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            name, text, n = _joined(rows, "key", np.uint64), _joined(rows, "hash", np.uint64), _joined(rows, "size", np.uint32)
            rows.clear()
            order = np.lexsort((text, name))
            name, text, n = name[order], text[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
            total = np.minimum(np.add.reduceat(n, first, dtype=np.int64), (1 << 31) - 1)
            fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
            several = np.add.reduceat(fresh, first, dtype=np.int64) > 1
            many = total > 1
            put(folder, f"class-{bucket:05d}-key", name[first][many])
            put(folder, f"class-{bucket:05d}-n", total[many].astype(np.uint32) | np.where(several[many], _MULTIPLE, np.uint32(0)))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([int(many.sum())], pa.int64())], names=["bucket", "n"])

    return work


def _look(folder: str, present: set[str], name: np.ndarray, buckets: int) -> np.ndarray:
    """Stored numbers of anchor hashes, 0 where there is none."""
    out = np.zeros(len(name), np.uint32)
    order = np.argsort(name)
    cuts = np.searchsorted(bucket_of(name[order], buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        if (label := f"class-{b:05d}") not in present:
            continue
        stored, some = mapped(folder, f"{label}-key"), order[cuts[b] : cuts[b + 1]]
        if len(stored):
            at = np.minimum(np.searchsorted(stored, name[some]), len(stored) - 1)
            hit = stored[at] == name[some]
            out[some[hit]] = mapped(folder, f"{label}-n")[at[hit]]
    return out


def _split(found: Runs, stretch, hot: np.ndarray, length: int) -> Runs:
    """Runs of frequent classes cut by distance from the anchor; a part's name also covers the bytes its starts share."""
    which = np.flatnonzero(hot)
    near, far = (found.anchor[which] - found.hi[which]) // PART, (found.anchor[which] - found.lo[which]) // PART
    parts = far - near + 1
    own = np.repeat(which, parts)
    step = np.repeat(near, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    last = found.anchor[own] - step * PART  # the last start of a whole part, whether or not the run has it
    lo, hi = np.maximum(found.lo[own], last - PART + 1), np.minimum(found.hi[own], last)
    name = mix64(found.name[own] + mix64(stretch(last, last - PART + 1 + length) + step.astype(np.uint64)))
    rest = ~hot
    both = lambda a, b: np.concatenate([a[rest], b])
    return Runs(both(found.lo, lo), both(found.hi, hi), both(found.anchor, found.anchor[own]), both(found.name, name), both(found.text, stretch(lo, hi + length)), both(found.row, found.row[own]))


def _gather(folder: str, present: set[str], length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, texts, spans, size = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            size = 0
            if held:
                name, text, length_, doc, lo = (np.concatenate(x) for x in zip(*held, strict=True))
                data = np.concatenate(texts)
                held.clear()
                texts.clear()
                begin = np.concatenate([[0], np.cumsum(length_)[:-1]])
                order = np.lexsort((text, name))
                name, text, length_, doc, lo, begin = (x[order] for x in (name, text, length_, doc, lo, begin))
                fresh = np.concatenate([[True], (name[1:] != name[:-1]) | (text[1:] != text[:-1])])
                region, first = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
                cuts = np.searchsorted(bucket_of(name, buckets), np.arange(buckets + 1))
                rows = []
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    a, z = cuts[b], cuts[b + 1]
                    own = first[region[a] : region[z - 1] + 1]
                    rows.append(_row(b, 0, key=name[own], hash=text[own], size=length_[own], text=picked(data, begin[own], length_[own]), region=(region[a:z] - region[a]).astype(np.int32), doc=doc[a:z], lo=lo[a:z]))
                yield _batch(rows)
            if spans:
                yield _batch(_span_rows(*(np.concatenate(x) for x in zip(*spans, strict=True)), buckets))
                spans.clear()

        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            keys = row_keys(batch.column("doc_id").to_pylist(), buf, offsets)
            for found, stretch in runs(buf, offsets, length):
                n = _look(folder, present, found.name, buckets)
                alone = (n > 0) & (n < _MULTIPLE)
                if alone.any():
                    row = found.row[alone]
                    spans.append((keys[row], found.lo[alone] - offsets[row], found.hi[alone] + length - offsets[row]))
                    size += 24 * int(alone.sum())
                several = n >= _MULTIPLE
                if several.any():
                    some = Runs(*(getattr(found, f)[several] for f in ("lo", "hi", "anchor", "name", "text", "row")))
                    some = _split(some, stretch, (n[several] & ~_MULTIPLE) >= HOT, length)
                    long = some.hi + length - some.lo
                    # a task sends each text of this block once
                    held.append((some.name, some.text, long, keys[some.row], some.lo - offsets[some.row]))
                    texts.append(picked(buf, some.lo, long))
                    size += int(long.sum()) + 40 * len(long)
                if size >= FLUSH_BYTES:
                    yield from flush()
        yield from flush()

    return work


def _span_rows(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, buckets: int) -> list[tuple]:
    doc, lo, hi = merged(doc, lo, hi)
    cuts = np.searchsorted(bucket_of(doc, buckets), np.arange(buckets + 1))
    return [_row(b, 1, doc=doc[cuts[b] : cuts[b + 1]], lo=lo[cuts[b] : cuts[b + 1]], hi=hi[cuts[b] : cuts[b + 1]]) for b in np.flatnonzero(np.diff(cuts)).tolist()]


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping and touching spans of a document as one, sorted."""
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    group = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]])).astype(np.int64) << 40
    reach = np.maximum.accumulate(hi + group)
    first = np.flatnonzero(np.concatenate([[True], (lo + group)[1:] > reach[:-1]]))
    ends = np.append(first[1:], len(doc)) - 1
    return doc[first], lo[first], reach[ends] - group[ends]


def repeated_starts(texts: list[np.ndarray], length: int) -> list[np.ndarray]:
    """Of each text, which starts of `length` bytes occur at another place in any of them, by one suffix array."""
    size = np.array([len(t) for t in texts])
    begin = np.concatenate([[0], np.cumsum(size + 1)[:-1]])
    text = np.ones(int(size.sum()) + len(texts) + 1, np.uint8)  # 1 between texts, 0 at the end
    for t, b in zip(texts, begin.tolist(), strict=True):
        text[b : b + len(t)] = t + np.uint8(2)
    text[-1] = 0
    flags, before = np.zeros(len(text), bool), 0
    for at, lcp in sorted_suffixes(text, length):
        near = lcp >= length
        flags[at[near]] = True
        flags[np.concatenate([[before], at[:-1]])[near]] = True
        before = at[-1]
    return [flags[b : b + s - length + 1] for b, s in zip(begin.tolist(), size.tolist(), strict=True)]


def _sort(length: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches):
            if ready := [(r[0], 1, *r[2:]) for r in rows if r[1] == 1]:
                yield _batch(ready)
            rows = [r for r in rows if r[1] == 0]
            if not rows:
                continue
            counts = [len(r[2]) // 8 for r in rows]
            shift = np.concatenate([[0], np.cumsum(counts)[:-1]])
            key, text, size = _joined(rows, "key", np.uint64), _joined(rows, "hash", np.uint64), _joined(rows, "size", np.int64)
            data = _joined(rows, "text", np.uint8)
            region = np.concatenate([np.frombuffer(r[6], np.int32).astype(np.int64) + s for r, s in zip(rows, shift.tolist(), strict=True)])
            doc, lo = _joined(rows, "doc", np.uint64), _joined(rows, "lo", np.int64)
            rows.clear()
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            order = np.lexsort((text, key))
            fresh = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])])
            number = np.empty(len(key), np.int64)
            number[order] = np.cumsum(fresh) - 1
            first = order[fresh]
            region = number[region]
            weight = np.bincount(region, minlength=len(first))
            key, size, begin = key[first], size[first], begin[first]
            by = np.argsort(region, kind="stable")
            region, doc, lo = region[by], doc[by], lo[by]
            # classes one after the other, as many as fit a shard
            ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, len(key)) if len(key) else []
            a = 0
            for i, z in enumerate(ends):
                more = i + 1 < len(ends) and int(size[a : ends[i + 1]].sum()) <= SHARD
                if more:
                    continue
                found = _shard_spans(data, begin[a:z], size[a:z], weight[a:z], key[a:z], length)
                u, w = np.searchsorted(region, (a, z))
                if len(found[0]):
                    yield _batch(_span_rows(*_occurring(found, region[u:w] - a, doc[u:w], lo[u:w], z - a), buckets))
                a = z

    return work


def _shard_spans(data: np.ndarray, begin: np.ndarray, size: np.ndarray, weight: np.ndarray, key: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (region, from, to) covered by repeated starts of a shard's regions."""
    alone = np.ones(len(key), bool)
    same = key[1:] == key[:-1]
    alone[1:] &= ~same
    alone[:-1] &= ~same
    flags: list[np.ndarray] = [np.ones(0, bool)] * len(key)
    sort = np.flatnonzero(~alone).tolist()
    if sort:
        for i, f in zip(sort, repeated_starts([data[begin[i] : begin[i] + size[i]] for i in sort], length), strict=True):
            flags[i] = f
    for i in np.flatnonzero(weight > 1).tolist():
        flags[i] = np.ones(size[i] - length + 1, bool)
    starts = np.concatenate([[0], np.cumsum([len(f) for f in flags])])
    flat = np.concatenate(flags) if flags else np.zeros(0, bool)
    edge = np.zeros(len(flat) + 1, bool)
    edge[starts] = True
    lo = np.flatnonzero(flat & (edge[:-1] | np.concatenate([[True], ~flat[:-1]])))
    hi = np.flatnonzero(flat & (edge[1:] | np.concatenate([~flat[1:], [True]])))
    owner = np.searchsorted(starts, lo, side="right") - 1
    return owner, lo - starts[owner], hi - starts[owner] + length


def _occurring(found: tuple[np.ndarray, ...], region: np.ndarray, doc: np.ndarray, lo: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The spans of regions at all their occurrences."""
    owner, begin, end = found
    spans = np.bincount(owner, minlength=n)
    first = np.concatenate([[0], np.cumsum(spans)[:-1]])
    times = spans[region]
    which = np.repeat(np.arange(len(region)), times)
    pick = first[region[which]] + np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
    return doc[which], lo[which] + begin[pick], lo[which] + end[pick]


def _keep(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            doc, lo, hi = merged(_joined(rows, "doc", np.uint64), _joined(rows, "lo", np.int64), _joined(rows, "hi", np.int64))
            put(folder, f"span-{bucket:05d}-key", doc)
            put(folder, f"span-{bucket:05d}-at", np.stack([lo, hi], axis=1))
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(doc)], pa.int64())], names=["bucket", "n"])

    return work


@dataclass
class Spans:
    """Where the repeated bytes of all documents are stored."""

    folder: str
    buckets: int
    present: set[str]

    def of(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        """Of each row's key the spans to remove, n x 2."""
        for key, b in zip(keys, bucket_of(keys, self.buckets).tolist(), strict=True):
            if (label := f"span-{b:05d}") in self.present:
                stored = mapped(self.folder, f"{label}-key")
                a, z = np.searchsorted(stored, key), np.searchsorted(stored, key, side="right")
                yield mapped(self.folder, f"{label}-at")[a:z]
            else:
                yield np.zeros((0, 2), np.int64)


def find_repeats(docs: DataFrame, length: int = 200, folder: str | None = None, buckets: int | None = None) -> Spans:
    """The spans covered by strings of `length` bytes that start more than once in the whole column text."""
    if length < GRAM + PART:
        raise ValueError(f"length must be {GRAM + PART} at least")
    spark = docs.sparkSession
    folder, buckets = folder or scratch(spark, "repeats"), buckets or shuffle_partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    dealt = lambda df: df.repartitionById(buckets, "target").sortWithinPartitions("target", "kind")
    dealt(rows.select("text").transform(arrow(_count(length, buckets), _PACKED))).transform(arrow(_classes(folder), "bucket int, n long")).collect()
    gathered = dealt(rows.transform(arrow(_gather(folder, listed(folder), length, buckets), _PACKED)))
    dealt(gathered.transform(arrow(_sort(length, buckets), _PACKED))).transform(arrow(_keep(folder), "bucket int, n long")).collect()
    return Spans(folder, buckets, {x for x in listed(folder) if x.startswith("span-")})


def _kept(data: memoryview, spans: np.ndarray) -> bytes:
    parts, at = [], 0
    for lo, hi in spans.tolist():
        parts.append(data[at:lo])
        at = hi
    return b"".join([*parts, data[at:]])


SUMMARY = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def summary(docs: DataFrame, spans: Spans) -> DataFrame:
    """Of every row the bytes, the removed bytes and spans, and the digest of what is left."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            keys, data, out = row_keys(batch.column("doc_id").to_pylist(), buf, offsets), memoryview(buf), []
            for own, a, z in zip(spans.of(keys), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append((z - a, int((own[:, 1] - own[:, 0]).sum()), len(own), hashlib.sha256(_kept(data[a:z], own)).hexdigest()))
            columns = [pa.array(c) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3 + [pa.array([], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=[f.split()[0] for f in SUMMARY.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.transform(arrow(work, SUMMARY))


def whole_characters(data: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Spans narrowed to whole UTF-8 characters."""
    out = []
    for lo, hi in spans.tolist():
        while lo < hi and data[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return np.array(out, np.int64).reshape(-1, 2)


def without_repeats(docs: DataFrame, spans: Spans) -> DataFrame:
    """docs with the spans taken out of text, by whole characters, and n_chars (if there is one) counted anew."""
    names = [c.lower() for c in docs.columns]
    at, ident = names.index("text"), names.index("doc_id")
    count = names.index("n_chars") if "n_chars" in names else None

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = column_bytes(batch.column(at))
            keys, out = row_keys(batch.column(ident).to_pylist(), buf, offsets), []
            for own, a, z in zip(spans.of(keys), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                out.append(_kept(memoryview(buf[a:z]), whole_characters(buf[a:z], own)).decode())
            columns = list(batch.columns)
            columns[at] = pa.array([t if v else None for v, t in zip(batch.column(at).is_valid().to_pylist(), out, strict=True)], pa.string())
            if count is not None:
                columns[count] = pa.array([len(t) for t in out]).cast(batch.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.transform(arrow(work, T.StructType(docs.schema.fields)))
