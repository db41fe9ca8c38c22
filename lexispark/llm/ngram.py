"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash arrays, mapped by workers.

Words are 64-bit hashes. Tasks count the pairs of (context, word) of a few million tokens at a time in numpy and send
them, packed into one binary row per bucket of contexts, to the task that owns the bucket. That task adds them up and
writes arrays sorted by hash: pairs with counts, contexts with their total and their numbers of words seen once, twice
and more often. A context's total is also its word's count, so unigram counts need no further pass. How many different
contexts precede a word (its continuation count) is added up by a second exchange in the same way. Contexts frequent
in a sample of the rows are dealt by pair instead of by context, so no bucket holds a very frequent word; that changes
where counts are added up, not what they are.

Scoring maps the arrays into memory and looks up each batch's different pairs in hash order:
p(w|v) = max(c(v,w) - D(c), 0) / c(v) + g(v) p(w),  p(w) = max(k(w) - d(k), 0) / K + g / (V + 1).

Defined results: a null text is empty and has one token, its end. Rows with null doc_id are learned from and are not
held out. Without learned tokens every token has probability 1 / (V + 1) = 1. Every input row gives one row; an empty table gives
none. Columns beside doc_id and text are ignored, whatever their names; repeated rows are learned from as often.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch, shuffle_partitions
from .files import listed, mapped, put
from .textops import arrow, column_bytes, mix64, slices, word_hashes

BEGIN, END = np.uint64(0x8D5E9A3C17F4B260), np.uint64(0x3F0C6E81D2A975B4)
#: Tokens a task counts before it sends the counts on; one row in so many shows which contexts are frequent.
FLUSH, HOT_SAMPLE = 2_000_000, 64
_PACKED = "target int, context binary, runs binary, word binary, n binary, info string"
_FIELDS = ["target", "context", "runs", "word", "n", "info"]
_KINDS = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.string()]


def sequence(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context and word of every token, row by row with its end token, and n + 1 row offsets."""
    h, o = word_hashes(buf, offsets)
    n = len(o) - 1
    at = o + np.arange(n + 1)
    word = np.full(len(h) + n, END, np.uint64)
    inner = np.ones(len(word), bool)
    inner[at[1:] - 1] = False
    word[inner] = h
    context = np.empty_like(word)
    context[1:] = word[:-1]
    context[at[:-1]] = BEGIN
    return context, word, at


def pair_key(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix64(context * np.uint64(0x9E3779B97F4A7C15) + word)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def owner(context: np.ndarray, key: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    return bucket_of(np.where(np.isin(context, hot), key, context), buckets)


def added(keys: np.ndarray, n: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys, their sums of n, and the first of each further array."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    total = np.add.reduceat(n[order], first, dtype=np.uint64) if len(keys) else np.zeros(0, np.uint64)
    return keys[first], total, *(m[order[first]] for m in more)


def _row(target: int, info: str | None = None, **arrays: np.ndarray) -> tuple:
    return (target, *(arrays[f].tobytes() if f in arrays else None for f in _FIELDS[1:5]), info)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_FIELDS)


def _array(column: pa.Array, i: int, kind: type) -> np.ndarray:
    return np.frombuffer(column[i].as_py(), kind)


def _count(hot: np.ndarray, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            context, word = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            key, n, context, word = added(pair_key(context, word), np.ones(len(word), np.uint32), context, word)
            to = owner(context, key, hot, buckets)
            order = np.lexsort((context, to))
            to, context, word, n = to[order], context[order], word[order], n[order].astype(np.uint32)
            rows, cuts = [], np.searchsorted(to, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                c, w, m = (x[cuts[b] : cuts[b + 1]] for x in (context, word, n))
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
                runs = np.diff(np.append(first, len(c))).astype(np.uint32)
                rows.append(_row(b, context=c[first], runs=runs, word=w, n=m))
            return _batch(rows)

        for batch in batches:
            buf, offsets = column_bytes(batch.column(0))
            for a, b in slices(offsets):
                context, word, _ = sequence(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                held.append((context, word))
                size += len(word)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return work


def _tally(n: np.ndarray) -> list[int]:
    """How many counts are 1, 2, 3 and 4."""
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """Rows of one target at a time; rows come sorted by target."""
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


def _pairs(folder: str, hot: np.ndarray, buckets: int):
    """Adds up a bucket's pairs, writes its arrays and sends on the continuation counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            context = np.concatenate([np.repeat(np.frombuffer(r[1], np.uint64), np.frombuffer(r[2], np.uint32)) for r in rows])
            word = np.concatenate([np.frombuffer(r[3], np.uint64) for r in rows])
            n = np.concatenate([np.frombuffer(r[4], np.uint32) for r in rows])
            rows.clear()
            key, n, context, word = added(pair_key(context, word), n, context, word)
            put(folder, f"pair-{bucket:05d}-key", key)
            put(folder, f"pair-{bucket:05d}-n", n.astype(np.uint32))
            names, totals = added(context, n)[:2]
            kinds = [added(context, ((n == k) if k < 3 else (n >= 3)).astype(np.uint32))[1] for k in (1, 2, 3)]
            often = np.isin(names, hot)
            put(folder, f"context-{bucket:05d}-key", names[~often])
            put(folder, f"context-{bucket:05d}-n", np.stack([totals, *kinds], axis=1)[~often])
            info = {"pairs": len(key), "tally": _tally(n), "hot": {str(c): [int(t), *(int(k[i]) for k in kinds)] for i, c, t in zip(np.flatnonzero(often), names[often], totals[often], strict=True)}}
            plain = names[~often] != BEGIN
            info |= {"contexts": int(plain.sum()), "tokens": int(totals[~often][plain].sum())}
            words, k = added(word, np.ones(len(word), np.uint32))[:2]
            cuts = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
            out = [_row(b, word=words[cuts[b] : cuts[b + 1]], n=k[cuts[b] : cuts[b + 1]].astype(np.uint32)) for b in np.flatnonzero(np.diff(cuts)).tolist()]
            yield _batch([*out, _row(bucket, info=json.dumps(info))])

    return work


def _continuations(folder: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _grouped(batches):
            out = [pa.array([r[5] for r in rows if r[5]], pa.string())]
            if parts := [r for r in rows if r[3]]:
                word, k = (np.concatenate([np.frombuffer(r[i], t) for r in parts]) for i, t in ((3, np.uint64), (4, np.uint32)))
                word, k = added(word, k)
                put(folder, f"word-{bucket:05d}-key", word)
                put(folder, f"word-{bucket:05d}-n", k.astype(np.uint32))
                out.append(pa.array([json.dumps({"k_tally": [*_tally(k), int((k >= 3).sum())], "k_total": int(k.sum())})], pa.string()))
            for column in out:
                yield pa.RecordBatch.from_arrays([column], names=["info"])

    return work


def discounts(tally: list[int]) -> np.ndarray:
    """D for counts 0, 1, 2 and 3 or more, from how many counts are 1, 2, 3 and 4."""
    n = [float(x) for x in tally]
    if not n[0] or not n[1]:
        return np.array([0.0, 0.5, 0.75, 1.0])
    y = n[0] / (n[0] + 2 * n[1])
    found = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else float(k) for k in (1, 2, 3)]
    return np.array([0.0, *np.clip(found, 0.05, [0.95, 1.95, 2.95])])


@dataclass
class Model:
    folder: str
    buckets: int
    hot: dict[int, list[int]]
    tokens: int
    vocabulary: int
    pair_discount: np.ndarray
    word_discount: np.ndarray
    k_total: int
    k_kinds: list[int]  # words with continuation count 1, 2, 3 or more
    ends: int
    present: set[str]

    def _look(self, kind: str, keys: np.ndarray, to: np.ndarray, width: int = 1) -> np.ndarray:
        """Stored numbers of keys, zeros where there are none; to: buckets."""
        out = np.zeros((len(keys), width), np.int64)
        order = np.lexsort((keys, to))
        cuts = np.searchsorted(to[order], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            name = f"{kind}-{b:05d}"
            if name not in self.present:
                continue
            some = order[cuts[b] : cuts[b + 1]]
            stored = mapped(self.folder, f"{name}-key")
            if not len(stored):
                continue
            at = np.minimum(np.searchsorted(stored, keys[some]), len(stored) - 1)
            hit = stored[at] == keys[some]
            out[some[hit]] = mapped(self.folder, f"{name}-n")[at[hit]].reshape(-1, width)
        return out

    def contexts(self, context: np.ndarray) -> np.ndarray:
        """Total count and numbers of words seen once, twice and more often, for each context."""
        out = self._look("context", context, bucket_of(context, self.buckets), 4)
        for c, numbers in self.hot.items():
            out[context == np.uint64(c)] = numbers
        return out

    def score(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n_tokens, n_known, base score and model score (log10) of each row."""
        context, word, at = sequence(buf, offsets)
        tokens, which = np.unique(word, return_inverse=True)
        own = self.contexts(tokens)
        count = np.where(tokens == END, self.ends, own[:, 0])
        base = np.log10((count + 0.1) / (self.tokens + 0.1 * (self.vocabulary + 1)))
        k = self._look("word", tokens, bucket_of(tokens, self.buckets))[:, 0]
        spare = float(self.word_discount[1:] @ np.array(self.k_kinds)) / self.k_total if self.k_total else 1.0
        p_word = np.maximum(k - self.word_discount[np.minimum(k, 3)], 0) / max(self.k_total, 1) + spare / (self.vocabulary + 1)
        key, first, pair = np.unique(pair_key(context, word), return_index=True, return_inverse=True)
        before = context[first]
        place = np.minimum(np.searchsorted(tokens, before), len(tokens) - 1)
        known = tokens[place] == before  # all but the beginning of a text
        stats = own[place] * known[:, None] + self.contexts(np.array([BEGIN])) * ~known[:, None]
        n = self._look("pair", key, owner(before, key, np.array(list(self.hot), np.uint64), self.buckets))[:, 0]
        total = np.maximum(stats[:, 0], 1)
        back = np.where(stats[:, 0] > 0, stats[:, 1:] @ self.pair_discount[1:] / total, 1.0)
        p = np.maximum(n - self.pair_discount[np.minimum(n, 3)], 0) / total + back * p_word[which[first]]
        sums = lambda x: np.add.reduceat(x, at[:-1])  # noqa: E731  each row has one token at least
        return np.diff(at), sums((count > 0)[which].astype(np.int64)), sums(base[which]), sums(np.log10(p)[pair])


def learn(texts: DataFrame, folder: str | None = None, buckets: int | None = None) -> Model:
    """Count the whole column text of all rows; the arrays go to folder, in the shared directory by default."""
    spark = texts.sparkSession
    folder, buckets = folder or scratch(spark, "ngram"), buckets or shuffle_partitions(spark)
    rows = texts.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = column_bytes(batch.column(0))
            for a, b in slices(offsets):
                context, _, _ = sequence(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                names, n = np.unique(context, return_counts=True)
                use = n * 8 * buckets > len(context)
                yield pa.RecordBatch.from_arrays([pa.array(names[use].view(np.int64)), pa.array(n[use], pa.int64())], names=["context", "n"])

    sampled = rows.where(F.pmod(F.xxhash64("text"), F.lit(HOT_SAMPLE)) == 0)
    seen = sampled.transform(arrow(frequent, "context long, n long")).groupBy("context").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "context").limit(4 * buckets).collect()
    limit = sum(r["n"] for r in seen) / (4 * buckets)
    hot = np.array([r["context"] & (1 << 64) - 1 for r in seen if r["n"] >= limit], np.uint64)

    counted = rows.transform(arrow(_count(hot, buckets), _PACKED)).repartitionById(buckets, "target").sortWithinPartitions("target")
    sent = counted.transform(arrow(_pairs(folder, hot, buckets), _PACKED)).repartitionById(buckets, "target").sortWithinPartitions("target")
    infos = [json.loads(r["info"]) for r in sent.transform(arrow(_continuations(folder), "info string")).collect()]
    pairs, words = [i for i in infos if "pairs" in i], [i for i in infos if "k_total" in i]
    together = {int(c): [0] * 4 for c in hot.tolist()}
    for info in pairs:
        for c, numbers in info["hot"].items():
            together[int(c)] = [a + b for a, b in zip(together[int(c)], numbers, strict=True)]
    together = {c: x for c, x in together.items()}
    plain = [x for c, x in together.items() if c != int(BEGIN) and x[0]]
    ends = rows.count()
    columns = lambda name, n: [sum(i[name][k] for i in (pairs if name == "tally" else words)) for k in range(n)]
    tally, k_tally = columns("tally", 4), columns("k_tally", 5)
    return Model(
        folder=folder,
        buckets=buckets,
        hot=together,
        tokens=sum(i["tokens"] for i in pairs) + sum(x[0] for x in plain) + ends,
        vocabulary=sum(i["contexts"] for i in pairs) + len(plain) + (ends > 0),
        pair_discount=discounts(tally),
        word_discount=discounts(k_tally[:4]),
        k_total=sum(i["k_total"] for i in words),
        k_kinds=[k_tally[0], k_tally[1], k_tally[4]],
        ends=ends,
        present=listed(folder),
    )


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """Log10 probabilities of every whole text under the model and under smoothed word frequencies."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets):
                found = m.score(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                n_tokens, n_known, base, own = (pa.array(x) for x in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), n_tokens.cast(pa.int64()), n_known, pa.array([m.tokens] * (b - a), pa.int64()), base, own],
                    names=[f.split()[0] for f in SCORED.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.transform(arrow(work, SCORED))
