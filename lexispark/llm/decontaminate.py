"""Benchmark decontamination: a BM25 index of test items, queried by every passage of every document.

The index holds the items' words with BM25 impacts, divided by the item's score for itself, so that 1 means "all
words of the item, as often". Passages are windows of twice the longest item's words at steps of its length: any
contiguous copy of an item lies inside one. Passages are evaluated in batches by block-max WAND: the sum of a
passage's list maxima must reach the threshold, then, for each block of items, the sum of its block maxima; only items
of blocks that pass are scored. All items above the threshold are retrieved, none is cut off. A retrieved pair is
verified on the words themselves: of the three-word sequences of the whole item the share WHOLE must occur in the
passage, whichever they are, so that truncated and edited copies count; or, above THRESHOLD, the given shares of those
of the item's question and of its answer (its last quarter of words, as the benchmark has one text column). Each item's
threshold is lowered to a score that no passage with the share WHOLE of its sequences falls short of.

Postings lists hold the items of a word with their impacts; a second list holds the largest impact of each block of items.
Indexes are built for SHARD items at a time and sent to the workers in rounds of about ROUND items and ROUND_WORDS words,
so that what is broadcast has a fixed bound; a larger benchmark takes more rounds over the documents. Document frequencies are counted
over all items.

Defined results: words are lower-cased runs of bytes other than ASCII white space and punctuation; null or wordless
texts and items match nothing; copies of an item match alike; every input row is judged, repeated ones too. Empty
tables give empty results. Columns beside doc_id and text (item_id and text) are ignored, but for clean, which returns
those of its input, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import arrow, column_bytes, mix64, slices, word_hashes

K1, B = 1.2, 0.75
THRESHOLD, QUESTION, ANSWER, WHOLE = 0.6, 0.6, 0.6, 0.6
BLOCK, SHARD, ROUND = 8, 512, 8192
#: Words of a round's items; passages, and block maxima of passages, looked at together.
ROUND_WORDS, WINDOWS, GATHERED = 1 << 22, 4096, 1 << 21
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[[i for i in range(33, 128) if not chr(i).isalnum()]] = 32


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    buf, offsets = column_bytes(column)
    return word_hashes(_PLAIN[buf], offsets)


def sequences(h: np.ndarray) -> np.ndarray:
    """Hashes of the three-word sequences; of all words where there are fewer."""
    n = min(3, len(h))
    out = np.zeros(len(h) - n + 1 if n else 0, np.uint64)
    for i in range(n):
        out = mix64(out + h[i : len(h) - n + 1 + i])
    return out


@dataclass
class Index:
    items: np.ndarray  # item_id
    terms: np.ndarray  # sorted word hashes
    first: np.ndarray  # of each term its first posting, and their number
    item: np.ndarray  # postings by term: items, rising, and their impacts
    impact: np.ndarray
    first_block: np.ndarray  # the same of the blocks that its postings lie in, with the largest impact in each
    block: np.ndarray
    block_most: np.ndarray
    most: np.ndarray  # terms, maxima
    longest: int
    question: list[np.ndarray]
    answer: list[np.ndarray]
    whole: list[np.ndarray]
    least: np.ndarray  # score that a passage to be verified has at least, for each item


def least_score(h: np.ndarray, at: np.ndarray, weight: np.ndarray) -> float:
    """At most THRESHOLD, and at most the score of any passage with the share WHOLE of an item's sequences.

    at: place of each word's impact in weight. A word that a passage lacks takes all its sequences with it, so its
    impact, spread over them, is within the sum of the missing sequences' shares.
    """
    n = min(3, len(h))
    names, sequence = np.unique(sequences(h), return_inverse=True)
    pairs = np.unique(np.concatenate([sequence * len(weight) + at[i : len(h) - n + 1 + i] for i in range(n)]))
    sequence, term = pairs // len(weight), pairs % len(weight)
    share = np.sort(np.bincount(sequence, (weight / np.bincount(term, minlength=len(weight)))[term]))
    return min(THRESHOLD, 1 - float(share[int(np.ceil(WHOLE * len(names) - 1e-9)) :].sum()))


def build(items: list[tuple[int, np.ndarray]], frequency: dict[int, int], n_items: int, mean: float) -> Index | None:
    """Index of (item_id, word hashes); frequency: items with a word, of all n_items."""
    items = [(i, h) for i, h in items if len(h)]
    if not items:
        return None
    terms = np.unique(np.concatenate([h for _, h in items]))
    df = np.array([frequency[t] for t in terms.tolist()], float)
    idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
    least, postings = np.zeros(len(items)), []
    for j, (_, h) in enumerate(items):
        at, place, tf = np.unique(np.searchsorted(terms, h), return_inverse=True, return_counts=True)
        weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(h) / mean))
        postings.append((at, np.full(len(at), j), weight / weight.sum()))
        least[j] = least_score(h, place, weight / weight.sum())
    term, item, impact = (np.concatenate(x) for x in zip(*postings, strict=True))
    order = np.lexsort((item, term))
    term, item, impact = term[order], item[order], impact[order]
    heads = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)]))
    first, block_most = np.searchsorted(term, np.arange(len(terms) + 1)), np.maximum.reduceat(impact, heads)
    cut = [max(1, len(h) - max(3, len(h) // 4)) if len(h) > 3 else len(h) for _, h in items]
    question = [np.unique(sequences(h[:c])) for (_, h), c in zip(items, cut, strict=True)]
    answer = [np.unique(sequences(h[c:] if c < len(h) else h)) for (_, h), c in zip(items, cut, strict=True)]
    whole = [np.unique(sequences(h)) for _, h in items]
    lists = (first, item, impact, np.searchsorted(term[heads], np.arange(len(terms) + 1)), item[heads] // BLOCK, block_most, np.maximum.reduceat(impact, first[:-1]))
    return Index(np.array([i for i, _ in items]), terms, *lists, max(len(h) for _, h in items), question, answer, whole, least)


def search(index: Index, h: np.ndarray, offsets: np.ndarray, least: np.ndarray | None = None) -> list[tuple[int, int, int, int, float]]:
    """(row, first word, words, item, score) of all pairs of a passage and an item above least, by default THRESHOLD."""
    least = (np.full(len(index.items), THRESHOLD) if least is None else least) - 1e-5
    least_of_block = np.minimum.reduceat(least, np.arange(0, len(least), BLOCK))
    at = np.minimum(np.searchsorted(index.terms, h), len(index.terms) - 1)
    hit = np.flatnonzero(index.terms[at] == h)
    if not len(hit):
        return []
    step, n = index.longest, np.diff(offsets)
    per_row = np.maximum(1, -(-n // step))  # windows of a row
    base = np.concatenate([[0], np.cumsum(per_row)])
    row = np.searchsorted(offsets, hit, side="right") - 1
    step_no = (hit - offsets[row]) // step
    first = base[row] + step_no
    windows = np.concatenate([first, first[step_no > 0] - 1])  # the window that begins here, and the one before
    terms = np.concatenate([at[hit], at[hit][step_no > 0]])
    entry = np.unique(windows * len(index.terms) + terms)
    windows, terms = entry // len(index.terms), entry % len(index.terms)
    live = np.bincount(windows, index.most[terms], minlength=base[-1]) >= least.min()
    keep = live[windows]
    windows, terms = windows[keep], terms[keep]
    if not len(windows):
        return []
    found, blocks = [], -(-len(index.items) // BLOCK)
    starts = np.flatnonzero(np.concatenate([[True], windows[1:] != windows[:-1]]))
    cuts = np.append(starts, len(windows))
    gathered = np.concatenate([[0], np.cumsum(np.diff(index.first_block)[terms])])[cuts]
    lo = 0
    while lo < len(starts):  # bounds the gathered block maxima
        hi = min(lo + WINDOWS, max(lo + 1, int(np.searchsorted(gathered, gathered[lo] + GATHERED, side="right")) - 1))
        own = slice(cuts[lo], cuts[hi])
        place = np.repeat(np.arange(hi - lo), np.diff(cuts[lo : hi + 1]))
        entry, at = _expanded(index.first_block, terms[own])
        bound = np.bincount(place[entry] * blocks + index.block[at], index.block_most[at], (hi - lo) * blocks).reshape(-1, blocks)
        passed = bound >= least_of_block
        some = passed.any(axis=1)
        if some.any():
            use = some[place]
            number = np.cumsum(some) - 1
            entry, at = _expanded(index.first, terms[own][use])
            window, item = place[use][entry], index.item[at]
            keep = passed[window, item // BLOCK]
            score = np.bincount(number[window[keep]] * len(least) + item[keep], index.impact[at[keep]], int(some.sum()) * len(least)).reshape(-1, len(least))
            for w, j in zip(*np.nonzero(score >= least), strict=True):
                window = windows[starts[lo + np.flatnonzero(some)[w]]]
                r = int(np.searchsorted(base, window, side="right") - 1)
                start = int(window - base[r]) * step
                found.append((r, start, min(2 * step, int(n[r]) - start), int(j), float(score[w, j])))
        lo = hi
    return found


def _expanded(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of all postings of the terms, one list after the other: index of the term, and place of the posting."""
    size = first[terms + 1] - first[terms]
    entry = np.repeat(np.arange(len(terms)), size)
    return entry, np.arange(len(entry)) + np.repeat(first[terms] - (np.cumsum(size) - size), size)


def matches(index: Index, h: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(row, item_id, score, question overlap, answer overlap): the best verified passage of each row and item."""
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    for row, start, count, item, score in search(index, h, offsets, index.least):
        own = sequences_of_window(h[offsets[row] + start : offsets[row] + start + count])
        q, a, w = (float(np.isin(part, own).mean()) for part in (index.question[item], index.answer[item], index.whole[item]))
        if w >= WHOLE or score >= THRESHOLD - 1e-5 and q >= QUESTION and a >= ANSWER:
            key = row, int(index.items[item])
            best[key] = max(best.get(key, (0.0, 0.0, 0.0)), (score, q, a))
    return [(*k, *v) for k, v in sorted(best.items())]


def sequences_of_window(h: np.ndarray) -> np.ndarray:
    """Hashes of all sequences of one, two and three words of a passage."""
    out, parts = np.zeros(len(h), np.uint64), []
    for i in range(min(3, len(h))):
        out = mix64(out[: len(h) - i] + h[i:])
        parts.append(out)
    return np.concatenate(parts) if parts else out


def indexes(benchmark: DataFrame) -> Iterator[list[Index]]:
    """Rounds of indexes over all items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL AND item_id IS NOT NULL").dropDuplicates(["item_id", "text"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, offsets = words(batch.column("text"))
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                term, tf = np.unique(h[offsets[i] : offsets[i + 1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(term), pa.int64()), pa.array(term.view(np.int64)), pa.array(tf, pa.int64())], names=["item_id", "term", "tf"])

    postings = items.transform(arrow(counted, "item_id long, term long, tf long"))
    total = postings.groupBy().agg(F.sum("tf").alias("words"), F.countDistinct("item_id").alias("items")).first()
    n_items, rounds = total["items"], max(-(-total["items"] // ROUND), -(-(total["words"] or 0) // ROUND_WORDS))
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    for r in range(rounds):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r)
        used = part.transform(arrow(counted, "item_id long, term long, tf long")).select("term").distinct()
        df = {x["term"] & (1 << 64) - 1: x["df"] for x in used.join(frequency, "term").collect()}
        table = part.orderBy("item_id", "text").toArrow()
        h, offsets = words(table.column("text"))
        own = [(i, h[offsets[k] : offsets[k + 1]]) for k, i in enumerate(table.column("item_id").to_pylist())]
        own.sort(key=lambda x: len(x[1]))  # items of like length share windows
        built = (build(own[k : k + SHARD], df, n_items, total["words"] / n_items) for k in range(0, len(own), SHARD))
        yield [b for b in built if b]


HITS = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"


def _judge(found: list[Index], texts: pa.Array) -> Iterator[tuple[int, int, float, float, float]]:
    at = column_bytes(texts)[1]
    for lo, hi in slices(at):
        h, offsets = words(texts.slice(lo, hi - lo))
        for index in found:
            for row, *rest in matches(index, h, offsets):
                yield lo + row, *rest


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item that it holds: doc_id, item_id, score, question and answer overlap."""
    spark, results = docs.sparkSession, []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for found in indexes(benchmark):
        shared = spark.sparkContext.broadcast(found)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                if out := [(ids[row], *rest) for row, *rest in _judge(shared.value, batch.column("text"))]:
                    kinds = [pa.int64()] * 2 + [pa.float64()] * 3
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in HITS.split(", ")])

        results.append(rows.transform(arrow(work, HITS)))
    if not results:
        return spark.createDataFrame([], HITS)
    union = results[0]
    for more in results[1:]:
        union = union.unionByName(more)
    return union


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold an item; no shuffle."""
    at = next(i for i, c in enumerate(docs.columns) if c.lower() == "text")
    for found in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(found)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bad = {row for row, *_ in _judge(shared.value, batch.column(at))}
                yield batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

        docs = docs.transform(arrow(work, T.StructType(docs.schema.fields)))
    return docs
