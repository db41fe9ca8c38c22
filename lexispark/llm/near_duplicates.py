"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join and exact confirmation.

A text's set holds the hashes of its distinct k-word shingles. Its signature has five b-bit values (the low bits of
five minima) in each of m chunks. By the pigeonhole principle two signatures that differ in fewer than 2 m values
differ in at most one value of some chunk; so every chunk is indexed under all choices of one value left out, and
every pair within that signature distance meets under a key. m follows from the similarity asked for: a pair at
exactly that similarity meets under no key with a probability below MISSED.

Texts with equal sets are one class, whose smallest doc_id stands for it. Classes that meet under a key are joined to
candidate families through the smallest class of each key, so the links sent grow with the keys, not with pairs.
Inside a family all classes are compared on their full sets, in tiles of TILE x TILE classes that different tasks
take: pairs whose signatures agree in fewer values than a pair at the threshold has (but for a probability of 1e-9) are
passed over, the others are confirmed on their full sets. A tile sends on only links that join what it has not yet
joined. No candidate is dropped.

Defined results: null, empty and wordless texts have empty sets and are linked with nothing; a text with fewer than k
words has its whole word sequence as its one shingle. Rows that share a doc_id count as one document. A null doc_id is
linked with nothing, has a null component and is kept. Every input row gives one row; an empty table gives none.
Columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle, shuffle_partitions
from .components import components
from .textops import arrow, column_bytes, mix64, slices, word_hashes

ROWS, MISSED, TILE = 5, 1e-7, 512
#: Families up to this number of classes are sent to all workers instead of shuffling the texts.
BROADCAST_ROWS = 250_000
_SIGNED = "doc_id long, n long, h1 long, h2 long, signature binary"


def chunks_for(similarity: float, missed: float = MISSED) -> int:
    """Chunks at which a pair of the given similarity meets under no key with a probability below missed."""
    alone = similarity**ROWS + ROWS * (1 - similarity) * similarity ** (ROWS - 1)
    return math.ceil(math.log(missed) / math.log(1 - alone)) if alone < 1 else 1


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each row the sorted hashes of its distinct shingles."""
    buf, offsets = column_bytes(column)
    for a, b in slices(offsets):
        h, o = word_hashes(buf[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        chain = mix64(h)
        for i in range(1, k):
            chain = mix64(chain[: max(0, len(h) - i)] + h[i:])
        for i in range(b - a):
            lo, hi = int(o[i]), int(o[i + 1])
            if hi - lo >= k:
                yield np.unique(chain[lo : hi - k + 1])
            elif hi > lo:
                whole = np.array([hi - lo], np.uint64)
                for i in range(lo, hi):
                    whole = mix64(whole + h[i : i + 1])
                yield whole
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """16 bits of the minimum of each hash function over a set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[None, at : at + 4096] * factors[:, None]).min(axis=1), out=least)
    return (least >> np.uint64(16)).astype(np.uint16)


def _factors(n: int) -> np.ndarray:
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def signatures(docs: DataFrame, k: int, chunks: int) -> DataFrame:
    """doc_id, set size n, a 128-bit digest of the set and its signature, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(chunks * ROWS)
        for batch in batches:
            n, digest, signed = [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                digest.append((np.add.reduce(mix64(s)), np.add.reduce(mix64(s ^ np.uint64(0xA5A5A5A55A5A5A5A)))))
                signed.append(signature(s, factors).tobytes() if len(s) else None)
            h = np.array(digest, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.ascontiguousarray(h[:, 0])), pa.array(np.ascontiguousarray(h[:, 1])), pa.array(signed, pa.binary())], names=[f.split()[0] for f in _SIGNED.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.transform(arrow(work, _SIGNED))


def _keys(signed: list[bytes], chunks: int) -> np.ndarray:
    """All index keys of each signature, signatures x keys: chunk by chunk, each value left out in turn."""
    values = np.frombuffer(b"".join(signed), np.uint16).astype(np.uint64).reshape(-1, chunks, ROWS)
    found = np.empty((len(values), chunks * ROWS), np.uint64)
    for chunk in range(chunks):
        for left_out in range(ROWS):
            key = np.zeros(len(values), np.uint64)
            for j in range(ROWS):
                if j != left_out:
                    key = key << np.uint64(16) | values[:, chunk, j]
            number = chunk * ROWS + left_out
            found[:, number] = mix64(key + mix64(np.array([number + 1], np.uint64)))
    return found


def meetings(classes: DataFrame, chunks: int) -> DataFrame:
    """rep and hub: each class with the smallest class it shares a key with, for every key.

    Tasks send (key, class) pairs packed into one binary row for each bucket of keys; a bucket is sorted in numpy.
    """
    buckets = shuffle_partitions(classes.sparkSession)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                found = _keys(part.column("signature").to_pylist(), chunks)
                rep = np.repeat(part.column("rep").to_numpy(), found.shape[1])
                found = found.ravel()
                to = ((found >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                to, found, rep = to[order], found[order], rep[order]
                cuts = np.searchsorted(to, np.arange(buckets + 1))
                own = np.flatnonzero(np.diff(cuts)).tolist()
                rows = [(b, found[cuts[b] : cuts[b + 1]].tobytes(), rep[cuts[b] : cuts[b + 1]].tobytes()) for b in own]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["target", "keys", "reps"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, reps = [], []
        for batch in batches:
            keys += [np.frombuffer(x, np.uint64) for x in batch.column("keys").to_pylist()]
            reps += [np.frombuffer(x, np.int64) for x in batch.column("reps").to_pylist()]
        if keys:
            key, rep = np.concatenate(keys), np.concatenate(reps)
            order = np.lexsort((rep, key))
            key, rep = key[order], rep[order]
            first = np.maximum.accumulate(np.where(np.concatenate([[True], key[1:] != key[:-1]]), np.arange(len(key)), 0))
            pairs = np.stack([rep, rep[first]], axis=1)
            pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, i])) for i in (0, 1)], names=["rep", "hub"])

    sent = classes.select("rep", "signature").transform(arrow(send, "target int, keys binary, reps binary"))
    return sent.repartitionById(buckets, "target").transform(arrow(meet, "rep long, hub long"))


class _Forest:
    def __init__(self, n: int):
        self.up, self.trees = list(range(n)), n

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[i] = j
            self.trees -= 1
        return i != j


def least_equal(values: int, similarity: float, missed: float = 1e-9) -> int:
    """Equal values that the signatures of a pair of the given similarity have at least, but for a probability below missed."""
    below, equal = 0.0, 0
    while equal < values:
        below += math.comb(values, equal) * similarity**equal * (1 - similarity) ** (values - equal)
        if below >= missed:
            break
        equal += 1
    return equal


def tile_links(reps: list[int], sides: list[int], sets: list[np.ndarray], signed: np.ndarray, percent: int, least: int) -> list[tuple[int, int]]:
    """Links that join the classes of a tile whose sets are alike by percent; sides: 0 and 1, or all 0 for one block.

    Only pairs whose signatures agree in `least` values are compared on their sets, and none that is joined already.
    """
    forest, links = _Forest(len(reps)), []
    sizes = np.array([len(s) for s in sets])
    cuts = np.concatenate([[0], np.cumsum(sizes)]).tolist()
    names, which = np.unique(np.concatenate(sets), return_inverse=True)
    side, flag = np.array(sides), np.zeros(len(names), bool)
    across = bool(side.any())
    for x in np.flatnonzero(side == 0).tolist():
        if forest.trees == 1:
            break
        near = np.count_nonzero(signed == signed[x], axis=1) >= least
        if across:
            near &= side == 1
        else:
            near[: x + 1] = False
        some = [y for y in np.flatnonzero(near).tolist() if forest.find(y) != forest.find(x)]
        if not some:
            continue
        own = which[cuts[x] : cuts[x + 1]]
        flag[own] = True
        for y in some:
            shared = int(np.count_nonzero(flag[which[cuts[y] : cuts[y + 1]]]))
            if 100 * shared >= percent * (int(sizes[x]) + int(sizes[y]) - shared) and forest.join(x, y):
                links.append((reps[x], reps[y]))
        flag[own] = False
    return links


def verified_links(families: DataFrame, docs: DataFrame, k: int, percent: int, chunks: int, tile: int = TILE) -> DataFrame:
    """Links between classes of the same family, confirmed on full sets; families: rep, family, size, signature."""
    least = least_equal(chunks * ROWS, percent / 100)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([s.tobytes() for s in shingle_sets(batch.column("text"), k)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("family"), batch.column("size"), batch.column("doc_id"), batch.column("signature"), found], names=["family", "size", "rep", "signature", "shingles"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, links = None, []

        def closed() -> list[tuple[int, int]]:
            reps, sides, sets, signed = zip(*held[1], strict=True)
            return tile_links(reps, sides, sets, np.stack(signed), percent, least) if len(reps) > 1 else []

        for batch in batches:
            for family, low, high, side, rep, signed, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held is None or held[0] != (family, low, high):
                    if held:
                        links += closed()
                    held = (family, low, high), []
                held[1].append((rep, side, np.frombuffer(raw, np.uint64), np.frombuffer(signed, np.uint16)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])
                links = []
        if held and (links := closed()):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=["a", "b"])

    few = families.count() <= BROADCAST_ROWS
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = rows.join(F.broadcast(families) if few else families, F.col("doc_id") == F.col("rep")).select("family", "size", "doc_id", "signature", "text")
    full = held.transform(arrow(sets, "family long, size long, rep long, signature binary, shingles binary")).where(F.length("shingles") > 0)
    blocks = full.withColumn("blocks", F.ceil(F.col("size") / tile)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = blocks.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    tiles = dealt.select("family", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "rep", "signature", "shingles")
    return tiles.repartition(shuffle_partitions(docs.sparkSession), "family", "low", "high").sortWithinPartitions("family", "low", "high", "rep").transform(arrow(compare, "a long, b long"))


def _with_rep(signed: DataFrame, reps: DataFrame) -> DataFrame:
    """signed with the rep of its class, null without a class.

    Classes of more than 1 / (4 x partitions) of all rows are fewer than that, so they are sent to all tasks; the rows
    of the others are exchanged.
    """
    limit = max(1, signed.count() // (4 * shuffle_partitions(signed.sparkSession)))
    hot = reps.where(F.col("members") > limit).select("h1", "h2", "n", F.col("rep").alias("_hot"))
    spread = signed.join(F.broadcast(hot), ["h1", "h2", "n"], "left").withColumn("_k", F.when(F.col("_hot").isNull(), F.col("h1")).otherwise(F.xxhash64("doc_id")))
    cold = reps.where(F.col("members") <= limit).select(F.col("h1").alias("_k"), "h2", "n", "rep")
    found = spread.join(cold, ["_k", "h2", "n"], "left").withColumn("rep", F.coalesce("_hot", "rep"))
    return found.select("doc_id", "n", "h1", "h2", "signature", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("rep")).alias("rep"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, chunks: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the smallest doc_id of its component) of every row.

    Documents are linked where 100 * intersection >= percent * union of their sets of k-word shingles.
    """
    chunks = chunks or chunks_for(percent / 100)
    signed = settle(signatures(docs, k, chunks), "signatures")
    usable = signed.where("n > 0 AND doc_id IS NOT NULL")
    reps = settle(usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("members")), "classes")
    keyed = _with_rep(signed, reps)
    members = keyed.where("rep IS NOT NULL AND doc_id IS NOT NULL")
    classes = settle(members.where("doc_id = rep").select("rep", "signature").dropDuplicates(["rep", "signature"]), "classes")
    met = meetings(classes, chunks)
    family = components(met).select(F.col("node").alias("rep"), F.col("component").alias("family"))
    sizes = family.groupBy("family").agg(F.count("*").alias("size"))
    families = settle(family.join(sizes, "family").join(classes, "rep").select("rep", "family", "size", "signature"), "families")
    links = verified_links(families, docs, k, percent, chunks)
    found = components(links).select(F.col("node").alias("rep"), "component")
    # a document whose rows have different sets belongs to all their classes
    own = members.select("doc_id", "rep").where("doc_id != rep").distinct()
    repeated = signed.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("h1", "h2", "n").alias("sets")).where("sets > 1")
    if repeated.limit(1).count():
        extra = own.join(repeated, "doc_id").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(found.select(F.col("rep").alias("a"), F.col("component").alias("b")).unionByName(extra)).select(F.col("node").alias("rep"), "component")
        keyed = signed.join(own.join(repeated, "doc_id", "left_anti"), "doc_id", "left")
    placed = keyed.withColumn("rep", F.coalesce("rep", "doc_id")).join(found, "rep", "left")
    component = F.coalesce("component", "rep")
    return placed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
