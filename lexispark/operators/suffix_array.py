"""Suffix arrays of one text, of integer sequences and of string sets, by prefix doubling over blocks.

Suffixes never run into the next string: a missing symbol is smaller than all others. Equal suffixes of different
strings stay equal; the final order breaks such ties by place in the concatenation. Positions count code points.

A position's bucket is the number of suffixes that are smaller by their first h symbols. In a round, blocks ask the
blocks h, 2 h, ... places on for the buckets of their open positions only; the answers make keys (bucket, bucket ahead,
...). Keys get their ranks without moving positions: a block sends its different keys with their numbers, so that however
often a key occurs, it is one entry of each block; the keys are dealt by sampled borders, so that a bucket however large is
spread by what lies ahead; and running sums continue over the borders. Only changed positions are written. A position is
done once its bucket holds no other, or once its suffix ends within the symbols compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop, exchanged, scratch, settle, shuffle_partitions
from . import blocks as B
from .blocks import distinct, meet, packed, unpacked
from .common_prefix import common_prefixes
from .ranking import ranked

#: Sampled keys for each part of the key space.
SAMPLE = 32
#: Positions for each part of the key space.
PART = 1 << 18
#: How many times longer keys get in a round at most.
MOST_TIMES = 16
SINGLE, OPEN, TIED = 0, 1, 2
#: Flags of a key: no other suffix has it; its rank is above its bucket, by smaller keys in it.
ALONE, MOVED = 1, 2
_STATE = "block long, round int, places binary, ranks binary, kinds binary, starts binary, ends binary, ids binary, open long, split long"
_KEYS = "block long, places binary, inverse binary, counts binary, done binary, columns int, width int, keys binary, starts binary, ends binary, ids binary"
_REPLY = "block long, part int, lead int, ranks binary, flags binary, info binary"
_WORDS = {4: np.uint32, 8: np.uint64}
_FINAL = "block long, ranks binary, starts binary, ends binary, ids binary"


@dataclass
class SuffixArray:
    """sa: rank, str_id, pos, gidx. text: the blocks; ranks: rows _FINAL, the final rank of every position."""

    sa: DataFrame
    text: B.Text
    ranks: B.Table
    rounds: int = 0


def _key_row(block: int, places: np.ndarray | None, columns: list[np.ndarray], done, row: dict) -> list[tuple]:
    """One row of _KEYS; done gives, for different keys, whether their suffixes end within them."""
    keys, counts, inverse = distinct(columns)
    if not len(counts):
        return []
    return [(block, places, inverse.astype(np.int32), counts.astype(np.int32), done(keys), len(keys), keys[0].itemsize, np.concatenate(keys), row["starts"], row["ends"], row["ids"])]


def _columns(row: dict) -> list[np.ndarray]:
    return list(unpacked(row["keys"], _WORDS[row["width"]]).reshape(row["columns"], -1))


def _borders(columns: list[np.ndarray], borders: np.ndarray) -> np.ndarray:
    """Of each border the number of sorted keys before it."""
    out = np.empty(len(borders), np.int64)
    for i, border in enumerate(borders):
        lo, hi = 0, len(columns[0])
        for c, x in zip(columns, border, strict=True):
            lo, hi = lo + int(np.searchsorted(c[lo:hi], x)), lo + int(np.searchsorted(c[lo:hi], x, side="right"))
            if lo == hi:
                break
        out[i] = lo
    return out


def _merge(batches: Iterator[pa.RecordBatch], word: type) -> Iterator[pa.RecordBatch]:
    """Ranks of the keys of each part, bucket + smaller keys of the bucket in this part, sent back to their blocks."""

    def part(number: int, rows: list[tuple]) -> list[pa.RecordBatch]:
        sizes = np.array([len(r[4]) // 4 for r in rows])
        columns = [np.concatenate([unpacked(r[3], _WORDS[r[2]]).reshape(r[1], -1)[i] for r in rows]) for i in range(rows[0][1])]
        count = np.concatenate([unpacked(r[4], np.int32) for r in rows])
        keys, _, inverse = distinct(columns)
        total = np.bincount(inverse, count).astype(np.int64)
        before = np.cumsum(total) - total
        bucket = keys[0]
        head = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        smaller = before - before[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
        rank = (bucket.astype(np.int64) + smaller).astype(word)
        flags = ((total == 1) * ALONE + (smaller > 0) * MOVED).astype(np.uint8)
        last = np.flatnonzero(head)[-1]
        first_total = int(total[bucket == bucket[0]].sum())
        info = np.array([int(bucket[0]), int(bucket[-1]), first_total, int(total[last:].sum())], np.int64)
        ranks, flags, lead = rank[inverse], flags[inverse], columns[0] == bucket[0]
        cuts, out = np.concatenate([[0], np.cumsum(sizes)]), [(-1, number, 0, b"", b"", info)]
        for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True):
            out.append((r[0], number, int(lead[a:z].sum()), ranks[a:z], flags[a:z], None))
        return packed(_REPLY, out).to_batches()

    held, rows = None, []
    for batch in batches:
        for number, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number != held and rows:
                yield from part(held, rows)
                rows = []
            held = number
            rows.append(row)
    if rows:
        yield from part(held, rows)


class _Engine:
    def __init__(self, text: B.Text):
        self.text, self.spark = text, text.spark
        self.blocks = -(-text.n // text.size)
        self.parts = max(1, min(max(shuffle_partitions(self.spark), -(-text.n // PART)), text.n))
        self.state = B.Table(self.spark, _STATE)
        self.word = np.uint32 if text.n < (1 << 32) - 1 else np.uint64  # of ranks, and of ranks + 1
        self.round = 0

    def ranked(self, keys: B.Table) -> None:
        """Rank all keys, and append the new buckets of their positions to the state."""
        parts, each = self.parts, SAMPLE
        stride = max(1, -(-self.blocks // (SAMPLE * parts)))

        def sample(row: dict) -> list[tuple]:
            columns = _columns(row)
            m = len(columns[0])
            at = np.unique(np.linspace(0, m - 1, min(m, each * 4)).astype(np.int64))
            return [(m / len(at), len(columns), np.concatenate([c[at].astype(np.uint64) for c in columns]))]

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    for weight, columns, data in sample(row):
                        yield pa.record_batch([pa.array([weight]), pa.array([columns], pa.int32()), pa.array([data.tobytes()], pa.binary())], names=["weight", "columns", "keys"])

        found = keys.rows().where(F.col("block") % stride == 0).select("columns", "width", "keys").mapInArrow(weigh, "weight double, columns int, keys binary").collect()
        borders = np.zeros((0, 0), np.uint64)
        if found and parts > 1:
            width = found[0]["columns"]
            table = np.concatenate([unpacked(r["keys"], np.uint64).reshape(width, -1) for r in found], axis=1)
            weights = np.concatenate([np.full(len(r["keys"]) // (8 * width), r["weight"]) for r in found])
            order = np.lexsort(table[::-1])
            sums = np.cumsum(weights[order])
            at = np.searchsorted(sums, sums[-1] * np.arange(1, parts) / parts)
            borders = np.unique(table[:, order[at]].T, axis=0)
        shared = self.spark.sparkContext.broadcast(borders)
        partitions = shuffle_partitions(self.spark)

        def send(row: dict) -> list[tuple]:
            columns, counts = _columns(row), unpacked(row["counts"], np.int32)
            cuts = [0, *_borders(columns, shared.value).tolist(), len(counts)]
            return [(p, row["block"], len(columns), row["width"], np.concatenate([c[a:z] for c in columns]), counts[a:z]) for p, (a, z) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < z]

        schema = "part int, block long, columns int, width int, keys binary, counts binary"
        sent = keys.rows().select("block", "counts", "columns", "width", "keys").mapInArrow(B.by_block(send, schema), schema)
        number = len(borders) + 1
        dealt = sent.withColumn("to", F.floor(F.col("part") * partitions / number).cast("int")).repartitionById(partitions, "to").drop("to").sortWithinPartitions("part", "block")
        path = scratch(self.spark, "replies")
        word = self.word
        B.stored(dealt.mapInArrow(lambda batches: _merge(batches, word), _REPLY), path)
        replies = self.spark.read.schema(_REPLY).parquet(path)
        # a bucket that goes on over a border adds up what it had before: one row for each part
        carried, now, total = np.zeros(number, np.int64), None, 0
        for r in replies.where("block = -1").select("part", "info").orderBy("part").collect():
            first, last, first_total, last_total = unpacked(r["info"]).tolist()
            carried[r["part"]] = total if first == now else 0
            total = last_total + (carried[r["part"]] if first == last else 0)
            now = last
        carry = self.spark.sparkContext.broadcast(carried)
        round_ = self.round

        def update(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return packed(_STATE, [])
            row = right.to_pylist()[0]
            ranks, flags = [], []
            for r in sorted(left.to_pylist(), key=lambda r: r["part"]):
                part, flag = unpacked(r["ranks"], word).copy(), unpacked(r["flags"], np.uint8).copy()
                if before := int(carry.value[r["part"]]):
                    part[: r["lead"]] += word(before)
                    flag[: r["lead"]] |= MOVED
                ranks.append(part)
                flags.append(flag)
            rank, flag = np.concatenate(ranks), np.concatenate(flags)
            kind = np.where(flag & ALONE, SINGLE, np.where(unpacked(row["done"], bool), TIED, OPEN)).astype(np.uint8)
            inverse = unpacked(row["inverse"], np.int32)
            kinds = kind[inverse]
            split = int(((flag & MOVED) > 0).sum())
            return packed(_STATE, [(row["block"], round_, row["places"], rank[inverse], kinds, row["starts"], row["ends"], row["ids"], int((kinds == OPEN).sum()), split)])

        # the keys themselves, most of a row, are not needed again
        rest = keys.rows().select("block", "places", "inverse", "done", "starts", "ends", "ids")
        self.state.append(meet(replies.where("block >= 0").select("block", "part", "lead", "ranks", "flags"), rest, update, _STATE))
        drop(self.spark, path)
        keys.drop()

    def start(self, k: int) -> int:
        text = self.text
        word, k = text.first_symbols(k)
        bits, size, n, kind = text.bits, text.size, text.n, text.kind
        symbols, least = self.spark.sparkContext.broadcast(text.symbols), text.least

        def keys(row: dict) -> list[tuple]:
            codes, ends = unpacked(row["codes"], kind), unpacked(row["ends"])
            own = min(size, n - row["block"] * size)
            dense = (np.searchsorted(symbols.value, codes) if symbols.value is not None else codes - least) + 1
            g = row["block"] * size + np.arange(own)
            words = B.key_words(dense, ends[B.string_of(g, ends)] - g, bits, word, k)
            spare = np.uint64(bits * (word - 1 - (k - 1) % word))
            mask = np.uint64((1 << bits) - 1)
            ended = lambda keys: (keys[-1] >> spare & mask) == 0  # noqa: E731  the last symbol compared is none
            return _key_row(row["block"], None, [np.zeros(own, np.uint64), *words], ended, row)

        table = B.Table(self.spark, _KEYS).append(text.table.rows().mapInArrow(B.by_block(keys, _KEYS), _KEYS))
        self.ranked(table)
        return k

    def refine(self, h: int, times: int) -> None:
        """Buckets by the first h * times symbols, from those by h."""
        size, last = self.text.size, self.state.rows().where(F.col("round") == self.round)
        word = self.word

        def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Places of the open positions, their gidx, and the ends of their strings."""
            open_ = np.flatnonzero(unpacked(row["kinds"], np.uint8) == OPEN)
            places = open_ if row["places"] is None else unpacked(row["places"], np.int32)[open_].astype(np.int64)
            g, ends = row["block"] * size + places, unpacked(row["ends"])
            return places, g, ends[B.string_of(g, ends)] if len(g) else g

        def ask(row: dict) -> list[tuple]:
            _, g, end = opened(row)
            out = []
            for j in range(1, times):
                at = g + j * h
                at = at[at < end]
                to = at // size
                cuts = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(at)]
                out += [(int(to[a]), row["block"], j, (at[a:z] - to[a] * size).astype(np.int32)) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if a < z]
            return out

        def answer(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return packed("block long, source long, step int, values binary", [])
            ranks = overlaid(right.select(["round", "places", "ranks"]).to_pylist(), "ranks", word) + word(1)
            out = [(r["asker"], r["block"], r["step"], ranks[unpacked(r["places"], np.int32)]) for r in left.to_pylist()]
            return packed("block long, source long, step int, values binary", out)

        def keys(left: pa.Table, right: pa.Table) -> pa.Table:
            if not right.num_rows:
                return packed(_KEYS, [])
            row = right.to_pylist()[0]
            places, g, end = opened(row)
            if not len(g):
                return packed(_KEYS, [])
            kinds = unpacked(row["kinds"], np.uint8)
            columns, answers = [unpacked(row["ranks"], word)[kinds == OPEN]], left.to_pylist()
            for j in range(1, times):
                column = np.zeros(len(g), word)
                own = [unpacked(r["values"], word) for r in sorted(answers, key=lambda r: r["source"]) if r["step"] == j]
                if own:
                    column[g + j * h < end] = np.concatenate(own)
                columns.append(column)
            ended = lambda keys: keys[-1] == 0
            return packed(_KEYS, _key_row(row["block"], places.astype(np.int32), columns, ended, row))

        asked = last.select("block", "places", "kinds", "ends").mapInArrow(B.by_block(ask, "block long, asker long, step int, places binary"), "block long, asker long, step int, places binary")
        answers = meet(asked, self.state.rows().select("block", "round", "places", "ranks"), answer, "block long, source long, step int, values binary")
        table = B.Table(self.spark, _KEYS).append(meet(answers, last, keys, _KEYS))
        self.round += 1
        self.ranked(table)

    def finished(self) -> B.Table:
        """Final ranks: equal suffixes in order of place. A rank that many blocks share is one entry of each."""
        size, n, parts, word = self.text.size, self.text.n, self.parts, self.word

        def whole(right: pa.Table) -> tuple[np.ndarray, np.ndarray, dict]:
            rows = right.to_pylist()
            base = next(r for r in rows if r["places"] is None)
            return overlaid(rows, "ranks", word).astype(np.int64), overlaid(rows, "kinds", np.uint8), base

        def tied(right: pa.Table) -> pa.Table:
            ranks, kinds, base = whole(right)
            names, counts = np.unique(ranks[kinds != SINGLE], return_counts=True)
            part = names * parts // n
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            return packed("part int, block long, ranks binary, counts binary", [(int(part[a]), base["block"], names[a:z], counts[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if a < z])

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Of each rank and block, how many of the rank the blocks before hold; blocks come in order."""
            held, rows = None, []

            def closed() -> list[pa.RecordBatch]:
                rank = np.concatenate([unpacked(r[1]) for r in rows])
                count = np.concatenate([unpacked(r[2]) for r in rows])
                order = np.argsort(rank, kind="stable")
                before = np.cumsum(count[order]) - count[order]
                head = np.concatenate([[True], rank[order][1:] != rank[order][:-1]])
                out = np.empty(len(rank), np.int64)
                out[order] = before - before[np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))]
                cuts = np.cumsum([0, *(len(r[1]) // 8 for r in rows)])
                return packed("block long, part int, begin binary", [(r[0], held, out[a:z]) for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True)]).to_batches()

            for batch in batches:
                for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if part != held and rows:
                        yield from closed()
                        rows = []
                    held = part
                    rows.append(row)
            if rows:
                yield from closed()

        def final(left: pa.Table, right: pa.Table) -> pa.Table:
            ranks, kinds, base = whole(right)
            at = np.flatnonzero(kinds != SINGLE)
            if len(at):
                at = at[np.argsort(ranks[at], kind="stable")]
                head = np.flatnonzero(np.concatenate([[True], ranks[at][1:] != ranks[at][:-1]]))
                sizes = np.diff(np.append(head, len(at)))
                begin = np.concatenate([unpacked(r["begin"]) for r in sorted(left.to_pylist(), key=lambda r: r["part"])])
                ranks[at] += np.repeat(begin - head, sizes) + np.arange(len(at))
            return packed(_FINAL, [(base["block"], ranks, base["starts"], base["ends"], base["ids"])])

        partitions = shuffle_partitions(self.spark)
        rows = self.state.rows()
        sent = rows.select("block", "round", "places", "ranks", "kinds").groupBy("block").applyInArrow(tied, "part int, block long, ranks binary, counts binary")
        dealt = sent.withColumn("to", F.floor(F.col("part") * partitions / parts).cast("int")).repartitionById(partitions, "to").drop("to").sortWithinPartitions("part", "block")
        begun = dealt.mapInArrow(number, "block long, part int, begin binary")
        table = B.Table(self.spark, _FINAL).append(meet(begun, rows, final, _FINAL))
        self.state.drop()
        return table


def overlaid(rows: list[dict], column: str, kind: type) -> np.ndarray:
    """A block's values: the first round's, with those of later rounds in their places."""
    rows = sorted(rows, key=lambda r: r["round"])
    out = unpacked(rows[0][column], kind).copy()
    for r in rows[1:]:
        out[unpacked(r["places"], np.int32)] = unpacked(r[column], kind)
    return out


def rank_rows(final: DataFrame, size: int, value: str | None = None, step: int = 1 << 16) -> DataFrame:
    """rank, str_id, pos, gidx of every position, and the block's values of a further column."""
    names = ["rank", "str_id", "pos", "gidx", *([value] if value else [])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ranks, starts, ends, ids = (unpacked(row[c]) for c in ("ranks", "starts", "ends", "ids"))
                values = unpacked(row[value]) if value else None
                for a in range(0, len(ranks), step):
                    part = ranks[a : a + step]
                    g = row["block"] * size + np.arange(a, a + len(part))
                    string = B.string_of(g, ends)
                    columns = [part, ids[string], g - starts[string], g, *([values[a : a + step]] if value else [])]
                    yield pa.record_batch([pa.array(c) for c in columns], names=names)

    return final.mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _construct(text: B.Text, k: int, times: int) -> SuffixArray:
    spark = text.spark
    if not text.n:
        return SuffixArray(spark.createDataFrame([], "rank long, str_id long, pos long, gidx long"), text, B.Table(spark, _FINAL))
    engine = _Engine(text)
    h = engine.start(k)
    while h <= text.longest:
        open_, split = engine.state.rows().where(F.col("round") == engine.round).agg(F.sum("open"), F.sum("split")).first()
        if not open_ or engine.round and not split:  # equal suffixes only: a stable partition stays stable
            break
        step = times or max(2, min(MOST_TIMES, 1 + text.n // open_))  # long keys pay once few positions are left
        engine.refine(h, step)
        h *= step
    ranks = engine.finished()
    return SuffixArray(rank_rows(ranks.rows(), text.size), text, ranks, engine.round)


def suffix_array(strings: DataFrame, k: int = 0, times: int = 0) -> SuffixArray:
    """(Generalized) suffix array of strings (str_id, text), or of pieces (str_id, pos, text) of long ones.

    k: symbols of the first keys, by default as many as fit a word or two; times: 2 doubles, 3 triples, ...; 0 chooses for
    each round so that no more is asked for than there are positions.
    """
    return _construct(B.of_strings(strings), k, times)


def suffix_array_int(values: DataFrame, times: int = 0) -> SuffixArray:
    """Suffix array of one sequence of whole numbers (pos 0..n-1, v)."""
    return _construct(B.of_values(values), 0, times)


def inverse(index: SuffixArray) -> DataFrame:
    """str_id, pos, gidx, rank: the same rows, keyed by place."""
    return index.sa.select("str_id", "pos", "gidx", "rank")


def lcp_array(index: SuffixArray) -> DataFrame:
    """sa with lcp (0 at rank 0)."""
    if not index.text.n:
        return index.sa.withColumn("lcp", F.lit(0).cast("long"))
    return rank_rows(common_prefixes(index.text, index.ranks).rows(), index.text.size, "lcps").withColumnRenamed("lcps", "lcp")


def with_before(lcp: DataFrame) -> DataFrame:
    """lcp with p_str and p_pos, the place of the suffix before; null at rank 0."""
    before = lcp.select((F.col("rank") + 1).alias("rank"), F.col("str_id").alias("p_str"), F.col("pos").alias("p_pos"))
    return lcp.join(exchanged(before), "rank", "left")


def string_lcp(a, b):
    """Length of the common prefix of two short strings."""
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda k: F.substr(a, F.lit(1), k) == F.substr(b, F.lit(1), k))), F.lit(0)).cast("long")


def lc_array(lcp: DataFrame, chars: DataFrame) -> DataFrame:
    """rank, lcp and lc: the symbol of the suffix before, right after the common prefix; '$' at its end; null at rank 0."""
    at = chars.select(F.col("str_id").alias("p_str"), F.col("pos").alias("_at"), F.col("ch").alias("lc"))
    keyed = with_before(lcp).withColumn("_at", F.col("p_pos") + F.col("lcp"))
    found = keyed.join(exchanged(at), ["p_str", "_at"], "left")
    return found.select("rank", "lcp", F.when(F.col("p_str").isNotNull(), F.coalesce("lc", F.lit("$"))).alias("lc"))


def bwt(index: SuffixArray, chars: DataFrame) -> DataFrame:
    """rank and ch: the symbol before each suffix in its string, '$' at a string's start."""
    before = chars.select("str_id", (F.col("pos") + 1).alias("pos"), "ch")
    return index.sa.join(exchanged(before), ["str_id", "pos"], "left").select("rank", F.coalesce("ch", F.lit("$")).alias("ch"))


def inverse_bwt(index_rows: DataFrame) -> DataFrame:
    """pos and ch of the text whose transform (rank, ch; one text, with the row of its end) is given.

    The step from a row to the row of the symbol before is a permutation; pointer doubling follows it for all rows at
    once, in as many joins as the length has binary digits.
    """
    rows = ranked(index_rows.select("rank", F.when(F.col("ch") == "$", "").otherwise(F.col("ch")).alias("ch")), ["ch", "rank"]).select("rank", "ch", F.col("idx").alias("next"))
    n = rows.count()
    # row 0 is the end's; following `next` t times from it visits the text's symbols from the last to the first
    jump = settle(rows.select(F.col("rank").alias("at"), F.col("next").alias("to")), "jump")
    seen = rows.sparkSession.createDataFrame([(0, 0)], "t long, at long")
    step = 1
    while step < n:
        moved = seen.join(exchanged(jump), "at").select((F.col("t") + step).alias("t"), F.col("to").alias("at"))
        seen = settle(seen.unionByName(moved.where(F.col("t") < n)), "seen")
        twice = jump.alias("a").join(exchanged(jump).alias("b"), F.col("a.to") == F.col("b.at")).select(F.col("a.at").alias("at"), F.col("b.to").alias("to"))
        jump = settle(twice, "jump")
        step *= 2
    return seen.join(exchanged(rows), seen["at"] == rows["rank"]).where("ch != ''").select((F.lit(n - 2) - F.col("t")).alias("pos"), "ch")
