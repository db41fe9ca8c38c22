"""Texts and arrays over their positions in blocks of consecutive positions, one packed row for each block.

The strings of a set stand one after the other by str_id, empty ones left out; a position in that order is a gidx. Block b
holds positions [b * size, (b + 1) * size) and HALO symbols more. Tables of blocks are stored bucketed by block, so what
meets a block's own rows by cogroup is exchanged, but the block isn't.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop, exchanged, few_bytes, scratch, settle, shuffle_partitions
from . import kmers, stringsets

#: Positions of a block at most, and of one that is cut no further for the sake of a task's memory; blocks from which on they
#: grow, as some exchanges have a row for two blocks; blocks for each partition at least, and symbols of the next block that a
#: block holds.
MOST, FEW, MANY, SPREAD, HALO = 1 << 18, 1 << 16, 1 << 13, 4, 64
#: Rows of a block are large: Parquet's writer is to look at its buffer after each, else it holds (and a reader gets at once)
#: a hundred of them, and Arrow batches hold few. lz4_raw and snappy keep pages in direct memory until a collection.
#: Of packed columns no least and greatest values: the writer would keep both, whole, for every row group until the file ends.
ROW_GROUP, BATCH, OPEN_FILES = 8 << 20, 4 << 20, 8
_WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.block.size": str(ROW_GROUP), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
_WRITER |= {"parquet.enable.dictionary": "false", "parquet.size.statistics.enabled": "false", "parquet.column.statistics.enabled": "false"}
_WRITER |= {f"parquet.column.statistics.enabled#{c}": "true" for c in ("block", "round")}
TEXT = "block long, codes binary, starts binary, ends binary, ids binary"


class Table:
    """Rows of blocks, stored bucketed by block; rows can be appended."""

    def __init__(self, spark: SparkSession, schema: str):
        few_bytes(spark, BATCH)
        self.spark, self.schema, self.path = spark, schema, scratch(spark, "blocks")
        self.name = f"lexispark_{uuid.uuid4().hex}"
        self.buckets = shuffle_partitions(spark)

    def append(self, rows: DataFrame) -> Table:
        # tasks hold blocks of a bucket or two: with a file open for each, the writer needn't sort (and so hold) all their rows
        key = "spark.sql.maxConcurrentOutputFileWriters"
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, str(max(OPEN_FILES, int(before))))
        try:
            rows.write.format("parquet").options(**_WRITER).mode("append").option("path", self.path).bucketBy(self.buckets, "block").saveAsTable(self.name)
        finally:
            self.spark.conf.set(key, before)
        return self

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def save(self, path: str) -> None:
        """Write the rows to path, in as many buckets."""
        name = f"lexispark_{uuid.uuid4().hex}"
        self.rows().repartition(self.buckets, "block").write.format("parquet").options(**_WRITER).mode("overwrite").option("path", path).bucketBy(self.buckets, "block").saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")

    @classmethod
    def stored(cls, spark: SparkSession, schema: str, path: str, buckets: int) -> Table:
        """The table that save wrote."""
        few_bytes(spark, BATCH)
        table = cls.__new__(cls)
        table.spark, table.schema, table.path, table.name, table.buckets = spark, schema, path, f"lexispark_{uuid.uuid4().hex}", buckets
        spark.sql(f"CREATE TABLE {table.name} ({schema}) USING parquet CLUSTERED BY (block) INTO {buckets} BUCKETS LOCATION '{path}'")
        return table

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        drop(self.spark, self.path)


def stored(rows: DataFrame, path: str) -> None:
    """Write packed rows to path, as those of tables are."""
    rows.write.options(**_WRITER).parquet(path)


def meet(left: DataFrame, right: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """work(rows of left, rows of right) for every block; left is exchanged, right (rows of a Table) is not."""
    dealt = left.repartition(shuffle_partitions(left.sparkSession), "block")
    return dealt.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(work, schema)


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def packed(schema: str, rows: list[tuple]) -> pa.Table:
    """A table of rows; arrays become binary values."""
    kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.table([pa.array([v.tobytes() if isinstance(v, np.ndarray) else v for v in c], k) for c, k in zip(columns, kinds, strict=True)], names=names(schema))


def unpacked(value: bytes | None, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(value or b"", kind)


def by_block(work: Callable[[dict], list[tuple]], out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: work on each row (a dict), which gives rows of the schema out."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from packed(out, work({n: batch.column(n)[i].as_py() for n in batch.schema.names})).to_batches()

    return apply


@dataclass
class Text:
    """Rows TEXT: codes (int32 code points, or int64 values), and start, end and str_id of all strings that reach into the
    block or its halo. symbols: all different codes, ascending (None: any up to most)."""

    spark: SparkSession
    table: Table
    n: int
    size: int
    longest: int
    kind: type
    symbols: np.ndarray | None
    least: int = 0
    most: int = 0
    held: list[Table] = field(default_factory=list)

    @property
    def bits(self) -> int:
        return max(1, (len(self.symbols) if self.symbols is not None else self.most - self.least + 1).bit_length())

    def first_symbols(self, requested: int) -> tuple[int, int]:
        """Symbols of a key word, and symbols that suffixes are first sorted by: the requested number, or as many as fit a
        word, or two where a word's symbols (of about 2.5 bits of information) tell few suffixes apart."""
        word = kmers.optimal_k(0, self.bits, max(1, self.longest))
        own = word if word * min(self.bits, 2.5) > self.n.bit_length() + 4 else 2 * word
        return word, max(1, min(requested or own, HALO, max(1, self.longest)))


def _sized(n: int, spark: SparkSession) -> int:
    most = min(MOST, max(FEW, -(-n // MANY)))
    blocks = max(1, -(-n // most), min(SPREAD * shuffle_partitions(spark), -(-n // (2 * HALO))))
    return max(1, -(-n // blocks))


def _stored(spark: SparkSession, pieces: DataFrame, kind: type) -> Table:
    """Pieces (block, at, codes, start, end, id) as one row for each block."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []

        def closed() -> list[pa.RecordBatch]:
            first = [r for i, r in enumerate(rows) if not i or rows[i - 1][2] != r[2]]  # of a string's pieces one
            strings = (np.array([r[i] for r in first], np.int64) for i in (2, 3, 4))
            return packed(TEXT, [(held, b"".join(r[1] for r in rows), *strings)]).to_batches()

        for batch in batches:
            for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != held and rows:
                    yield from closed()
                    rows = []
                held = block
                rows.append(row)
        if rows:
            yield from closed()

    table = Table(spark, TEXT)
    dealt = pieces.select("block", "at", "codes", "start", "end", "id").repartition(table.buckets, "block").sortWithinPartitions("block", "at")
    return table.append(dealt.mapInArrow(join, TEXT))


PIECES = "block long, at long, codes binary, start long, end long, id long"


def of_strings(strings: DataFrame) -> Text:
    """The text of a set (str_id, text), or of pieces of long strings (str_id, pos, text) in code points."""
    spark, whole = strings.sparkSession, "pos" not in strings.columns
    ready = strings.where(F.length("text") > 0).select(F.col("str_id").cast("long").alias("str_id"), (F.lit(0) if whole else F.col("pos")).cast("long").alias("pos"), "text")
    sizes = ready if whole else ready.groupBy("str_id").agg(F.sum(F.length("text")).alias("size"))
    offsets = settle(stringsets.offsets(sizes), "offsets")
    n, longest = offsets.agg(F.max("end"), F.max(F.col("end") - F.col("begin"))).first()
    n, longest = n or 0, longest or 0
    size = _sized(n, spark)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for i, pos, text, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.int32)
                x, y = begin + pos, begin + pos + len(codes)
                for b in range(max(0, (x - HALO) // size), (y - 1) // size + 1):
                    lo, hi = max(x, b * size), min(y, (b + 1) * size + HALO)
                    if lo < hi:
                        out.append((b, lo, codes[lo - x : hi - x], begin, end, i))
                        held += hi - lo
                if len(out) >= 4096 or held >= MOST:
                    yield from packed(PIECES, out).to_batches()
                    out, held = [], 0
            yield from packed(PIECES, out).to_batches()

    placed = ready.join(exchanged(offsets), "str_id").select("str_id", "pos", "text", "begin", "end")
    table = _stored(spark, placed.mapInArrow(cut, PIECES), np.int32)

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0x110000, bool)
        for batch in batches:
            for s in batch.column(0).to_pylist():
                seen[unpacked(s, np.int32)] = True
        yield from packed("symbol long", [(int(s),) for s in np.flatnonzero(seen)]).to_batches()

    # at most the code points of Unicode; in one step, as each step of a task has a Python worker, and workers stay
    symbols = sorted(r["symbol"] for r in table.rows().select("codes").mapInArrow(used, "symbol long").distinct().collect())
    return Text(spark, table, n, size, longest, np.int32, np.array(symbols, np.int64))


def of_values(values: DataFrame) -> Text:
    """The text of one sequence of whole numbers (pos 0..n-1, v)."""
    spark = values.sparkSession
    rows = values.select(F.col("pos").cast("long").alias("pos"), F.col("v").cast("long").alias("v"))
    n, least, most = rows.agg(F.count("*"), F.min("v"), F.max("v")).first()
    size = _sized(n, spark)
    blocks = F.expr(f"sequence(greatest(0L, (pos - {HALO}) div {size}L), pos div {size}L)")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, parts = None, []
        for batch in batches:
            block, v = batch.column("block").to_numpy(), batch.column("v").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]]) if len(block) else np.zeros(1, np.int64)
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if block[a] != held and parts:
                    yield from packed(TEXT, [(held, np.concatenate(parts), *one)]).to_batches()
                    parts = []
                held = int(block[a])
                parts.append(v[a:z])
        if parts:
            yield from packed(TEXT, [(held, np.concatenate(parts), *one)]).to_batches()

    one = np.zeros(1, np.int64), np.array([n], np.int64), np.zeros(1, np.int64)
    table = Table(spark, TEXT)
    dealt = rows.withColumn("block", F.explode(blocks)).where(F.col("pos") < (F.col("block") + 1) * size + HALO)
    table.append(dealt.select("block", "pos", "v").repartition(table.buckets, "block").sortWithinPartitions("block", "pos").mapInArrow(cut, TEXT))
    return Text(spark, table, n, size, n, np.int64, None, least or 0, most or 0)


def string_of(at: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Index of the string that holds each position; ends ascending."""
    return np.searchsorted(ends, at, side="right")


def key_words(codes: np.ndarray, left: np.ndarray, bits: int, word: int, k: int) -> list[np.ndarray]:
    """The first k symbols from every position in words of `word` symbols; symbols beyond a string's end are 0.

    codes: symbols > 0, halo included; left: symbols left in its string from each position, for as many positions.
    """
    out, n = [], len(left)
    padded = np.concatenate([codes, np.zeros(k, codes.dtype)])
    for at in range(0, k, word):
        key = np.zeros(n, np.uint64)
        for j in range(at, at + word):
            key <<= np.uint64(bits)
            if j < k:
                key |= np.where(left > j, padded[j : j + n], 0).astype(np.uint64)
        out.append(key)
    return out


def distinct(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Different keys in ascending order, their numbers of occurrences, and of each key its index among them."""
    m = len(columns[0])
    if not m:
        return columns, np.zeros(0, np.int64), np.zeros(0, np.int64)
    used, spare = [], 0
    for c in columns:  # as few words as the values' bits allow
        bits = int(c.max()).bit_length()
        if used and bits <= spare:
            used[-1] = used[-1] << np.uint64(bits) | c
        else:
            used.append(c.astype(np.uint64))
            spare = 64
        spare -= bits
    order = np.argsort(used[0]) if len(used) == 1 else np.lexsort(used[::-1])
    fresh = np.zeros(m, bool)
    fresh[0] = True
    for c in used:
        fresh[1:] |= c[order[1:]] != c[order[:-1]]
    first = np.flatnonzero(fresh)
    inverse = np.empty(m, np.int64)
    inverse[order] = np.cumsum(fresh) - 1
    heads = order[first]
    return [c[heads] for c in columns], np.diff(np.append(first, m)), inverse


def kmer_counts(text: Text, k: int) -> DataFrame:
    """kmer and n of all k-mers of a text; those of a string's end are shorter. A block reads on in its halo, and counts
    before the exchange."""
    size, total = text.size, text.n
    if k > HALO:
        raise ValueError(f"k-mers have {HALO} symbols at most")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes, ends = unpacked(row["codes"], np.int32), unpacked(row["ends"])
                g = row["block"] * size + np.arange(min(size, total - row["block"] * size))
                words = key_words(codes.astype(np.int64) + 1, ends[string_of(g, ends)] - g, 21, 3, k)
                names, counts, _ = distinct(words)
                symbols = [(names[j // 3] >> np.uint64(21 * (2 - j % 3)) & np.uint64((1 << 21) - 1)).astype(np.int64) - 1 for j in range(k)]
                found = ["".join(chr(c) for c in x if c >= 0) for x in zip(*(s.tolist() for s in symbols), strict=True)]
                yield pa.record_batch([pa.array(found, pa.string()), pa.array(counts, pa.int64())], names=["kmer", "n"])

    return text.table.rows().select("block", "codes", "ends").mapInArrow(work, "kmer string, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
