"""Deterministic sharded WARC archives: write, commit, read back.

Records are range-sorted by page_id into shards whose bounds are quantiles of a hash-chosen sample of ids, so the
same rows give the same files. Each shard's task writes compressed records one by one, rolls to a new file once the
compressed size is reached, and moves a finished file from a temporary to its final name. The manifest (name, bytes,
records, SHA-256 of each file) is committed last by Spark's own writer; a reader only opens what it lists, so files
of failed or repeated attempts don't count. A run of the same task again writes the same bytes to the same name.

Of records with equal payloads of at least min_revisit bytes the one with the smallest page_id is the response, the
others are revisits that refer to it. Only narrow rows are shuffled to find them; they travel to the writer as notes
sorted before the page they concern.

Defined results: a null html is an empty payload; a null page_id sorts first and is never a revisit; rows that repeat
the smallest page_id of a payload are responses too; a null url becomes urn:page:<page_id>. An empty table gives an
empty manifest and no records; columns beside page_id, url and html are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from .files import open_folder
from .textops import arrow

DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Ids sampled for the shards' bounds.
SAMPLE = 50_000
MANIFEST = "name string, bytes long, records long, sha256 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One WARC record. Its extension headers Page-Id and Refers-To-Page-Id carry the ids."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or f"urn:page:{page_id}")
    headers = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": _record_id(page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": target,
        "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Page-Id": page_id,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    if refers_to is not None:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": _record_id(refers_to, digest), "Refers-To-Page-Id": refers_to}
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(record) + packer.flush()


class _Shard:
    """Files of one shard, each under a temporary name until it is whole."""

    def __init__(self, folder: str, number: int, roll: int):
        self.fs, self.path = open_folder(folder)
        self.number, self.roll, self.files, self.attempt = number, roll, 0, uuid.uuid4().hex
        self.stream = None

    def write(self, member: bytes) -> tuple | None:
        if self.stream is None:
            self.name = f"part-{self.number:05d}-{self.files:05d}.warc.gz"
            self.temporary = f"{self.path}/_temporary/{self.name}.{self.attempt}"
            self.stream, self.size, self.records, self.digest = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
        self.stream.write(member)
        self.digest.update(member)
        self.size += len(member)
        self.records += 1
        return self.close() if self.size >= self.roll else None

    def close(self) -> tuple | None:
        if self.stream is None:
            return None
        self.stream.close()
        self.fs.move(self.temporary, f"{self.path}/{self.name}")
        self.stream = None
        self.files += 1
        return self.name, self.size, self.records, self.digest.hexdigest()


def write_archives(pages: DataFrame, folder: str, roll: int = 256 << 20, min_revisit: int = 100, shards: int | None = None, level: int = 3) -> DataFrame:
    """Write pages as compressed WARC files into folder; returns the committed manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    narrow = rows.where((F.length("payload") >= min_revisit) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("last > first").select("digest", "first")
    notes = narrow.join(first, "digest").where("page_id > first").groupBy("page_id", "digest").agg(F.min("first").alias("first"))

    n = shards or shuffle_partitions(spark)
    step = max(1, pages.count() // SAMPLE)
    sample = rows.select("page_id").where(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(step)) == 0)).toPandas()["page_id"].sort_values().to_numpy(np.int64)
    bounds = np.unique(sample[[len(sample) * i // n for i in range(1, n)]]) if len(sample) else np.zeros(0, np.int64)

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids, side="right").astype(np.int32))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        note, shard = (None, None, None), None
        for batch in batches:
            done = []
            for number, page_id, is_page, digest, first_id, url, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not is_page:
                    note = page_id, digest, first_id
                    continue
                if shard is None or shard.number != number:
                    done.append(shard and shard.close())
                    shard = _Shard(folder, number, roll)
                refers = note[2] if note[:2] == (page_id, digest) else None
                done.append(shard.write(_member(record_bytes(page_id, url, payload, digest, refers), level)))
            if done := [d for d in done if d]:
                yield _manifest(done)
        if shard and (last := shard.close()):
            yield _manifest([last])

    order = ["shard", "page_id", "digest", "is_page", "url"]
    notes = notes.select("page_id", F.lit(False).alias("is_page"), "digest", "first", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    whole = rows.select("page_id", F.lit(True).alias("is_page"), "digest", F.lit(None).cast("long").alias("first"), "url", "payload")
    placed = whole.unionByName(notes).select(F.when(F.col("page_id").isNull(), 0).otherwise(shard_of(F.coalesce("page_id", F.lit(0)))).alias("shard"), "*")
    filesystem, path = open_folder(folder)
    filesystem.create_dir(f"{path}/_temporary", recursive=True)
    placed.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(*order).transform(arrow(work, MANIFEST)).write.parquet(f"{folder}/_manifest")
    filesystem.delete_dir(f"{path}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def _manifest(done: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["name", "bytes", "records", "sha256"])


def members(stream: pa.NativeFile, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The decompressed gzip members of a file, one at a time."""
    data, unpacker, parts = b"", zlib.decompressobj(31), []
    while data := data or stream.read(chunk):
        parts.append(unpacker.decompress(data))
        data = b""
        if unpacker.eof:
            yield b"".join(parts)
            data, unpacker, parts = unpacker.unused_data, zlib.decompressobj(31), []
    if any(parts):
        raise ValueError("the last record is cut short")


def parse_record(record: bytes) -> tuple:
    """page_id, url, payload_bytes, payload_digest, record_type and refers_to; raises where a digest doesn't hold."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise ValueError(f"{fields['WARC-Record-ID']}: the block's digest doesn't hold")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{fields['WARC-Record-ID']}: the payload's digest doesn't hold")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("Page-Id"), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], number("Refers-To-Page-Id")


def read_archives(spark: SparkSession, folder: str, group: int = 1000) -> DataFrame:
    """The records of all files that the manifest lists."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, path = open_folder(folder)
        names = [f.split()[0] for f in RECORDS.split(", ")]
        kinds = [pa.int64() if f.endswith("long") else pa.string() for f in RECORDS.split(", ")]
        for batch in batches:
            for name in batch.column("name").to_pylist():
                found = []
                with filesystem.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for record in members(stream):
                        found.append(parse_record(record))
                        if len(found) == group:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)
                            found = []
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=names)

    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/_manifest").select("name")
    return manifest.repartition(shuffle_partitions(spark)).transform(arrow(work, RECORDS))
