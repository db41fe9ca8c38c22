"""Storing and loading indexes: Parquet tables, headerless native integer arrays, decimal dumps."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions

PARTS = ("sa", "lcp", "lc", "alphabet")
#: Bytes of a native array that a task reads at once.
CHUNK = 1 << 23


def write_index(path: str, **parts: DataFrame) -> None:
    """Write the given parts (sa, lcp, lc, alphabet) below path."""
    for name, df in parts.items():
        if name not in PARTS:
            raise ValueError(f"unknown part {name}")
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str, *names: str) -> dict[str, DataFrame]:
    """The named parts; raises where sa, lcp and lc differ in their number of rows."""
    found = {n: spark.read.parquet(f"{path}/{n}") for n in names}
    sizes = {n: df.count() for n, df in found.items() if n != "alphabet"}
    if len(set(sizes.values())) > 1:
        raise ValueError(f"the parts differ in size: {sizes}")
    return found


def write_native(values: DataFrame, folder: str, value: str = "v", index: str = "idx", width: int = 8) -> None:
    """Values in order of their index as headerless native integers (4 bytes: without sign), in files part-00000.bin, part-00001.bin, ... whose
    concatenation is the array. Each file is written under a temporary name and moved; a list of them comes last."""
    spark = values.sparkSession
    kind = {4: np.uint32, 8: np.int64}[width]
    ordered = values.select(F.col(index).alias("i"), F.col(value).cast("long").alias("v")).repartitionByRange(shuffle_partitions(spark), "i").sortWithinPartitions("i")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, n, out = f"part-{TaskContext.get().partitionId():05d}.bin", 0, None
        filesystem, path = _opened(folder)
        filesystem.create_dir(path, recursive=True)
        temporary = f"{path}/.{name}.{uuid.uuid4().hex}"
        for batch in batches:
            if batch.num_rows:
                out = out or filesystem.open_output_stream(temporary, compression=None)
                out.write(batch.column("v").to_numpy().astype(kind).tobytes())
                n += batch.num_rows
        if out:
            out.close()
            filesystem.move(temporary, f"{path}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], names=["name", "n"])

    files = ordered.mapInArrow(work, "name string, n long").collect()
    filesystem, path = _opened(folder)
    filesystem.create_dir(path, recursive=True)
    with filesystem.open_output_stream(f"{path}/files.json", compression=None) as out:
        out.write(json.dumps(sorted((r["name"], r["n"]) for r in files)).encode())


def read_native(spark: SparkSession, path: str, width: int = 8) -> DataFrame:
    """idx and v of a headerless array of native integers of 4 or 8 bytes: one file, or a folder that write_native wrote.

    Files are read in chunks of CHUNK bytes, dealt to tasks; sizes must be multiples of the width.
    """
    filesystem, where = _opened(path)
    if filesystem.get_file_info(where).type == fs.FileType.Directory:
        with filesystem.open_input_stream(f"{where}/files.json") as data:
            names = [f"{path.rstrip('/')}/{name}" for name, _ in json.loads(data.read())]
    else:
        names = [path]
    chunks, first = [], 0
    for name in names:
        size = filesystem.get_file_info(_opened(name)[1]).size
        if size % width:
            raise ValueError(f"{size} bytes are no multiple of {width}")
        chunks += [(name, at, min(CHUNK, size - at), (first + at) // width) for at in range(0, size, CHUNK)]
        first += size
    kind = {4: np.uint32, 8: np.int64}[width]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                filesystem, where = _opened(row["name"])
                with filesystem.open_input_file(where) as data:
                    data.seek(row["at"])
                    v = np.frombuffer(data.read(row["n"]), kind).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(row["first"] + np.arange(len(v))), pa.array(v)], names=["idx", "v"])

    listed = spark.createDataFrame(chunks, "name string, at long, n long, first long")
    return listed.repartition(max(1, len(chunks))).mapInArrow(work, "idx long, v long")


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if ":/" in uri else f"file://{uri}")


def decimal_dump(values: DataFrame, path: str, index: str = "idx", value: str = "v") -> None:
    """Values in order of their index, one a line, as text files whose names sort in that order."""
    n = values.sparkSession.conf.get("spark.sql.shuffle.partitions")
    values.repartitionByRange(int(n), index).sortWithinPartitions(index).select(F.col(value).cast("string").alias("value")).write.mode("overwrite").text(path)
