"""What the operators of this subpackage share: worker state, byte views of Arrow text, blobs of arrays."""

from __future__ import annotations

import atexit
import sys
import types
import uuid

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import cut, forget, shared_folder  # noqa: F401

# Executors need no copy of this package: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules["graphloom.llm"])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def worker_state(name: str) -> types.ModuleType:
    """A module object that lives as long as the Python worker; tasks of one worker share caches through it."""
    return sys.modules.setdefault(f"graphloom_worker_{name}", types.ModuleType(name))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Index ranges [i, j) of whole documents with about `most` bytes each (one document at least)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a well-known 64-bit mixer, on uint64 arrays."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, one after another."""
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *dtypes) -> list[np.ndarray]:
    """The arrays that pack() made."""
    kinds = [np.dtype(d) for d in dtypes]
    n, at, out = len(blob) // sum(k.itemsize for k in kinds), 0, []
    for k in kinds:
        out.append(np.frombuffer(blob, k, n, at))
        at += n * k.itemsize
    return out


def gather(blobs: list[bytes], *dtypes) -> list[np.ndarray]:
    """The arrays of many blobs, joined."""
    parts = [unpack(b, *dtypes) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.empty(0, d) for i, d in enumerate(dtypes)]


def scatter(part: np.ndarray, n: int, *arrays: np.ndarray):
    """(p, arrays of the rows with part == p) for each p that occurs, n being the number of parts."""
    if not len(part):
        return
    order = np.argsort(part.astype(np.uint32 if n > 65535 else np.uint16), kind="stable")
    part = part[order]
    edges = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(part)]))
    arrays = [a[order] for a in arrays]
    for i, j in zip(edges[:-1], edges[1:]):
        if j > i:
            yield int(part[i]), [a[i:j] for a in arrays]


def blobs_by_part(batches):
    """(part, blobs) from record batches with the columns part and blob, of a frame sorted by part."""
    now, held = None, []
    for batch in batches:
        for p, b in zip(batch.column("part").to_pylist(), batch.column("blob").to_pylist()):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append(b)
    if held:
        yield now, held


def by_part(df: DataFrame, n: int) -> DataFrame:
    """Rows (part, blob, ...) dealt by part and sorted by it; a part is one of n shares of a hash, never a key."""
    return df.repartitionById(n, F.col("part")).sortWithinPartitions("part")


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches, so that a Python worker holds a few MB of text at a time whatever the row sizes.

    Plans read this setting when they run, which is after the operator has returned them, so it stays for the session.
    """
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > 1000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)


def share_bytes(spark: SparkSession, data: bytes, name: str) -> str:
    """Writes bytes to the shared folder and has Spark hand the file to every executor; SparkFiles.get(result) finds it."""
    jvm, name = spark.sparkContext._jvm, f"{uuid.uuid4().hex}-{name}"
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/files/{name}")
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    for i in range(0, len(data), 1 << 20):
        stream.write(bytearray(data[i : i + (1 << 20)]))
    stream.close()
    spark.sparkContext.addFile(target.toString())
    atexit.register(forget, spark, target.toString())
    return name
