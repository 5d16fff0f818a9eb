"""Helpers shared by the operators: tables, lineage cuts, posting rows."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only in local mode (tests)."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = context.getConf().get("spark.checkpoint.dir")
    if not configured and not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="rasterspark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def buckets(docs: DataFrame, each: int = 64 << 20) -> int:
    """How many groups the rows made from docs (text) are dealt into: one for each 64 MB of text, so that a
    group fits in a task's memory whatever the input, and as many as shuffle partitions at least.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // each))


def texts_of(batch: pa.RecordBatch | pa.Table, name: str = "text") -> list[bytes]:
    """UTF-8 bytes of a binary column; null counts as empty."""
    return [x if x is not None else b"" for x in batch.column(name).to_pylist()]


def chunks(sizes: list[int], limit: int = 1 << 20):
    """Consecutive index ranges whose sizes sum to about limit; a larger item stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def split_by(bucket: np.ndarray):
    """(bucket, row indices) for each bucket that occurs, rows in stable order."""
    order = np.argsort(bucket, kind="stable")
    if not len(order):
        return
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts):
        yield int(bucket[part[0]]), part


def pack(values: np.ndarray) -> bytes:
    """Bytes of the values, all first bytes before all second ones and so on, which compresses well."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes()


def posting_rows(bucket: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket; every column becomes the packed bytes of its values."""
    keys, packed = [], {name: [] for name in columns}
    for key, rows in split_by(bucket):
        keys.append(key)
        for name, values in columns.items():
            packed[name].append(pack(values[rows]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int32()), *(pa.array(v, pa.binary()) for v in packed.values())],
        names=["bucket", *packed],
    )


def unpack(group: pa.Table, name: str, dtype) -> np.ndarray:
    """The values of all rows of a packed column."""
    width = np.dtype(dtype).itemsize
    parts = [np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, -1).T).view(dtype).reshape(-1) for x in group.column(name).to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, dtype)


def posting_schema(*names: str) -> str:
    return "bucket int, " + ", ".join(f"{x} binary" for x in names)


def split_runs(*keys: np.ndarray):
    """(start, end) of each run of rows with equal keys; rows of equal keys stand together."""
    new = np.zeros(len(keys[0]), bool)
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    new[:1] = True
    start = np.flatnonzero(new)
    return zip(start.tolist(), np.append(start[1:], len(new)).tolist())


def first_equal(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order rows by keys; return that order and, along it, the number of the group of equal keys."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    for key in keys:
        k = key[order]
        new[1:] |= k[1:] != k[:-1]
    return order, np.cumsum(new)
