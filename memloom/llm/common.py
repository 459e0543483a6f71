"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where none is named, a temporary one, in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="memloom-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def plain_unions(spark: SparkSession) -> None:
    """Let a union claim no partitioning.

    Spark 4.1 passes on the partitioning of a union's branches and drops a following
    repartition; adaptive execution then changes the branches one by one, and rows of one
    key end in different tasks.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table in the shared folder and go on from there.

    Unlike a checkpoint, a table that is read back has its true size, so the planner's
    estimates do not multiply from round to round.
    """
    spark = df.sparkSession
    plain_unions(spark)
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary_rows(a: np.ndarray) -> pa.Array:
    """One binary value per row of a contiguous 2-d array."""
    a = np.ascontiguousarray(a)
    width = a.shape[1] * a.itemsize
    offsets = np.arange(len(a) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(offsets), pa.py_buffer(a)])


def rows_of_binary(col: pa.Array, dtype: type) -> np.ndarray:
    """The reverse of binary_rows; all values must have one length."""
    n = len(col)
    if n == 0:
        return np.empty((0, 0), dtype)
    width = len(col[0].as_py()) // np.dtype(dtype).itemsize
    flat = b"".join(col.to_pylist())
    return np.frombuffer(flat, dtype=dtype).reshape(n, width)


def groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Split a stream that is sorted by ``key`` into one table per key; a group may span batches."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).combine_chunks() for k in key]
        change = np.zeros(t.num_rows - 1, dtype=bool)
        for c in cols:
            codes = c.dictionary_encode().indices.to_numpy(zero_copy_only=False) if pa.types.is_string(c.type) else c.to_numpy(zero_copy_only=False)
            change |= codes[1:] != codes[:-1]
        edges = [0, *(np.flatnonzero(change) + 1).tolist(), t.num_rows]
        for lo, hi in zip(edges, edges[1:]):
            now = tuple(c[lo].as_py() for c in cols)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(t.slice(lo, hi - lo))
            last = now
    if held:
        yield pa.concat_tables(held)


def word_column(*cols: str) -> F.Column:
    """Distinct maximal runs of letters or digits of the lower-cased columns, joined by a space; null counts as empty."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in cols]))
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))
