"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step handles at a time; a longer document is handled alone.
CHUNK = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a local master only, a folder of our own where it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            held = spark.sparkContext.getCheckpointDir()
        where = held
    return where.rstrip("/")


def saved(df: DataFrame, label: str) -> DataFrame:
    """df, written to the shared folder and read back: cuts lineage, and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def drop(df: DataFrame) -> None:
    """Deletes what saved() wrote, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._saved_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def collected(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size as arrays, by way of Arrow and never as Python rows."""
    got = df.toArrow()
    return [got.column(c).to_numpy() for c in got.column_names]


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those with one of these names."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def pieces(batch: pa.RecordBatch, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose first column (texts or ids; else all) holds about `limit` bytes; a larger row stands alone."""
    first = batch.column(0)
    start, n = 0, batch.num_rows
    if pa.types.is_list(first.type) and pa.types.is_integer(first.type.value_type):
        sizes = pc.fill_null(pc.multiply(pc.list_value_length(first), 4), 0).to_numpy(zero_copy_only=False)
    elif pa.types.is_string(first.type) or pa.types.is_binary(first.type):
        sizes = pc.fill_null(pc.binary_length(first), 0).to_numpy(zero_copy_only=False)
    else:
        sizes = np.full(n, batch.nbytes // max(n, 1))
    total = np.cumsum(sizes.astype(np.int64))
    while start < n:
        used = int(total[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(total, used + limit, "right")))
        yield batch.slice(start, end - start)
        start = end


def arrow_map(df: DataFrame, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]]) -> DataFrame:
    """mapInArrow of a function made once for each task, over slices that bound a worker's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for piece in pieces(batch):
                yield each(piece)

    return df.mapInArrow(run, schema)
