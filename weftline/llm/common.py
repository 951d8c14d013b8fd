"""Session helpers that the operators share: the shared folder, saved intermediate tables, slices of Arrow text."""

from __future__ import annotations

import atexit
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.functions import scratch
from weftline.functions.scratch import shared_dir

__all__ = ["drop", "fresh", "numbered", "ready", "remainder", "save", "sent", "shared_dir", "spread_join", "table", "text_digest", "text_slices"]

#: Rows and bytes of an Arrow batch where the session has the usual values: whole texts may be long, and a batch is held several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4m")}
_SAVED: dict[str, SparkSession] = {}


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package, and hand them batches of moderate size."""
    scratch.ready(spark)
    for key, (usual, ours) in BATCH.items():
        if spark.conf.get(key) == usual:
            spark.conf.set(key, ours)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: lineage ends here, so lost executors cost one table at most."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _SAVED[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


#: A saved table up to this many rows is sent to all executors; a larger one is joined by shuffle.
SEND_ROWS = 500_000


def sent(df: DataFrame) -> DataFrame:
    """A saved table of slim rows, marked for sending to all executors if its rows, which are counted first, are few."""
    return F.broadcast(df) if df.count() <= SEND_ROWS else df


def spread_join(left: DataFrame, right: DataFrame, on: list[str], count: str, rows: int, how: str = "inner") -> DataFrame:
    """left joined (inner or left) with right, which has each key once and how many of left's `rows` rows have it in the column `count`.

    Keys of very many rows, of which there are SEND_ROWS at most by their counts, are sent to all
    executors; so no key brings more than rows / SEND_ROWS rows, or 64, into one task. The column is left out.
    """
    most = max(64, -(-rows // SEND_ROWS))
    hot = F.broadcast(right.where(F.col(count) > most).drop(count))
    rest = left.join(F.broadcast(right.where(F.col(count) > most).select(*on)), on, "left_anti")
    return left.join(hot, on).unionByName(rest.join(right.where(F.col(count) <= most).drop(count), on, how))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that no column of df has, whatever their case."""
    held, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name in held:
            name += "_"
        out.append(name)
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a saved table that nothing reads any more."""
    if df is not None and (path := getattr(df, "_weft_path", None)):
        _delete(path, _SAVED.pop(path))


def _delete(path: str, spark: SparkSession) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


@atexit.register
def _clear() -> None:
    for path, spark in list(_SAVED.items()):
        try:
            _delete(path, spark)
        except Exception:  # the session has ended; the folder's owner clears it
            return


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with a number from 0 among the rows of equal keys (nulls are equal), in no set order. Rows are numbered within the partition they come from, and partitions by their counts, so a key that very many rows share is spread."""
    part, own, before, *other = fresh(df, "_part", "_own", "_before", *(f"_key{i}" for i in range(len(keys))))
    rows = save(df.withColumn(part, F.spark_partition_id()), "numbered")
    counts = rows.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(own))
    ahead = counts.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), F.col(part).alias(f"{part}_"), (F.sum(own).over(W.partitionBy(*keys).orderBy(part)) - F.col(own)).alias(before))
    same = F.col(part) == F.col(f"{part}_")
    for k, o in zip(keys, other, strict=True):
        same &= F.col(k).eqNullSafe(F.col(o))
    placed = rows.withColumn(own, F.row_number().over(W.partitionBy(*keys, part).orderBy(part)) - 1).join(ahead, same)
    return placed.withColumn(name, F.col(before) + F.col(own)).select(*df.columns, name)


def text_digest(column: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int) -> Column:
    """crc32 of a column's text form modulo n; the crc of a null counts as 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(0)) % n


def text_slices(column: pa.Array, most: int = 1 << 20, rows: int = 1 << 30):
    """Rows of a string column in runs of about `most` bytes and at most `rows` rows: (first row, row after the last, bytes, offsets from 0). A null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        hi = min(hi, lo + rows)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
