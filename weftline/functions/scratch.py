"""Session helpers: imports of Python workers, and saved intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])
_SAVED: dict[str, SparkSession] = {}


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver imports it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a new folder where that is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="weft-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def new_path(spark: SparkSession) -> str:
    """A folder for a table, deleted by drop or when the driver ends."""
    path = f"{shared_dir(spark)}/weft-{uuid.uuid4().hex}"
    _SAVED[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back, so that an iterative plan's lineage stays short."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weft_path = path
    return out


def drop(*frames: DataFrame | None) -> None:
    """Delete saved tables that nothing reads any more."""
    for df in frames:
        if df is not None and (path := getattr(df, "_weft_path", None)) in _SAVED:
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


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def replace_table(df: DataFrame, path: str) -> None:
    """Write a table beside its place and then put it there: readers see the old one or the new one."""
    spark, own = df.sparkSession, f"{path}.{uuid.uuid4().hex}"
    try:
        df.write.parquet(own)
        fs, p = _fs(spark, path)
        fs.delete(p, True)
        if not fs.rename(_fs(spark, own)[1], p):
            raise OSError(f"could not put {path} in its place")
    finally:
        fs, p = _fs(spark, own)
        fs.delete(p, True)


class Rounds:
    """A table that grows by the rows of each round of a loop: a round is written once, and earlier ones are only read."""

    def __init__(self, first: DataFrame):
        self.spark, self.schema, self.tables = first.sparkSession, first.schema, []
        self.last = self.add(first)

    def add(self, df: DataFrame) -> DataFrame:
        self.last = cut(df)
        self.tables.append(self.last)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(t._weft_path for t in self.tables))
