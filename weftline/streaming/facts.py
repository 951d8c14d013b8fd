"""Facts that follow a source tree: scans arrive as a stream of file rows, and only changed files are parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.functions.scratch import exists, ready
from weftline.sources import parsers, project


def publish(files: DataFrame, folder: str) -> None:
    """Add a scan to the folder that follow reads."""
    files.write.mode("append").parquet(folder)


def follow(spark: SparkSession, folder: str, facts: str, checkpoint: str) -> StreamingQuery:
    """Parse what scans bring and end when all are done; run it again after further scans.

    Each batch looks up its files in the facts written so far and parses those whose path, content or
    parser version is new. A batch's facts are one part of the table (batch=n), which a repeated
    batch replaces, so a restart after a failure neither loses nor doubles any.
    """
    ready(spark)

    def step(batch: DataFrame, n: int) -> None:
        files = batch.where("status = 'parsed'").dropDuplicates(["path", "sha256"])
        todo, _ = project.split_by_cache(files, read(spark, facts, before=n), parsers.VERSION)
        parsers.facts(todo).write.mode("overwrite").parquet(f"{facts}/batch={n}")

    rows = spark.readStream.schema(project.SCHEMA).parquet(folder)
    return rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read(spark: SparkSession, facts: str, before: int | None = None) -> DataFrame | None:
    """All facts written so far, of batches before one if given; None where there are none."""
    if not exists(spark, facts):
        return None
    rows = spark.read.option("basePath", facts).schema(f"{parsers.SCHEMA}, batch int").parquet(facts)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def latest(spark: SparkSession, folder: str, facts: str) -> DataFrame:
    """Facts of the tree as its last scan saw it. Scans are told apart by the files' modification times: of a path the last content counts."""
    files = spark.read.schema(project.SCHEMA).parquet(folder).where("status = 'parsed'").select("path", "sha256", "mtime_ms")
    newest = files.withColumn("_rn", F.row_number().over(W.partitionBy("path").orderBy(F.desc("mtime_ms"), "sha256"))).where("_rn = 1").select("path", "sha256")
    return read(spark, facts).where(F.col("parser_version") == parsers.VERSION).join(newest, ["path", "sha256"], "left_semi")
