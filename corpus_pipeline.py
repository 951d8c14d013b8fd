"""Corpus pipeline over documents: quality rules, near-duplicates, secrets, mixing, packing.

Each stage works on all that the stage before kept, written as Parquet to the shared folder and read
again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import common, minhash, mixing, packing, quality, secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the trees reject go."""
    return quality.keep_good(docs, quality.fit(docs, common.table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 or more over shingles of five words one stays.

    Of a group the row of the least doc_id stays. Rows that share a doc_id with unlike texts are decided
    each by its own text; of rows with equal id and text one stays. Rows without an id, and null or
    empty texts, are no copies. An empty table stays empty; other columns go through.
    """
    return minhash.once(docs, 80, 5)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Owner-specific, live-looking credentials are replaced in the text; widely copied examples stay."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that each source's words come near its target.

    Copies are decided by row: rows that share an id, or have none, are documents of their own. A null
    source is a source, a null or empty text has no words; an empty table stays empty, and other
    columns go through.
    """
    return mixing.taken(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("secret scans", secret_scans), ("mixing sources", mix_sources), ("packing", pack)]
#: Trees, hashes and sampling have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = common.table(spark, sf_dir, "documents")
    last = None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        docs, before = common.save(out, "stage"), last
        common.drop(before)
        last = docs
    return docs
