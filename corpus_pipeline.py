"""The corpus pipeline: each stage works on all rows that the stage before it kept."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from titerflow.llm.common import ID, SUB, same, table, with_key
from titerflow.llm.contamination import decontaminated
from titerflow.llm.mixing import mixed_documents
from titerflow.llm.neardup import near_duplicates
from titerflow.llm.quality import accepted
from titerflow.llm.queries import word_tokenizer
from titerflow.llm.tokens import tokenized
from titerflow.session import temp_table_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates: five-word shingles, similarity 0.8.

    A row without an id stays.  An id stands for one document: of several rows with it the one with the longest text
    stays, of these the one whose text, then whose other columns (maps aside) sort first.
    """
    kept = near_duplicates(docs, words=5, percent=80).where("kept").select(F.col("doc_id").alias(ID)).distinct()
    keyed = with_key(docs, "doc_id", "text")
    held = keyed.join(kept, same(keyed, kept, ID), "left_semi")
    repeats = keyed.groupBy(ID).count().where(f"count > 1 and {ID} is not null").limit(1).count() > 0
    if repeats:  # an id that stands for several rows leaves one of them
        others = [c for c, kind in docs.dtypes if not any(k in kind for k in ("map<", "variant"))]
        order = F.struct((-F.coalesce(F.length("text"), F.lit(-1))).alias("short"), F.struct("text", *[c for c in others if c != "text"]).alias("row"))
        chosen = held.where(F.col(ID).isNotNull()).groupBy(ID).agg(F.min_by(F.struct(*held.columns), order).alias("kept"))
        one = chosen.select("kept.*")
        held = one.unionByName(held.where(F.col(ID).isNull()))
    return held.select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"), words=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by weight, as documents: one row per document and pass over it."""
    return mixed_documents(docs, weights=(5, 2, 1), limit=3)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's ids, written as directly addressable codes in ascending id order and read back."""
    done = tokenized(docs, word_tokenizer(), end_id=1)
    return done.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-id binary output", token_files),
]

#: The classifier, the mix's permutations and the tokenizer are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        if at:
            path = temp_table_path(spark, f"stage-{uuid.uuid4().hex}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
        docs = stage(spark, docs, sf_dir)
    return docs
