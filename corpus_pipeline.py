"""A corpus from raw documents to packed sequences, one Parquet table after each stage.

Every stage takes documents with any columns beside doc_id, text, source and n_chars (extra ones stay, whatever their names), with nulls in any of them, rows and ids
that repeat, and tables without rows; what it does with these stands in its docstring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorewell.llm.catalog import tokenizer_path
from lorewell.llm.mixing import mixed
from lorewell.llm.near_dedup import keep_one
from lorewell.llm.packing import pack
from lorewell.llm.pii import redact
from lorewell.llm.shared import materialize, table
from lorewell.llm.toxicity import fit, without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. A null text is scored as an empty one; rows that repeat score alike; without labels, or with one label only, nothing goes that the labels don't say."""
    return without_toxic(docs, fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document stays, that of the smallest id. Rows that share an id but no text are documents of their own, of rows that share both one stays; rows with a null id, and those without words, all stay."""
    return keep_one(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kind, and the length follows. A null text stays null, its length too."""
    return redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it. A null source is one; null ids are ids like any other; documents without words are taken once; of rows that repeat, some may be taken once more."""
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, a row for each piece. A null text is the end mark alone; every row is a document. Small pieces and few remembered words: executors are full of what earlier stages left."""
    return pack(docs, tokenizer_path(), piece_bytes=1 << 20, remembered=150_000)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("pii", pii), ("mixing", mixing), ("packing", packing)]

#: Learnt scores and tokens are beyond SQL; the stages are tested against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
