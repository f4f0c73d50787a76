"""Corpus pipeline over ``documents``: language, quality, near-duplicates,
benchmark passages, packing.

Every stage takes (spark, docs, sf_dir), works on all rows that the stage
before it kept and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridquarry.llm.decontaminate import decontaminate, without_places
from gridquarry.llm.language_id import identify_language
from gridquarry.llm.packing import pack
from gridquarry.llm.quality import fit_quality, score_quality
from gridquarry.llm.shared import numbered, shared_dir
from gridquarry.llm.simhash import simhash_groups

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Dearest code, in bits a byte, of a text that counts as in a known language.
#: Clean text costs 2 to 3; random bytes cost 8.
MOST_BITS = 6.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language: those with a letter whose best code is at
    most ``MOST_BITS`` a byte. Null, empty and letterless texts go. Rows that
    repeat, or have null or equal ids, are judged one by one; a long text is
    scored whole; an empty table gives none; other columns are dropped."""
    found = identify_language(docs, carry=COLUMNS)
    return found.where((F.col("lang_pred") != "und") & (F.col("bits_per_byte") <= MOST_BITS)).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the rules predict to be of quality 1. Null and empty
    texts are judged by the statistics of the empty text; rows that repeat, or
    have null or equal ids, one by one; a long text is measured whole; an empty
    table gives none; other columns are dropped."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_quality(docs, model, carry=COLUMNS).where("predicted = 1").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash group: the one with the smallest id,
    of equal ids the first row; a null id counts as largest. Null and empty
    texts are one group; a long text is hashed whole; an empty table gives
    none; other columns are dropped."""
    rows = numbered(docs.select(*COLUMNS))
    # Null ids sort last, equal ids by row.
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id").alias("rank")
    groups = simhash_groups(rows.select(rank, "text"), key="rank")
    kept = groups.where("doc_id = component_id").select("doc_id.row_id")
    return rows.join(kept, "row_id", "left_semi").select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item. Null and empty
    texts hold none and stay; rows with null or equal ids are told apart by
    their texts; a long text is looked through whole; an empty table gives
    none; other columns are dropped."""
    return without_places(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 1024 tokens. A null or empty text
    is its end token; a long one fills several sequences; rows that repeat, or
    have null or equal ids, are packed each; an empty table gives none."""
    import public_tokenizers

    return pack(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json")).drop("ids")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("packing", packing),
]

#: Language models, rules and tokens have no form in SQL; tests compare the
#: stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.schema(docs.schema).parquet(path)
    return docs
