"""Training-data pipeline over `documents`: five stages, each written as Parquet and read again.

1. quality rules: failing lines go, and so do documents that are rejected
2. near-duplicates at a similarity of SIMILAR_PERCENT or more: of each group one document stays
3. benchmark decontamination: documents that hold a benchmark window go
4. secret scans: secrets are masked in the text
5. best-fit packing: the remaining texts as token sequences

Every stage but the last returns the columns of the documents it is given. Rows that share a doc_id are
one document to the near-duplicate stage: they stay or go together, fully equal rows too; rows without
a doc_id pass it. Decontamination judges every row by its own text, whatever its doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import cut_lineage, table
from rankloom.llm.decontamination import decontaminate
from rankloom.llm.minhash_dedup import near_duplicates
from rankloom.llm.packing import pack
from rankloom.llm.quality_rules import cleaned_documents
from rankloom.llm.secret_scan import redacted_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
SIMILAR_PERCENT = 80  # of word shingles; the 85 of op1_minhash_dedup is that query's own


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned_documents(docs)


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    copies = near_duplicates(docs, percent=SIMILAR_PERCENT).filter(~F.col("kept")).select(F.col("doc_id").alias("gone"))
    return docs.join(copies.hint("merge"), docs["doc_id"] == F.col("gone"), "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    hit = found.filter("contaminated").select(F.col("doc_id").alias("gone"), F.col("tag").alias("gone_text"))
    text = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(hit, docs["doc_id"].eqNullSafe(F.col("gone")) & (text == F.col("gone_text")), "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redacted_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicate),
    ("decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packing),
]

# tokenizers and a fitted field can't be written in SQL; tests/llm holds a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
