"""A training corpus from `documents`: quality rules, line dedup, near-dedup,
benchmark decontamination, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept.  ``run`` writes what each stage returns to the shared folder and reads it
again, so a lost executor costs a part of one stage.  Columns besides those of
`documents` may have any names and are kept up to the last stage; a very long
text takes time and memory in proportion to its length in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loctrack.llm import bytebpe, decontaminate, line_dedup, quality_rules, simhash
from loctrack.llm.common import table, written
from loctrack.llm.queries import BYTE_BPE


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or look unlike the trusted ones go.  A null
    or short text fails a base rule; rows that repeat are judged alike and all
    stay or go; an empty table stays empty."""
    return quality_rules.keep_clean(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of repeated passages leave the texts; n_chars, where
    there is one, is that of what is left.  A null text stays null; a text may
    become empty, and its row stays; rows that repeat are changed alike."""
    found = line_dedup.dedup_lines(docs, counts=False)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the least id
    (null last); null and empty texts are one group; of rows that repeat an id and
    a text one stays."""
    return simhash.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go, also with words inserted
    or swapped.  A null or empty text holds none; rows that repeat an id with
    another text are judged by their own text."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256) of what is left: the ids, and the
    digest of the bytes that they decode to.  A null or empty text has no ids."""
    found = bytebpe.encode(docs, public_tokenizers.path(BYTE_BPE), public_tokenizers.PATTERN)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded_sha256")


STAGES = [("quality rules", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("byte-level BPE", tokens)]

#: SimHash components and BPE merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
