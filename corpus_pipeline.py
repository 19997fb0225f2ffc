"""Corpus pipeline: quality, near-dedup, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last keep the columns of ``documents``.

Defined cases: rows are told apart by themselves, not by their ids or a hash,
so null and repeated ids and columns of any further name neither drop nor
multiply rows; null and empty texts fail the quality rules, and as input of a
later stage are one near-duplicate class, hold no passage and no secret and have no
tokens; very long texts are handled whole; of repeated rows near-dedup keeps
one, ties going to the smaller id, ids before nulls; empty tables give empty results.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import op01_simhash, op05_bpe, op07_decontamination, op08_secrets, op09_quality
from wayfold.llm.common import bucketed, materialize, read, release, scratch, unused

#: Near-duplicates here: five-word shingles and a Jaccard similarity of 0.8 or
#: more, verified on the shingles themselves.
SHINGLE, SIMILARITY = 5, 0.8


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard rules and are no outliers of their language and source."""
    whole = docs.select(F.struct(*docs.columns).alias("document"), "text", "lang", "source")
    return op09_quality.judge(whole, keep=("document",)).where("kept").select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    row = unused(docs, "row")
    numbered = bucketed(docs, row)
    named = numbered.select(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")).alias("id"), "text", row)
    heads = op01_simhash.similar(named, "id", k=SHINGLE, similarity=SIMILARITY, row=row).select(F.col("component_id.row").alias(row)).distinct()
    return numbered.join(heads, row, "left_semi").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    leaks = unused(docs, "leaks")
    return op07_decontamination.scan(docs, read(spark, sf_dir, "benchmark"), out=leaks).where(F.size(leaks) == 0).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return op08_secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    return op05_bpe.digests(docs)


def _stage(work):
    """``work``, after the tables of earlier stages are gone: their results are written by now, unless ``docs`` reads them still."""

    @functools.wraps(work)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs, "pipeline")
        with scratch("pipeline"):
            return work(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality rules", _stage(quality)),
    ("SimHash near-dedup", _stage(near_dedup)),
    ("benchmark decontamination", _stage(decontaminate)),
    ("secret scans", _stage(secrets)),
    ("byte-level BPE encoding and decoding", _stage(tokens)),
]
#: The stages fit models and walk graphs, which SQL cannot state; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
