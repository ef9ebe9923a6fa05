"""The corpus pipeline: quality, near-duplicates, repeated passages, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. `docs` is a plain scan of written files,
so its rows are read in the same order each time. All but the last return the columns of documents; the last returns one row
for each copy that the mix holds. Labels come from sf_dir, for rows that are still there.

In all stages null texts are empty texts, null ids and rows that share an id are rows of their own, and an empty table
gives an empty one; what else a stage defines is in its docstring and in that of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import bpe, mixing, near_texts, quality_classifier, substring_dedup
from vellum.llm.common import drop, scratch, written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts. Empty texts have the share of good labels as score and stay where that is 0.3 or
    more; without labels all stay; rows that are equal fare alike; a score of exactly 0.3 is accepted."""
    voters = quality_classifier.train(docs, _labels(spark, sf_dir))
    return quality_classifier.classify(docs, voters, keep_text=True).where("predicted = 1").select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the SimHash index finds candidates, links are five-word shingle sets with a
    Jaccard similarity of 0.8 or more. The row of smallest id stays, of those the one of least digest; rows that are equal
    are one; all empty texts are one group; a row without an id stays only where its group has none."""
    return near_texts.keep_one(docs, size=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 35 words and more that occur more than once, all occurrences; n_chars follows, 0 for null
    texts. No row goes: equal rows, which near_duplicates leaves none of, would both become empty."""
    cut = substring_dedup.remove_repeated(docs, settled=True)
    return cut.withColumns({"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")), "n_chars": F.length(F.coalesce("kept_text", F.lit("")))}).select(*[F.col(f.name).cast(f.dataType) for f in docs.schema.fields])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated so that languages come to tempered shares; rates are at least 1, so no document is lost. Empty texts have no
    words and a uniform posterior, so their copies follow the mean of the rates; rows of one id share their rounding."""
    mixer, _, _, _ = mixing.fit(docs, _labels(spark, sf_dir), temper=0.7, grow=True, least_rate=1.0)
    return mixing.realised(docs, mixer)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of what they decode to, a row for each row of docs; empty texts have no ids."""
    path = bpe.tokenizer_path()
    return bpe.decode(bpe.encode(docs.select("doc_id", "text"), path, bpe.tokenizer_pattern(), settled=True), path, digests=True)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixed", mixed), ("tokens", tokens)]

#: Stages train classifiers and search by hashes; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each is written in the shared folder and read again by the next. A stage's own tables go when it
    is written, and its result when the next one is; the last result reads one stage's table."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            now = written(stage(spark, docs, sf_dir), name, lasting=True)
        if before is not None:
            drop(before)
        docs = before = now
    return STAGES[-1][1](spark, docs, sf_dir)
