"""A corpus made ready for training: language, near-duplicates, benchmark passages, mix and token files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colsift.llm import decontamination, language, mixing, near_duplicates, token_files
from colsift.llm.queries import END_ID, tokenizer_path
from colsift.llm.staging import staged


def free(docs: DataFrame, name: str) -> str:
    """``name``, with a number behind it where documents have a column of that name."""
    return next(c for c in (name, *(f"{name}_{i}" for i in range(len(docs.columns)))) if c not in docs.columns)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter, or without one language that is more likely than not, go.

    Null and empty texts go. Repeated rows are judged alike, ties go to the first language by name, an empty table stays empty, and
    columns of any other name are passed on.
    """
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies; of repeated rows one stays.

    Texts without words are copies of nothing and stay. A null id stays unless its text is a copy of a named document's. An empty table
    stays empty, and columns of any other name are passed on.
    """
    found = near_duplicates.near_duplicates(docs).where("kept")
    key, rows, digest = free(docs, "kept_id"), free(docs, "kept_rows"), free(docs, "kept_digest")
    kept = staged(found.groupBy(F.col("doc_id").alias(key)).agg(F.count("*").alias(rows)), "kept")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key))
    once = docs.join(kept.where(F.col(rows) == 1), same, "left_semi")
    if kept.where(F.col(rows) > 1).isEmpty():
        return once
    more = docs.join(kept.where(F.col(rows) > 1), same, "left_semi").withColumn(digest, F.sha2(F.col("text").cast("string"), 256))
    return once.unionByName(more.dropDuplicates(["doc_id", digest]).drop(digest))


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null and empty texts and items match nothing; repeated rows are judged alike."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Texts without words are not taken. A null source is one of its own. Rows of one id are taken alike, as often as all of them are.
    """
    key, times, turn = free(docs, "plan_id"), free(docs, "plan_times"), free(docs, "plan_turn")
    plan = mixing.mixed(docs).groupBy(F.col("doc_id").alias(key)).agg(F.expr("cast(sum(taken) div greatest(sum(size), 1) as int)").alias(times))
    names = docs.columns
    both = docs.join(plan.where(F.col(times) > 0), F.col("doc_id").cast("long").eqNullSafe(F.col(key)))
    return both.withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*(docs[c] for c in names))


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and every document's place in them; a document taken twice has two. Null texts are their end id only."""
    return token_files.token_offsets(docs, tokenizer_path(), END_ID)


STAGES = [("language", identify_language), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_passages),
          ("mixing", mix_sources), ("token_files", write_tokens)]
# SQL cannot express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
