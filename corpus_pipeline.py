"""The training-corpus pipeline: five stages over ``documents``, each an operator of ``concord.llm``.

A stage is ``(name, function)``; the function takes ``(spark, docs, sf_dir)`` and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``.  All but the last
return the columns of ``documents``.  Null and empty texts are not toxic, have no language and so go in
the second stage; empty tables pass through as empty ones; other columns are kept, but none may begin
with an underscore.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm import language, ngram_join, packing, substrings, toxicity
from concord.llm.folds import fold
from concord.session import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below one half; those with null or empty texts stay."""
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, to="_score").where("_score < 0.5").select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages; those below the margin, null texts and texts without a letter go.

    Margins are calibrated on all labelled documents of the training folds.
    """
    return language.identify_calibrated(docs, fold() != 0).where("not rejected").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group that Jaccard 0.8 of five-word shingles links.

    Rows are told apart by id and text, so that a repeated id does not keep another row's near copy; of
    rows equal in both one stays.  Texts are moved for such rows only.
    """
    marked = docs.withColumn("_row", F.xxhash64("doc_id", "text"))
    groups = ngram_join.ngram_components(marked, key="_row", k=5, p=80, q=100).distinct()
    named = groups.join(marked.select("_row", "doc_id").distinct(), "_row")
    heads = named.groupBy("component_id").agg(F.min_by("_row", F.struct("doc_id", "_row")).alias("_row")).select("_row")
    kept = cut(marked.join(heads, "_row", "left_semi"), "heads")
    again = cut(kept.groupBy("_row").agg(F.count("*").alias("n")).where("n > 1").select("_row"), "again")
    once = kept if again.isEmpty() else kept.join(again, "_row", "left_anti").unionByName(kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return once.select(*docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, less the words of windows of 35 words that occur more than once; ``n_chars`` is counted anew."""
    kept = substrings.dedup(docs, size=35)
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack),
]

#: No SQL expresses the classifiers or the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, one after the other."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out = cut(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
