"""The corpus pipeline: language ID, line dedup, near dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloam.llm import langid, lines, mixing, near, packing
from graphloam.session import drop_table, write_table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on labelled rows of ``docs``; rejected documents go, and ``lang`` is what the model says.

    Null, empty and unlettered texts are rejected, as is every row where none has text and label. Texts of any length count
    whole. Equal rows fare alike. Null ids and sources stay. An empty table stays empty. Other columns pass through
    whatever their names, those that the operator uses included.
    """
    scored = langid.identify(docs, langid.fit(docs))
    predicted, accepted = scored.columns[len(docs.columns)], scored.columns[-1]
    return scored.where(F.col(accepted)).select(*(F.col(predicted if c == "lang" else f"`{c}`").alias(c) for c in docs.columns))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out, count the characters anew; a document of nothing but repeated lines goes.

    Null and empty texts stay as they are, and a null text has no count. The first of equal lines is the one with the least
    doc_id (nulls last), then text hash, then place. Rows with equal doc_id and text come out alike. An empty table stays
    empty. Other columns pass through whatever their names.
    """
    done = lines.line_dedup(docs)
    dropped = done.columns[-1]
    kept = done.where((F.col(dropped) == 0) | F.col(dropped).isNull() | (F.trim(F.regexp_replace("text", "\n", "")) != ""))
    return kept.select(*(F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the least doc_id (nulls last).

    Null and blank texts are in no group and stay. Of rows with equal doc_id and text one stays. An empty table stays
    empty. Other columns pass through whatever their names.
    """
    return near.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample in which the sources have their target weights, in shuffled shards.

    Null and empty texts and null ids are rows like others, equal rows are taken one by one, and the null source is a
    source. An empty table stays empty. Other columns pass through whatever their names.
    """
    return mixing.mix_sources(docs).select(*(F.col(f"`{c}`") for c in docs.columns))


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of token ids over mixing's shards, each in its shuffled order; both are found again from what mixing kept.

    Null and empty texts are in no window; equal rows are each packed. No documents give no windows. Other columns have no
    effect but on the order of the shuffle.
    """
    mixed = mixing.mixed_order(docs)
    shard, position = mixed.columns[-2:]
    return packing.pack(mixed, shard_col=shard, order_col=position)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Training, sampling and packing aren't expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written in the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
