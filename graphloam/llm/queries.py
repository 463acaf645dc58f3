"""Registered queries of the training-data operators, with DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from . import ann, langid, lines, mixing, near, packing, pii, quality, store, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_content_store(spark, sf_dir):
    return store.chunk_store(_table(spark, sf_dir, "documents"))


def op2_quality_rules(spark, sf_dir):
    return quality.quality(_table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark, sf_dir):
    """Every vector whose id is divisible by 20 against all vectors."""
    return ann.neighbours(_table(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 20 == 0)


def op4_line_dedup(spark, sf_dir):
    return lines.line_dedup(_table(spark, sf_dir, "documents"))


def op5_near_dedup(spark, sf_dir):
    return near.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc_salvage(spark, sf_dir):
    """Pages go into archives in the shared folder, some of them damaged, and are read back; ``file`` and ``offset`` depend on how the table was split."""
    path = scratch_path(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), path, damage=warc.damage_some)
    return warc.read_warc(spark, path)


def op7_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op8_mixing(spark, sf_dir):
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text", "lang"), langid.fit(docs))
    return found.select("doc_id", "lang", "predicted", "confidence", "known_share", "accepted")


def op10_pii(spark, sf_dir):
    return pii.find_pii(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_content_store,
        op2_quality_rules,
        op3_nearest_neighbours,
        op4_line_dedup,
        op5_near_dedup,
        op6_warc_salvage,
        op7_packing,
        op8_mixing,
        op9_language_id,
        op10_pii,
    )
}

ORACLE = {"op2_quality_rules": quality.oracle()}
