"""The corpus pipeline: quality rules, exact dedup, n-gram Jaccard join,
substring dedup and packing, each on what the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's ``docs``.  All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearsay.llm.debruijn import substring_dedup
from hearsay.llm.exact import exact_dedup
from hearsay.llm.jaccard import jaccard_components
from hearsay.llm.packing import pack
from hearsay.llm.rules import apply_rules
from hearsay.llm.store import materialize


def _only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose id is in ``ids``; a missing id matches a missing id."""
    return docs.join(ids.select(F.col("id").alias("__kept")), F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    return apply_rules(docs, measures=False, only_kept=True)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id."""
    return _only(docs, exact_dedup(docs).where("kept").select(F.col("doc_id").alias("id")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the one with the smallest id."""
    found = jaccard_components(docs)
    return _only(docs, found.where(F.col("id").eqNullSafe(F.col("component_id"))).select("id"))


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too; untouched texts stay
    as they are, the others' words are joined by one space."""
    found = substring_dedup(docs, carry=docs.columns)
    cut = F.col("n_removed") > 0
    text = F.when(cut, F.col("kept")).otherwise(F.col("carried.text"))
    chars = F.when(cut, F.length("kept")).otherwise(F.col("carried.n_chars"))
    new = {"text": text, "n_chars": chars.cast("bigint")}
    return found.select([new.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of 4096 tokens, as pieces of documents."""
    import public_tokenizers

    out = pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("n-gram Jaccard join", near),
    ("substring dedup", substrings),
    ("packing", packed),
]

#: Packing needs a tokenizer, which SQL does not have; the tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
