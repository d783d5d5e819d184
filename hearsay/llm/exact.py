"""Exact dedup with keyed streaming state.  DataFrame operations only.

A ledger of (digest, id, locator) streams through an aggregation whose state
lives in RocksDB on disk, keyed by digest, without a watermark: nothing expires.
The state keeps the digest, the stable identifier of the row that stays and the
locator of its content: file and row.  Rows that hit a digest held by another row
fetch their text by their own locator and the kept row's by that of the state, and
the full bytes are compared; digests under which texts differ are resolved by the
texts themselves.  Who meets whom, and in which slice of a hot group, is settled
in narrow rows before any text moves.

Defined results: null counts as the empty text; texts are equal when identical
after lower-casing A-Z; the largest id of a group stays; rows that repeat an id
count each and share its verdict; rows without an id stay only if their whole
group has none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, fresh_dir, materialize, tidy

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "100",
    "spark.sql.streaming.stateStore.rocksdb.compactOnCommit": "false",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Rows of one group that are compared with one copy of the kept text.
SALT_ROWS = 256


def normalized(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _locator() -> Column:
    """The locator of the row that stays; of rows without an id any, but always the same."""
    return F.max_by("locator", F.struct(F.col("id").isNotNull(), F.col("id"), F.col("locator")))


def located(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, norm, locator) of each row.  Rows that do not come straight from files
    are written first, so that a locator can find them again."""
    where = F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))

    def of(df: DataFrame) -> DataFrame:
        return df.select(F.col(f"`{id_col}`").alias("id"), normalized(F.col(f"`{text_col}`")).alias("norm"), where.alias("locator"))

    try:
        return of(docs)
    except AnalysisException:
        return of(materialize(docs.select(f"`{id_col}`", f"`{text_col}`"), "exact-rows"))


def keyed_state(ledger: DataFrame, checkpoint: str) -> DataFrame:
    """digest -> keep_id, locator, group_size.  ``ledger`` is a written table;
    a later call with the same checkpoint goes on from the state it left."""
    spark = ledger.sparkSession
    source = sorted({f.rsplit("/", 1)[0] for f in ledger.inputFiles()})
    before = {k: spark.conf.get(k, None) for k in STATE}
    out = f"{checkpoint}-updates"
    empty = ledger.groupBy("digest").agg(F.max("id").alias("keep_id"), _locator().alias("locator"), F.count(F.lit(1)).alias("group_size"))
    if not source:
        return empty

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        arriving = spark.readStream.schema(ledger.schema).parquet(source[0])
        query = (
            arriving.groupBy("digest")
            .agg(F.max("id").alias("keep_id"), _locator().alias("locator"), F.count(F.lit(1)).alias("group_size"))
            .writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .foreachBatch(put)
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    # a key's last update has its largest id and count
    return spark.read.schema(empty.schema).parquet(f"{out}/*").groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max_by("locator", F.struct("group_size", "keep_id")).alias("locator"), F.max("group_size").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256, state: str | None = None) -> DataFrame:
    """One row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``digest`` and ``locator`` (file and row of the kept row).

    ``state``: a folder whose state the call goes on from and leaves behind, for
    documents that arrive in portions; rows of earlier portions count, and are
    read again by their locators where a hit asks for their bytes."""
    spark = docs.sparkSession
    rows = located(docs, id_col, text_col)
    ledger = materialize(rows.select("id", digest(F.col("norm")).alias("digest"), "locator"), "ledger")
    arrived = ledger
    if state:
        # portions arrive in one folder, which the stream goes on reading
        ledger.write.mode("append").parquet(f"{state}-ledger")
        arrived = spark.read.schema(ledger.schema).parquet(f"{state}-ledger")
    keys = materialize(keyed_state(arrived, state or fresh_dir(spark, "exact-state")), "exact-keys")
    # the hits and their slices, without any text
    hit = keys.where("group_size > 1").select("digest", "keep_id", "group_size", F.col("locator").alias("keep_locator"))
    slices = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    hits = arrived.select("digest", "locator").join(hit, "digest").withColumn("slice", F.pmod(F.xxhash64("locator"), slices).cast("int"))
    every = rows
    if state:
        earlier = _files(hits).join(_files(ledger), "file", "left_anti")
        if files := [r["file"] for r in earlier.collect()]:  # as many as files, not rows
            every = rows.unionByName(located(spark.read.parquet(*files), id_col, text_col))
    texts = every.select("locator", "norm")
    members = materialize(hits.select("digest", "slice", "locator").join(texts, "locator").select("digest", "slice", "norm"), "exact-hits")
    tidy(spark)
    kept = hit.withColumn("slices", slices).select("digest", "slices", F.col("keep_locator").alias("locator")).join(texts, "locator")
    kept = kept.select("digest", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.col("norm").alias("kept_norm"))
    unlike = members.join(kept, ["digest", "slice"]).where(F.col("norm") != F.col("kept_norm")).select("digest").distinct()
    unlike = materialize(unlike, "exact-collisions")
    out = ledger.drop("locator").join(keys.select("digest", "keep_id", "group_size", "locator"), "digest", "left")
    if not unlike.isEmpty():
        torn = lambda df: df.withColumn("digest", digest(F.col("norm"))).join(unlike, "digest", "left_semi")
        groups = torn(every).groupBy("digest", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), _locator().alias("locator"))
        solved = torn(rows).drop("locator").join(groups, ["digest", "norm"]).select("digest", "id", "keep_id", "group_size", "locator")
        out = out.join(unlike, "digest", "left_anti").unionByName(solved)
    drop(spark, members)
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.coalesce(F.col("id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        "digest",
        "locator",
    )


def _files(found: DataFrame) -> DataFrame:
    return found.select(F.substring_index("locator", "#", 1).alias("file")).distinct()
