"""The registered queries of this folder: each applies one operator to its whole
table, and derives the result columns from the operator's own output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROBE = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .debruijn import substring_dedup

    out = substring_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import format_trees, linear, read_back

    talks = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    back = read_back(format_trees(linear(talks.unionByName(probe))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact import exact_dedup

    out = exact_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import jaccard_components

    out = jaccard_components(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_decode

    out = encode_decode(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import apply_rules

    out = apply_rules(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    out = scan_licenses(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffixes import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_bytes"), "n_removed", F.size("removed_start").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .transducer import count_tokens

    out = count_tokens(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op11_turn_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turns import payload, reassemble

    rows = _table(spark, sf_dir, "conversations").where("turn is not null").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    name = F.concat_ws(":", F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("turn").cast("string"))
    rows = rows.withColumn("h", F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("bigint"))
    once = F.struct((F.col("h") % 8).alias("batch"), "role")
    again = F.struct(((F.col("h") + 3) % 8).alias("batch"), F.lit("user").alias("role"))
    arrivals = rows.withColumn("a", F.explode(F.when(F.col("h") % 7 < 2, F.array(once, again)).otherwise(F.array(once)))).select("conv", "turn", "a.role", "text", "a.batch")
    out = reassemble(arrivals, 8)
    turns = F.array_join(F.col("unreleased").cast("array<string>"), ",")
    return out.select(
        "event",
        F.sha2(F.when(F.col("event") == "close", turns).otherwise(payload(F.col("role"), F.col("text"))), 256).alias("sha256"),
        F.col("conv").alias("conv_id"),
        F.coalesce("turn", F.lit(-1)).cast("bigint").alias("turn"),
        "batch",
        "n_missing",
        "n_breaks",
    )


def damaged(turns: DataFrame) -> DataFrame:
    """conv, turn, role, text of the turns after damage by the checksum of their name."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").alias("conv"), "turn", space("role").alias("role"), space("text").alias("text"), (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role"))
    out = rows.where("h <> 0").select("conv", "turn", role.alias("role"), text.alias("text"), F.when(F.col("h") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("n"))
    return out.withColumn("n", F.explode("n")).drop("n")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repair import repair

    turns = _table(spark, sf_dir, "conversations")
    report, repaired = repair(damaged(turns))
    lines = F.array_sort(F.collect_list(F.struct("pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))))
    digests = repaired.groupBy(F.col("conv").alias("of")).agg(F.sha2(F.array_join(F.transform(lines, lambda x: x["line"]), "\n"), 256).alias("repaired_sha256"))
    every = turns.select("conv_id").distinct()
    found = every.join(report, every["conv_id"].eqNullSafe(report["conv"]), "left").join(digests, every["conv_id"].eqNullSafe(digests["of"]), "left")
    none = F.lit(0).cast("bigint")
    return found.select(
        "conv_id",
        *[F.coalesce(F.col(c), none).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .shards import shard

    out = shard(_table(spark, sf_dir, "documents"), 8)
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_chat": op3_chat,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality_rules": op7_quality_rules,
    "op8_license_scan": op8_license_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_token_counts": op10_token_counts,
    "op11_turn_reassembly": op11_turn_reassembly,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_sharding": op13_sharding,
}
