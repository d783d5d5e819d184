"""Generic chat exports: JSON documents, JSON lines and CSV-like tables under any
of the usual field names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import epoch_or_iso, stable_id
from .base import AdapterConfig, Bundle, Capabilities

# Names a field goes by, best first, and keys that wrap a list of messages.
ALIASES = {
    "ts": ("ts", "timestamp", "time", "created_at", "createdAt", "date", "datetime", "sent_at"),
    "author": ("author", "author_raw", "agent", "agent_name", "agent_id", "sender", "from", "user", "username", "name", "speaker", "role"),
    "text": ("text", "content", "message", "body", "msg"),
    "channel": ("channel", "channel_id", "room", "room_id", "chat_room_id", "thread", "conversation", "conversation_id"),
    "id": ("id", "event_id", "message_id", "uuid"),
    "parent": ("parent_id", "reply_to", "parent", "in_reply_to"),
    "alt": ("author_alt", "user_id", "sender_id", "author_id"),
}
WRAPPERS = ("messages", "events", "transcript", "items", "data")


def _plain(df: DataFrame, name: str):
    """A field as text: nested authors by name, content blocks joined."""
    kind, c = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.StructType):
        inner = [F.nullif(c[k].cast("string"), F.lit("")) for k in ("name", "id") if k in kind.fieldNames()]
        return F.coalesce(*inner, F.to_json(c))
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, T.StructType):
            keys = kind.elementType.fieldNames()
            block = (lambda b: F.coalesce(b["text"].cast("string"), F.lit(""))) if "text" in keys else (lambda b: F.to_json(b))
            return F.array_join(F.filter(F.transform(c, block), lambda x: x != ""), "\n")
        return F.array_join(c.cast("array<string>"), "\n")
    return c.cast("string")


def field(df: DataFrame, what: str, mapping: dict[str, str] | None = None):
    names = [mapping[what]] if mapping and what in mapping else [n for n in ALIASES[what] if n in df.columns]
    found = [F.nullif(_plain(df, n), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def normalize(rows: DataFrame, mapping: dict[str, str] | None = None, default_channel: str = "chat") -> DataFrame:
    """Canonical events; rows with blank text go."""
    e = rows.select(*[field(rows, w, mapping).alias(w) for w in ALIASES])
    e = e.where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    channel = F.coalesce("channel", F.lit(default_channel))
    return e.select(
        F.coalesce("id", stable_id(F.coalesce("ts", F.lit("")), F.coalesce("author", F.lit("")), F.substring("text", 1, 200))).alias("event_id"), epoch_or_iso(F.col("ts")).alias("ts"), channel.alias("channel"),
        F.coalesce("author", "alt", F.lit("unknown")).alias("author_raw"), F.coalesce("alt", F.lit("")).alias("author_alt"), "text", F.col("parent").alias("parent_id"),
        F.lit(None).cast("timestamp").alias("visible_until"), F.lit("").alias("channel_family"), F.lit("").alias("source_ref"),
    )


def flatten(doc: DataFrame) -> DataFrame:
    """Whole documents to messages: a list under a wrapper key, or {room: [...]}."""
    wrapped = [w for w in WRAPPERS if w in doc.columns and isinstance(doc.schema[w].dataType, T.ArrayType)]
    if wrapped:
        return doc.select(F.explode(F.col(f"`{wrapped[0]}`")).alias("m")).select("m.*")
    rooms = [f.name for f in doc.schema.fields if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if rooms and len(rooms) == len(doc.columns):
        out = None
        for r in rooms:
            part = doc.select(F.explode(F.col(f"`{r}`")).alias("m")).select("m.*")
            part = part if any(n in part.columns for n in ALIASES["channel"]) else part.withColumn("channel", F.lit(r))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out
    return doc


def read(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines first, else one JSON document; gzip by its name."""
    rows = spark.read.option("mode", "PERMISSIVE").json(path)
    if "_corrupt_record" in rows.columns or not rows.columns:
        rows = spark.read.option("multiLine", True).json(path)
    if rows.columns == ["_corrupt_record"] or not rows.columns:
        raise ValueError(f"no JSON in {path}")
    return flatten(rows)


class ChatAdapter:
    name = "chat"

    def sniff(self, spark: SparkSession, path: str) -> bool:
        rows = read(spark, path)
        return any(n in rows.columns for n in ALIASES["text"]) and any(n in rows.columns for n in (*ALIASES["author"], *ALIASES["ts"]))

    def config(self) -> AdapterConfig:
        return AdapterConfig(name=self.name)

    def load(self, spark: SparkSession, path: str, mapping: dict[str, str] | None = None) -> Bundle:
        events = normalize(read(spark, path), mapping)
        n = events.agg(F.count(F.lit(1)).alias("n"), F.count("ts").alias("timed")).first()
        caps = Capabilities(has_wall_clock=bool(n["n"]) and n["timed"] > 0.9 * n["n"], has_threading=True)
        return Bundle(events=events, capabilities=caps, notes={"posts": n["n"], "timed": n["timed"]})
