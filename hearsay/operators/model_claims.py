"""Claims from a language model: candidates, cached calls and the merge with rules.

The client is any callable from a request's text to a reply of ``REPLY``'s form, or
to its list of claims alone; none ships with the engine.  Replies are cached by
(model, event_id) in a Parquet table, so a rerun asks only for posts that have none.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.items import canonical_item
from ..functions.text import stable_id

# What makes a post worth asking about, and the fields of a reply.
KEYWORDS = r"(?i)answer|submitt|expect|predict|CONFIRMED|arrived|\bR\d\b|\bG\d\b"
REPLY = {
    "type": "object",
    "properties": {
        "claims": {
            "type": "array",
            "items": {
                "type": "object",
                "properties": {
                    "event_type": {"enum": ["answer", "prediction"]}, "episode": {"type": ["integer", "null"]}, "item": {"type": ["string", "null"]}, "value": {"type": ["string", "null"]},
                    "latency_class": {"enum": ["instant", "delayed", None]}, "timer_s": {"type": ["number", "null"]}, "wrong": {"type": "boolean"}, "correct": {"type": "boolean"},
                },
                "required": ["event_type"],
            },
        },
        "independent_claim": {"type": "boolean"},
        "disputes_value": {"type": "boolean"},
    },
    "required": ["claims"],
}
PROMPT = (
    "The post below is by one of many agents that answer timed rounds of questions (R3, G3, #3) and tell each other. List its claims as JSON of the given schema: "
    "an answer for each round that the author reports to have answered, a prediction for each value that the author expects of a round to come. "
    "Leave out values that are only quoted, tabulated or asked about. item is what the question is about; value is the number as written, without % and thousands separators, several joined by /. "
    "latency_class is instant up to two seconds, delayed above, null if nothing is said. wrong and correct are what the author says of the answer. "
    "independent_claim: the author worked the value out; disputes_value: the author calls a posted value wrong."
)
_CLAIM = "struct<event_type:string,episode:double,item:string,value:string,value_raw:string,latency_class:string,timer_s:double,wrong:boolean,correct:boolean>"


def candidates(posts: DataFrame) -> DataFrame:
    """Posts of a task family that a keyword makes worth asking about."""
    known = posts.where("family <> ''") if "family" in posts.columns else posts
    return known.where(F.col("text").rlike(KEYWORDS))


def request(posts: DataFrame) -> Column:
    """What the client is asked: family, author and channel where there are any, and the whole post."""
    told = {"Task family": "family", "Author": "author_raw", "Channel": "channel"}
    head = [F.concat(F.lit(f"{name}: "), F.coalesce(F.col(c), F.lit("")), F.lit("\n")) for name, c in told.items() if c in posts.columns]
    return F.concat(*head, F.lit("Post:\n"), "text")


def ask(posts: DataFrame, client: Callable[[str], dict | list], model: str, cache: DataFrame | None = None) -> DataFrame:
    """(model, event_id, reply): posts that the cache has not, asked by batches; a
    failed call gives no row and is asked again next time."""
    asked = candidates(posts)
    todo = asked.select("event_id", request(asked).alias("text"))
    if cache is not None:
        todo = todo.join(cache.where(F.col("model") == model).select("event_id"), "event_id", "left_anti")

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for event_id, text in zip(batch["event_id"], batch["text"], strict=True):
                try:
                    rows.append((model, event_id, json.dumps(client(text))))
                except Exception:  # the caller's client may fail in any way
                    continue
            yield pd.DataFrame(rows, columns=["model", "event_id", "reply"])

    return todo.mapInPandas(call, "model string, event_id string, reply string")


def parse(replies: DataFrame) -> DataFrame:
    """The claims of each reply, in the fields of the rules; a reply that is no JSON has none."""
    listed = F.coalesce(F.from_json("reply", f"struct<claims:array<{_CLAIM}>>")["claims"], F.from_json("reply", f"array<{_CLAIM}>"))
    c = replies.select("event_id", *(["model"] if "model" in replies.columns else []), F.posexplode(listed).alias("k", "c")).where("c is not null")
    name = F.concat(F.lit("llm:"), F.coalesce("model", F.lit(""))) if "model" in replies.columns else F.lit("llm")
    item = F.nullif(F.trim("c.item"), F.lit(""))
    return c.select(
        stable_id(F.col("event_id"), F.lit("llm"), F.col("k")).alias("claim_id"), "event_id", canonical_item(item).alias("item"), F.coalesce("c.value", "c.value_raw").alias("value_raw"), "c.episode", "c.latency_class", "c.timer_s",
        F.coalesce("c.wrong", F.lit(False)).alias("wrong_flag"), F.coalesce("c.correct", F.lit(False)).alias("correct_flag"), F.coalesce("c.event_type", F.lit("answer")).alias("event_type"), name.alias("extractor"),
    )


def post_flags(replies: DataFrame) -> DataFrame:
    """Whether a post's author worked a value out, and whether they dispute one."""
    r = F.from_json("reply", "struct<independent_claim:boolean,disputes_value:boolean>")
    return replies.select("event_id", F.coalesce(r["independent_claim"], F.lit(False)).alias("is_independent"), F.coalesce(r["disputes_value"], F.lit(False)).alias("disputes_value"))


def merge(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Posts the model covered keep its rows, with gaps filled from the rule row of
    the same (event_id, event_type, item); other posts keep their rule rows."""
    key = ["event_id", "event_type", "item"]
    rest = [c for c in rules.columns if c not in key and c not in ("claim_id", "extractor")]
    once = rules.dropDuplicates(key)
    joined = model.alias("m").join(once.alias("r"), [F.col(f"m.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key], "left")
    have = set(model.columns)
    filled = [F.coalesce(F.col(f"m.{c}"), F.col(f"r.{c}")).alias(c) if c in have else F.col(f"r.{c}").alias(c) for c in rest]
    ext = F.concat(F.col("m.extractor"), F.when(F.col("r.claim_id").isNotNull(), "+rule").otherwise("")).alias("extractor")
    claim = F.coalesce("m.claim_id", "r.claim_id") if "claim_id" in have else F.col("r.claim_id")
    covered = joined.select(claim.alias("claim_id"), *[F.col(f"m.{k}").alias(k) for k in key], *filled, ext)
    other = rules.join(model.select("event_id").distinct(), "event_id", "left_anti")
    return covered.unionByName(other.select(covered.columns))
