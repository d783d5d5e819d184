"""Text operators on rendered posts: the oracle selects what was rendered."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import BIND, _events, _mentions, _with, query, table
from .functions import text as tx
from .functions.items import ItemMatcher
from .operators import extract, relay, trees
from .sources import chat

COUNTRY = ["Poland", "Hungary", "Estonia", "Norway", "Chile", "Japan", "Kenya", "Peru", "Spain", "Malta"]
MONTH = ["Jan", "Mar", "May", "Jul", "Sep", "Nov"]
SQL_COUNTRY = "[" + ", ".join(f"'{c}'" for c in COUNTRY) + "]"
SQL_MONTH = "[" + ", ".join(f"'{c}'" for c in MONTH) + "]"

#: What the posts below say, as columns.
SAID = f"""q AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_id AS n, {SQL_COUNTRY}[CAST(k % 10 AS INT) + 1] AS country, k % 9 + 1 AS round_no, k % 50 + 10 AS whole, k % 10 AS tenth,
 {SQL_MONTH}[CAST(user_id % 6 AS INT) + 1] AS month, user_id % 28 + 1 AS day, user_id, k FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'click') x)"""
VALUE = "whole || CASE WHEN tenth > 0 THEN '.' || tenth ELSE '' END"


def _said(spark, d):
    e = _events(spark, d).where("event_type = 'click'")
    k = F.col("k")
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    return e.select(
        "event_id", "ts", "user_id", "k", F.lit("board").alias("channel"), F.lit("trade").alias("family"), F.lit("").alias("channel_family"), pick(COUNTRY, k % 10).alias("country"), (k % 9 + 1).alias("round"), (k % 50 + 10).alias("whole"), (k % 10).alias("tenth"),
        F.concat(pick(MONTH, F.col("user_id") % 6), F.lpad((F.col("user_id") % 28 + 1).cast("string"), 2, "0"), F.lit("-runner"), "user_id").alias("author_raw"),
    ).withColumn("agent_strict", F.col("author_raw")).withColumn("agent_merged", F.col("author_raw"))


def _render(spark, d, pattern: str, *cols):
    return _said(spark, d).withColumn("text", F.format_string(pattern, *cols))


def _answers(spark, d):
    return _render(spark, d, "%s R%d CONFIRMED: %s arrived 10:00:00, 56s timer; answered %d.%d%% instantly. -- %s", F.substring("author_raw", 1, 5), "round", "country", "whole", "tenth", "author_raw")


@query(_with(SAID) + f" SELECT event_id, 'answer' AS event_type, country AS item, CAST(round_no AS DOUBLE) AS episode, {VALUE} AS value_norm, 'instant' AS latency_class, 56.0 AS timer_s, false AS wrong_flag FROM q")
def claims_answer(spark, d):
    return extract.answer_claims(_answers(spark, d), ItemMatcher()).select("event_id", "event_type", "item", "episode", "value_norm", "latency_class", "timer_s", "wrong_flag")


@query(_with(SAID) + " SELECT event_id, country AS item, CASE WHEN k % 40 <= 2 THEN 'instant' ELSE 'delayed' END AS latency_class, CAST(k % 40 AS DOUBLE) AS latency_s, k % 3 = 0 AS wrong_flag FROM q")
def claims_latency(spark, d):
    posts = _render(spark, d, "R%d %s arrived 10:00:00; answered %d.%d%% at 10:00:%02d%s", "round", "country", "whole", "tenth", F.col("k") % 40, F.when(F.col("k") % 3 == 0, " as a guess").otherwise(""))
    return extract.answer_claims(posts, ItemMatcher()).select("event_id", "item", "latency_class", "latency_s", "wrong_flag")


@query(_with(SAID) + " SELECT event_id, country AS item, CAST(round_no AS DOUBLE) AS episode, CAST(whole * 1000 + tenth AS VARCHAR) AS value_norm FROM q")
def claims_equation(spark, d):
    posts = _render(spark, d, "G%d CONFIRMED: %s = %d,%03d", "round", "country", "whole", "tenth")
    return extract.equation_claims(posts, ItemMatcher()).select("event_id", "item", "episode", "value_norm")


@query(_with(SAID) + f" SELECT event_id, country AS item, CAST(round_no AS DOUBLE) AS episode, {VALUE} AS value_norm FROM q")
def claims_prediction(spark, d):
    posts = _render(spark, d, "R%d open. Next expected %s %d.%d%% soon", "round", "country", "whole", "tenth")
    return extract.prediction_claims(posts, ItemMatcher()).select("event_id", "item", "episode", "value_norm")


@query(_with(SAID) + " SELECT event_id, country AS item, CAST(round_no AS DOUBLE) AS episode FROM q WHERE k % 4 <> 0")
def claims_sequence(spark, d):
    posts = _render(spark, d, "R%d%s confirmed: %s next", "round", F.when(F.col("k") % 4 == 0, " deadline").otherwise(""), "country")
    return extract.sequence_claims(posts, ItemMatcher()).select("event_id", "item", "episode")


@query(_with(SAID) + f" SELECT event_id, 'trade' AS family, country AS item, {VALUE} AS value_key FROM q")
def mentions_extracted(spark, d):
    return extract.mentions(_answers(spark, d), ItemMatcher(), urls=False).select("event_id", "family", "item", "value_key")


@query(_with(SAID) + " SELECT event_id, k % 2 = 0 AS is_request, k % 3 = 0 AS is_independent, k % 5 = 0 AS is_correction, true AS is_arrival, false AS is_prediction, CASE WHEN k % 7 = 0 THEN 'proxy' ELSE '' END AS techniques FROM q")
def tags_flags(spark, d):
    k = F.col("k")
    posts = _render(spark, d, "%s arrived%s%s%s%s", "country", F.when(k % 2 == 0, ", please share").otherwise(""), F.when(k % 3 == 0, ", own lookup").otherwise(""), F.when(k % 5 == 0, ", actually late").otherwise(""), F.when(k % 7 == 0, " via proxy.site").otherwise(""))
    return extract.tags(posts, None, {"proxy": r"proxy\.site"}).select("event_id", "is_request", "is_independent", "is_correction", "is_arrival", "is_prediction", F.array_join("techniques", ",").alias("techniques"))


@query(_with(SAID) + " SELECT event_id, 'agent-' || user_id || ',Helper' || tenth AS cites FROM q")
def citations(spark, d):
    posts = _render(spark, d, "thanks Helper%d and @agent-%d for it", "tenth", "user_id")
    return extract.tags(posts).select("event_id", F.array_join(F.array_sort("cites", lambda a, b: F.when(a == b, 0).when(F.lower(a) < F.lower(b), -1).otherwise(1)), ",").alias("cites"))


@query("""SELECT 'trade' AS family, unnest(['Business', 'Fine Arts', 'Law & Order']) AS item""")
def learned_items(spark, d):
    names = F.array(*[F.lit(x) for x in ("Business", "Fine Arts", "Law & Order", "Poland at")])
    posts = _said(spark, d).withColumn("text", F.format_string("R%d CONFIRMED: %s arrived", "round", F.get(names, (F.col("k") % 4).cast("int"))))
    return extract.learn_items(posts)


@query("SELECT 'trade' AS family, * FROM (VALUES ('Poland', 1), ('Hungary', 2), ('Estonia', 3)) v(item, position)")
def learned_sequences(spark, d):
    odd = F.col("k") % 9 == 0
    posts = _said(spark, d).withColumn("text", F.when(odd, "Hungary -> Poland -> Estonia").otherwise("Poland -> Hungary -> Estonia"))
    return extract.learn_sequences(posts, ItemMatcher())


@query(_with(SAID) + " SELECT DISTINCT month || lpad(CAST(day AS VARCHAR), 2, '0') || '-runner' || user_id AS author_raw, lower(month || lpad(CAST(day AS VARCHAR), 2, '0')) || '-runner' || user_id AS agent_strict, month || lpad(CAST(day AS VARCHAR), 2, '0') || '|trade' AS agent_merged, month || lpad(CAST(day AS VARCHAR), 2, '0') AS cohort FROM q")
def cohort_identity(spark, d):
    posts = _answers(spark, d)
    return extract.resolve_agents(posts).select("author_raw", "agent_strict", "agent_merged", "cohort")


@query(_with(SAID) + """, f AS (SELECT event_id, month || lpad(CAST(day AS VARCHAR), 2, '0') || '-runner' || user_id AS author, CASE WHEN k % 2 = 0 THEN 'runner' || (user_id % 7) END AS cited FROM q),
 a AS (SELECT DISTINCT author FROM f), n AS (SELECT lower(author) AS token, max(author) AS src FROM a GROUP BY 1)
 SELECT src, author AS dst, event_id FROM (SELECT event_id, author, (SELECT max(author) FROM a WHERE lower(author) = lower(x.name)) AS src FROM (SELECT *, (SELECT min(author) FROM a) AS name FROM f WHERE cited IS NOT NULL) x) WHERE src <> author""")
def citation_edges(spark, d):
    posts = _said(spark, d)
    agents = posts.select("author_raw").distinct().select("author_raw", F.col("author_raw").alias("agent_merged"), F.lit(None).cast("string").alias("cohort"))
    least = posts.agg(F.min("author_raw").alias("name"))
    cites = F.when(F.col("k") % 2 == 0, F.array("name"))  # one name for all
    tagged = posts.join(least, how="cross").select("event_id", "agent_merged", "family", cites.alias("cites"))
    return relay.citation_edges(tagged, agents, "agent_merged").select("src", "dst", "event_id")


# ------------------------------------------------------------------ scalar functions


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p = '0' THEN '0' ELSE p END AS value_norm FROM (SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(printf('%.4f', l_extendedprice), '0+$', ''), '\\.$', '') || '/' || CAST(CAST(l_quantity AS INT) AS VARCHAR) AS p FROM lineitem)""")
def norm_value(spark, d):
    li = table(spark, d, "lineitem")
    raw = F.format_string("%,.2f%%; %d", "l_extendedprice", F.col("l_quantity").cast("int"))
    return li.select("l_orderkey", "l_linenumber", tx.norm_value(raw).alias("value_norm"))


@query("SELECT doc_id, substr(sha1(doc_id || chr(31) || source || chr(31) || lang), 1, 16) AS id FROM documents")
def stable_id(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.stable_id(F.col("doc_id"), F.col("source"), F.col("lang")).alias("id"))


@query("SELECT md5(key) AS key, count(*) AS n FROM (SELECT lower(trim(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g'), '[ \\t-\\r\\x1c-\\x1f]+', ' ', 'g'))) AS key FROM documents) GROUP BY 1")
def norm_key(spark, d):
    return table(spark, d, "documents").select(F.md5(tx.norm_key(F.col("text"))).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query(_with(BIND) + " SELECT event_id, split_part(value_key || '/' || item, '/', 1) AS value_key FROM m")
def value_key(spark, d):
    return _mentions(spark, d).select("event_id", tx.value_key(F.concat_ws("/", "value_key", "item")).alias("value_key"))


@query("SELECT page_id, split_part(regexp_replace(url, '^https?://', ''), '/', 1) AS host FROM pages")
def url_host(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_host(F.col("url")).alias("host"))


@query(r"""SELECT page_id, unnest(list_transform(list_distinct(regexp_extract_all(html, 'https?://[^\s\]\)\|''"<>]+')), lambda u: rtrim(u, '.,;'))) AS url FROM pages""")
def url_facts(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(tx.urls_of(F.col("html"))).alias("url"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN epoch_us(date_trunc('second', ts)) WHEN 1 THEN epoch_us(ts) WHEN 2 THEN epoch_us(date_trunc('second', ts)) END AS ts FROM events""")
def date_literals(spark, d):
    e = table(spark, d, "events")
    n, ts = F.col("event_id") % 4, F.col("ts")
    us = F.unix_micros(ts)
    text = F.when(n == 0, F.date_format(ts, "yyyyMMddHHmmss")).when(n == 1, F.format_string("%d.%06d", F.floor(us / 1000000).cast("bigint"), F.pmod(us, F.lit(1000000)))).when(n == 2, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("current")
    return e.select("event_id", F.unix_micros(tx.date_literal(text)).alias("ts"))


@query("""SELECT event_id, CAST(k * 60 + v AS DOUBLE) AS secs, CAST(k % 12 * 3600 + v * 60 + k AS INT) AS clock FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) % 60 AS k, event_id % 60 AS v FROM events) x""")
def clock_tokens(spark, d):
    e = _events(spark, d)
    k, v = F.col("k") % 60, F.col("event_id").cast("bigint") % 60
    return e.select(F.col("event_id").cast("bigint").alias("event_id"), tx.seconds_of(F.format_string("%dm%02ds", k, v)).alias("secs"), tx.clock_seconds(F.format_string("%d:%02d:%02d", k % 12, v, k)).alias("clock"))


@query("SELECT count(text) AS texts, count(DISTINCT text) AS distinct_texts, count(text) - count(DISTINCT text) AS repeated_texts FROM documents")
def text_dedupe(spark, d):
    return trees.text_repeats(table(spark, d, "documents"))


@query("SELECT lang AS family, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def tag_families(spark, d):
    return trees.tag_families(table(spark, d, "documents").select(F.concat_ws("; ", "lang", "source").alias("tags")))


@query("""SELECT CASE n_regionkey % 3 WHEN 0 THEN 'SERVICE URL' WHEN 1 THEN 'destination' ELSE '(unlabelled)' END AS category, count(*) AS occurrences, count(DISTINCT n_nationkey) AS records FROM nation GROUP BY 1""")
def placeholder_categories(spark, d):
    n = table(spark, d, "nation")
    r = F.col("n_regionkey") % 3
    text = F.concat(F.lit("see "), F.when(r == 0, F.format_string("[SERVICE %d URL 1]", "n_nationkey")).when(r == 1, F.format_string("[REDACTED:destination:%06d]", "n_nationkey")).otherwise(F.format_string("[%06d]", "n_nationkey")), F.lit(" there"))
    return trees.placeholders(n.select(F.col("n_nationkey").alias("id"), text.alias("text")))


@query("SELECT n_nationkey, trim(regexp_replace(lower(n_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM nation")
def slugs(spark, d):
    return table(spark, d, "nation").select("n_nationkey", tx.slug(F.concat("n_name", F.lit(" & Co."))).alias("slug"))


@query("""SELECT conv_id || ':' || turn AS event_id, 1704067200000000 + conv_id * 3600000000 + turn * 60000000 AS ts, 'c' || conv_id AS channel, role AS author_raw, sha1(text) AS text, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent_id FROM conversations WHERE trim(text) <> ''""")
def chat_normalise(spark, d):
    t = table(spark, d, "conversations")
    raw = t.select(F.concat_ws(":", "conv_id", "turn").alias("id"), (F.lit(1704067200) + F.col("conv_id") * 3600 + F.col("turn") * 60).cast("string").alias("timestamp"), F.concat(F.lit("c"), "conv_id").alias("room"), F.col("role").alias("sender"), F.col("text").alias("message"), F.when(F.col("turn") > 0, F.concat_ws(":", "conv_id", (F.col("turn") - 1).cast("string"))).alias("reply_to"))
    e = chat.normalize(raw)
    return e.select("event_id", F.unix_micros("ts").alias("ts"), "channel", "author_raw", F.sha1("text").alias("text"), "parent_id")


@query("SELECT doc_id, CASE WHEN s IN ('dse') THEN 'main wiki (dse)' WHEN s IN ('is.gd') THEN 'shorteners' WHEN s LIKE '%paste%' THEN 'pastebins' WHEN s LIKE '%wiki%' THEN 'other wikis' ELSE 'other' END AS grp FROM (SELECT doc_id, ['dse', 'is.gd', 'pastebin.com', 'mywiki.org', 'x.com'][CAST(doc_id % 5 AS INT) + 1] AS s FROM documents)")
def surface_groups(spark, d):
    from .plans.statistics import surface_group

    names = F.array(*[F.lit(x) for x in ("dse", "is.gd", "pastebin.com", "mywiki.org", "x.com")])
    return table(spark, d, "documents").select("doc_id", surface_group(F.get(names, (F.col("doc_id") % 5).cast("int"))).alias("grp"))
