"""Times, names, labels and repairs on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .bindings import query, r6, table
from .functions import text as tx
from .functions.items import ItemMatcher
from .functions.repair import repaired
from .operators import extract
from .plans import statistics as st

#: Numbers are seconds, above 1e11 milliseconds; else an ISO date, with a time and a zone or without.
NUMBER = r"^-?\d+(\.\d+)?([eE]\+?\d+)?$"
ISO = r"^\d{4}-\d{1,2}-\d{1,2}"


@query(f"""WITH s AS (SELECT stamp_id, trim(raw) AS t FROM stamps), n AS (SELECT *, CASE WHEN regexp_matches(t, '{NUMBER}') THEN TRY_CAST(t AS DOUBLE) END AS x FROM s)
 SELECT stamp_id, CASE WHEN x IS NOT NULL THEN CAST(round(CASE WHEN x > 1e11 THEN x * 1000 ELSE x * 1000000 END) AS BIGINT) WHEN regexp_matches(t, '{ISO}') THEN epoch_us(TRY_CAST(t AS TIMESTAMPTZ)) END AS us FROM n""")
def stamp_times(spark, d):
    return table(spark, d, "stamps").select("stamp_id", F.unix_micros(tx.epoch_or_iso(F.col("raw"))).alias("us"))


@query(f"""WITH s AS (SELECT stamp_id, trim(raw) AS t FROM stamps), n AS (SELECT *, CASE WHEN regexp_matches(t, '^\\d{{9,}}(\\.\\d+)?$') THEN TRY_CAST(t AS DOUBLE) END AS x, regexp_extract(t, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}( \\d{{1,2}}:\\d{{2}}(:\\d{{2}})?)?$') AS sl FROM s)
 SELECT stamp_id, CASE WHEN x IS NOT NULL THEN CAST(round(CASE WHEN x > 1e11 THEN x * 1000 ELSE x * 1000000 END) AS BIGINT) WHEN regexp_matches(t, '{ISO}') THEN epoch_us(TRY_CAST(t AS TIMESTAMPTZ))
  WHEN sl <> '' THEN epoch_us(coalesce(try_strptime(sl, '%m/%d/%Y %H:%M:%S'), try_strptime(sl, '%m/%d/%Y %H:%M'), try_strptime(sl, '%m/%d/%Y'))) END AS us FROM n""")
def roster_times(spark, d):
    return table(spark, d, "stamps").select("stamp_id", F.unix_micros(tx.roster_timestamp(F.col("raw"))).alias("us"))


@query("""SELECT sale_id, sold_at, epoch_us(CASE WHEN sold_at >= TIMESTAMP '2024-03-10 02:00:00' AND sold_at < TIMESTAMP '2024-03-10 03:00:00' THEN TIMESTAMPTZ '2024-03-10 10:00:00+00' ELSE timezone('America/Los_Angeles', sold_at) END) AS us FROM sales""".replace("sale_id, sold_at,", "sale_id, epoch_us(sold_at) AS wall,"))
def pacific_times(spark, d):
    return table(spark, d, "sales").select("sale_id", F.unix_micros("sold_at").alias("wall"), F.unix_micros(tx.pacific_to_utc(F.col("sold_at"))).alias("us"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split(regexp_replace(replace(lower(text), '''', ''), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda x: x <> '' AND NOT list_contains({list(tx.ERA_STOP)!r}, x)) AS ws FROM documents WHERE text IS NOT NULL)
 SELECT doc_id, 'e' || lpad(CAST(doc_id % 60 AS VARCHAR), 2, '0') || '-' || CASE WHEN len(ws) = 0 THEN 'goal' ELSE array_to_string(ws[1:3], '-') END AS label FROM w""")
def era_labels(spark, d):
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", tx.era_label((F.col("doc_id") % 60).cast("int"), F.col("text")).alias("label"))


@query(r"""SELECT doc_id, NOT regexp_matches(text, '[^\x00-\x7F]') OR regexp_matches(text, '[\x{80}-\x{FF}]') AS as_before FROM documents WHERE text IS NOT NULL""")
def repaired_texts(spark, d):
    """Texts whose UTF-8 bytes were read as Latin-1 once: repaired where the reading shows."""
    t = table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", (repaired(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")) == F.col("text")).alias("as_before"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN regexp_matches(source, '^[A-Za-z][A-Za-z0-9_.-]{1,60}$') THEN source END AS author FROM documents""")
def signatures(spark, d):
    t = table(spark, d, "documents")
    mark = F.when(F.col("doc_id") % 3 == 0, " no sign").when(F.col("doc_id") % 3 == 1, F.concat(F.lit("\n-- "), "source")).otherwise(F.concat(F.lit("\n-- [["), "source", F.lit("]] . \n")))
    return t.select("doc_id", tx.signature_of(F.concat(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 200), "-", " "), mark)).alias("author"))


@query("""SELECT doc_id, 'see https://' || source || '.org/[omitted] and https://h/[omitted].' AS text FROM documents""")
def omitted_urls(spark, d):
    raw = F.concat(F.lit("see [operational URL omitted; host="), "source", F.lit(".org; id="), "doc_id", F.lit("] and [operational URL omitted; host=h;]."))
    return table(spark, d, "documents").select("doc_id", tx.rewrite_omitted_urls(raw).alias("text"))


@query("""SELECT client_id, coalesce(CASE client_id % 3 WHEN 0 THEN city || '|' || segment WHEN 1 THEN city || '|' || segment END, '') AS names FROM clients""")
def allow_names(spark, d):
    i = F.col("client_id") % 3
    raw = F.when(i == 0, F.concat(F.lit('["'), "city", F.lit('", "'), "segment", F.lit('"]'))).when(i == 1, F.concat(F.lit(" "), "city", F.lit("; "), "segment", F.lit(",")))
    return table(spark, d, "clients").select("client_id", F.array_join(tx.names_list(raw), "|").alias("names"))


#: Chains of four names, turned by one place for some readers; each family turns another share.
CHAINS = """e AS (SELECT event_id, event_type AS family, CASE WHEN event_type = 'view' THEN user_id % 3 WHEN user_id % 4 = 0 THEN 1 ELSE 0 END AS turn FROM events),
 v AS (SELECT family, item, ((place - turn - 1 + 8) % 4) + 1 AS position FROM e, (VALUES ('Poland', 1), ('Hungary', 2), ('Estonia', 3), ('Latvia', 4)) x(item, place)),
 n AS (SELECT family, item, position, count(*) AS n FROM v GROUP BY 1, 2, 3), b AS (SELECT *, sum(n) OVER (PARTITION BY family, item) AS total, row_number() OVER (PARTITION BY family, item ORDER BY n DESC, position) AS rn FROM n)"""


@query(f"WITH {CHAINS} SELECT family, item, CAST(position AS INT) AS position FROM b WHERE rn = 1 AND n >= 2 AND n / total >= 0.6")
def voted_sequences(spark, d):
    names = ["Poland", "Hungary", "Estonia", "Latvia"]
    turn = F.when(F.col("event_type") == "view", F.col("user_id") % 3).when(F.col("user_id") % 4 == 0, 1).otherwise(0).cast("int")
    chain = F.get(F.array(*[F.lit(" -> ".join(names[k:] + names[:k])) for k in range(3)]), turn)
    posts = table(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("family"), F.concat(F.lit("order "), chain, F.lit(" so far")).alias("text"))
    return extract.learn_sequences(posts, ItemMatcher())


#: Means by agent taken out, two items are one dummy: a regression on two columns in closed form.
@query("""WITH r AS (SELECT l_suppkey AS g, CAST(l_linestatus = 'O' AS DOUBLE) AS i, l_quantity AS y, CAST(l_discount > 0.05 AS DOUBLE) AS d FROM lineitem),
 c AS (SELECT g, y - avg(y) OVER w AS y, d - avg(d) OVER w AS d, i - avg(i) OVER w AS i FROM r WINDOW w AS (PARTITION BY g)),
 s AS (SELECT sum(d * d) AS dd, sum(d * i) AS di, sum(i * i) AS ii, sum(d * y) AS dy, sum(i * y) AS iy FROM c)
 SELECT (SELECT count(*) FROM r) AS n, round((dy * ii - di * iy) / (dd * ii - di * di), 6) AS beta FROM s""")
def fixed_effects_two_items(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("agent"), F.col("l_linestatus").alias("item_fe"), F.col("l_quantity").cast("double").alias("y"), (F.col("l_discount") > 0.05).cast("int").alias("d"))
    fit = st.two_way_fixed_effects(li, "y", "d")
    return spark.createDataFrame([(fit["n"], fit["beta"])], "n bigint, beta double").select("n", r6("beta", "beta"))
