"""Text functions as Column expressions; nothing here leaves the JVM.

``rx`` gives a pattern Python's ``re`` meaning of \\w, \\d, \\b and $ on Java:
Unicode classes, and ``$`` only before a final newline.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[ \t-\r\x1c-\x1f\x85\xa0]"
MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")

# Patterns of the canonical text formats.
NUM = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?"
ONE_NUM = rf"(?<![\w.:+#]){NUM}(?![\w:])"
VALUE = rf"{ONE_NUM}(?:\s*[;/]\s*{ONE_NUM})*"
TIME = r"\b\d{1,2}:\d{2}(?::\d{2})?(?:/\d{2})?\b"
YEAR = r"(?:19[5-9]\d|20[0-4]\d)"
SIGNATURE = r"(?:^|\s)--\s?\[{0,2}([A-Za-z][A-Za-z0-9_\-\.]{1,60}?)\]{0,2}\s*\.?\s*$"
URL = r"""https?://[^\s\]\)\|'"<>]+"""
COHORT = r"(?<![A-Za-z])(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sept?(?:ember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?|JAN|FEB|MAR|APR|MAY|JUN|JUL|AUG|SEP|OCT|NOV|DEC)[ \-]?(\d{1,2})(?!\d)"
EPISODE = r"(?<![A-Za-z0-9])(?:R|G|#|Round\s?)([1-9])(?![0-9])"
PLACEHOLDER = r"\[[^\[\]]{1,80}\]"


def rx(pattern: str, ignore_case: bool = False) -> str:
    return f"(?{'iu' if ignore_case else ''}Ud)" + pattern


def find_iter(text: Column, pattern: str) -> Column:
    """All matches with their places: array<struct<at int, tok string>>, from 0."""
    # each of the two runs over the text once: inside a lambda they would run once a match
    toks, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<at:int,tok:string>>").alias("out"))
    pairs = F.filter(F.zip_with(toks, gaps, lambda t, g: F.struct(F.length(g).alias("gap"), t.alias("tok"))), lambda p: p["tok"].isNotNull())

    def step(acc: Column, p: Column) -> Column:
        at = (acc["end"] + p["gap"]).cast("int")
        return F.struct((at + F.length(p["tok"])).cast("int").alias("end"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), p["tok"].alias("tok")))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row: filters and projections above cannot copy it."""
    return df.withColumn(name, F.explode(F.array(value)))


def stable_id(*parts: Column | str) -> Column:
    """First 16 hexadecimal digits of the SHA-1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *[F.col(p) if isinstance(p, str) else p.cast("string") for p in parts])), 1, 16)


def norm_key(text: Column) -> Column:
    """ASCII only, white space collapsed, trimmed, lower case."""
    ascii_only = F.regexp_replace(text, r"[^\x00-\x7F]", "")
    return F.lower(F.trim(F.regexp_replace(ascii_only, r"[ \t-\r\x1c-\x1f]+", " ")))


def value_key(value: Column) -> Column:
    return F.split_part(value, F.lit("/"), F.lit(1))


def norm_value(raw: Column) -> Column:
    """'16.40%' -> '16.4', '20,369' -> '20369', '874,322;951,258' -> '874322/951258'."""
    parts = F.split(F.trim(raw), r"\s*[;/]\s*")
    cleaned = F.transform(parts, lambda x: F.trim(F.translate(x, ",%", "")))
    numbers = F.transform(cleaned, lambda x: F.when(F.rlike(x, F.lit(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")), x.try_cast("double")))
    shown = F.transform(F.filter(numbers, lambda x: x.isNotNull()), lambda x: F.regexp_replace(F.regexp_replace(F.format_string("%.4f", x), "0+$", ""), r"\.$", ""))
    return F.nullif(F.array_join(shown, "/"), F.lit(""))


def first_value(segment: Column) -> Column:
    """The first number that is neither a clock time nor a bare year or part of a year range."""
    seg = F.regexp_replace(segment, rx(TIME), " ")
    found = find_iter(seg, rx(VALUE))

    def real(m: Column) -> Column:
        before = F.substr(seg, F.lit(1), m["at"])
        after = F.substr(seg, m["at"] + F.length(m["tok"]) + 1, F.lit(1))
        year = F.rlike(F.trim(m["tok"]), F.lit(f"^{YEAR}$"))
        tail = F.rlike(before, F.lit(r"(?:19|20)\d\d-$"))
        head = F.rlike(F.trim(F.split_part(m["tok"], F.lit("-"), F.lit(1))), F.lit(f"^{YEAR}$")) & (after == "-")
        return ~(year | tail | head)

    return F.try_element_at(F.filter(found, real), F.lit(1))["tok"]


def seconds_of(token: Column) -> Column:
    """'12m18s', '56s', '30 sec' -> seconds; anything else null."""
    t = F.replace(F.replace(F.lower(token), F.lit(" "), F.lit("")), F.lit("sec"), F.lit("s"))
    m = F.regexp_extract(t, r"^(?:(\d+)m)?(\d+)?s?$", 1)
    s = F.regexp_extract(t, r"^(?:(\d+)m)?(\d+)?s?$", 2)
    total = F.coalesce(F.nullif(m, F.lit("")).cast("double"), F.lit(0.0)) * 60 + F.coalesce(F.nullif(s, F.lit("")).cast("double"), F.lit(0.0))
    return F.when((m != "") | (s != ""), total)


def clock_seconds(token: Column) -> Column:
    """'[h:]mm:ss' -> seconds."""
    return F.aggregate(F.split(token, ":"), F.lit(0), lambda acc, x: (acc * 60 + F.coalesce(x.try_cast("int"), F.lit(0))).cast("int"))


def slug(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def strict_handle(author: Column) -> Column:
    return F.lower(F.regexp_replace(author, r"(?U)\W+$", ""))


def cohort_token(text: Column, pattern: str = COHORT) -> Column:
    """First month and day 1-31: 'Mar 16' -> 'Mar16'."""
    pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("d"))
    day = lambda p: p["1"].cast("int")
    good = F.try_element_at(F.filter(F.transform(pairs, lambda p: F.struct(p["m"].alias("0"), p["d"].alias("1"))), lambda p: day(p).between(1, 31)), F.lit(1))
    return F.concat(F.initcap(F.substring(good["0"], 1, 3)), F.lpad(good["1"], 2, "0"))


def signature_of(text: Column) -> Column:
    last = F.element_at(F.split(F.rtrim(F.regexp_replace(text, r"\s+$", "")), "\n"), -1)
    return F.nullif(F.regexp_extract(last, rx(SIGNATURE), 1), F.lit(""))


def url_host(url: Column) -> Column:
    return F.split_part(F.regexp_replace(url, "^https?://", ""), F.lit("/"), F.lit(1))


def urls_of(text: Column) -> Column:
    """Distinct URLs in order, without trailing punctuation."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(rx(URL)), F.lit(0))))
    return F.transform(found, lambda u: F.regexp_replace(u, "[.,;]+$", ""))


def rewrite_omitted_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"\[operational URL omitted; host=([^;\]]+);[^\]]*\]", r"https://$1/[omitted]")


def epoch_or_iso(value: Column) -> Column:
    """Numbers above 1e11 are milliseconds, other numbers seconds, else ISO text."""
    text = F.trim(value.cast("string"))
    number = F.when(F.rlike(text, F.lit(r"^-?\d+(\.\d+)?([eE]\+?\d+)?$")), text.try_cast("double"))
    micros = F.when(number > 1e11, number * 1000).otherwise(number * 1000000)
    return F.coalesce(F.timestamp_micros(F.round(micros).cast("bigint")), iso_timestamp(F.when(number.isNull(), text)))


def iso_timestamp(text: Column) -> Column:
    """An ISO date with or without time; anything else null."""
    t = F.when(F.rlike(text, F.lit(r"^\s*\d{4}-\d{1,2}-\d{1,2}")), F.trim(text))
    return F.coalesce(F.try_to_timestamp(t), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(t, F.lit("yyyy-MM-dd HH:mm")))


def date_literal(text: Column) -> Column:
    """Ten-digit epoch (with fraction), fourteen-digit stamp or ISO prefix."""
    t = F.trim(text.cast("string"))
    epoch = F.when(F.rlike(t, F.lit(r"^\d{10}(\.\d+)?$")), F.timestamp_micros(F.round(t.try_cast("decimal(30,9)") * 1000000).cast("bigint")))
    stamp = F.when(F.rlike(t, F.lit(r"^\d{14}$")), F.try_to_timestamp(t, F.lit("yyyyMMddHHmmss")))
    return F.coalesce(epoch, stamp, F.when(F.rlike(t, F.lit(r"^\d{4}-\d{2}-\d{2}")), iso_timestamp(t)))


def roster_timestamp(text: Column) -> Column:
    """Needs a date: a bare clock time is not a point in time."""
    t = F.trim(text.cast("string"))
    number = F.when(F.rlike(t, F.lit(r"^\d{9,}(\.\d+)?$")), t)
    slashed = F.when(F.rlike(t, F.lit(r"^\d{1,2}/\d{1,2}/\d{4}")), F.coalesce(F.try_to_timestamp(t, F.lit("M/d/yyyy H:mm:ss")), F.try_to_timestamp(t, F.lit("M/d/yyyy H:mm")), F.try_to_timestamp(t, F.lit("M/d/yyyy"))))
    return F.coalesce(epoch_or_iso(number), iso_timestamp(t), slashed)


# Words that era labels leave out.
ERA_STOP = (
    "a", "an", "the", "your", "you", "yours", "as", "can", "it", "to", "and", "of", "in", "on", "for", "with", "like", "whatever", "youd", "do",
    "each", "agent", "agents", "own", "be", "is", "that", "this", "up", "out", "much", "many", "most", "while", "one", "other", "which", "will",
    "next", "soon", "please", "yourselves",
)


def era_label(number: Column, goal: Column) -> Column:
    """'e17-form-two-teams'; a goal of such words alone is 'goal'."""
    plain = F.regexp_replace(F.replace(F.lower(goal), F.lit("'"), F.lit("")), "[^a-z0-9 ]+", " ")
    words = F.filter(F.split(plain, " +"), lambda w: (w != "") & ~w.isin(*ERA_STOP))
    name = F.array_join(F.slice(words, 1, 3), "-")
    return F.concat(F.format_string("e%02d-", number), F.when(name == "", "goal").otherwise(name))


# Beginnings of model names and their vendors, first match wins.
VENDORS = (
    ("claude", "Anthropic"), ("gpt", "OpenAI"), ("o1", "OpenAI"), ("o3", "OpenAI"), ("o4", "OpenAI"), ("gemini", "Google"), ("grok", "xAI"),
    ("deepseek", "DeepSeek"), ("kimi", "Moonshot"), ("glm", "Zhipu"), ("muse", "Meta"), ("llama", "Meta"), ("qwen", "Alibaba"), ("mistral", "Mistral"),
)


def vendor(model: Column) -> Column:
    low = F.lower(F.trim(model))
    return reduce(lambda acc, p: F.when(low.startswith(p[0]), p[1]).otherwise(acc), reversed(VENDORS), F.when(low != "", "other"))


def placeholder_category(token: Column) -> Column:
    """'[SERVICE 2 URL 1]' -> 'SERVICE URL'; '[REDACTED:destination:000002]' -> 'destination'."""
    body = F.regexp_replace(token, r"^\[|\]$", "")
    marked = F.split_part(body, F.lit(":"), F.lit(2))
    plain = F.trim(F.regexp_replace(F.regexp_replace(body, r"\d+", " "), r"\s+", " "))
    return F.when(body.startswith("REDACTED:"), marked).when(plain == "", "(unlabelled)").otherwise(plain)


def names_list(value: Column) -> Column:
    """'["a", "b"]' or 'a, b' -> array."""
    t = F.trim(value)
    literal = F.from_json(F.translate(t, "'", '"'), "array<string>")
    plain = F.filter(F.transform(F.split(t, r"[,;]"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(t.startswith("["), F.coalesce(literal, F.array().cast("array<string>"))).when(t.isNull() | (t == ""), F.array().cast("array<string>")).otherwise(plain)


def pacific_to_utc(local: Column, zone: str = "America/Los_Angeles") -> Column:
    """Wall clock to UTC.  A time that the clock shows twice is null; one that it
    skips moves to the end of the gap."""
    utc = F.to_utc_timestamp(local, zone)
    again = F.from_utc_timestamp(utc, zone)
    hour = F.expr("interval 1 hour")
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    gap_end = F.to_utc_timestamp(F.date_trunc("hour", again), zone)
    return F.when(again == local, F.when(~twice, utc)).otherwise(gap_end)


def hour_of(text: Column) -> Column:
    """'9', '09:30' or '9:30' -> hours."""
    return F.split_part(text, F.lit(":"), F.lit(1)).try_cast("double") + F.coalesce(F.nullif(F.split_part(text, F.lit(":"), F.lit(2)), F.lit("")).try_cast("double"), F.lit(0.0)) / 60
