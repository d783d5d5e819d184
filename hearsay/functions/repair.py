"""Text that was read in the wrong encoding and saved again, layer by layer.

cp1252 cannot be expressed with Spark's own charsets, so this is an Arrow UDF;
``repaired`` calls it only for texts that show the traces.
"""

from __future__ import annotations

from itertools import pairwise

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Letters that give a wrong reading away, the charsets of wrong
# readings in order of trial, and how many readings may lie on each other.
TRACES = ("Ã", "Â")
CHARSETS = ("cp1252", "latin-1")
LAYERS = 4


def _reread(text: str, charset: str) -> str | None:
    """The UTF-8 text whose bytes were taken for ``charset``; None if there is none."""
    try:
        return str(text.encode(charset), "utf-8")
    except UnicodeError:
        return None


def _inner(text: str) -> str:
    """The text below one wrong reading; the same text if it shows no traces or
    does not decode cleanly."""
    if not any(map(text.__contains__, TRACES)):
        return text
    return next((t for c in CHARSETS if (t := _reread(text, c)) is not None), text)


def unwind(text: str) -> str:
    """The innermost text, at most ``LAYERS`` readings deep."""
    depths = [text]
    while len(depths) <= LAYERS and all(a != b for a, b in pairwise(depths[-2:])):
        depths.append(_inner(depths[-1]))
    return depths[-1]


@F.pandas_udf(StringType())
def _unwind(texts: pd.Series) -> pd.Series:
    return texts.map(unwind, na_action="ignore")


def repaired(text: Column) -> Column:
    traces = [text.contains(t) for t in TRACES]
    return F.when(traces[0] | traces[1], _unwind(text)).otherwise(text)
