"""Members of a source: a folder, a zip archive or a file beside others.

Paths are the cluster's: everything is read through Spark, so any store that
Spark can open will do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder or an archive."""
    if path.endswith(".zip"):
        return sorted(r[0] for r in _members(spark, path, None).select("name").distinct().collect())
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _members(spark: SparkSession, path: str, member: str | None) -> DataFrame:
    """(name, text) of an archive's members, or of those with one base name."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import io
        import zipfile

        for batch in batches:
            for raw in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(raw)) as z:
                    for name in z.namelist():
                        base = name.rsplit("/", 1)[-1]
                        if base and (member is None or base == member):
                            text = "" if member is None else z.read(name).decode("utf-8", "replace")
                            yield pd.DataFrame({"name": [base], "text": [text]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "name string, text string")


def find(spark: SparkSession, root: str, member: str) -> str | None:
    """Where a member lies: as named, compressed, or numbered; None if nowhere."""
    if root.endswith(".zip"):
        return f"{root}!{member}" if member in names(spark, root) else None
    folder = root if is_folder(spark, root) else root.rsplit("/", 1)[0]
    have = names(spark, folder)
    stem = member.rsplit(".", 1)[0]
    for n in (member, f"{member}.gz", *[h for h in have if stem in h and h.endswith((".gz", ".jsonl", ".json", ".csv"))]):
        if n in have:
            return f"{folder}/{n}"
    return None


def read_json(spark: SparkSession, where: str | None, multi_line: bool = False) -> DataFrame | None:
    if where is None:
        return None
    if "!" in where:
        root, member = where.split("!", 1)
        text = _members(spark, root, member).select("text")
        lines = text if multi_line else text.select(F.explode(F.split("text", "\n")).alias("text")).where(F.trim("text") != "")
        # the schema comes from all lines, as that of a file in a folder does
        return None if lines.isEmpty() else spark.read.json(lines.rdd.map(lambda r: r[0]))
    return spark.read.option("multiLine", multi_line).json(where)


def read_csv(spark: SparkSession, where: str | None, sep: str = ",") -> DataFrame | None:
    """All columns as text."""
    return None if where is None else spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(where)


def with_columns(df: DataFrame, *names_: str) -> DataFrame:
    """Adds columns that a JSON source happens not to have, as null text."""
    for n in names_:
        if n not in df.columns:
            df = df.withColumn(n, F.lit(None).cast("string"))
    return df
