"""SRT files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kaptura.functions import text as tx

_TIMES = r"^(\d+:\d+:\d+,\d+)\s*-->\s*(\d+:\d+:\d+,\d+)"


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.srt")
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def entries(files: DataFrame, key: str = "path", value: str = "value") -> DataFrame:
    """key, pos, id, time_line (as it stands), start, end, text: natively.

    Blocks of fewer than three lines, without a number or without times are left out; further
    lines of a block are joined by spaces.
    """
    once = lambda x: F.explode(F.array(x))  # noqa: E731  no filter is pushed below it
    unified = F.regexp_replace(F.coalesce(value, F.lit("")), "\r\n?", "\n")
    blocks = files.select(F.col(key), F.posexplode(F.split(tx.strip(unified), r"\n\s*\n")).alias("pos", "block"))
    lines = blocks.select(key, "pos", once(F.split(tx.strip(F.col("block")), "\n")).alias("l")).filter(F.size("l") >= 3)
    at = lambda i: tx.strip(F.get("l", F.lit(i)))
    found = lines.select(key, "pos", "l", at(0).try_cast("int").alias("id"), once(at(1)).alias("time_line")).filter(F.col("id").isNotNull())
    parts = lambda g: F.split(F.regexp_extract("time_line", _TIMES, g), "[:,]")
    timed = found.select(key, "pos", "l", "id", "time_line", once(F.struct(parts(1).alias("a"), parts(2).alias("b"))).alias("t")).filter(F.size("t.a") == 4)

    def seconds(time: str) -> Column:
        h, m, s, ms = (F.get(time, F.lit(i)).try_cast("double") for i in range(4))
        return h * 3600 + m * 60 + s + ms / 1000

    text = tx.strip(F.array_join(F.slice("l", 3, 1 << 30), " "))
    return timed.select(key, "pos", "id", "time_line", seconds("t.a").alias("start"), seconds("t.b").alias("end"), text.alias("text"))
