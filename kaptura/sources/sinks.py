"""SRT, text and JSON outputs, one value for each document, and writers of one file each."""

from __future__ import annotations

import os
import tarfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaptura.functions import text as tx
from kaptura.session import filesystem


def _in_order(key: str, order: str, value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), value.alias("v")))), lambda x: x["v"])


def block(number: Column, start: Column, end: Column, text: Column) -> Column:
    return F.concat(number.cast("string"), F.lit("\n"), tx.srt_time(start), F.lit(" --> "), tx.srt_time(end), F.lit("\n"), text, F.lit("\n"))


def srt(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, srt: lines in order of id."""
    one = block(F.col("id"), F.col("start_time"), F.col("end_time"), F.col("text"))
    return lines.groupBy(key).agg(F.concat(tx.strip(F.array_join(_in_order(key, "id", one), "\n")), F.lit("\n")).alias("srt"))


def srt_as_read(entries: DataFrame, key: str = "path") -> DataFrame:
    """key, srt: entries with their own numbers and time lines, byte for byte."""
    one = F.concat(F.col("id").cast("string"), F.lit("\n"), F.col("time_line"), F.lit("\n"), F.col("text"), F.lit("\n\n"))
    return entries.groupBy(key).agg(F.array_join(_in_order(key, "pos", one), "").alias("srt"))


def plain(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, txt: lines that aren't empty, one below the other."""
    return lines.filter("text <> ''").groupBy(key).agg(F.array_join(_in_order(key, "id", F.col("text")), "\n").alias("txt"))


def lines_srt(lines: Column) -> Column:
    """The SRT text of an array of lines, without a shuffle."""
    one = F.transform(lines, lambda x: block(x["id"], x["start_time"], x["end_time"], x["text"]))
    return F.when(F.size(lines) > 0, F.concat(tx.strip(F.array_join(one, "\n")), F.lit("\n"))).otherwise("")


def lines_text(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, lambda x: x["text"]), lambda t: t != ""), "\n")


def lines_json(language: Column, text: Column, lines: Column, tokens: Column, offset: float = 0.0) -> Column:
    """The JSON of a document: words moved by ``offset``, ends 0.05 behind starts at least."""
    words = F.transform(tokens, lambda t: F.struct(t["text"].alias("text"), F.round(t["start"] + offset, 3).alias("start_time"), F.round(F.greatest(t["end"], t["start"] + 0.05) + offset, 3).alias("end_time")))
    return F.to_json(F.struct(F.coalesce(F.nullif(language, F.lit("")), F.lit("Auto")).alias("language"), F.coalesce(text, F.lit("")).alias("full_text"), lines.alias("segments"), words.alias("word_timestamps")))


def write_each(rows: DataFrame, name: str, value: str, folder: str, suffix: str) -> None:
    """One file for each row below a folder that all executors share, by rename: a task that runs
    again leaves the same files."""

    def write(part: Iterable) -> None:
        files, base = filesystem(folder)
        files.create_dir(base, recursive=True)
        for row in part:
            at = f"{base}/{row[name]}{suffix}"
            own = f"{at}.{uuid.uuid4().hex}.tmp"
            with files.open_output_stream(own) as out:
                out.write((row[value] or "").encode())
            files.move(own, at)

    rows.select(name, value).foreachPartition(write)


def replace_table(rows: DataFrame, path: str) -> None:
    """Overwrites a table that ``rows`` may be read from: written beside it, then swapped.

    The old table is moved aside first and deleted last: a crash between leaves both whole.
    """
    spark = rows.sparkSession
    own = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    rows.write.parquet(own)
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = jvm.org.apache.hadoop.fs.Path(own), jvm.org.apache.hadoop.fs.Path(path)
    files = old.getFileSystem(hadoop)
    aside = jvm.org.apache.hadoop.fs.Path(f"{own}.old")
    moved = files.exists(old) and files.rename(old, aside)
    if not files.rename(new, old):
        if moved:
            files.rename(aside, old)
        raise OSError(f"{own} could not be moved to {path}")
    if moved:
        files.delete(aside, True)


def package(files: DataFrame, archive: str) -> int:
    """A tar.gz of the files listed (name, path); the list of one task is small."""
    with tarfile.open(archive, "w:gz") as out:
        names = 0
        for row in files.orderBy("name").toLocalIterator():
            if os.path.getsize(row.path) > 0:
                out.add(row.path, row.name)
                names += 1
    return names
