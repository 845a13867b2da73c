"""From transcripts to caption lines, as one declared plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.operators import classic, lines
from kaptura.session import spread


def caption_rows(captioned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, id, start_time, end_time, text: a row for each line."""
    return captioned.select(key, F.explode("lines").alias("l")).select(key, "l.*")


def captions(table: DataFrame, key: str = "doc_id", text: str = "text", style: lines.Style = lines.Style()) -> DataFrame:  # noqa: B008
    """Caption lines of plain texts, read at an even pace: a scan and a map; only a table of few
    files is dealt out first."""
    rows = spread(table.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    return caption_rows(lines.captioned_texts(rows, style=style, keep=["doc_id"]))


def classic_captions(table: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    rows = spread(table.select(F.col(key).alias("doc_id"), F.col(text).alias("text")))
    return caption_rows(classic.captioned_texts(rows, keep=["doc_id"]))
