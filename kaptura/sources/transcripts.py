"""Transcript documents from recogniser JSON of any known shape, and their metadata.

A document is a row: path, language, full_text and its tokens as an array. The JSON is read as a
VARIANT, which tells a key that is there and null from one that isn't.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kaptura.functions import text as tx
from kaptura.operators.documents import TOKEN, map_documents

SHAPE = T.StructType([T.StructField("language", T.StringType()), T.StructField("full_text", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN)), T.StructField("profile", T.StringType())])


def read_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, value: each JSON file whole."""
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", "*.json")
    return reader.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")


def _token(row: dict, span: float, behind: float) -> dict | None:
    text = str(row.get("text") or row.get("word") or "").strip()
    if not text:
        return None
    start = float(row["start_time"] if "start_time" in row else row.get("start", 0.0))
    end = float(row["end_time"] if "end_time" in row else row.get("end", start + span))
    return {"text": text, "start": start, "end": end if end >= start else start + behind}


def document(raw: str | None) -> dict:
    """Words from the first of word_timestamps, words, the segments' words, the segments."""
    data = json.loads(raw or "{}")
    if isinstance(data, list):
        data = {"segments": data}
    segments = [s for s in data.get("segments") or data.get("sentences") or data.get("utterances") or [] if isinstance(s, dict)]
    nested = [w for s in segments if isinstance(s.get("words"), list) for w in s["words"]]
    words = data.get("word_timestamps") or data.get("words") or data.get("tokens") or nested
    if words:
        tokens = [_token(w, 0.08, 0.05) for w in words if isinstance(w, dict)]
    else:
        tokens = [_token({k: v for k, v in s.items() if k != "word"}, 1.0, 0.1) for s in segments]
    text = data.get("full_text") or "\n".join(s["text"].strip() for s in segments if s.get("text"))
    profile = data.get("domain_profile")
    return {"language": data.get("language"), "full_text": text, "tokens": [t for t in tokens if t], "profile": json.dumps(profile, ensure_ascii=False) if profile else None}


def documents(files: DataFrame, value: str = "value") -> DataFrame:
    """language, full_text, tokens and profile (JSON) beside the other columns; a file that isn't
    JSON of a known shape has nulls and its ``error``."""
    parsed = map_documents(files, [value], "doc", SHAPE, document, [c for c in files.columns if c != value])
    keep = [c for c in files.columns if c != value]
    return parsed.select(*keep, "doc.*", F.col("doc_error").alias("error"))


def exploded(docs: DataFrame, key: str = "doc_id", tokens: str = "tokens") -> DataFrame:
    """key, pos, text, start, end: a row for each token."""
    return docs.select(key, F.posexplode(tokens).alias("pos", "t")).select(key, "pos", "t.*")


def peeked(files: DataFrame, value: str = "value", keep: tuple[str, ...] = ("path",)) -> DataFrame:
    """``keep``, n_segments, duration and domain of usable files, natively by VARIANT.

    The list is the first of six keys that is a list of something, or the file itself. The parsed
    file and the list come out of generators, below which no filter is pushed: each is computed once.
    """
    once = lambda x: F.explode(F.array(x))
    doc = files.select(*dict.fromkeys((*keep, value)), once(F.try_parse_json(value)).alias("_v")).filter(F.col("_v").isNotNull())
    lists = [F.try_variant_get("_v", p, "array<variant>") for p in ("$", *(f"$.{k}" for k in ("segments", "sentences", "utterances", "word_timestamps", "words", "tokens")))]
    chosen = F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists])
    last = F.try_element_at(F.col("_list"), F.lit(-1))
    number = lambda k: F.nullif(F.try_variant_get(last, f"$.{k}", "double"), F.lit(0.0))
    found = doc.select(*keep, "_v", once(chosen).alias("_list")).filter(F.col("_list").isNotNull())
    return found.select(*keep, F.size("_list").alias("n_segments"), F.coalesce(number("end_time"), number("end"), number("orig_end"), F.lit(0.0)).alias("duration"), F.coalesce(F.try_variant_get("_v", "$.domain_profile.domain", "string"), F.lit("")).alias("domain"))


def paced_tokens(text: str, per_second: float = 3.0) -> Column:
    """A plain text's words as tokens at an even pace (``per_second`` words)."""
    words = F.filter(F.split(tx.strip(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    token = lambda w, i: F.struct(w.alias("text"), (i / per_second).alias("start"), ((i + 0.8) / per_second).alias("end"))
    return F.transform(words, token)


def from_lines(table: DataFrame, key: str, text: str, per_second: float = 3.0) -> DataFrame:
    """A plain text as a transcript."""
    return table.select(F.col(key).alias("doc_id"), F.col(text).alias("full_text"), paced_tokens(text, per_second).alias("tokens"))
