"""Whole jobs: media to captions, transcript JSON and SRT files to corrected ones."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.functions import text as tx
from kaptura.functions.spoken import Glossary, normalised
from kaptura.operators import acoustic, classic, correct, lines
from kaptura.plans.captions import caption_rows
from kaptura.sources import recogniser as rec
from kaptura.sources import sinks, srt, transcripts, wave


@dataclass
class Job:
    """Corrected lines, documents with their outputs, and the grown cache."""

    lines: DataFrame
    outputs: DataFrame
    cache: DataFrame


def numbered_documents(files: DataFrame, key: str = "path") -> DataFrame:
    """``doc_id``: a hash of the key, so that it is the same in every run."""
    return files.withColumn("doc_id", F.xxhash64(key))


def _outputs(found: DataFrame) -> DataFrame:
    """doc_id, srt and txt of lines with their final text."""
    final = found.select("doc_id", "id", "start_time", "end_time", F.col("final").alias("text"))
    return sinks.srt(final).join(sinks.plain(final), "doc_id", "left")


def correct_documents(docs: DataFrame, provider: correct.Provider, cache: DataFrame | None = None, glossary: Glossary = Glossary(), profiles: DataFrame | None = None, **options) -> Job:  # noqa: B008
    """Documents (doc_id, full_text, lines) profiled, corrected line by line and normalised.

    Where the provider gives no profile or answer, lines stay as they are but for normalisation.
    """
    found = profiles if profiles is not None else correct.profiled(docs.select("doc_id", "full_text"), provider).select("doc_id", "profile")
    rows = caption_rows(docs)
    done = correct.correct_lines(rows, provider, cache, found, **options)
    final = done.lines.withColumn("final", normalised(F.col("corrected"), glossary))
    return Job(final, _outputs(final), done.cache)


def correct_transcripts(files: DataFrame, provider: correct.Provider, cache: DataFrame | None = None, tokenizer=None, **options) -> Job:
    """Transcript JSON files (path, value): segmented again, corrected, normalised.

    A document that can't be segmented keeps its own segments as lines.
    """
    docs = numbered_documents(transcripts.documents(files))
    cut = lines.captioned(docs, tokenizer)
    own = F.transform("tokens", lambda t, i: F.struct((i + 1).cast("int").alias("id"), t["start"].alias("start_time"), t["end"].alias("end_time"), t["text"].alias("text")))
    return correct_documents(cut.withColumn("lines", F.coalesce("lines", own)), provider, cache, **options)


def correct_srt(files: DataFrame, provider: correct.Provider, cache: DataFrame | None = None, profiles: DataFrame | None = None, **options) -> Job:
    """SRT files (path, value) corrected by the command line's guard; numbers and times stay.

    A line is looked up by its text, then by its text with single letters joined.
    """
    from kaptura.functions.spoken import letters_joined

    entries = srt.entries(numbered_documents(files), "doc_id")
    rows = entries.select("doc_id", F.col("pos").alias("id"), F.col("id").alias("number"), "time_line", "text")
    known = cache
    if cache is not None:
        keyed = correct.with_cached(rows.select("doc_id", "text").distinct(), cache, letters_joined(F.col("text")))
        known = keyed.filter("candidate is not null").select("doc_id", "text", "candidate")
    done = correct.correct_lines(rows, provider, known, profiles, variant="cli", **options)
    final = done.lines.withColumn("final", tx.spaced_unmarked(F.col("corrected")))
    written = sinks.srt_as_read(final.select("doc_id", F.col("id").alias("pos"), F.col("number").alias("id"), "time_line", F.col("final").alias("text")), "doc_id")
    return Job(final, written, done.cache)


def transcribe(media: DataFrame, decoder: rec.Decoder | None, recogniser: rec.Recogniser, language: str | None = None, longest: float = classic.LONGEST, pause: float = classic.PAUSE, at_once: int | None = None) -> DataFrame:
    """Media (doc_id, path, duration) to documents: full_text, tokens, lines of all chunks.

    Without a decoder the files are WAV: they are cut at quiet places, and nobody needs to know their
    length; with one, chunks of the length that ``duration`` leaves. Chunks of a file are recognised on their own, their times moved to the file's, and their
    lines finished together.
    """
    sound = rec.chunk_samples(acoustic.chunks(media), decoder) if decoder else wave.heard(wave.planned(media))
    heard = rec.recognised(sound, recogniser, language, at_once)
    at = F.col("chunk_start")
    moved = F.transform("result.tokens", lambda t: F.struct(t["text"].alias("text"), F.round(t["start"] + at, 3).alias("start"), F.round(F.greatest(t["end"], t["start"] + 0.05) + at, 3).alias("end")))
    each = heard.select("doc_id", "chunk", F.col("result.text").alias("full_text"), F.col("result.tokens").alias("own"), moved.alias("tokens"), "chunk_start")
    from pyspark.sql import types as T

    from kaptura.operators.documents import LINE, map_documents

    lined = map_documents(each, ["full_text", "own", "chunk_start"], "lines", T.ArrayType(LINE), lambda x, t, o: classic.caption(x, t, longest, pause, o or 0.0))
    parts = F.array_sort(F.collect_list(F.struct("chunk", "full_text", "tokens", "lines")))
    whole = lined.groupBy("doc_id").agg(parts.alias("p"))
    docs = whole.select("doc_id", F.array_join(F.transform("p", lambda p: p["full_text"]), "").alias("full_text"), F.flatten(F.transform("p", lambda p: p["tokens"])).alias("tokens"), F.flatten(F.transform("p", lambda p: p["lines"])).alias("lines"))
    return classic.finished(docs)
