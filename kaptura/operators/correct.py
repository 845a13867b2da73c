"""Correction of lines through a provider, behind a cache and the guard.

Lines: ``doc_id``, ``id``, ``text``. The cache is a table (``doc_id``, ``text``, ``candidate``).
Joins are declared and left to the optimizer; only the provider and the guard run in Python.
A line's number, times and place never change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kaptura.functions import text as tx
from kaptura.operators.guard import verified
from kaptura.session import filesystem, written

BATCH = 25
PROFILE = "struct<domain:string,topic:string,jargon_list:array<string>,confusion_rules:map<string,string>,style_notes:string>"
CACHE = "doc_id long, text string, candidate string"


class Provider(Protocol):
    """Answers a prompt. A task may run again, so equal prompts must get equal answers."""

    def answer(self, system: str, user: str) -> str: ...


@dataclass(frozen=True)
class IdentityProvider:
    """Gives every line back as it is."""

    def answer(self, system: str, user: str) -> str:
        return "\n".join(x for x in user.split("\n") if x.startswith("["))


@dataclass(frozen=True)
class ReplayProvider:
    """Recorded candidates by line text; lines without one get no answer."""

    candidates: dict[str, str] = field(default_factory=dict)

    def answer(self, system: str, user: str) -> str:
        out = []
        for line in user.split("\n"):
            head, _, text = line.partition("] ")
            if head.startswith("[") and text in self.candidates:
                out.append(f"{head}] {self.candidates[text]}")
        return "\n".join(out)


# ---------------------------------------------------------------------------- profiles


def parsed_profile(raw: Column) -> Column:
    """A profile from a model's answer: as JSON, or field by field where it isn't any."""
    kept = F.regexp_extract(tx.answer_text(raw), r"(?s)(\{.*\})", 1)
    whole = F.from_json(kept, PROFILE, {"mode": "PERMISSIVE"})
    usable = kept.isNotNull() & (kept != "") & F.try_parse_json(kept).isNotNull()
    one = lambda name: F.nullif(F.regexp_extract(raw, rf'"{name}"\s*:\s*"([^"]+)"', 1), F.lit(""))
    items = F.regexp_extract_all(F.regexp_extract(raw, r'(?s)"jargon_list"\s*:\s*\[(.*?)(\]|\z)', 1), F.lit('"([^"]+)"'), 1)
    loose = F.struct(one("domain").alias("domain"), one("topic").alias("topic"), F.slice(items, 1, 25).alias("jargon_list"), F.expr("cast(map() as map<string,string>)").alias("confusion_rules"), F.lit(None).cast("string").alias("style_notes"))
    return F.when(usable, whole).otherwise(loose)


def profiled(docs: DataFrame, provider: Provider, text: str = "full_text", system: str = "") -> DataFrame:
    """``profile`` of each document by the provider's answer to a sample of its text; a document
    without text, or whose provider fails, has the empty profile."""
    kept = docs.withColumn("_sample", tx.three_slices(F.coalesce(text, F.lit(""))))

    @F.pandas_udf("string")
    def ask(samples: pd.Series) -> pd.Series:
        def one(sample: str) -> str:
            try:
                return provider.answer(system, sample) if sample.strip() else ""
            except Exception:  # noqa: BLE001  an unanswered profile is empty
                return ""

        return samples.map(one)

    return kept.withColumn("profile", parsed_profile(ask("_sample"))).drop("_sample")


def system_prompt(profile: Column, jargon: int = 25, rules: int = 12) -> Column:
    """What the provider is told of the domain: topic, jargon and confusions, bounded."""
    pairs = F.transform(F.slice(F.coalesce(F.map_entries(profile["confusion_rules"]), F.expr("cast(array() as array<struct<key:string,value:string>>)")), 1, rules), lambda e: F.concat(F.lit("  - "), e["key"], F.lit(" -> "), e["value"]))
    terms = F.array_join(F.slice(F.coalesce(profile["jargon_list"], F.array().cast("array<string>")), 1, jargon), ", ")
    return F.concat_ws("\n", F.lit("Correct each subtitle line. Answer with one line '[id] text' for each line given, nothing else."), F.concat(F.lit("Domain: "), F.coalesce(profile["domain"], F.lit(""))), F.concat(F.lit("Topic: "), F.coalesce(profile["topic"], F.lit(""))), F.concat(F.lit("Terms: "), terms), F.lit("Often confused:"), F.array_join(pairs, "\n"))


# ---------------------------------------------------------------------------- cache and batches


def with_cached(lines: DataFrame, cache: DataFrame, fallback: Column | None = None) -> DataFrame:
    """``candidate`` of each line from the cache: by its text, else by ``fallback`` of its text."""
    first = lines.join(cache.select("doc_id", "text", "candidate"), ["doc_id", "text"], "left")
    if fallback is None:
        return first
    own = "_"  # before the helper columns, so often that no column of the lines begins like them
    while any(c.startswith(own) for c in lines.columns):
        own += "_"
    second = cache.select(F.col("doc_id").alias(f"{own}d"), F.col("text").alias(f"{own}t"), F.col("candidate").alias(f"{own}c"))
    keyed = first.withColumn(f"{own}key", fallback)
    joined = keyed.join(second, (F.col("doc_id") == F.col(f"{own}d")) & (F.col(f"{own}key") == F.col(f"{own}t")), "left")
    return joined.withColumn("candidate", F.coalesce("candidate", f"{own}c")).select(*lines.columns, "candidate")


def uncached(lines: DataFrame, cache: DataFrame) -> DataFrame:
    return lines.join(cache, ["doc_id", "text"], "left_anti")


def batched(lines: DataFrame, size: int = BATCH) -> DataFrame:
    """``batch``: numbers lines of a document in order, ``size`` at a time."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("id"))
    return lines.withColumn("batch", F.floor((place - 1) / size).cast("int"))


def hit_rate(lines: DataFrame, cache: DataFrame) -> DataFrame:
    known = with_cached(lines, cache).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("candidate").alias("hits"))
    return known.withColumn("rate", F.round(F.col("hits") / F.col("n_lines"), 4))


# ---------------------------------------------------------------------------- answers

_ANSWER = r"^(?:\[(\d+)\]|(\d+)[.:：\s])\s*(.*)$"


def answered_lines(answers: DataFrame, lines: DataFrame, bounded: bool = True, by: str = "doc_id") -> DataFrame:
    """``by``, id, candidate: answers' lines whose number is one of ``lines``, the last of each.

    ``bounded``: candidates of 0.25 to 2.5 times the line's length only, checked before the last
    one is taken.
    """
    split = answers.select(by, F.posexplode(F.split(tx.strip(F.coalesce("answer", F.lit(""))), "\n")).alias("pos", "raw")).withColumn("raw", tx.strip(F.col("raw")))
    number = F.coalesce(*[F.nullif(F.regexp_extract("raw", _ANSWER, i), F.lit("")) for i in (1, 2)])
    found = split.select(by, "pos", number.try_cast("int").alias("id"), tx.strip(tx.without_marks(tx.strip(F.regexp_extract("raw", _ANSWER, 3)))).alias("candidate")).filter("id is not null and candidate <> ''")
    joined = found.join(lines.select(by, "id", F.col("text").alias("_line")), [by, "id"])
    if bounded:
        ratio = F.char_length("candidate") / F.greatest(F.char_length("_line"), F.lit(1))
        joined = joined.filter(ratio.between(0.25, 2.5))
    return joined.groupBy(by, "id").agg(tx.spaced(F.max_by("candidate", "pos")).alias("candidate"))


def ask_batches(batches: DataFrame, provider: Provider, tries: int = 1) -> DataFrame:
    """``answer`` of each row's (system, user); null where every try failed."""

    @F.pandas_udf("string")
    def run(system: pd.Series, user: pd.Series) -> pd.Series:
        return pd.Series([_answer(provider, s, u, tries) for s, u in zip(system, user, strict=True)], dtype="object")

    return batches.withColumn("answer", run("system", "user"))


def answers_logged(batches: DataFrame, provider: Provider, log: str, every: int = 10, tries: int = 1) -> DataFrame:
    """``answer`` of each row's (system, user) by a log in the folder ``log``, which outlives the run.

    A prompt is its own key. What the log holds isn't asked again; each task puts down its answers after
    ``every`` of them, as a file that appears whole, so a run that is killed has lost that many a task at
    most, and the next one asks for the rest. A prompt that stands in several rows is asked once. Between
    two prompts a task looks for the mark that ``stop_asking`` sets, and ends with what it has put down;
    prompts that weren't asked, or failed every try, have a null answer and no place in the log.
    """
    spark = batches.sparkSession
    keyed = batches.withColumn("_prompt", F.sha2(F.concat_ws("\x00", "system", "user"), 256))
    files, root = filesystem(log)
    files.create_dir(f"{root}/answers", recursive=True)
    known = lambda: spark.read.schema("prompt string, answer string").parquet(f"{log}/answers")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = filesystem(log)
        held: list[tuple[str, str]] = []
        asked = 0

        def put_down() -> None:
            if held:
                name = uuid.uuid4().hex
                with fs.open_output_stream(f"{top}/_{name}") as out:
                    pq.write_table(pa.table([pa.array(c) for c in zip(*held, strict=True)], names=["prompt", "answer"]), out)
                fs.move(f"{top}/_{name}", f"{top}/answers/{name}.parquet")
                held.clear()

        for batch in rows:
            for row in batch.to_pylist():
                if fs.get_file_info(f"{top}/stop").type:
                    break
                answer = _answer(provider, row["system"], row["user"], tries)
                asked += 1
                if answer is not None:
                    held.append((row["_prompt"], answer))
                if len(held) >= every:
                    put_down()
        put_down()
        yield pa.RecordBatch.from_arrays([pa.array([asked], pa.int64())], names=["asked"])

    todo = keyed.select("_prompt", "system", "user").dropDuplicates(["_prompt"]).join(known().select(F.col("prompt").alias("_prompt")), "_prompt", "left_anti")
    todo.mapInArrow(run, "asked long").agg(F.sum("asked")).collect()
    answers = known().groupBy(F.col("prompt").alias("_prompt")).agg(F.min("answer").alias("answer"))
    return keyed.join(answers, "_prompt", "left").drop("_prompt")


def stop_asking(log: str) -> None:
    """Tasks that ask for ``log`` end before their next prompt; ``ask_again`` takes the mark away."""
    files, root = filesystem(log)
    files.create_dir(root, recursive=True)
    files.open_output_stream(f"{root}/stop").close()


def ask_again(log: str) -> None:
    files, root = filesystem(log)
    if files.get_file_info(f"{root}/stop").type:
        files.delete_file(f"{root}/stop")


def _answer(provider: Provider, system: str, user: str, tries: int) -> str | None:
    for _ in range(tries):
        try:
            return provider.answer(system, user)
        except Exception:  # noqa: BLE001, S112  tried again, then left unanswered
            continue
    return None


@dataclass
class Corrected:
    lines: DataFrame
    cache: DataFrame
    fresh: DataFrame


def correct_lines(lines: DataFrame, provider: Provider, cache: DataFrame | None = None, profiles: DataFrame | None = None, variant: str = "service", store=None, at_once: int | None = None, compat: bool = False, tries: int = 2, log: str | None = None) -> Corrected:
    """Every line with ``corrected``, ``accepted``, ``reason`` and ``source``; the grown cache.

    Cached candidates are judged again. Lines without one go to the provider in batches; answers
    are written down by ``store`` (a function of a DataFrame; a scratch table if None) before they
    are used, so no provider is asked twice for one answer; with ``log``, a folder, they go to a log
    that a run which is killed or stopped leaves to the next one (``answers_logged``). A rejected candidate is cached as it
    came, a line without answer isn't. ``at_once`` bounds how many tasks ask at the same time,
    ``tries`` how often a batch is asked until the provider doesn't fail. A text with line breaks
    is asked about as one line.
    """
    spark = lines.sparkSession
    store = store or (lambda df: written(df, "answers"))
    cache = cache if cache is not None else spark.createDataFrame([], CACHE)
    known = profiles if profiles is not None else lines.select("doc_id").distinct().withColumn("profile", F.lit(None).cast(PROFILE))
    todo = batched(uncached(lines, cache))
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: F.concat(F.lit("["), x["id"].cast("string"), F.lit("] "), F.regexp_replace(x["text"], rf"[{tx.BLANKS}]*\n[{tx.BLANKS}]*", " "))), "\n")
    batches = todo.groupBy("doc_id", "batch").agg(prompt.alias("user")).join(known, "doc_id", "left").withColumn("system", system_prompt(F.col("profile")))
    if at_once:
        batches = batches.repartition(at_once)
    if log:
        answers = answers_logged(batches, provider, log, tries=tries).select("doc_id", "batch", "answer")
    else:
        answers = store(ask_batches(batches, provider, tries).select("doc_id", "batch", "answer"))
    numbered = todo.select("doc_id", "id", "text")
    fresh = answered_lines(answers, numbered)
    new = fresh.join(numbered, ["doc_id", "id"]).select("doc_id", "id", "text", "candidate")
    grown = cache.select("doc_id", "text", "candidate").unionByName(new.groupBy("doc_id", "text").agg(F.max_by("candidate", "id").alias("candidate")))
    had = with_cached(lines, cache).withColumnRenamed("candidate", "_cached")
    both = had.join(fresh.withColumnRenamed("candidate", "_fresh"), ["doc_id", "id"], "left").join(known, "doc_id", "left")
    both = both.withColumn("candidate", F.coalesce("_cached", "_fresh")).withColumn("source", F.when(F.col("_cached").isNotNull(), "cache").when(F.col("_fresh").isNotNull(), "provider").otherwise("none"))
    judged = both.withColumn("_g", verified(F.col("text"), F.col("candidate"), F.col("profile"), variant, compat=compat))
    none, accepted = F.col("candidate").isNull(), F.col("_g.accepted")
    done = judged.select(
        *lines.columns,
        F.when(~none & accepted, F.col("candidate")).otherwise(F.col("text")).alias("corrected"),
        (~none & accepted).alias("accepted"),
        F.when(none, "no_answer").otherwise(F.col("_g.reason")).alias("reason"),
        "source",
    )
    return Corrected(done, grown, new)


def correction_summary(corrected: DataFrame) -> DataFrame:
    """doc_id, lines, corrections made, cache hits and their rate."""
    made = F.count_if(F.col("corrected") != F.col("text"))
    hits = F.count_if(F.col("source") == "cache")
    return corrected.groupBy("doc_id").agg(F.count("*").alias("n_lines"), made.alias("corrections"), hits.alias("cache_hits"), F.round(hits / F.count("*"), 4).alias("hit_rate"))


def summaries_and_total(corrected: DataFrame) -> DataFrame:
    """The summary of every document and, with a null doc_id and ``is_total``, that of all, in one pass."""
    made, hits = F.count_if(F.col("corrected") != F.col("text")), F.count_if(F.col("source") == "cache")
    rows = corrected.rollup("doc_id").agg(F.grouping("doc_id").cast("int").alias("is_total"), F.count("*").alias("n_lines"), made.alias("corrections"), hits.alias("cache_hits"), F.round(hits / F.count("*"), 4).alias("hit_rate"))
    return rows.select("doc_id", "is_total", "n_lines", "corrections", "cache_hits", "hit_rate")


def read_cache_files(spark, path: str) -> DataFrame:
    """Caches as JSON objects, one file for each document, named by its number."""
    files = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"(\d+)[^/]*$", 1).try_cast("long").alias("doc_id"), "value")
    return files.select("doc_id", F.explode(F.from_json("value", "map<string,string>")).alias("text", "candidate"))


def as_json(rows: Iterator[tuple[str, str]]) -> str:
    return json.dumps(dict(rows), ensure_ascii=False)
