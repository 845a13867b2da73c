"""Queries of profiles and prompts, and of files that are written from the tables and read again."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import functions as F

from kaptura.operators import correct
from kaptura.plans.queries import _CACHE, SQL, query, task_files, turn_cache
from kaptura.session import scratch, table
from kaptura.sources import media, sinks


@query(
    """select doc_id, 'Correct each subtitle line. Answer with one line ''[id] text'' for each line given, nothing else.' || chr(10) || 'Domain: ' || source || chr(10) || 'Topic: ' || lang || chr(10) || 'Terms: ' ||
  array_to_string(list_transform(range(1, least(25, 10 + doc_id % 40) + 1), lambda i: 'j' || i), ', ') || chr(10) || 'Often confused:' || chr(10) ||
  array_to_string(list_transform(range(1, least(12, 5 + doc_id % 20) + 1), lambda i: '  - k' || i || ' -> ' || source || i), chr(10)) prompt from documents"""
)
def prompt_limits(spark, sf_dir):
    """Prompts of profiles with up to 49 terms and 24 confusions, of which 25 and 12 are told."""
    n = lambda least, span: F.sequence(F.lit(1), F.lit(least) + (F.col("doc_id") % span).cast("int"))
    jargon = F.transform(n(10, 40), lambda i: F.concat(F.lit("j"), i.cast("string")))
    rules = F.map_from_entries(F.transform(n(5, 20), lambda i: F.struct(F.concat(F.lit("k"), i.cast("string")), F.concat("source", i.cast("string")))))
    profile = F.struct(F.col("source").alias("domain"), F.col("lang").alias("topic"), jargon.alias("jargon_list"), rules.alias("confusion_rules"), F.lit(None).cast("string").alias("style_notes"))
    rows = table(spark, sf_dir, "documents").select("doc_id", profile.alias("p"))
    return rows.select("doc_id", correct.system_prompt(F.col("p")).alias("prompt"))


@dataclass(frozen=True)
class Measuring:
    """Tells a sample's length and first letters as its profile; fails for every sample that is short."""

    def answer(self, system: str, user: str) -> str:
        if len(user) < 100:
            raise ValueError("too short")
        letters = "".join(c for c in user if c.isascii() and c.isalpha())[:8]
        return "<think>hm</think>```json\n" + json.dumps({"domain": str(len(user)), "topic": letters, "jargon_list": [letters.lower(), system]}) + "\n```"


@query(
    f"""select doc_id, case when length(sample) >= 100 then length(sample)::varchar end as domain, case when length(sample) >= 100 then letters end topic, case when length(sample) >= 100 then [lower(letters), 'told'] else []::varchar[] end jargon
from (select doc_id, sample, substring(regexp_replace(sample, '[^A-Za-z]+', '', 'g'), 1, 8) letters from ({SQL["text_three_slices"]}))"""
)
def document_profiles(spark, sf_dir):
    """Every document's profile by a provider that sees a sample of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("full_text"))
    p = F.col("profile")
    return correct.profiled(docs, Measuring(), system="told").select("doc_id", p["domain"].alias("domain"), p["topic"].alias("topic"), p["jargon_list"].alias("jargon"))


@query(f"select doc_id, text, candidate from {_CACHE}")
def cache_files(spark, sf_dir):
    """The cache as a JSON file for each document, written and read again."""
    folder = scratch(spark, "caches")
    pairs = F.map_from_entries(F.collect_list(F.struct("text", "candidate")))
    files = turn_cache(spark, sf_dir).groupBy("doc_id").agg(F.to_json(pairs).alias("cache"))
    sinks.write_each(files, "doc_id", "cache", folder, ".json")
    return correct.read_cache_files(spark, folder)


@query("select user_id::varchar task_id, 'transcribe' task_type, count(*)::int total_files, case when user_id % 2 = 0 then 'completed' else 'pending' end status, case when user_id % 3 = 0 then round(sum((event_id % 50)::double), 2) else 0 end total_audio_duration from events group by user_id")
def task_files_read(spark, sf_dir):
    """A record file for each task, some fields left out, and files that are no record."""
    folder = scratch(spark, "tasks")
    by = task_files(spark, sf_dir).groupBy("task_id").agg(F.count("*").alias("n"), F.round(F.sum("processed"), 2).alias("length"))
    record = F.struct(F.col("task_id").cast("string").alias("task_id"), F.col("n").cast("int").alias("total_files"), F.when(F.col("task_id") % 2 == 0, "completed").alias("status"), F.when(F.col("task_id") % 3 == 0, F.col("length")).alias("total_audio_duration"))
    sinks.write_each(by.select("task_id", F.to_json(record).alias("record")), "task_id", "record", folder, ".json")
    sinks.write_each(by.select("task_id", F.lit("no record").alias("record")), "task_id", "record", f"{folder}/other", ".json")
    return media.task_records(spark, folder).select("task_id", "task_type", "total_files", "status", "total_audio_duration")
