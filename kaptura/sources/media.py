"""Scans of folders and task records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaptura.functions.spoken import Glossary
from kaptura.operators import tasks

TASK = "task_id string, task_type string, status string, progress double, current_file string, total_files int, completed_files int, total_audio_duration double, processed_audio_duration double, elapsed_time double, speed_rtf double, created_at double, params map<string,string>, is_cancelled boolean, files array<struct<path:string,name:string,duration:double,status:string,progress:double,current_chunk:int,total_chunks:int,srt_path:string,txt_path:string,json_path:string,text_preview:string,segments_count:int,correction_count:int,corrections:array<struct<idx:int,from:string,to:string>>,error:string>>"
#: What a field of an older record is when it isn't there.
DEFAULTS = {"task_type": "transcribe", "status": "pending", "progress": 0.0, "current_file": "", "total_files": 0, "completed_files": 0, "total_audio_duration": 0.0, "processed_audio_duration": 0.0, "elapsed_time": 0.0, "speed_rtf": 0.0, "created_at": 0.0, "is_cancelled": False}


def listed(paths: DataFrame, root: str = "") -> DataFrame:
    """path, name, stem, folder, suffix of usable paths, each once."""
    relative = F.regexp_replace("path", "^" + root.rstrip("/").replace(".", r"\.") + "/?", "") if root else F.col("path")
    rows = tasks.first_of_each(paths.filter(~tasks.ignored(relative)), ["path"], [c for c in paths.columns if c != "path"] or ["path"])
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("name", name).withColumn("stem", F.regexp_replace(name, r"\.[^.]*$", "")).withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")).withColumn("suffix", tasks.suffix(F.col("path")))


def scan(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """All files below ``root`` with their sizes; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    sized = found.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.col("length").alias("size"), F.round(F.col("length") / 1048576, 2).alias("size_mb"))
    return listed(sized, root)


def media(files: DataFrame) -> DataFrame:
    """Media files, each with whether captions stand beside it or in a folder "srt" there."""
    captions = files.filter("suffix = '.srt'").select(F.regexp_replace("folder", "/srt$", "").alias("folder"), "stem")
    return tasks.with_output_flag(files.filter(tasks.is_media(F.col("path"))), captions)


def task_records(spark: SparkSession, path: str) -> DataFrame:
    """Persisted tasks; files that are no record are left out, absent fields have defaults."""
    rows = spark.read.schema(TASK).option("multiLine", "true").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.filter("task_id is not null").fillna(DEFAULTS)


def glossary(spark: SparkSession, path: str) -> Glossary:
    """A glossary file; small by nature, so it is read to the driver and sent with the functions."""
    import json

    try:
        rows = spark.read.text(path, wholetext=True).collect()
        data = json.loads(rows[0].value) if rows else {}
    except (ValueError, IndexError):
        data = {}
    return Glossary({str(k).upper(): str(v) for k, v in (data.get("acronyms") or {}).items()}, tuple((str(k), str(v)) for k, v in (data.get("terms") or {}).items()))
