"""Tasks and their files: roll-ups, states, histories, packages. All native."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kaptura.functions import lexicon as lex


def ignored(path):
    """A path with an ignored or hidden folder or file in it."""
    return F.exists(F.split(path, "/"), lambda p: p.isin(*lex.IGNORED_FOLDERS) | p.startswith("."))


def suffix(path):
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def is_media(path):
    return suffix(path).isin(*lex.MEDIA_EXTENSIONS)


def first_of_each(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key, by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def last_of_each(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first ``k`` rows of each key by ``order``, with ``place``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def folder_rollup(files: DataFrame, count: str = "duration", nested: bool = False) -> DataFrame:
    """folder, files, duration_sec and, with ``nested``, the files themselves in order of path."""
    more = [F.array_sort(F.collect_list(F.struct("path", "name", count))).alias("items")] if nested else []
    return files.groupBy("folder").agg(F.count("*").alias("n_files"), F.round(F.sum(count), 2).alias("duration_sec"), *more)


def folder_numbers(folders: DataFrame, name: str = "folder") -> DataFrame:
    """folder_id: fg_0, fg_1, ... in order of name; folders are few, files aren't moved."""
    return folders.withColumn("folder_id", F.concat(F.lit("fg_"), (F.row_number().over(Window.orderBy(name)) - 1).cast("string")))


def totals(files: DataFrame, duration: str = "duration") -> DataFrame:
    return files.agg(F.count("*").alias("n_files"), F.round(F.sum(duration), 2).alias("total_sec"), F.round(F.sum(duration) / 60, 1).alias("total_min"))


def folders_and_totals(files: DataFrame, duration: str = "duration", segments: str | None = None) -> DataFrame:
    """Every folder's row and, with a null folder and ``is_total``, that of all, in one pass; with
    ``segments``, a column of numbers, their totals too."""
    more = [F.sum(F.coalesce(segments, F.lit(0))).alias("segments_total")] if segments else []
    return files.rollup("folder").agg(F.count("*").alias("n_files"), F.round(F.sum(duration), 2).alias("duration_sec"), *more, F.grouping("folder").cast("int").alias("is_total"))


def task_totals(files: DataFrame, duration: str = "duration") -> DataFrame:
    """task_id, total_files, total_audio_duration: files without a duration count as files."""
    return files.groupBy("task_id").agg(F.count("*").alias("total_files"), F.round(F.coalesce(F.sum(duration), F.lit(0.0)), 2).alias("total_audio_duration"))


def progress(files: DataFrame) -> DataFrame:
    """task_id, progress: the files' mean, 99 at most until all are done, then 100."""
    done = F.every(F.col("status").isin("completed", "failed", "skipped"))
    return files.groupBy("task_id").agg(F.round(F.when(done, F.lit(100.0)).otherwise(F.least(F.lit(99.0), F.avg("progress"))), 2).alias("progress"))


def real_time_factor(files: DataFrame) -> DataFrame:
    """task_id, rtf: processed seconds of media for each second elapsed; null before any."""
    by = files.groupBy("task_id").agg(F.sum("processed").alias("p"), F.max("elapsed").alias("e"))
    return by.select("task_id", F.round(F.try_divide("p", F.nullif("e", F.lit(0.0))), 2).alias("rtf"))


def final_status(files: DataFrame, skipped_is_done: bool = True) -> DataFrame:
    """task_id, status: completed, partial or failed, by any file done and any failed."""
    done = F.col("status") == "completed"
    if skipped_is_done:
        done = done | (F.col("status") == "skipped")
    by = files.groupBy("task_id").agg(F.bool_or(done).alias("d"), F.bool_or(F.col("status") == "failed").alias("f"))
    return by.select("task_id", F.when(F.col("d") & F.col("f"), "partial").when(F.col("d"), "completed").when(F.col("f"), "failed").otherwise("pending").alias("status"))


def recent(tasks: DataFrame, created: str, key: str, limit: int = 30) -> DataFrame:
    return tasks.orderBy(F.desc(created), key).limit(limit)


def packaged(outputs: DataFrame, others: DataFrame) -> DataFrame:
    """name, path, size: files of some size, one for each name, the task's own before others."""
    both = outputs.select("name", "path", "size", F.lit(0).alias("rank")).unionByName(others.select("name", "path", "size", F.lit(1).alias("rank")))
    return first_of_each(both.filter("size > 0"), ["name"], ["rank", "path"]).drop("rank")


def without_tasks(folders: DataFrame, tasks: DataFrame, key: str = "task_id") -> DataFrame:
    return folders.join(tasks.select(key), key, "left_anti")


def without_output(files: DataFrame, outputs: DataFrame, force: bool = False) -> DataFrame:
    """Files that still need work: those without a caption file of their stem beside them."""
    return files if force else files.join(outputs.select("folder", "stem"), ["folder", "stem"], "left_anti")


def with_output_flag(files: DataFrame, outputs: DataFrame) -> DataFrame:
    found = outputs.select("folder", "stem").distinct().withColumn("has_srt", F.lit(True))
    return files.join(found, ["folder", "stem"], "left").withColumn("has_srt", F.coalesce("has_srt", F.lit(False)))


def evenly_sampled(lines: DataFrame, key: str, order: str, text: str = "text", most: int = 28, least_chars: int = 8, cjk: bool = True) -> DataFrame:
    """About thirty lines of each document, evenly: of long ones those from 4 to 96 percent."""
    w = Window.partitionBy(key).orderBy(order)
    size = F.count("*").over(Window.partitionBy(key))
    rows = lines.withColumn("_i", F.row_number().over(w) - 1).withColumn("_n", size)
    lo, hi = (F.when(F.col("_n") > 200, F.floor(F.col("_n") * F.lit(share))).otherwise(other) for share, other in ((0.04, F.lit(0)), (0.96, F.col("_n"))))
    step = F.greatest(F.lit(1), F.floor((hi - lo) / 30))
    fits = (F.col("_i") >= lo) & (F.col("_i") < hi) & ((F.col("_i") - lo) % step == 0) & (F.char_length(F.trim(text)) >= least_chars)
    if cjk:
        fits = fits & F.col(text).rlike(r"[一-鿿]")
    return last_of_each(rows.filter(fits), [key], [order], most).drop("_i", "_n")
