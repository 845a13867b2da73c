"""Sessions, tables, and tables written on the way."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A session on this machine; on a cluster the caller brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, for a map that costs more than a shuffle.

    A file of one row group is read by one task, however many partitions the scan plans. A table
    of at least as many files as there are cores is read in parallel as it is and doesn't move.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if len(rows.inputFiles()) >= cores else rows.repartition(4 * cores)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder of ``spark.checkpoint.dir``, or in the warehouse, which executors share
    too, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/kaptura/{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written and read back: computed once, and a cut in the lineage that survives lost executors."""
    path = scratch(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def filesystem(path: str):
    """(filesystem, root) of a folder that every executor can reach, for what tasks write themselves."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
