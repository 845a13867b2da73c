"""Scratch tables in the cluster's shared folder, and small helpers the operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Characters of a word that caches keep; longer ones are worked out each time, so that a cache of so
#: many entries is bounded in bytes, whatever the language or encoding.
LONGEST_KEPT = 64
#: Rows of two or three numbers that may be broadcast: some 100 MB in memory.
FEW_ROWS = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one in the warehouse, which executors share
    too, where that is unset."""
    base = spark.conf.get(CHECKPOINT_KEY, None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kaptura/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few_rows(df: DataFrame, most: int = FEW_ROWS) -> bool:
    """Whether a written table of a few numbers a row is small enough to be broadcast."""
    return df.limit(most + 1).count() <= most


def clear_scratch(spark: SparkSession) -> None:
    """Remove all tables written here; results that still read them must have been written first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/kaptura")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def open_fs(uri: str):
    """(filesystem, path) for a URI that every executor can reach."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri
