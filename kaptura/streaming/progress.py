"""Progress for those who watch: a throttle by file, and a source over the versions of the progress table."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import LongType, StructField, StructType

from kaptura.session import filesystem

#: Seconds between two snapshots of one file.
EVERY = 1.5
VERSION = re.compile(r"v(\d+)$")


class Throttle(StatefulProcessor):
    """The first snapshot of a file goes out at once; while ``every`` seconds from the last one out aren't
    over the newest is held back, and a timer sends it when they are. One that ``over`` marks as the
    file's last is sent at once, and the file's state goes."""

    def __init__(self, schema: StructType, key: str, order: str, over: str, every: float):
        self.schema, self.key, self.order, self.over, self.every = schema, key, order, over, int(every * 1000)
        self.names = schema.fieldNames()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.schema)
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        newest = tuple(self.held.get()) if self.held.exists() else None
        for part in rows:
            for row in part[self.names].astype(object).where(part[self.names].notna(), None).itertuples(index=False, name=None):
                if newest is None or row[self.names.index(self.order)] >= newest[self.names.index(self.order)]:
                    newest = row
        now = timerValues.getCurrentProcessingTimeInMs()
        due = self.due.get()[0] if self.due.exists() else 0
        if newest[self.names.index(self.over)]:
            self._clear()
            yield self._out(newest)
        elif now >= due:
            self._clear()
            self.due.update((now + self.every,))
            yield self._out(newest)
        else:
            if not self.held.exists():
                self.handle.registerTimer(due)
            self.held.update(newest)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            row = tuple(self.held.get())
            self.held.clear()
            self.due.update((timerValues.getCurrentProcessingTimeInMs() + self.every,))
            yield self._out(row)

    def _clear(self) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.held.clear()
        self.due.clear()

    def _out(self, row: tuple) -> pd.DataFrame:
        return pd.DataFrame([row], columns=self.names)


def throttled(snapshots: DataFrame, key: str = "file_id", order: str = "seq", over: str = "done", every: float = EVERY) -> DataFrame:
    """A stream of snapshots with one of a file in ``every`` seconds at most, the newest; none is lost that
    ``over`` (a boolean column) marks as the last. A null key is a file of its own."""
    snapshots.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    processor = Throttle(snapshots.schema, key, order, over, every)
    return snapshots.groupBy(key).transformWithStateInPandas(processor, snapshots.schema, "Append", "ProcessingTime")


# ---------------------------------------------------------------------------- subscribe


class Part(InputPartition):
    def __init__(self, folder: str):
        self.folder = folder


class Versions(DataSourceStreamReader):
    """Offsets are numbers of versions. The first batch is the snapshot that stands then, each later one
    what has changed in the versions since: a batch that is read again is the same."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path, schema

    def _newest(self) -> int:
        from pyarrow import fs

        files, root = filesystem(f"{self.path.rstrip('/')}/changes")
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return max((int(VERSION.search(f.path.removesuffix("/_SUCCESS"))[1]) for f in found if f.base_name == "_SUCCESS"), default=-1)

    def initialOffset(self) -> dict:
        return {"version": -1}

    def latestOffset(self) -> dict:
        return {"version": self._newest()}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        a, b = start["version"], end["version"]
        if a < 0 <= b:
            return [Part(f"{self.path}/v{b}")]
        return [Part(f"{self.path}/changes/v{n}") for n in range(a + 1, b + 1)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        files, root = filesystem(partition.folder)
        found = ds.dataset(root, format="parquet", filesystem=files)
        for batch in found.to_batches(columns=self.schema.fieldNames()):
            if batch.num_rows:
                yield batch


class ProgressSource(DataSource):
    """``spark.readStream.format("progress").schema(...).load(path)``: the table that ``live.publish`` keeps."""

    @classmethod
    def name(cls) -> str:
        return "progress"

    def schema(self) -> str:
        raise ValueError("the schema of the progress table must be given")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return Versions(self.options["path"], schema)


def subscribed(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stream of the progress table under ``path``: the snapshot that stands, then every change."""
    spark.dataSource.register(ProgressSource)
    return spark.readStream.format("progress").schema(schema).load(path)
