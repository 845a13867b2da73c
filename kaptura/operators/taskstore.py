"""A table of tasks: created, listed, fetched, cancelled, cleared.

Each change writes one small record; a task's state is its newest record. Work of a task runs
under a Spark tag, by which it is cancelled.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaptura.operators import tasks

RECORD = "task_id string, task_type string, status string, progress double, created_at double, seq long, params map<string,string>, files array<struct<path:string,name:string,duration:double,status:string,progress:double,error:string>>, deleted boolean"
FINAL = ("completed", "partial", "failed", "cancelled")


class TaskStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _put(self, record: dict) -> None:
        row = self.spark.createDataFrame([{"deleted": False, **record, "seq": time.time_ns()}], RECORD)
        row.coalesce(1).write.mode("append").parquet(self.path)

    def records(self) -> DataFrame:
        return self.spark.read.schema(RECORD).parquet(self.path)

    def all(self) -> DataFrame:
        """Each task's newest state; deleted ones are out."""
        newest = self.records().groupBy("task_id").agg(F.max_by(F.struct("*"), "seq").alias("t"))
        return newest.select("t.*").filter("not deleted")

    def create(self, files: list[dict], task_type: str = "transcribe", params: dict[str, str] | None = None) -> str:
        """A task over files (path and what is known of each), each path once."""
        seen: dict[str, dict] = {}
        for f in files:
            seen.setdefault(f["path"], {"path": f["path"], "name": f["path"].rsplit("/", 1)[-1], "duration": float(f.get("duration") or 0.0), "status": "pending", "progress": 0.0, "error": None})
        key = uuid.uuid4().hex[:12]
        self._put({"task_id": key, "task_type": task_type, "status": "pending", "progress": 0.0, "created_at": time.time(), "params": params or {}, "files": list(seen.values())})
        return key

    def get(self, key: str) -> dict | None:
        row = self.all().filter(F.col("task_id") == key).first()
        return row.asDict(recursive=True) if row else None

    def listed(self, limit: int = 30) -> DataFrame:
        return tasks.recent(self.all(), "created_at", "task_id", limit)

    def update(self, key: str, **changes) -> None:
        """Progress never falls back."""
        now = self.get(key)
        if now is None:
            raise KeyError(key)
        if "progress" in changes:
            changes["progress"] = max(now["progress"], changes["progress"])
        self._put({**now, **changes})

    def run(self, key: str, work: Callable[[dict], DataFrame], sink: Callable[[DataFrame], None]) -> str:
        """Run a task's work under its tag; its state is then completed, failed or cancelled."""
        task = self.get(key)
        if task is None:
            raise KeyError(key)
        if task["status"] == "cancelled":
            return "cancelled"
        self.update(key, status="running")
        self.spark.addTag(f"task-{key}")
        try:
            sink(work(task))
            status = "completed"
        except Exception:
            status = "cancelled" if (self.get(key) or {}).get("status") == "cancelled" else "failed"
            if status == "failed":
                self.update(key, status=status)
                raise
        finally:
            self.spark.removeTag(f"task-{key}")
        if (self.get(key) or {}).get("status") == "cancelled":
            status = "cancelled"
        self.update(key, status=status, progress=100.0 if status == "completed" else 0.0)
        return status

    def cancel(self, key: str) -> bool:
        """Whether the task was still open; its jobs are interrupted."""
        task = self.get(key)
        if task is None or task["status"] in FINAL:
            return False
        self.update(key, status="cancelled")
        self.spark.interruptTag(f"task-{key}")
        return True

    def delete(self, key: str) -> bool:
        task = self.get(key)
        if task is None or task["status"] == "running":
            return False
        self._put({**task, "deleted": True})
        return True

    def clear(self) -> int:
        """Final tasks go; how many went."""
        done = [r.task_id for r in self.all().filter(F.col("status").isin(*FINAL)).select("task_id").toLocalIterator()]
        return sum(self.delete(k) for k in done)
