"""Progress and captions as streams.

Progress: snapshots keyed by file; each batch keeps the newest of a file and upserts it, so a
batch that runs again changes nothing. Captions: lines are given out as they become final, from a
keyed state that holds what may still change and doesn't grow with the document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from kaptura.operators.lines import Word
from kaptura.operators.resume import Resumable

KINDS = {"boolean": BooleanType(), "double": DoubleType(), "int": IntegerType(), "long": LongType(), "string": StringType()}


def fields(ddl: str) -> StructType:
    """A schema that needs no session: workers read it, too."""
    return StructType([StructField(name, KINDS[kind]) for name, kind in (f.split() for f in ddl.split(","))])


LINES = fields("doc_id long, id int, start_time double, end_time double, text string")
PLACE = fields("ended double, at_sentence boolean, base int, line int, columns int, cut int, moved int, end int, before int, start int, given int, next int")
WORDS = fields("kind string, text string, start double, end double, sentence_end boolean, clause_end boolean")
WAITING = fields("kind string, start double, end double, text string")
EARLY = fields("pos int, text string, start double, end double, sentence_end boolean, last boolean")


def newest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The newest snapshot of each key; never less progress than an older one had."""
    others = [c for c in rows.columns if c not in (key, "progress")]
    return rows.groupBy(key).agg(F.max("progress").alias("progress"), F.max_by(F.struct(*others), order).alias("s")).select(key, "progress", "s.*").select(*rows.columns)


def publish(progress: DataFrame, path: str, checkpoint: str, key: str = "file_id", order: str = "seq", every: str | None = None, kept: int = 100) -> StreamingQuery:
    """Keep a table of the newest snapshots under ``path``: a version for each batch, and beside it, in
    ``changes``, the rows that it has changed. The last ``kept`` versions stay for those who subscribe."""

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        old = f"{path}/v{number - 1}"
        rows = batch
        if number and _exists(spark, old):
            rows = batch.unionByName(spark.read.schema(batch.schema).parquet(old))
        newest(rows, key, order).write.mode("overwrite").parquet(f"{path}/v{number}")
        now = spark.read.schema(batch.schema).parquet(f"{path}/v{number}")
        changed = now.join(batch.select(key).distinct().withColumnRenamed(key, "_changed"), F.col(key).eqNullSafe(F.col("_changed")), "left_semi")
        changed.write.mode("overwrite").parquet(f"{path}/changes/v{number}")  # last: with it the version is there
        if number > kept:
            _remove(spark, f"{path}/v{number - kept - 1}")

    writer = progress.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Captions(StatefulProcessor):
    """A document's state in typed parts: where the segmentation stands, the words that a line may still
    change, lines that wait for the next, and tokens that came before their turn. Words of some lines
    only are kept, however long the document; a clause is kept whole where a tokenizer has to see it,
    and a run of words that may not begin a line as long as it goes on."""

    def __init__(self, tokenizer: Callable[[str], list[str]] | None = None, idle: float | None = None):
        self.tokenizer, self.idle = tokenizer, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", PLACE)
        self.words = handle.getListState("words", WORDS)
        self.lines = handle.getListState("lines", WAITING)
        self.early = handle.getListState("early", EARLY)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        told, place = self._load()
        waiting = {t[0]: t for t in self.early.get()}
        for part in rows:
            part = part[["pos", "text", "start", "end", "sentence_end", "last"]]
            for pos, text, start, end, sentence_end, last in part.itertuples(index=False, name=None):
                if pos >= place:
                    waiting[int(pos)] = (int(pos), text, float(start), float(end), bool(sentence_end) and sentence_end == sentence_end, bool(last) and last == last)
        out, over = [], False
        while not over and place in waiting:
            _, text, start, end, sentence_end, over = waiting.pop(place)
            out += told.token(Word(text, start, end, sentence_end), self.tokenizer) if text else ()
            place += 1
        yield from self._told(key, out, told, place, list(waiting.values()), over)
        for timer in list(self.handle.listTimers()) if self.idle else ():
            self.handle.deleteTimer(timer)
        if self.idle and not over:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.idle * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No token has come for so long that the document is over."""
        told, place = self._load()
        out = []
        for _, text, start, end, sentence_end, _ in sorted(self.early.get()):
            out += told.token(Word(text, start, end, sentence_end), self.tokenizer) if text else ()
        yield from self._told(key, out, told, place, [], True)

    def _load(self) -> tuple[Resumable, int]:
        told, place = Resumable(), 0
        if self.place.exists():
            told.ended, told.at_sentence, told.base, told.line, told.columns, told.cut, told.moved, told.end, told.before, told.start, told.given, place = self.place.get()
            for kind, *word in self.words.get():
                (told.held if kind == "held" else told.words).append(Word(*word))
            for kind, start, end, text in self.lines.get():
                told.shown += [(start, end, text)] if kind == "shown" else []
                told.last += [[start, end, text]] if kind == "last" else []
        return told, place

    def _told(self, key: tuple, out: list, told: Resumable, place: int, early: list, over: bool) -> Iterator[pd.DataFrame]:
        if over:
            out += told.finish(self.tokenizer)
            for state in (self.place, self.words, self.lines, self.early):
                state.clear()
        else:
            self.place.update((told.ended, told.at_sentence, told.base, told.line, told.columns, told.cut, told.moved, told.end, told.before, told.start, told.given, place))
            words = [(kind, w.text, w.start, w.end, w.sentence_end, w.clause_end) for kind, part in (("held", told.held), ("word", told.words)) for w in part]
            lines = [("shown", *s) for s in told.shown] + [("last", *s) for s in told.last]
            for state, rows in ((self.words, words), (self.lines, lines), (self.early, early)):
                state.put(rows) if rows else state.clear()
        yield pd.DataFrame([(key[0], *line) for line in out], columns=["doc_id", "id", "start_time", "end_time", "text"])


def live_captions(tokens: DataFrame, tokenizer: Callable[[str], list[str]] | None = None, idle: float | None = None) -> DataFrame:
    """Final lines of a stream of tokens (doc_id, pos, text, start, end, sentence_end, last).

    ``pos`` counts a document's tokens from 0; one that comes early waits, one that comes again is
    passed over. A document is over with its token ``last``, or when none has come for ``idle`` seconds
    of processing time; then its other lines are given out and its state goes. The session's state store
    becomes RocksDB, which keyed state with timers needs.
    """
    tokens.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    mode = "ProcessingTime" if idle else "None"
    return tokens.groupBy("doc_id").transformWithStateInPandas(Captions(tokenizer, idle), LINES, "Append", mode)


def normalise_stream(lines: DataFrame, glossary_path: str, sink: Callable[[DataFrame, int], None], checkpoint: str, text: str = "text") -> StreamingQuery:
    """Lines normalised batch by batch; the glossary is read anew for each, so a change of the
    file counts from the next batch on, and what it no longer holds counts no more."""
    from kaptura.functions.spoken import normalised
    from kaptura.sources.media import glossary

    def each(batch: DataFrame, number: int) -> None:
        known = glossary(batch.sparkSession, glossary_path)
        sink(batch.withColumn(text, normalised(F.col(text), known)), number)

    return lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def session_clauses(events: DataFrame, key: str, time: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Breath clauses of a stream: sessions of a key; what is still open at the end is held."""
    timed = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    return timed.groupBy(key, F.session_window("_t", gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
