"""Repair of token times, cutting of long audio, and character times."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kaptura.functions import lexicon as lex
from kaptura.operators.documents import FLAGGED, map_documents

LONGEST, STRETCHED, TOUCHING = 1.2, 0.5, 0.2
JUMP, MARGIN, SHORT = 0.4, 0.05, 0.05
FAR = 999.0


def ordered_end(start: Column, end: Column, least: float = 0.05) -> Column:
    """An end before its start moves behind it."""
    return F.when(end < start, start + least).otherwise(end)


def repaired_times(start: Sequence[float], end: Sequence[float]) -> tuple[Sequence[float], Sequence[float], set[int]]:
    """Stretched tokens shortened, backward jumps marked and what runs into them pulled back.

    Starts and ends are two columns that are changed in the order of the tokens: a gap is
    measured from the end that the token before has by then. Also gives the places of the jumps.
    """
    n, jumps = len(start), set()
    if n and not (None in start or None in end):
        a, b = np.array(start, float), np.array(end, float)
        if (b >= a).all() and (b - a <= LONGEST).all() and (a[1:] >= a[:-1]).all():
            return start, end, jumps
    start, end = list(start), list(end)
    for i in range(n):
        if end[i] - start[i] <= LONGEST:
            continue
        before = start[i] - end[i - 1] if i else FAR
        after = start[i + 1] - end[i] if i + 1 < n else FAR
        if before >= TOUCHING > after:
            start[i] = end[i] - STRETCHED
        else:
            end[i] = start[i] + STRETCHED
    for i in range(1, n):
        back = start[i - 1] - start[i]
        if back >= JUMP:
            jumps.add(i)
            limit, k = start[i] - MARGIN, i - 1
            while k >= 0 and max(start[k], end[k]) > limit:
                end[k] = min(end[k], limit)
                start[k] = min(start[k], end[k] - SHORT)
                k -= 1
        elif back > 0:
            start[i] = start[i - 1]
            if end[i] < start[i]:
                end[i] = start[i] + SHORT
    return start, [b if b >= a else a + SHORT for a, b in zip(start, end, strict=True)], jumps


def repair(tokens: Sequence[dict] | None) -> list[dict]:
    """Tokens with repaired times, ``jump`` and flags that are not known yet."""
    tokens = tokens or []
    start, end, jumps = repaired_times([t["start"] for t in tokens], [t["end"] for t in tokens])
    return [{"text": t["text"], "start": a, "end": b, "jump": i in jumps, "punctuation": "", "sentence_end": False, "clause_end": False} for i, (t, a, b) in enumerate(zip(tokens, start, end, strict=True))]


def repaired(docs: DataFrame, tokens: str = "tokens") -> DataFrame:
    return map_documents(docs, [tokens], tokens, T.ArrayType(FLAGGED), repair)


_ROW_BLANKS = re.compile("[ \t\n\x0b\f\r]+")
_OTHER_BLANKS = re.compile("[^\\S \t\n\x0b\f\r]")


def paced(text: str | None, per_second: float = 3.0) -> tuple[list[str], list[float], list[float]]:
    """The tokens of ``transcripts.from_lines`` by columns."""
    text = (text or "").strip()
    words = [w for w in _ROW_BLANKS.split(text) if w] if _OTHER_BLANKS.search(text) else text.split()
    at = np.arange(len(words))
    return words, (at / per_second).tolist(), ((at + 0.8) / per_second).tolist()


def pauses(tokens: DataFrame, key: str, order: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """``pause``: from a token's end to the next one's start; null for the last."""
    return tokens.withColumn("pause", F.lead(start).over(Window.partitionBy(key).orderBy(*order)) - F.col(end))


def breath_clauses(tokens: DataFrame, key: str, order: list[str], pause: float = 0.38, sentence_pause: float = 0.12) -> DataFrame:
    """``clause``: from 0, one more behind each breath: a long pause, a short one at a sentence's
    end, or a backward jump. Native: one exchange by ``key`` serves both windows."""
    w = Window.partitionBy(key).orderBy(*order)
    gap = F.col("start") - F.lag("end").over(w)
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in tokens.columns else F.lit(False)
    ended = F.coalesce(F.lag(flag("sentence_end")).over(w), F.lit(False))
    cut = F.coalesce((gap >= pause) | ended & (gap >= sentence_pause) | flag("jump") & gap.isNotNull(), F.lit(False))
    rows = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return tokens.withColumn("_cut", cut.cast("int")).withColumn("clause", F.sum("_cut").over(rows)).drop("_cut")


def letter_runs(tokens: DataFrame, key: list[str], order: str) -> DataFrame:
    """Runs of single ASCII letters or digits within ``key`` become one token each: the texts and times
    of all, ``order`` of the first, what else a token has of the last."""
    single = F.col("text").rlike(r"^[A-Za-z0-9]\z")
    w = Window.partitionBy(*key).orderBy(order)
    joined = F.coalesce(single & F.lag(single).over(w), F.lit(False))
    run = F.sum(F.when(joined, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    others = [c for c in tokens.columns if c not in (*key, order, "text", "start", "end", "run")]
    parts = F.array_sort(F.collect_list(F.struct(order, "text", "start", "end", *others)))
    grouped = tokens.withColumn("run", run).groupBy(*key, "run").agg(parts.alias("p"))
    first, last = F.col("p")[0], F.element_at("p", -1)
    return grouped.select(*key, "run", first[order].alias(order), F.array_join(F.col("p.text"), "").alias("text"), first["start"].alias("start"), last["end"].alias("end"), *(last[c].alias(c) for c in others))


def letters_together(words: Column) -> Column:
    """``letter_runs`` of an array of words that have no times and no blanks in them: within the row."""
    text = F.regexp_replace(F.array_join(words, " "), r"(?<![^ ])([A-Za-z0-9]) (?=[A-Za-z0-9](?: |\z))", "$1")
    return F.filter(F.split(text, " "), lambda w: w != "")


# ---------------------------------------------------------------------------- long audio


# Fixed values, in seconds: the averaged window and the distance between two of them, how far from
# its due time a cut may move, and what it keeps away from the cut before and the end.
QUIET_WINDOW, QUIET_HOP, CUT_SLACK, FROM_LAST_CUT, FROM_END = 0.2, 0.05, 3.0, 60.0, 1.0


def quiet_place(heard: np.ndarray, rate: int) -> float | None:
    """Seconds to the middle of the first of the quietest windows; None if none fits."""
    width, hop = int(QUIET_WINDOW * rate), int(QUIET_HOP * rate)
    if not hop or len(heard) < width + hop:
        return None
    means = np.lib.stride_tricks.sliding_window_view(heard, width)[: len(heard) - width - (len(heard) - width) % hop : hop].mean(axis=1)
    return (int(means.argmin()) * hop + width / 2) / rate


def quiet_places(media: DataFrame, samples: str, rate: int) -> DataFrame:
    """``quiet``: the quiet place of each row's samples."""

    def find(wave: Sequence[float] | None) -> float | None:
        level = np.abs(np.asarray(wave if wave is not None else [], np.float32))
        return quiet_place(level, rate)

    return map_documents(media, [samples], "quiet", T.DoubleType(), find, [c for c in media.columns if c != samples]).drop("quiet_error")


def _cut_times(total: float, hear: Callable[[float, float], np.ndarray] | None, rate: int, longest: float) -> Iterator[float]:
    last = 0.0
    while (due := last + longest) < total:
        a, b = max(last + FROM_LAST_CUT, due - CUT_SLACK), min(total - FROM_END, due + CUT_SLACK)
        quiet = quiet_place(hear(a, b), rate) if hear and a < b else None
        last = due if quiet is None else a + quiet
        yield last


def cuts_into_chunks(total: float, hear: Callable[[float, float], np.ndarray] | None, rate: int, longest: float = 300.0) -> list[tuple[float, float]]:
    """Chunks of about ``longest`` seconds at most; ``hear`` gives the levels between two times and is
    asked for what lies around the cuts only, so that each lies in a quiet place."""
    cuts = [round(c, 2) for c in _cut_times(total, hear, rate, longest)]
    edges = [0.0, *cuts, round(total, 2) if cuts else total]
    return [pair for pair in itertools.pairwise(edges) if not cuts or pair[0] < pair[1]]


def chunk_bounds(total: float, samples: Sequence[float] | None = None, rate: int = 16_000, longest: float = 300.0) -> list[tuple[float, float]]:
    """Chunks of a sound whose samples are at hand, or of one of which only the length is known."""
    if samples is None or rate <= 0:
        return cuts_into_chunks(total, None, rate, longest)
    level = np.abs(np.asarray(samples, np.float32))
    return cuts_into_chunks(total, lambda a, b: level[int(a * rate) : int(b * rate)], rate, longest)


def chunks(media: DataFrame, duration: str = "duration", samples: str | None = None, rate: int = 16_000) -> DataFrame:
    """One row for each chunk of each row of ``media``: chunk, chunk_start, chunk_end."""
    kind = T.ArrayType(T.StructType([T.StructField("chunk_start", T.DoubleType()), T.StructField("chunk_end", T.DoubleType())]))

    def cut(total, wave=None):
        return [{"chunk_start": a, "chunk_end": b} for a, b in chunk_bounds(total or 0.0, wave, rate)]

    out = map_documents(media, [duration, samples] if samples else [duration], "cuts", kind, cut, [c for c in media.columns if c != samples])
    return out.select(*[c for c in media.columns if c != samples], F.posexplode("cuts").alias("chunk", "c")).select("*", "c.*").drop("c")


def rebased(tokens: DataFrame, chunk_table: DataFrame, keys: list[str]) -> DataFrame:
    """Times within chunks as times of the whole; ends at least 0.05 behind starts."""
    at = F.col("chunk_start")
    joined = tokens.join(chunk_table.select(*keys, "chunk_start"), keys)
    return joined.select(*tokens.columns[:-2], F.round(F.col("start") + at, 3).alias("start"), F.round(F.greatest("end", F.col("start") + 0.05) + at, 3).alias("end"))


# ---------------------------------------------------------------------------- character times

_PLAIN = frozenset(lex.HARD_BREAKS + lex.SOFT_BREAKS + lex.OUTER_PUNCTUATION)


@functools.lru_cache(1 << 16)
def folded(text: str) -> str:
    return unicodedata.normalize("NFKC", text).lower().strip()


def character_times(text: str | None, tokens: Sequence[dict] | None, ahead: int = 15) -> list[tuple[str, float, float]]:
    """(character, start, end) of each character of a punctuated text.

    A character takes the time of the next of 15 tokens that holds it, else 0.08 s behind the
    one before; punctuation has no duration.
    """
    times = character_columns(text, *([t[k] for t in tokens or ()] for k in ("text", "start", "end")), ahead)
    return list(zip(text, *times, strict=True)) if times else []


def character_columns(text: str | None, texts: Sequence[str | None], starts: Sequence[float | None], ends: Sequence[float | None], ahead: int = 15) -> tuple[list[float], list[float]] | None:
    """Starts and ends of ``character_times``; None without characters or tokens."""
    usable = []
    for word, a, b in zip(texts, starts, ends, strict=True):
        word = (word or "").strip()
        if word:
            a, b = a or 0.0, b or 0.0
            usable.append((word, a, b if b > a else a + 0.08))
    if not text or not usable:
        return None
    begun, ended, at, end, n = [], [], 0, usable[0][2], len(usable)
    keys = {c: "" if (key := folded(c)) in _PLAIN else key for c in set(text)}
    words = unicodedata.normalize("NFKC", "\n".join(u[0] for u in usable)).lower()
    if words.count("\n") != n - 1:  # no character is a line break when folded
        words = "\n".join(folded(u[0]).replace("\n", " ") for u in usable)
    begin = [0, *itertools.accumulate(len(w) + 1 for w in words.split("\n"))]
    for i, c in enumerate(text):
        if at == n:  # no token is left: times go on by themselves
            codes = np.frombuffer(text[i:].encode("utf-32-le", "surrogatepass"), "<u4")
            spoken = np.ones(len(codes), bool)
            for silent in (c for c, key in keys.items() if not key):
                spoken &= codes != ord(silent)
            upto = np.add.accumulate(np.concatenate(([end], np.where(spoken, 0.08, 0.0))))
            return [*begun, *np.where(spoken, upto[:-1], upto[1:]).tolist()], [*ended, *upto[1:].tolist()]
        key = keys[c]
        if not key:
            begun.append(end)
            ended.append(end)
            continue
        last = min(at + ahead, n)
        found = words.find(key, begin[at], begin[last])
        if found < 0:
            start, end = end, end + 0.08
        else:
            at = bisect.bisect_right(begin, found, at, last)
            _, start, stop = usable[at - 1]
            end = max(stop, start + 0.05)
        begun.append(start)
        ended.append(end)
    return begun, ended
