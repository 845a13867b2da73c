"""The character-based segmenter: clauses of a punctuated text, packed, split and smoothed."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kaptura.functions import lexicon as lex
from kaptura.functions.spoken import normal_text, spaced
from kaptura.operators.acoustic import character_columns, paced
from kaptura.operators.documents import LINE, field_rows, map_documents, structs

LONGEST, PAUSE, LEAST, WIDEST = 5.5, 0.55, 0.8, 24
_OUTER = lex.OUTER_PUNCTUATION
#: Outer punctuation and all that strip() takes.
_TRIMMED = _OUTER + "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_BREAKS = frozenset(lex.HARD_BREAKS + lex.SOFT_BREAKS)
_LEADS, _TRAILS = re.compile("|".join(lex.SPLIT_LEADERS)), re.compile(f"[{''.join(lex.SPLIT_TRAILERS)}]")


def trimmed(text: str | None) -> str:
    """A line without outer punctuation and blanks, spaced."""
    text = (text or "").strip(_TRIMMED)
    return text if text.isascii() and "  " not in text else spaced(text)


class Clause(NamedTuple):
    text: str
    start: float
    end: float
    hard: bool = False


Characters = Sequence[tuple[str, float, float]]


@functools.lru_cache(1 << 12)
def _distances(n: int) -> tuple[int, list[float], int]:
    """Where a clause of n characters may split first, what each place there scores for lying far from the
    middle, and which is best if nothing else counts."""
    ks = range(max(4, int(n * 0.25)), min(n - 3, int(n * 0.75)) + 1)
    scores = [-0.35 * abs(k - n / 2) for k in ks]
    return ks.start, scores, ks[scores.index(max(scores))] if scores else n // 2


def _balanced(n: int, text: str, gaps: Callable[[int, int], list[tuple[int, float]]]) -> int:
    """Where a long clause splits: near the middle, before a leader, behind a trailer, at one of the ``gaps``
    (place and length) from the first place to the last."""
    first, scores, best = _distances(n)
    plain = text.isascii()  # no leader or trailer is
    led, trailed = not plain and bool(_LEADS.search(text)), not plain and bool(_TRAILS.search(text))
    wide = gaps(first, first + len(scores)) if scores else []
    if not (led or trailed or wide):
        return best
    scores = list(scores)
    for i, k in enumerate(range(first, first + len(scores))):
        if led and text.startswith(lex.SPLIT_LEADERS, k):
            scores[i] += 10.0
        if trailed and text.endswith(lex.SPLIT_TRAILERS, 0, k):
            scores[i] += 6.0
    for k, gap in wide:
        scores[k - first] += 20.0 * gap
    return first + scores.index(max(scores)) if scores else n // 2


def _balance(chars: Characters, text: str) -> int:
    def gaps(a: int, b: int) -> list[tuple[int, float]]:
        return [(k, gap) for k in range(a, b) if (gap := chars[k][1] - chars[k - 1][2]) > 0.1]

    return _balanced(len(chars), text, gaps)


class _Timed:
    """A text with the times of its characters by columns."""

    def __init__(self, text: str, starts: list[float], ends: list[float]):
        self.text, self.starts, self.ends = text, starts, ends
        self.start, self.end = np.array(starts, float), np.array(ends, float)
        gaps = self.start[1:] - self.end[:-1]
        self.wide = (np.flatnonzero(gaps > 0.1) + 1).tolist()  # behind a gap
        self.gap = dict(zip(self.wide, gaps[[k - 1 for k in self.wide]].tolist(), strict=True))
        behind = np.zeros(len(starts), np.int64)
        behind[self.wide] = 1
        self.before = [0, *np.cumsum(behind).tolist()]

    def gaps(self, lo: int, hi: int) -> list[tuple[int, float]]:
        return [(k - lo, self.gap[k]) for k in self.wide[self.before[lo] : self.before[hi]]]

    def halves(self, clause: Clause, lo: int, hi: int, longest: float, widest: int) -> list[Clause]:
        """A clause split until its parts are short enough or hold six characters."""
        out, todo = [], [(clause, lo, hi)]
        while todo:
            c, lo, hi = todo.pop()
            if hi - lo <= 6 or c.end - c.start <= longest and len(c.text) <= widest:
                out.append(c)
                continue
            at = lo
            k = lo + _balanced(hi - lo, c.text, lambda a, b, at=at: [(p + a, gap) for p, gap in self.gaps(at + a, at + b)])
            for a, b, hard in ((k, hi, c.hard), (lo, k, False)):
                todo.append((Clause(trimmed(self.text[a:b]), self.starts[a], self.ends[b - 1], hard), a, b))
        return out

    def clauses(self, longest: float, pause: float, widest: int) -> list[Clause]:
        """Clauses end at punctuation, long pauses, when they grow too long, and at the end."""
        text, starts, ends = self.text, self.starts, self.ends
        n = len(text)
        if not n:
            return []
        start, end = self.start, self.end
        steady = bool((end[1:] >= end[:-1]).all() and end[0] > 0)  # the latest end is the last one
        upto = np.minimum.accumulate
        place = np.arange(n)
        codes, breaks = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), np.zeros(n, bool)
        for c in _BREAKS.intersection(text):
            breaks |= codes == ord(c)
        paused = np.append(start[1:] - end[:-1] >= pause, False)
        broken, resting = (upto(np.where(x, place, n - 1)[::-1])[::-1].tolist() for x in (breaks, paused))
        out, lo, most, longer = [], 0, int(-(-1.5 * widest // 1)), 1.5 * longest
        while lo < n:
            hi = min(broken[lo], lo + max(most, 1) - 1, n - 1)
            if lo + 3 < n:
                hi = min(hi, resting[lo + 3])
            first = starts[lo]
            if steady and ends[hi] - first < longer:
                stop = ends[hi]
            else:
                stop = None
                for i in range(lo, hi + 1):
                    if not stop or ends[i] > stop:
                        stop = ends[i]
                    if stop - first >= longer:
                        hi = i
                        break
            if own := trimmed(text[lo : hi + 1]):
                clause = Clause(own, first, stop, text[hi] in lex.HARD_BREAKS)
                if (stop - first > longest or len(own) > widest) and hi + 1 - lo > 6:
                    out += self.halves(clause, lo, hi + 1, longest, widest)
                else:
                    out.append(clause)
            lo = hi + 1
        return out


def cut_clauses(chars: Characters, longest: float = LONGEST, pause: float = PAUSE, widest: int = WIDEST) -> list[Clause]:
    if not chars:
        return []
    texts, starts, ends = zip(*chars, strict=True)
    return _Timed("".join(texts), list(starts), list(ends)).clauses(longest, pause, widest)


def packed(clauses: Sequence[Clause], longest: float = LONGEST, widest: int = WIDEST) -> list[Clause]:
    """Neighbours joined by a comma while they fit on one line."""
    out: list[Clause] = []
    for c in clauses:
        last = out[-1] if out else None
        if last and not last.hard and c.end - last.start <= longest and len(last.text) + 1 + len(c.text) <= widest and c.start - last.end < 0.8:
            out[-1] = Clause(f"{last.text}，{c.text}", last.start, c.end, c.hard)
        else:
            out.append(c)
    return out


def connectors_forward(lines: Sequence[Clause]) -> list[Clause]:
    """A connector at the end of a line goes to the next one, with a quarter second a character."""
    out = list(lines)
    for i in range(len(out) - 1):
        line, after = out[i], out[i + 1]
        if not line.text.endswith(lex.CLASSIC_CONNECTORS):
            continue
        word = next((c for c in lex.CLASSIC_CONNECTORS if line.text.endswith(c) and len(line.text) > len(c)), None)
        left = line.text[: -len(word)].rstrip(_OUTER).strip() if word else ""
        if left:
            at = round(max(line.start + 0.3, line.end - 0.25 * len(word)), 3)
            out[i] = line._replace(text=left, end=at)
            out[i + 1] = after._replace(text=f"{word}，{after.text.lstrip(_OUTER).strip()}", start=at)
    return out


def smoothed(lines: Sequence[Clause], least: float = LEAST) -> list[Clause]:
    """Blank lines out; each line long enough and not before the end of the one before it."""
    out: list[Clause] = []
    for line in lines:
        text = trimmed(line.text)
        if not text:
            continue
        start, end = line.start, max(line.end, line.start + least)
        if out:
            start = max(start, out[-1].end)
            end = end if end > start else start + least
        out.append(Clause(text, round(start, 3), round(end, 3)))
    return out


def token_clauses(texts: Sequence[str | None], starts: Sequence[float | None], ends: Sequence[float | None], longest: float = LONGEST) -> list[Clause]:
    """Without a text: tokens up to one with a break in it or until they last too long."""
    out, words, start, end = [], [], 0.0, 0.0
    for text, a, b in zip(texts, starts, ends, strict=True):
        text, a, b = text or "", a or 0.0, b or 0.0
        start = start if words else a
        end = max(end, b)
        words.append(text)
        if any(c in lex.HARD_BREAKS + lex.SOFT_BREAKS for c in text) or end - start >= longest:
            out.append(Clause("".join(words), start, end))
            words = []
    if words:
        out.append(Clause("".join(words), start, end))
    return out


def caption_rows(text: str | None, texts: Sequence[str | None], starts: Sequence[float | None], ends: Sequence[float | None], longest: float = LONGEST, pause: float = PAUSE, offset: float = 0.0) -> list[tuple[int, float, float, str]]:
    """Number, start, end and text of the lines of a recognised text with tokens by columns, moved by ``offset`` seconds."""
    text = (text or "").strip()
    if not texts:
        found = [Clause(trimmed(text), round(offset, 3), round(max(3.0, 0.25 * len(text)) + offset, 3))] if text else []
    else:
        times = character_columns(text, texts, starts, ends)
        found = packed(_Timed(text, *times).clauses(longest, pause, WIDEST), longest) if times else token_clauses(texts, starts, ends, longest)
        found = smoothed(connectors_forward(found))
        if offset > 0:
            found = [c._replace(start=round(c.start + offset, 3), end=round(c.end + offset, 3)) for c in found]
    return [(i, c[1], c[2], c[0]) for i, c in enumerate(found, 1)]


def _dicts(rows: Sequence[tuple]) -> list[dict]:
    return [dict(zip(LINE.fieldNames(), row, strict=True)) for row in rows]


def caption(text: str | None, tokens: Sequence[dict] | None, longest: float = LONGEST, pause: float = PAUSE, offset: float = 0.0) -> list[dict]:
    """Numbered lines of a recognised text with token times, moved by ``offset`` seconds."""
    return _dicts(caption_rows(text, *([t[k] for t in tokens or ()] for k in ("text", "start", "end")), longest, pause, offset))


def final_rows(lines: Sequence[tuple[int, float, float, str]]) -> list[tuple[int, float, float, str]]:
    """Lines of all chunks: connectors forward and smoothing once more, normalised, renumbered."""
    found = smoothed(connectors_forward([Clause(text, start, end) for _, start, end, text in lines]))
    return [(i, c.start, c.end, normal_text(c.text)) for i, c in enumerate(found, 1)]


def final_lines(lines: Sequence[dict] | None) -> list[dict]:
    return _dicts(final_rows([(0, x["start_time"], x["end_time"], x["text"]) for x in lines or ()]))


def captioned(docs: DataFrame, text: str = "full_text", tokens: str = "tokens", output: str = "lines", longest: float = LONGEST, pause: float = PAUSE, keep: list[str] | None = None) -> DataFrame:
    names = docs.schema[tokens].dataType.elementType.fieldNames()

    def apply(own: str | None, rows: list[list] | None) -> list[tuple]:
        columns = dict(zip(names, rows or [[]] * len(names), strict=True))
        return caption_rows(own, columns["text"], columns["start"], columns["end"], longest, pause)

    return map_documents(docs, [text, tokens], output, T.ArrayType(LINE), apply, keep, field_rows, structs)


def captioned_texts(docs: DataFrame, text: str = "text", output: str = "lines", longest: float = LONGEST, pause: float = PAUSE, per_second: float = 3.0, keep: list[str] | None = None) -> DataFrame:
    """Lines of plain texts, read at an even pace: words are tokens within the map."""
    return map_documents(docs, [text], output, T.ArrayType(LINE), lambda own: caption_rows(own, *paced(own, per_second), longest, pause), keep, build=structs)


def finished(docs: DataFrame, lines: str = "lines") -> DataFrame:
    return map_documents(docs, [lines], lines, T.ArrayType(LINE), final_lines)
