"""Punctuation of a reference text brought back to tokens by sequence alignment."""

from __future__ import annotations

import bisect
import functools
import re
import sys
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kaptura.functions import lexicon as lex
from kaptura.operators.documents import FLAGGED, map_documents

_MARKS = re.compile(f"[{lex.SENTENCE_ENDS}{lex.CLAUSE_ENDS}]")
AHEAD = 3


def _lower(text: str) -> list[str]:
    """A symbol for each character."""
    return list(text.lower()) if text.isascii() else [c.lower() for c in text]


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter or digit, and whether it is a mark."""
    alnum, mark = np.zeros(sys.maxunicode + 1, bool), np.zeros(sys.maxunicode + 1, bool)
    alnum[[c for c in range(sys.maxunicode + 1) if chr(c).isalnum()]] = True
    mark[list(map(ord, lex.SENTENCE_ENDS + lex.CLAUSE_ENDS))] = True
    return alnum, mark


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def _compared(texts: Sequence[str], alnum: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all tokens that are compared, letters and digits, or what isn't blank of a token
    that has none; and how many of them stand before each token's end, from 0."""
    codes = _codes("".join(texts))
    begin = np.concatenate(([0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))))
    kept = alnum[codes]
    held = np.concatenate(([0], np.cumsum(kept)))[begin]
    none = np.flatnonzero(held[1:] == held[:-1]).tolist()
    for i in none:
        left = len(texts[i]) - len(texts[i].lstrip())
        kept[begin[i] + left : begin[i] + left + len(texts[i].strip())] = True
    return codes[kept], np.concatenate(([0], np.cumsum(kept)))[begin] if none else held


def _longest(a: np.ndarray, places: dict[int, np.ndarray], lo: int, hi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """The longest common run of a[lo:hi] and b[blo:bhi]; of equal ones the first in a, then in b.

    Row by row over ``a``, the length of the run that ends at each equal place of ``b``; a row is
    a few vector operations on the places of its symbol.
    """
    lengths, touched = np.zeros(bhi - blo + 1, np.int32), np.zeros(0, np.int64)
    best = (lo, blo, 0)
    for i in range(lo, hi):
        own = places.get(int(a[i]))
        if own is not None:
            own = own[np.searchsorted(own, blo) : np.searchsorted(own, bhi)] - blo
        if own is None or not len(own):
            lengths[touched] = 0
            touched = np.zeros(0, np.int64)
            continue
        row = lengths[own] + 1  # lengths[j] belongs to the place before j
        lengths[touched] = 0
        touched = own + 1
        lengths[touched] = row
        top = int(row.argmax())
        if row[top] > best[2]:
            size = int(row[top])
            best = (i - size + 1, int(own[top]) + blo - size + 1, size)
    return best


def _own_runs(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]] | None:
    """``common_runs`` where ``b`` is ``a`` without the symbols that ``b`` doesn't hold, else None.

    No run crosses such a symbol, so the longest is the first of the longest pieces between them. Where
    it is found first at its own place, so are the pieces on both sides of it; else None.
    """
    held, pieces, lo, size = set(b), [], 0, 0
    if any(len(c) > 1 for c in held):
        return None
    for i, c in enumerate([*a, ""]):
        if c not in held:
            if i > lo:
                pieces.append((lo, size, i - lo))
                size += i - lo
            lo = i + 1
    text = "".join(b)
    if size != len(text) or any("".join(a[x : x + n]) != text[y : y + n] for x, y, n in pieces):
        return None
    done: list[int] = []
    for k in sorted(range(len(pieces)), key=lambda k: -pieces[k][2]):
        at = bisect.bisect(done, k)
        before = pieces[done[at - 1]] if at else (0, 0, 0)
        _, own, n = pieces[k]
        if text.find(text[own : own + n], before[1] + before[2]) != own:
            return None
        done.insert(at, k)
    return pieces


class _Runs:
    """Common runs of two texts as arrays of symbols, found by the ranks of their pieces of 1, 2, 4, ... symbols."""

    FEW = 24  #: rows that are searched one by one

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y, self.n = x, y, len(x)
        both = np.concatenate((x, [-1], y))
        self.ranks = [np.unique(both, return_inverse=True)[1]]

    @functools.cached_property
    def places(self) -> dict[int, np.ndarray]:
        order = np.argsort(self.y, kind="stable")
        cuts = np.flatnonzero(np.diff(self.y[order])) + 1
        return {int(self.y[g[0]]): g for g in np.split(order, cuts) if len(g)}

    def _pieces(self, size: int) -> np.ndarray:
        """A number for each piece of ``size`` symbols, the same for equal ones."""
        level = size.bit_length() - 1
        while len(self.ranks) <= level:
            last, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
            self.ranks.append(np.unique(last[:-half] * (int(last.max()) + 1) + last[half:], return_inverse=True)[1])
        own, rest = self.ranks[level], size - (1 << level)
        return own[: len(own) - rest] * (int(own.max()) + 1) + own[rest:]

    def longest(self, lo: int, hi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """The longest common run of x[lo:hi] and y[blo:bhi]; of equal ones the first in x, then in y."""
        if hi - lo <= self.FEW:
            return _longest(self.x, self.places, lo, hi, blo, bhi)
        at = self.n + 1

        def common(size: int) -> tuple[int, int] | None:
            pieces = self._pieces(size)
            own, others = pieces[lo : hi - size + 1], pieces[at + blo : at + bhi - size + 1]
            held = np.isin(own, others)
            i = int(held.argmax())
            return (lo + i, blo + int((others == own[i]).argmax())) if held[i] else None

        size, most, best = 0, min(hi - lo, bhi - blo), (lo, blo)
        step = 1
        while size < most:  # doubled until there is none, then halved
            if found := common(min(size + step, most)):
                size, best = min(size + step, most), found
                step *= 2
            else:
                most = min(size + step, most) - 1
                step = max(1, (most - size + 1) // 2)
        return (*best, size)


def runs_in_order(a: Sequence[str], b: Sequence[str]) -> Iterator[tuple[int, int, int]]:
    """Ratcliff and Obershelp's matching blocks (a, b, size) from left to right: the longest run, then both
    sides of it. A side to the right is searched when it is asked for."""
    if list(a) == list(b):
        yield from [(0, 0, len(a))] if a else []
        return
    if (own := _own_runs(a, b)) is not None:
        yield from own
        return
    codes: dict[str, int] = {}
    x, y = (np.array([codes.setdefault(c, len(codes)) for c in s], np.int64) for s in (a, b))
    runs = _Runs(x, y)
    todo: list[tuple[int, ...]] = [(0, len(x), 0, len(y))]
    while todo:
        part = todo.pop()
        if len(part) == 3:
            yield part
            continue
        lo, hi, blo, bhi = part
        if lo < hi and blo < bhi:
            i, j, size = runs.longest(lo, hi, blo, bhi)
            if size:
                todo += [(i + size, hi, j + size, bhi), (i, j, size), (lo, i, blo, j)]


def common_runs(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int, int]]:
    """All of ``runs_in_order``."""
    return list(runs_in_order(a, b))


def marks(texts: Sequence[str], full_text: str | None) -> list[tuple[int, str]] | None:
    """Places of tokens with punctuation and what it is; None where there is nothing to compare.

    What stands in the text between a token's last character and the first one of the next three
    tokens that is found there is its punctuation.
    """
    if not texts or not full_text:
        return None
    alnum, mark = _tables()
    codes = _codes(full_text)
    chars, begin = _compared(texts, alnum)
    places = np.flatnonzero(alnum[codes])
    if not len(chars) or not len(places):
        return None
    heard = codes[places]
    if np.array_equal(chars, heard):
        at = places
    else:
        at = np.full(len(chars), -1)  # where each character stands in the text
        for a, b, size in common_runs(*(_lower(x.tobytes().decode("utf-32-le", "surrogatepass")) for x in (chars, heard))):
            at[a : a + size] = places[b : b + size]
    some = np.flatnonzero(begin[1:] > begin[:-1])
    # Of each token and AHEAD more: the first character that is found; of each, where its last one stands.
    n = len(texts)
    first_at, start = np.full(n + AHEAD, len(codes)), np.full(n, -1)
    first_at[some] = np.minimum.reduceat(np.where(at < 0, len(codes), at), begin[some])
    start[some] = at[begin[some + 1] - 1]
    stop = np.full(n, len(codes))
    for d in range(AHEAD, 0, -1):
        following = first_at[d : d + n]
        stop = np.where(following < len(codes), following, stop)
    marked = np.concatenate(([0], np.cumsum(mark[codes])))
    seen = (start >= 0) & (stop < len(codes)) & (marked[stop] > marked[start + 1])
    return [(i, "".join(_MARKS.findall(full_text[start[i] + 1 : stop[i]]))) for i in np.flatnonzero(seen).tolist()]


def ends(found: str) -> tuple[bool, bool]:
    """Whether punctuation ends a sentence, a clause."""
    return any(c in lex.SENTENCE_ENDS for c in found), any(c in lex.CLAUSE_ENDS for c in found)


def punctuate(tokens: list[dict] | None, full_text: str | None) -> list[dict]:
    """Tokens with ``punctuation``, ``sentence_end`` and ``clause_end``.

    The last token ends a sentence. Without a text, or with nothing to compare, tokens stay as they are.
    """
    tokens = [dict(t) for t in tokens or []]
    found = marks([t["text"] for t in tokens], full_text)
    if found is None:
        return tokens
    for t in tokens:
        t["punctuation"], t["sentence_end"], t["clause_end"] = "", False, False
    for i, own in found:
        tokens[i]["punctuation"], (tokens[i]["sentence_end"], tokens[i]["clause_end"]) = own, ends(own)
    tokens[-1]["sentence_end"] = True
    return tokens


def punctuated(docs: DataFrame, tokens: str = "tokens", full_text: str = "full_text") -> DataFrame:
    """Documents of very long text take time up to the square of their length; each is its own row."""
    return map_documents(docs, [tokens, full_text], tokens, T.ArrayType(FLAGGED), punctuate)
