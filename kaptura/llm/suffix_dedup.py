"""Removal of long byte strings that occur more than once in the corpus, by suffix arrays.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else, in the
same document or another; strings never cross documents and are judged on the input.

A corpus has no suffix array that one task could hold, so suffixes are first dealt to groups in
which all their equals stand: a window of ``length`` bytes belongs to the smallest hash of the
32-byte strings within it, and equal windows have equal smallest hashes. Starts that follow each
other with one value are a run. Runs of a value that no other run has, and that stands once in
its run, repeat nothing and never move. Of the others, each group's text is suffix-sorted in two
stages: suffixes smaller than their successors are sorted directly, the others are induced by one
scan over the buckets. A window repeats if its common prefix with a neighbour is ``length`` long.

Copies of a whole text count once, with their number. Equal runs of a group are one before the
sort; a group in which every run has an equal one is not sorted at all. A group of more than
``most_bytes`` isn't gathered: its windows are counted by fingerprints of 124 bits with bases drawn at
random for each run, of which two different windows agree with a probability below 2 ** -89. Texts are dealt
to buckets of bounded size; a bucket sends each of its windows once, with its number, and gets
back those that repeat, so a passage that a third of all documents hold is one row a bucket.

``shared_passages`` looks for shorter repeats in the same way, with words for bytes: runs of
``words`` words that another row holds too, whatever their length in bytes. Windows of words with a
smallest hash that no other text has repeat nothing. Of texts with others, the first window of each run of
longer strings settles those in which it has an equal; the rest, and what has a run's value in common with
them, compare all windows, by fingerprints as above, of which two different ones agree with a probability
below 2 ** -77. Words of over ``LONGEST_KEPT`` bytes stand as
their SHA-256, so a window has at most 3,366 bytes.

Null and empty texts have no bytes; shorter texts than ``length`` lose nothing; repeated rows are
copies of each other and lose everything if long enough; a null doc_id is carried.
"""

from __future__ import annotations

import functools
import hashlib
import secrets
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import LONGEST_KEPT, shuffle_partitions, stored

LENGTH, GRAM = 400, 32
BLOCK = 1 << 18
#: Bytes of short texts, and windows of words, that are hashed side by side.
TOGETHER, STEP = 1 << 15, 1 << 12
MOST_BYTES = 1 << 19
#: Window starts of a bucket.
BUCKET = 1 << 22
#: Words of a shared passage, and of the strings whose smallest hash names a window of so many: at first, and
#: among texts that share such hashes.
PASSAGE, WORD_GRAM, LONG_GRAM = 51, 8, 32
PRIME = np.uint64((1 << 31) - 1)
_NULL_ID = -(1 << 63)
_SPACES = bytes.maketrans(b"\t\n\r\x0b\x0c", b" " * 5)
_EMPTY = hashlib.sha256(b"").hexdigest()


def string_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A polynomial hash of every substring of ``length`` bytes, by doubling, then mixed."""
    base = np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1) | 1)
    power, width = base, 1
    level = data.astype(np.uint64) + np.uint64(seed + 1)
    total, done = None, 0
    left = length
    while left:
        if left & 1:
            part = level[done : len(level)] if done else level
            total = part.copy() if total is None else total[: len(part)] * power + part[: len(total)]
            done += width
        left >>= 1
        if left:
            level = level[:-width] * power + level[width:]
            power, width = np.uint64(int(power) ** 2 & (2**64 - 1)), width * 2
    return _mixed(total[: len(data) - length + 1])


def _mixed(out: np.ndarray) -> np.ndarray:
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(29)
    return out


def _modular(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME."""
    for _ in range(2):
        x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def fingerprints(data: np.ndarray, length: int, bases: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for every substring of ``length`` numbers below PRIME: of four polynomials modulo a prime, two each.

    Two different strings agree in one polynomial for fewer than ``length`` of the bases there are, so
    four bases drawn at random after the texts were written tell any two strings apart but with a
    probability of (length / 2 ** 31) ** 4; that has no structured exceptions, unlike powers modulo 2 ** 64.
    """
    found = []
    for base in bases:
        power, width = np.uint64(base), 1
        level = data.astype(np.uint64)
        total, done, left = None, 0, length
        while left:
            if left & 1:
                part = level[done:]
                total = part.copy() if total is None else _modular(total[: len(part)] * power + part[: len(total)])
                done += width
            left >>= 1
            if left:
                level = _modular(level[:-width] * power + level[width:])
                power, width = np.uint64(int(power) ** 2 % int(PRIME)), width * 2
        found.append(total[: len(data) - length + 1])
    a, b, c, d = found
    return ((a << np.uint64(32)) | b).view(np.int64), ((c << np.uint64(32)) | d).view(np.int64)


def drawn_bases() -> tuple[int, ...]:
    return tuple(secrets.randbelow(int(PRIME) - 1000) + 500 for _ in range(4))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    got, n = x, 1
    while 2 * n <= width:
        got = np.minimum(got[:-n], got[n:])
        n *= 2
    rest = width - n
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def least_runs(hashes: np.ndarray, width: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of ``width`` hashes with one smallest hash: first, last, value.

    ``owner`` names the text of each window, -1 for those that are none; runs end with their text.
    """
    least = sliding_min(hashes, width)
    new = least[1:] != least[:-1]
    if owner is not None:
        new |= owner[1:] != owner[:-1]
    cuts = np.flatnonzero(new) + 1
    first = np.concatenate(([0], cuts))
    last = np.concatenate((cuts, [len(least)])) - 1
    if owner is not None:
        real = owner[first] >= 0
        first, last = first[real], last[real]
    return first, last, least[first]


def stands_twice(hashes: np.ndarray, width: int, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether the value of each run stands twice within it."""
    if not len(values):
        return np.zeros(0, np.bool_)
    # Places of small hashes by hash, then place: those of a run's value within it are counted by two searches.
    at = np.flatnonzero(hashes <= values.max())
    known, number = np.unique(hashes[at], return_inverse=True)
    size = len(hashes) + 1
    places = np.sort(number * size + at)
    base = np.searchsorted(known, values) * size
    return np.searchsorted(places, base + last + width) - np.searchsorted(places, base + first) > 1


def _byte_runs(whole: np.ndarray, length: int, gram: int, owner: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    hashes, width = string_hashes(whole, gram, 0), length - gram + 1
    first, last, values = least_runs(hashes, width, owner)
    return first, last, values.view(np.int64), stands_twice(hashes, width, first, last, values)


def value_runs(whole: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[list[int], list[int], list[int], list[bool]]:
    """Runs of window starts: first, last, value, whether the value stands twice within."""
    found: tuple[list, list, list, list] = ([], [], [], [])
    for at in range(0, len(whole) - length + 1, BLOCK):
        first, last, values, twice = _byte_runs(whole[at : at + BLOCK + length - 1], length, gram)
        for c, x in zip(found, (first + at, last + at, values, twice), strict=True):
            c += x.tolist()
    return found


def text_runs(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """``value_runs`` of many texts: number of the text, first, last, value, twice, in order."""
    found: list[tuple] = []
    held: list[tuple[int, bytes]] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(t) for _, t in held])
            begin = np.cumsum(sizes) - sizes
            whole = np.frombuffer(b"".join(t for _, t in held), np.uint8)
            owner = np.repeat(np.arange(len(held)), sizes)
            windows = len(whole) - length + 1
            owner = np.where(owner[:windows] == owner[length - 1 :], owner[:windows], -1)
            first, last, values, twice = _byte_runs(whole, length, gram, owner)
            of = owner[first]
            found.append((np.array([i for i, _ in held])[of], first - begin[of], last - begin[of], values, twice))
            held.clear()

    size = 0
    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if size + len(text) > TOGETHER:
            flush()
            size = 0
        if len(text) > TOGETHER:
            runs = value_runs(np.frombuffer(text, np.uint8), length, gram)
            found.append((np.full(len(runs[0]), i), *(np.array(c, k) for c, k in zip(runs, (np.int64, np.int64, np.int64, np.bool_), strict=True))))
        else:
            held.append((i, text))
            size += len(text)
    flush()
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros(0, np.bool_))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def smaller_than_next(data: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than its successor; the last one isn't."""
    n = len(data)
    out = np.zeros(n, np.bool_)
    if n > 1:
        differs = np.flatnonzero(data[:-1] != data[1:])
        at = np.searchsorted(differs, np.arange(n - 1))
        known = at < len(differs)
        place = differs[at[known]]
        out[:-1][known] = data[place] < data[place + 1]
    return out


def two_stage_suffix_array(text: bytes, depth: int) -> list[int]:
    """Suffixes in order of their first ``depth`` bytes at least."""
    n = len(text)
    if not n:
        return []
    data = np.frombuffer(text, np.uint8)
    small = smaller_than_next(data)
    direct = sorted(np.flatnonzero(small).tolist(), key=lambda i: text[i : i + depth])
    sizes = np.bincount(data, minlength=256)
    smalls = np.bincount(data[small], minlength=256)
    ends = np.cumsum(sizes)
    order = np.full(n, -1, np.int64)
    if direct:
        # In its bucket the suffixes sorted directly stand behind the induced ones.
        first = data[direct]
        rank = np.arange(len(direct)) - np.concatenate(([0], np.cumsum(smalls)[:-1]))[first]
        order[ends[first] - smalls[first] + rank] = direct
    out = order.tolist()
    head = (ends - sizes).tolist()
    induced = (~small).tolist()
    c = text[n - 1]
    out[head[c]] = n - 1
    head[c] += 1
    for j in out:
        i = j - 1
        if i >= 0 and induced[i]:
            c = text[i]
            out[head[c]] = i
            head[c] += 1
    return out


def common_prefixes(text: bytes, x: np.ndarray, y: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at x and y, up to ``most`` (a multiple of 8), in whole 8 bytes."""
    padded = text + bytes(most + 8)
    words = np.ndarray((len(text) + most,), "<u8", padded, strides=(1,))
    out, left = np.zeros(len(x), np.int64), np.arange(len(x))
    for k in range(0, most, 8):
        left = left[words[x[left] + k] == words[y[left] + k]]
        if not len(left):
            break
        out[left] = k + 8
    return out


def repeated_starts(segments: list[tuple[bytes, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment (text, number of starts) of one group: which starts repeat."""
    text = b"".join(s for s, _ in segments)
    valid = np.zeros(len(text), np.bool_)
    places, at = [], 0
    for s, starts in segments:
        valid[at : at + starts] = True
        places.append(at)
        at += len(s)
    order = np.array(two_stage_suffix_array(text, length), np.int64)
    order = order[valid[order]]
    equal = common_prefixes(text, order[:-1], order[1:], length) >= length
    repeats = np.zeros(len(text), np.bool_)
    repeats[order[:-1][equal]] = True
    repeats[order[1:][equal]] = True
    return [repeats[p : p + starts] for p, (_, starts) in zip(places, segments, strict=True)]


def true_runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


def _grouped(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated starts of segments (value, sha, first, copies, bytes) that come sorted by value."""
    held: list[tuple] = []
    found: list[tuple[bytes, int, int]] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["sha", "lo", "hi"])

    def group() -> None:
        same: dict[bytes, list[tuple]] = defaultdict(list)
        for _, sha, first, copies, body in held:
            same[body].append((sha, first, copies))
        bodies = list(same)
        if all(len(rows) > 1 or rows[0][2] > 1 for rows in same.values()):
            marks = [np.ones(len(b) - length + 1, np.bool_) for b in bodies]
        else:
            marks = repeated_starts([(b, len(b) - length + 1) for b in bodies], length)
        for body, mark in zip(bodies, marks, strict=True):
            rows = same[body]
            if len(rows) > 1 or rows[0][2] > 1:
                mark[:] = True
            for lo, hi in true_runs(mark):
                found.extend((sha, first + lo, first + hi) for sha, first, copies in rows if copies == 1)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[0] != held[0][0]:
                group()
                held.clear()
            held.append(row)
        if len(found) >= 10_000:
            yield out()
    if held:
        group()
    yield out()


def _listed(owner: np.ndarray, values: np.ndarray, n: int, kind: pa.DataType) -> pa.Array:
    """One list for each of n texts of the values that stand in order of their text."""
    offsets = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


Words = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _words(texts: list[bytes]) -> Words:
    """Words between ASCII white space, joined by one space: bytes, starts, ends, and the number of each one's text."""
    raw = np.frombuffer(b"\n".join(texts).translate(_SPACES), np.uint8)
    space = raw == 32
    behind = np.concatenate(([True], space[:-1]))[: len(raw)]
    data = raw[~(space & behind)]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(begin, np.flatnonzero(behind & ~space), "right") - 1
    if len(data) and data[-1] == 32:
        data = data[:-1]
    ends = np.concatenate((np.flatnonzero(data == 32), [len(data)]))[: len(owner)]
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(owner)]
    if (ends - starts).max(initial=0) > LONGEST_KEPT:
        # No word of valid UTF-8 holds the byte 255.
        words = [w if len(w) <= LONGEST_KEPT else b"\xff" + hashlib.sha256(w).hexdigest().encode() for w in data.tobytes().split(b" ")]
        data = np.frombuffer(b" ".join(words), np.uint8)
        ends = np.cumsum([len(w) + 1 for w in words]) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
    return data, starts, ends, owner


def word_parts(texts: list[bytes], passage: int) -> Iterator[Words]:
    """Parts of so many texts' words: bytes, starts and ends of words, and the number of the text for each window of
    ``passage`` words, -1 across texts."""
    sizes = np.cumsum([len(t) for t in texts])
    cuts = np.flatnonzero(np.diff(sizes // BLOCK)) + 1
    for x, y in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)], strict=True):
        data, starts, ends, owner = _words(texts[x:y])
        for at in range(0, len(owner) - passage + 1, STEP):
            to = min(at + STEP + passage - 1, len(owner))
            of = owner[at:to]
            windows = np.where(of[: len(of) - passage + 1] == of[passage - 1 :], of[: len(of) - passage + 1] + x, -1)
            yield data[starts[at] : ends[to - 1]], starts[at:to] - starts[at], ends[at:to] - starts[at], windows


@functools.lru_cache(maxsize=16)
def _powers(base: int, modulus: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    power, k = base, 1
    while k < n:
        more = out[: min(k, n - k)] * np.uint64(power)
        out[k : k + len(more)] = _modular(more) if modulus == int(PRIME) else more
        power, k = power * power % modulus, 2 * k
    return out


def _sums(data: np.ndarray, first: np.ndarray, end: np.ndarray, base: int, modulus: int, passage: int) -> np.ndarray:
    """A polynomial of each string data[first:end] of a part, by differences of running sums.

    The sums leave 64 bits, their differences modulo PRIME don't: a string has fewer than 2 ** 25 bytes.
    """
    # No part is longer, and equal strings of all parts are raised to one power.
    n = (STEP + passage) * (LONGEST_KEPT + 2)
    powers = _powers(base, modulus, n)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * powers[: len(data)], out=sums[1:])
    got = sums[end] - sums[first]
    if modulus == int(PRIME):
        return _modular(_modular(got) * powers[n - 1 - first])
    return got * powers[n - 1 - first]


def word_runs(part: Words, passage: int, gram: int = WORD_GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First, last and value of the runs of windows of ``passage`` words."""
    data, starts, ends, owner = part
    gram = min(gram, passage)
    hashes = _mixed(_sums(data, starts[: len(starts) - gram + 1], ends[gram - 1 :], 0x9E3779B97F4A7C15, 1 << 64, passage))
    first, last, values = least_runs(hashes, passage - gram + 1, owner)
    return first, last, values.view(np.int64)


def word_fingerprints(part: Words, at: np.ndarray, passage: int, bases: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for the windows of ``passage`` words that begin with the words ``at``."""
    data, starts, ends, _ = part
    a, b, c, d = (_sums(data, starts[at], ends[at + passage - 1], base, int(PRIME), passage) for base in bases)
    return ((a << np.uint64(32)) | b).view(np.int64), ((c << np.uint64(32)) | d).view(np.int64)


def word_values(texts: list[bytes], passage: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of texts, in order, and the values of their windows, each once a text."""
    found = []
    for part in word_parts(texts, passage):
        first, _, values = word_runs(part, passage)
        found.append((part[3][first], values))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, values = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (values[1:] != values[:-1])))
    return of[new], values[new]


def _measure(docs: DataFrame, length: int, gram: int, passage: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() if t else b"" for t in batch.column(1).to_pylist()]
            n = len(texts)
            of, *runs = text_runs(texts, length, gram)
            words = word_values(texts, passage) if passage else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    *(_listed(of, c, n, k) for c, k in zip(runs, kinds, strict=True)),
                    _listed(*words, n, pa.int64()),
                ],
                names=["doc_id", "sha", "n_bytes", "firsts", "lasts", "vals", "twice", "word_vals"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, sha binary, n_bytes long, firsts array<long>, lasts array<long>, vals array<long>, twice array<boolean>, word_vals array<long>")


def _segments(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for sha, copies, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                data = text.encode()
                rows += [(r["v"], sha, r["a"], copies, data[r["a"] : r["b"] + length]) for r in runs if not r["crowded"]]
                if len(rows) >= 20_000:
                    yield batch_of(rows)
                    rows = []
            yield batch_of(rows)

    def batch_of(rows):
        cols = list(zip(*rows, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["v", "sha", "first", "copies", "body"])

    return texts.mapInArrow(run, "v long, sha binary, first long, copies long, body binary")


Windows = Callable[[dict], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def _byte_windows(length: int) -> Windows:
    """First place and fingerprints of every window of each crowded run."""
    bases = drawn_bases()

    def of(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        whole = np.frombuffer(row["text"].encode(), np.uint8)
        for r in row["runs"]:
            if r["crowded"]:
                part = whole[r["a"] : r["b"] + length]
                yield (r["a"], *fingerprints(part, length, bases))

    return of


def _word_windows(passage: int) -> Windows:
    """The same, of windows of words by the values of longer strings that another text has; places are those among them."""
    bases = drawn_bases()

    def of(row: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        shared, n = np.array(row["shared"], np.int64), 0
        for part in word_parts([row["text"].encode()], passage):
            first, last, values = word_runs(part, passage, LONG_GRAM)
            wanted = np.isin(values, shared)
            sizes = (last - first + 1)[wanted]
            at = np.repeat(first[wanted] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            if len(at):
                yield n, *word_fingerprints(part, at, passage, bases)
                n += len(at)

    return of


def _first_windows(held: DataFrame, passage: int) -> DataFrame:
    """sha, v, h, g of runs of longer strings that meet a run of ``shared`` values: value, and fingerprints of the
    first window, each once a text."""
    bases = drawn_bases()

    def named(of: np.ndarray, v: np.ndarray) -> np.ndarray:
        """One number for a text and a value; equal ones only make more windows."""
        return v.view(np.uint64) + of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            values = np.sort(named(np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False)), lists.flatten().to_numpy(zero_copy_only=False)))
            found = [(np.zeros(0, np.int64),) * 4]
            for part in word_parts([t.encode() for t in batch.column(1).to_pylist()], passage):
                owner = part[3]
                first, last, v = word_runs(part, passage)
                own = named(owner[first], v)
                wanted = values.searchsorted(own, "right") > values.searchsorted(own)
                edges = np.zeros(len(owner) + 1, np.int64)
                edges[first[wanted]] += 1
                edges[last[wanted] + 1] -= 1
                within = np.concatenate(([0], np.cumsum(np.cumsum(edges[:-1]))))
                first, last, v = word_runs(part, passage, LONG_GRAM)
                meets = within[last + 1] > within[first]
                first = first[meets]
                found.append((owner[first], v[meets], *word_fingerprints(part, first, passage, bases)))
            of, v, h, g = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((g, h, of))
            of, v, h, g = of[order], v[order], h[order], g[order]
            if len(of):
                new = np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1]) | (g[1:] != g[:-1])))
                of, v, h, g = of[new], v[new], h[new], g[new]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), pa.array(v), pa.array(h), pa.array(g)], names=["sha", "v", "h", "g"])

    return held.select("sha", "text", "shared").mapInArrow(run, "sha binary, v long, h long, g long")


def _pairs(h: list[np.ndarray], g: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of hashes in order, each once, with the sum of its numbers."""
    x, y, z = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (h, g, n))
    order = np.lexsort((y, x))
    x, y, z = x[order], y[order], z[order]
    new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (y[1:] != y[:-1])))) if len(x) else np.zeros(0, np.int64)
    return x[new], y[new], np.add.reduceat(z, new) if len(new) else z


def _bucket_windows(batches: Iterator[pa.RecordBatch], windows: Windows, once: bool) -> Iterator[pa.RecordBatch]:
    """bucket, h, g and the number of each window of rows sorted by bucket; ``once``: one a text."""
    held: tuple[list, list, list] = ([], [], [])
    bucket, size = None, 0

    def out() -> pa.RecordBatch:
        h, g, n = _pairs(*held)
        for c in held:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), bucket or 0, np.int64)), pa.array(h), pa.array(g), pa.array(n)], names=["bucket", "h", "g", "n"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != bucket or size > 2 * BUCKET:
                yield out()
                bucket, size = row["bucket"], 0
            own: tuple[list, list, list] = ([], [], [])
            for _, h, g in windows(row):
                for c, x in zip(own, (h, g, np.full(len(h), row["copies"], np.int64)), strict=True):
                    c.append(x)
            if once and own[0]:
                h, g, _ = _pairs(*own)
                own = ([h], [g], [np.ones(len(h), np.int64)])
            for c, x in zip(held, own, strict=True):
                c += x
            size += sum(map(len, own[0]))
    yield out()


def _bucket_places(batches: Iterator[pa.RecordBatch], windows: Windows) -> Iterator[pa.RecordBatch]:
    """sha, lo, hi of windows that repeat: in each bucket their hashes come first, then the texts."""
    hashes: tuple[list, list] = ([], [])
    known, bucket = (np.zeros(0, np.int64), np.zeros(0, np.int64)), None
    found: list[tuple[bytes, int, int]] = []

    def out() -> pa.RecordBatch:
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["sha", "lo", "hi"])

    for batch in batches:
        of, is_text = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "is_text"))
        edges = np.concatenate(([0], np.flatnonzero((of[1:] != of[:-1]) | (is_text[1:] != is_text[:-1])) + 1, [len(of)]))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            part = batch.slice(x, y - x)
            if not part.num_rows:
                continue
            if of[x] != bucket:
                bucket, hashes = of[x], ([], [])
                known = (np.zeros(0, np.int64), np.zeros(0, np.int64))
            if not is_text[x]:
                for c, name in zip(hashes, ("h", "g"), strict=True):
                    c.append(part.column(name).to_numpy(zero_copy_only=False))
                continue
            if hashes[0]:
                known, hashes = _pairs(*hashes, [np.zeros(len(c), np.int64) for c in hashes[0]])[:2], ([], [])
            for row in part.to_pylist():
                for first, h, g in windows(row) if len(known[0]) else ():
                    at, end = known[0].searchsorted(h), known[0].searchsorted(h, "right")
                    marks = np.zeros(len(h), np.bool_)
                    for step in range(int((end - at).max(initial=0))):
                        place = np.minimum(at + step, len(known[0]) - 1)
                        marks |= (at + step < end) & (known[1][place] == g)
                    found += [(row["sha"], first + lo, first + hi) for lo, hi in true_runs(marks)]
            if len(found) >= 10_000:
                yield out()
    yield out()


def _repeated_windows(texts: DataFrame, windows: Windows, n_starts: int, once: bool = False) -> DataFrame:
    """sha, lo, hi of the windows of ``texts`` (sha, copies, text and what ``windows`` reads) that repeat.

    ``n_starts``: about how many windows there are, which sets the number of buckets.
    """
    n = max(shuffle_partitions(texts.sparkSession), -(-n_starts // BUCKET))
    dealt = texts.withColumn("bucket", F.pmod(F.xxhash64("sha"), F.lit(n)))
    in_order = dealt.repartition(n, "bucket").sortWithinPartitions("bucket")
    counted = stored(in_order.mapInArrow(lambda batches: _bucket_windows(batches, windows, once), "bucket long, h long, g long, n long"), "windows")
    repeated = counted.groupBy("h", "g").agg(F.sum("n").alias("n")).filter("n > 1").select("h", "g")
    back = counted.select("bucket", "h", "g").join(repeated, ["h", "g"]).withColumn("is_text", F.lit(False))
    both = dealt.withColumn("is_text", F.lit(True)).unionByName(back, allowMissingColumns=True)
    return both.repartition(n, "bucket").sortWithinPartitions("bucket", "is_text").mapInArrow(lambda batches: _bucket_places(batches, windows), "sha binary, lo long, hi long")


def _cut(found: DataFrame, length: int) -> DataFrame:
    """What is left of texts (sha, text, starts: array of lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, kept = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                data, at, gone, runs, left = text.encode(), 0, 0, 0, hashlib.sha256()
                end = -1
                for lo, hi in sorted((s["lo"], s["hi"] + length) for s in starts):
                    if lo > end:
                        runs += 1
                        left.update(data[at:lo])
                        gone += hi - lo
                        end = hi
                    elif hi > end:
                        gone += hi - end
                        end = hi
                    at = end
                left.update(data[at:])
                removed.append(gone)
                spans.append(runs)
                kept.append(left.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept)], names=["sha", "removed", "spans", "kept"])

    return found.mapInArrow(run, "sha binary, removed long, spans long, kept string")


def _bodies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rep, sha, ...) with the text of the row it names."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("rep"), "text").withColumn("sha", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    # Rows with the same doc_id and text each come: they are copies, and count as repeats anyhow.
    return rows.join(wanted, ["rep", "sha"])


def _word_suspects(texts: DataFrame) -> DataFrame:
    """sha, rep, copies and the values of word windows that another of ``texts`` has too."""
    # Values travel with a short number of their text; equal numbers only make more suspects.
    values = texts.select(F.xxhash64("sha").alias("k"), F.explode("word_vals").alias("v"))
    common = stored(values.groupBy("v").count().filter("count > 1").select("v"), "word-values")
    suspect = values.join(common, "v").groupBy("k").agg(F.collect_list("v").alias("shared"))
    return texts.select("sha", "rep", "copies", F.xxhash64("sha").alias("k")).join(suspect, "k").drop("k")


def _shared(held: DataFrame, passage: int) -> DataFrame:
    """sha of texts (sha, text, shared) that hold ``passage`` words another text holds too."""
    firsts = stored(_first_windows(held, passage), "first-windows")
    equal = firsts.groupBy("h", "g").count().filter("count > 1").select("h", "g")
    settled = stored(firsts.join(equal, ["h", "g"]).select("sha").distinct(), "settled")
    open_values = firsts.join(settled, "sha", "left_anti").select("v").distinct()
    met = firsts.select("sha", "v").join(open_values, "v").distinct()
    common = met.groupBy("v").count().filter("count > 1").select("v")
    shared = met.join(common, "v").groupBy("sha").agg(F.collect_list("v").alias("shared"))
    rest = stored(held.select("sha", F.lit(1).cast("long").alias("copies"), "text").join(shared, "sha"), "unsettled")
    n = rest.agg(F.sum(F.length("text"))).first()[0] or 0
    return settled.union(_repeated_windows(rest, _word_windows(passage), n // 6, once=True).select("sha")).distinct()


def shared_passages(docs: DataFrame, words: int = PASSAGE) -> DataFrame:
    """doc_id, shares_passage of every row: whether ``words`` words in a row, between ASCII white
    space, also stand in another row. Texts of fewer words share nothing."""
    if words < WORD_GRAM:
        raise ValueError(f"a passage has at least {WORD_GRAM} words")
    measured = stored(_measure(docs, LENGTH, GRAM, words), "runs")
    texts = stored(_distinct(measured), "texts")
    held = stored(_bodies(docs, _word_suspects(texts)).select("sha", "text", "shared"), "word-suspects")
    flagged = _shared(held, words).withColumn("other", F.lit(True))
    rows = measured.select("doc_id", "sha").join(texts.select("sha", "copies", (F.size("word_vals") > 0).alias("long")), "sha").join(flagged, "sha", "left")
    return rows.select("doc_id", (F.coalesce("other", F.lit(False)) | (F.col("copies") > 1) & F.col("long")).alias("shares_passage"))


def _distinct(measured: DataFrame) -> DataFrame:
    """Each text once: sha, its measures, copies, and the smallest doc_id as rep."""
    first = [F.first(c).alias(c) for c in ("n_bytes", "firsts", "lasts", "vals", "twice", "word_vals")]
    return measured.groupBy("sha").agg(*first, F.count("*").alias("copies"), F.min(F.coalesce("doc_id", F.lit(_NULL_ID))).alias("rep"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_bytes: int = MOST_BYTES, passage: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; with ``passage`` (a number of
    words) also shares_passage, as ``shared_passages`` has it."""
    if length % 8 or gram > length:
        raise ValueError("length must be a multiple of 8 and at least the gram's")
    if passage and passage < WORD_GRAM:
        raise ValueError(f"a passage has at least {WORD_GRAM} words")
    spark = docs.sparkSession
    measured = stored(_measure(docs, length, gram, passage), "runs")
    texts = stored(_distinct(measured), "texts")
    zipped = F.explode(F.arrays_zip("firsts", "lasts", "vals", "twice")).alias("r")
    runs = texts.select("sha", "rep", "copies", zipped).select("sha", "rep", "copies", F.col("r.firsts").alias("a"), F.col("r.lasts").alias("b"), F.col("r.vals").alias("v"), F.col("r.twice").cast("long").alias("again"))
    values = runs.groupBy("v").agg(F.sum(1 + F.col("again")).alias("n"), F.sum(F.col("b") - F.col("a") + length).alias("size")).filter("n > 1")
    values = stored(values.select("v", "size", (F.col("size") > most_bytes).alias("crowded")), "values")
    # A text of several copies goes as a whole; it only stands for its windows.
    suspect = runs.join(values.drop("size"), "v").groupBy("sha", "rep", "copies").agg(F.collect_list(F.struct("a", "b", "v", "crowded")).alias("runs"))
    if passage:
        suspect = suspect.join(_word_suspects(texts), ["sha", "rep", "copies"], "full_outer")
    bodies = stored(_bodies(docs, suspect).select("sha", "copies", "text", "runs", *(["shared"] if passage else [])), "suspects")
    held = bodies.filter("runs is not null").select("sha", "copies", "text", "runs")
    n = shuffle_partitions(spark)
    sorted_runs = _segments(held, length).repartition(n, "v").sortWithinPartitions("v")
    starts = sorted_runs.mapInArrow(lambda batches: _grouped(batches, length), "sha binary, lo long, hi long")
    n_crowded = values.filter("crowded").agg(F.sum("size")).first()[0]
    if n_crowded:
        crowded = held.filter(F.exists("runs", lambda r: r["crowded"]))
        # Texts of several copies are counted, and then go as a whole.
        starts = starts.unionByName(_repeated_windows(crowded, _byte_windows(length), n_crowded))
    by_text = starts.groupBy("sha").agg(F.collect_list(F.struct("lo", "hi")).alias("starts"))
    cut = _cut(held.filter("copies = 1").select("sha", "text").join(by_text, "sha").select("sha", "text", "starts"), length)
    out = measured.select("doc_id", "sha", "n_bytes").join(texts.select("sha", "copies", (F.size("word_vals") > 0).alias("long")), "sha").join(cut, "sha", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    more = []
    if passage:
        flagged = _shared(bodies.filter("shared is not null"), passage)
        out = out.join(flagged.withColumn("other", F.lit(True)), "sha", "left")
        more = [(F.coalesce("other", F.lit(False)) | (F.col("copies") > 1) & F.col("long")).alias("shares_passage")]
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(_EMPTY)).otherwise(F.coalesce("kept", F.lower(F.hex("sha")))).alias("kept_sha256"),
        *more,
    )
