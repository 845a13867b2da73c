"""Fill-in-middle rows: texts cut in prefix, middle and suffix at unit ends, with sentinels between.

A table drives the scan: for each state and class of byte the next state and what the step emits, that
is whether a code point starts, whether a unit ends and which sentinel is complete. A state depends on
the last few bytes alone (``reach``), so numpy takes the steps of a chunk's bytes side by side, each
from the bytes before it. The first pass counts what the steps emit, chunk by chunk; the second runs
the table again over the chunks only that hold a cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Between prefix, suffix and middle: fixed values of the output's format.
SENTINELS = ("<P>", "<S>", "<M>")
#: What a step emits: a code point's first byte, a unit's last one, and from SEEN on a sentinel's last one.
POINT, UNIT, SEEN = 1, 2, 4
CHUNK = 1 << 16
FORMS = {"psm": (0, 1, 2), "spm": (1, 0, 2)}


class Counted(NamedTuple):
    """Code points, units and sentinels of a text; (code points, ended units) before each chunk."""

    points: int
    units: int
    seen: list[tuple[int, int]]
    before: list[tuple[int, int]]


class Scanner:
    """The table for some sentinels; units are lines with their line feed."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        self.sentinels = [s.encode() for s in sentinels]
        if not all(self.sentinels) or b"\n" in b"".join(self.sentinels):
            raise ValueError("a sentinel is not empty and holds no line feed")
        own = sorted(set(b"".join(self.sentinels)))
        kinds = np.zeros(256, np.uint8)
        kinds[0x80:0xC0], kinds[0xC0:0xE0], kinds[0xE0:0xF0], kinds[0xF0:], kinds[10] = 1, 2, 3, 4, 5
        kinds[own] = np.arange(6, 6 + len(own), dtype=np.uint8)
        self.kind_of, self.kinds = kinds, 6 + len(own)
        #: (bytes of a sentinel read so far, bytes that a code point still lacks)
        read = sorted({s[:n] for s in self.sentinels for n in range(len(s))} | {b""}, key=len)
        states = [(r, lacks) for r in read for lacks in range(4)]
        at = {s: i for i, s in enumerate(states)}
        byte_of = [0, 0x80, 0xC3, 0xE1, 0xF1, 10, *own]
        self.next = np.zeros((len(states), self.kinds), np.uint8)
        self.emits = np.zeros((len(states), self.kinds), np.uint8)
        for (done, lacks), state in at.items():
            for kind, byte in enumerate(byte_of):
                lead = (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0)
                continues = 0x80 <= byte < 0xC0
                tail = done + bytes([byte]) if kind >= 6 else b""
                whole = max((i for i, s in enumerate(self.sentinels) if tail.endswith(s)), key=lambda i: len(self.sentinels[i]), default=-1)
                while tail not in read:
                    tail = tail[1:]
                self.next[state, kind] = at[tail, max(lacks - 1, 0) if continues else lead]
                self.emits[state, kind] = POINT * (not continues) | UNIT * (byte == 10) | SEEN * (whole + 1)
        self.reach = max(3, *map(len, self.sentinels))
        self.flat_next, self.flat_emits = self.next.ravel(), self.emits.ravel()

    def _steps(self, data: np.ndarray, a: int, b: int) -> np.ndarray:
        """What the steps over bytes a to b emit, each from the state its ``reach`` bytes before it lead to."""
        kinds = self.kind_of[data[max(0, a - self.reach) : b]].astype(np.uint16)
        if lacking := self.reach - min(a, self.reach):
            kinds = np.concatenate((np.zeros(lacking, np.uint16), kinds))
        state, n = np.zeros(b - a, np.uint16), b - a
        for j in range(self.reach):
            state = self.flat_next[state * self.kinds + kinds[j : j + n]].astype(np.uint16)
        return self.flat_emits[state * self.kinds + kinds[self.reach :]]

    def count(self, text: bytes) -> Counted:
        """The first pass."""
        data, points, units, seen, before = np.frombuffer(text, np.uint8), 0, 0, [], []
        for a in range(0, len(text), CHUNK):
            before.append((points, units))
            steps = self._steps(data, a, min(a + CHUNK, len(text)))
            counts = np.bincount(steps, minlength=SEEN)
            points += int(counts[POINT::2].sum())
            units += int(counts[UNIT:SEEN].sum())
            if counts[SEEN:].any():
                seen += [(a + int(i) + 1, int(steps[i] // SEEN) - 1) for i in np.flatnonzero(steps >= SEEN)]
        return Counted(points, units + (bool(text) and text[-1] != 10), seen, before)

    def cut(self, text: bytes, counted: Counted, units: int) -> tuple[int, int]:
        """The second pass: (bytes, code points) that the first ``units`` units have."""
        if not units:
            return 0, 0
        if units == counted.units:
            return len(text), counted.points
        chunk = np.searchsorted([u for _, u in counted.before], units) - 1
        a, (points, ended) = int(chunk) * CHUNK, counted.before[chunk]
        steps = self._steps(np.frombuffer(text, np.uint8), a, min(a + CHUNK, len(text)))
        end = int(np.flatnonzero(steps & UNIT)[units - ended - 1]) + 1
        return a + end, points + int((steps[:end] & POINT).sum())

    def restore(self, output: bytes, form: str) -> bytes:
        """The text that an output of this form was made of."""
        if form not in FORMS:
            return output
        seen = self.count(output).seen
        if [i for _, i in seen] != list(FORMS[form]):
            raise ValueError(f"an output of form {form} has other sentinels")
        ends = [*(end - len(self.sentinels[i]) for end, i in seen[1:]), len(output)]
        parts = {i: output[a:b] for (a, i), b in zip(seen, ends, strict=True)}
        return parts[0] + parts[2] + parts[1]


def transform(docs: DataFrame, rate: int = 100, spm: int = 50, seed: str = "7", sentinels: tuple[str, str, str] = SENTINELS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row.

    Four numbers of the SHA-256 of ``seed``:id give the two cuts, whether the row is cut at all (``rate``
    of a hundred) and its form (``spm`` of a hundred of those cut). Texts that are null, empty or hold a
    sentinel stay plain; a null id counts as an empty one. Repeated rows are cut alike, an empty table
    gives an empty one, and other columns are not read, whatever their names.
    """
    rows = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    schema = rows.select("doc_id").schema.add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentinels)
        p, s, m = scanner.sentinels
        for batch in batches:
            out: list[tuple] = []
            for own, whole in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                whole = whole or b""
                counted = scanner.count(whole)
                digest = hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).digest()
                h = [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]
                if not whole or counted.seen or h[2] % 100 >= rate:
                    out.append((counted.units, "plain", None, None, whole))
                    continue
                first, second = sorted(x % (counted.units + 1) for x in h[:2])
                (a, chars), (b, end) = scanner.cut(whole, counted, first), scanner.cut(whole, counted, second)
                prefix, middle, suffix = whole[:a], whole[a:b], whole[b:]
                if h[3] % 100 < spm:
                    out.append((counted.units, "spm", chars, end - chars, b"".join((s, suffix, p, prefix, m, middle))))
                else:
                    out.append((counted.units, "psm", chars, end - chars, b"".join((p, prefix, s, suffix, m, middle))))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            columns = [pa.array([x[i] for x in out], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns[:4], columns[4].view(pa.string())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def restored(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``rows`` of ``transform`` with the texts that they were made of in ``restored``."""
    names = [*rows.columns, "restored"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sentinels)
        at = names.index("output")
        for batch in batches:
            texts = [scanner.restore(o, f) for o, f in zip(batch.column(at).cast(pa.binary()).to_pylist(), batch.column(names.index("form")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).view(pa.string())], names=names)

    return rows.mapInArrow(run, rows.select("*").schema.add("restored", "string"))


ORACLE = r"""WITH u AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || d[1:8])::BIGINT AS h1, ('0x' || d[9:16])::BIGINT AS h2, ('0x' || d[17:24])::BIGINT AS h3, ('0x' || d[25:32])::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
