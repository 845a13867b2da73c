"""Token counts of documents, from counts of distinct pre-tokens.

1. Count every distinct pre-token of the corpus, partly within each task.
2. Give each distinct pre-token its number of pieces, once, by the tokenizers library.
3. Go over the documents again: the ``head`` most frequent pre-tokens (a fixed number, so a
   bounded broadcast) are summed at once; a document's other pre-tokens, with their
   frequencies, are joined to the table of pieces and summed by document.

No ids are made. Null and empty texts have no tokens. A special token's string inside a text
counts as one. One row out for each row in, whatever its doc_id.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import LONGEST_KEPT, stored

#: The pre-tokenizer pattern of byte-level vocabularies (a fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_PIECES = regex.compile(PATTERN)
_SPACE_THEN_SPACE = re.compile(r" \s| \Z")


class PreTokens:
    """Texts as chunks, and pre-tokens of chunks.

    A chunk is what stands between two single spaces, with the space before it: where no space
    meets other white space on its right, the pattern never looks beyond one. A text's first
    part, and parts of a text in which spaces do meet, are split by the pattern at once.
    """

    def __init__(self, special: tuple[str, ...]):
        self.special = special
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None

    def parts(self, text: str) -> tuple[list[str], list[str], int]:
        """Chunks (without their space), further pre-tokens, and how many special tokens."""
        parts = self.cut.split(text) if any(s in text for s in self.special) else [text]
        chunks: list[str] = []
        pieces: list[str] = []
        for part in parts:
            if _SPACE_THEN_SPACE.search(part):
                pieces += _PIECES.findall(part)
            elif part:
                first, *rest = part.split(" ")
                pieces += _PIECES.findall(first)
                chunks = chunks + rest if chunks else rest
        return chunks, pieces, len(parts) - 1


def _special(path: str) -> tuple[str, ...]:
    import json

    with open(path, encoding="utf-8") as f:
        return tuple(t["content"] for t in json.load(f)["added_tokens"])


def pre_token_table(docs: DataFrame, vocabulary: str, flush: int = 200_000) -> DataFrame:
    """pre_token, freq over the corpus, n_pieces."""

    def partly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, seen, pre = Counter(), Counter(), PreTokens(_special(vocabulary))

        def out():
            for chunk, n in chunks.items():
                for piece in _PIECES.findall(" " + chunk):
                    seen[piece] += n
            batch = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["pre_token", "freq"])
            chunks.clear()
            seen.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    more, pieces, _ = pre.parts(text)
                    chunks.update(more)
                    seen.update(pieces)
                    if len(chunks) + len(seen) >= flush:
                        yield out()
        if chunks or seen:
            yield out()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are parallel already
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        tokenizer.no_truncation()
        for batch in batches:
            n = [len(e.ids) for e in tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=["pre_token", "freq", "n_pieces"])

    distinct = docs.select("text").mapInArrow(partly, "pre_token string, freq long").groupBy("pre_token").agg(F.sum("freq").alias("freq"))
    return distinct.mapInArrow(pieces, "pre_token string, freq long, n_pieces long")


def _common(table: DataFrame, head: int) -> dict[str, int]:
    """At most ``head`` pre-tokens with their pieces: all from the least frequency on that gives
    no more. Some hundred counts by classes of frequency come first, so that no task sends rows
    that aren't used."""
    level = F.floor(F.log2("freq") * 16)
    classes = sorted(table.groupBy(level.alias("level")).count().collect(), reverse=True)
    least, total = None, 0
    for c in classes:
        total += c["count"]
        if total > head:
            break
        least = c["level"]
    if least is None:
        return {}
    return {r[0]: r[1] for r in table.filter(level >= least).select("pre_token", "n_pieces").collect()}


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, head: int = 1 << 16, cache: int = 300_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    table = stored(pre_token_table(docs, vocabulary), "pre-tokens")
    common = spark.sparkContext.broadcast(_common(table, head))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre, known = PreTokens(_special(vocabulary)), common.value
        sums: dict[str, int | None] = {}  # of chunks; none where a pre-token of it isn't common

        def chunk_sum(chunk: str) -> int | None:
            counts = [known.get(p) for p in _PIECES.findall(" " + chunk)]
            total = None if None in counts else sum(counts)
            if len(sums) < cache and len(chunk) <= LONGEST_KEPT:
                sums[chunk] = total
            return total

        def row(text: str) -> tuple[int, int, Counter]:
            chunks, pieces, total = pre.parts(text)
            found = list(map(sums.get, chunks, repeat(-1)))
            if -1 in found:
                found = [chunk_sum(c) if n == -1 else n for c, n in zip(chunks, found, strict=True)]
            if None in found:
                for chunk, n in zip(chunks, found, strict=True):
                    if n is None:
                        pieces += _PIECES.findall(" " + chunk)
                found = [n for n in found if n is not None]
            tail = Counter()
            for piece in pieces:
                n = known.get(piece)
                if n is None:
                    tail[piece] += 1
                else:
                    total += n
            return len(text.encode()), total + sum(found), tail

        for batch in batches:
            rows = [row(text) if text else (0, 0, {}) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([list(r[2]) for r in rows], pa.list_(pa.string())),
                    pa.array([list(r[2].values()) for r in rows], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_bytes", "head_tokens", "tail", "freqs"],
            )

    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_bytes long, head_tokens long, tail array<string>, freqs array<long>")
    base = stored(counted.withColumn("row", F.monotonically_increasing_id()), "pre-token-rows")
    rare = base.select("row", F.explode(F.arrays_zip("tail", "freqs")).alias("t")).select("row", F.col("t.tail").alias("pre_token"), F.col("t.freqs").alias("n"))
    summed = rare.join(table.select("pre_token", "n_pieces"), "pre_token").groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("tail_tokens"))
    n_tokens = F.col("head_tokens") + F.coalesce("tail_tokens", F.lit(0))
    return base.drop("tail", "freqs").join(summed, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
