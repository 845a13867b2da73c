"""Passages of benchmark items in documents.

An item's windows are its runs of 13 words, or all its words if it has fewer. All windows of a
block of items are one Aho-Corasick automaton; each text is folded to words and scanned once
for each block, and hits are mapped back to words and to offsets in the original text. A block
holds items of at most ``block_chars`` characters, so what a worker holds is bounded whatever
the size of the benchmark; there is one block unless the benchmark is large.

Null texts have no words. An item without words has no windows; items with the same words each
count. Items without an id hit words like any other; as in the SQL, all of them count as one item
and have no part in items_sha256. Rows with the same doc_id are judged each on its own.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kaptura.llm.common import stored
from kaptura.llm.words import fold_words, framed, original_spans, word_starts

WINDOW = 13


def item_windows(text: str | None, window: int = WINDOW) -> set[tuple[bytes, ...]]:
    words = fold_words(text)
    if not words:
        return set()
    return {tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))}


class Matcher:
    """The automaton of one block of items."""

    _kept: dict[int, Matcher] = {}

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        by_window = defaultdict(list)
        for item, text in items:
            for w in item_windows(text, window):
                by_window[w].append(item)
        self.machine = ahocorasick.Automaton()
        for w, found in by_window.items():
            line = framed(list(w))
            self.machine.add_word(line, (len(line), len(w), found))
        self.empty = not by_window
        if not self.empty:
            self.machine.make_automaton()

    @classmethod
    def load(cls, key: int, items, window: int) -> Matcher:
        if key not in cls._kept:
            cls._kept.clear()
            cls._kept[key] = cls(items, window)
        return cls._kept[key]

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal runs of hit words, and the items found."""
        if self.empty or not words:
            return [], set()
        hits = list(self.machine.iter(framed(words)))
        if not hits:
            return [], set()
        starts = word_starts(words)
        items, runs = set(), []
        for first, n, found in sorted((int(starts.searchsorted(end - size + 1)), n, i) for i, (end, (size, n, _)) in enumerate(hits)):
            items.update(hits[found][1][2])
            if runs and first <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], first + n)
            else:
                runs.append([first, first + n])
        return [tuple(r) for r in runs], items


def item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[str | None, str]]]:
    """Items in blocks of bounded size; no more than one block is on the driver at a time."""
    block, chars = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").filter("text is not null").toLocalIterator():
        block.append((row[0], row[1]))
        chars += len(row[1])
        if chars >= block_chars:
            yield block
            block, chars = [], 0
    if block:
        yield block


def _scanned(docs: DataFrame, items: list, window: int, with_spans: bool) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)
    key = sent._jbroadcast.id() if sent._jbroadcast is not None else id(sent)
    n = len(docs.columns)
    pairs_of_longs = T.ArrayType(T.ArrayType(T.LongType()))
    schema = docs.drop("_text").schema.add("n_words", "long").add("runs", pairs_of_longs).add("items", T.ArrayType(T.StringType())).add("spans", pairs_of_longs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher.load(key, sent.value, window)
        pairs = pa.list_(pa.list_(pa.int64()))
        for batch in batches:
            counts, runs, found, spans = [], [], [], []
            for text in batch.column(n - 1).to_pylist():
                words = fold_words(text)
                r, i = matcher.scan(words)
                counts.append(len(words))
                runs.append(r)
                found.append(sorted(i - {None}) + [None] * (None in i))
                spans.append(original_spans(text, r) if r and with_spans else [])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64()), pa.array(runs, pairs), pa.array(found, pa.list_(pa.string())), pa.array(spans, pairs)], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, keep: list[str], window: int = WINDOW, block_chars: int = 4_000_000, with_spans: bool = True) -> DataFrame:
    """``keep``, n_words, n_hit, items (sorted as strings, null last) and spans (code points, merged) of every row."""
    kept = docs.select(*keep, docs["text"].alias("_text"))
    blocks = item_blocks(benchmark, block_chars)
    first, second = next(blocks, []), next(blocks, None)
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    if second is None:
        one = _scanned(kept, first, window, with_spans)
        return one.select(*keep, "n_words", n_hit.alias("n_hit"), "items", "spans")
    # More than one block: the parts of a row meet again by a row number that is written down once.
    numbered = stored(kept.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    rows = numbered.select("_row", "_text")
    parts = stored(_scanned(rows, first, window, with_spans).filter("size(runs) > 0"), "block")
    for block in [second, *blocks]:
        parts = parts.unionByName(stored(_scanned(rows, block, window, with_spans).filter("size(runs) > 0"), "block"))
    merged = parts.groupBy("_row").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    merged = merged.select("_row", _union(F.col("runs")).alias("runs"), "items", _union(F.col("spans")).alias("spans"))
    base = _scanned(numbered.select(*keep, "_row", "_text"), [], window, False).select(*keep, "_row", "n_words")
    none = F.array().cast("array<array<long>>")
    return base.join(merged, "_row", "left").select(*keep, "n_words", F.coalesce("runs", none).alias("runs"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", none).alias("spans")).select(*keep, "n_words", n_hit.alias("n_hit"), "items", "spans")


def _union(runs):
    """Sorted runs with overlapping and touching ones joined."""

    def step(out, run):
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(last[0], F.greatest(last[1], run[1]))))
        return F.when(F.size(out) == 0, F.array(run)).when(run[0] <= F.try_element_at(out, F.lit(-1))[1], joined).otherwise(F.concat(out, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast("array<array<long>>"), step)


def is_contaminated(n_hit, n_words):
    return (n_hit > 0) & (20 * n_hit >= n_words)


def judge_documents(docs: DataFrame, benchmark: DataFrame, block_chars: int = 4_000_000) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    hits = benchmark_hits(docs, benchmark, ["doc_id"], block_chars=block_chars, with_spans=False)
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = 4_000_000) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    hits = benchmark_hits(whole, benchmark, ["doc"], block_chars=block_chars, with_spans=False)
    return hits.filter(~is_contaminated(F.col("n_hit"), F.col("n_words"))).select("doc.*")


#: The same in DuckDB SQL, over the views ``documents`` and ``benchmark``.
ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws from benchmark),
bw as (select distinct item_id, least(13, len(ws)) n, array_to_string(ws[i:i + 12], ' ') x from (select item_id, ws, unnest(range(1, greatest(2, len(ws) - 11))) i from b where len(ws) > 0)),
sizes as (select distinct n from bw),
dw as (select doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') x from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i from d, sizes)),
hit as (select doc_id, i, bw.n, item_id from dw join bw on dw.x = bw.x and dw.n = bw.n),
places as (select count(*) n_hit, doc_id from (select distinct doc_id, unnest(range(i, i + n)) p from (select distinct doc_id, i, n from hit)) group by doc_id),
items as (select doc_id, count(*) n_items, sha256(string_agg(item_id, ',' order by item_id)) items_sha256 from (select distinct doc_id, item_id::varchar item_id from hit) group by doc_id)
select d.doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, coalesce(items_sha256, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join places on places.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""
