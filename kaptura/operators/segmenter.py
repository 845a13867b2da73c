"""Words of clauses without blanks, from a dictionary counted in a table.

A clause is cut into units: a run of Latin letters or digits, or any other character. Runs of up to
``longest`` CJK units that the dictionary holds, and every single unit, lead from one place to another;
the words are the path of least cost, where a word that is seen n times of a total of N costs
ln(N / n), in millionths, and an unknown unit as much as a word seen once. Of paths that cost the same
the one whose first word is longest is taken, then the one whose second is, and so on.

A document is a row with its tokens in an array, as for all steps that depend on order, so nothing is
shuffled but the dictionary; words too rare to be known in every task are found by a join on the texts'
distinct grams.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kaptura.operators.documents import TOKEN, field_rows, map_documents, struct_columns
from kaptura.session import written

#: Units of the longest word, and the words of two or more units that are looked up in every task; as
#: single characters are looked up there too, only rare words are left to a shuffle, none a hot key.
LONGEST, COMMON = 4, 65_536
CJK_WORD = r"^[一-鿿]+$"
_UNIT, _WORD, _CJK = re.compile("(?s)[A-Za-z0-9]+|[^A-Za-z0-9]"), re.compile("[一-鿿]+"), re.compile("[一-鿿]")
_RUN = re.compile("[一-鿿]+|[^一-鿿]+")
TOKENS = ("text", "start", "end", "jump", "sentence_end", "clause_end")
WORDS = ("text", "start", "end", "sentence_end", "clause_end")
FOUND = T.ArrayType(T.StructType([T.StructField("clause", T.LongType()), T.StructField("at", T.LongType()), *TOKEN.fields, T.StructField("sentence_end", T.BooleanType()), T.StructField("clause_end", T.BooleanType())]))
BREATH, SENTENCE_BREATH = 0.38, 0.12


def dictionary(words: DataFrame, word: str = "word", longest: int = LONGEST) -> DataFrame:
    """word, n and total of the CJK words of ``longest`` characters at most; nulls and other words don't count."""
    known = words.select(F.col(word).alias("word")).filter(F.col("word").rlike(CJK_WORD) & (F.char_length("word") <= longest))
    return known.groupBy("word").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def _cost(n: Column, total: Column) -> Column:
    return F.round(1e6 * F.log(total / n)).cast("long")


def clauses(tokens: Sequence[dict] | None) -> list[list[list]]:
    """Tokens (text, start, end, sentence_end, clause_end) between breaths; letters read one by one are
    joined. Empty and null tokens go."""
    out: list[list[list]] = []
    before, open_run = None, False
    for t in tokens or ():
        text = (t["text"] or "").strip(" ")
        if not text:
            continue
        gap = t["start"] - before[2] if before and t["start"] is not None and before[2] is not None else None
        breath = gap is not None and (not gap < BREATH or t["jump"] or before[3] and not gap < SENTENCE_BREATH)
        single = len(text) == 1 and text.isascii() and text.isalnum()
        token = [text, t["start"], t["end"], bool(t["sentence_end"]), bool(t["clause_end"])]
        before = token.copy()
        if not out or breath:
            out.append([token])
        elif single and open_run:
            last = out[-1][-1]
            out[-1][-1] = [last[0] + text, last[1], *token[2:]]
        else:
            out[-1].append(token)
        open_run = single
    return out


def grams(text: str, begin: Sequence[int], longest: int) -> set[str]:
    """Runs of two to ``longest`` units that a dictionary may hold."""
    return {g for n in range(2, longest + 1) for a, b in zip(begin, begin[n:], strict=False) if _WORD.fullmatch(g := text[a:b])}


def unit_bounds(text: str) -> list[int]:
    """Where each unit of a clause begins, and where the last one ends."""
    return [0, *(m.end() for m in _UNIT.finditer(text))]


def best_path(run: str, cost: Callable[[str], int | None], unknown: int, longest: int = LONGEST) -> list[int]:
    """Sizes of the words on the path of least cost through a run of CJK units, each of which is a character."""
    n = len(run)
    least, step = [0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        own = cost(run[i])
        best, size = (unknown if own is None else own) + least[i + 1], 1
        for end in range(i + 2, min(i + longest, n) + 1):
            own = cost(run[i:end])
            if own is not None and own + least[end] <= best:  # of equal ones the longer
                best, size = own + least[end], end - i
        least[i], step[i] = best, size
    out, i = [], 0
    while i < n:
        out.append(step[i])
        i += step[i]
    return out


def _columns(tokens: Sequence[Sequence] | None) -> tuple[list, list, list, list, list, list[int]]:
    """Columns of ``clauses`` and where each clause begins; ``tokens``: columns text, start, end, jump and flags."""
    texts, starts, ends, jumps, sentence, paused = tokens or ([],) * 6
    n = len(texts)
    usual = all(texts) and not any(t[0] == " " or t[-1] == " " for t in texts) and None not in starts and None not in ends
    if usual and n:
        start, end = np.array(starts, float), np.array(ends, float)
        sent, gap = np.array(sentence, bool), start[1:] - end[:-1]
        breath = ~(gap < BREATH) | np.array(jumps, bool)[1:] | sent[:-1] & ~(gap < SENTENCE_BREATH)
        single = np.array([len(t) == 1 and t.isascii() and t.isalnum() for t in texts])
        if not (single[1:] & single[:-1] & ~breath).any():
            return texts, starts, ends, sentence, paused, [0, *(np.flatnonzero(breath) + 1).tolist()]
    names = ("text", "start", "end", "jump", "sentence_end", "clause_end")
    found = clauses([dict(zip(names, t, strict=True)) for t in zip(texts, starts, ends, jumps, sentence, paused, strict=True)])
    columns = zip(*(t for c in found for t in c), strict=True) if found else ([],) * 5
    return *map(list, columns), [0, *itertools.accumulate(map(len, found))][:-1]


def found_words(tokens: Sequence[Sequence] | None, cost: Callable[[str], int | None], unknown: int, longest: int = LONGEST) -> tuple[Sequence, ...]:
    """The words of all clauses by columns, with the times and flags of the tokens that their characters come
    from. ``tokens``: columns as of ``_columns``; ``cost`` knows CJK words only."""
    texts, starts, ends, sentence, paused, begins = _columns(tokens)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = [0, *np.cumsum(sizes).tolist()]  # of each token in all texts
    whole = "".join(texts)
    words: list[int] = []  # sizes
    counts, offsets = [], []  # words of each clause, and where it begins
    for lo, hi in itertools.pairwise([*begins, len(texts)]):
        own, a, b = len(words), begin[lo], begin[hi]
        text = whole[a:b]
        if _CJK.search(text):
            for run in _RUN.findall(text):
                words += best_path(run, cost, unknown, longest) if _CJK.match(run) else map(len, _UNIT.findall(run))
        else:
            words += map(len, texts[lo:hi])
        counts.append(len(words) - own)
        offsets.append(a)
    last = np.cumsum(np.array(words, np.int64))
    first = last - np.array(words, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    i, j = (owner[first], owner[last - 1]) if words else (first, last)
    within = lambda flags: (upto := np.concatenate(([0], np.cumsum(np.array(flags, bool)))))[j + 1] > upto[i]
    at = lambda values, k: [values[x] for x in k.tolist()] if None in values else np.array(values, float)[k]
    number = np.repeat(np.arange(len(counts)), np.array(counts, np.int64))
    place = first - np.repeat(np.array(offsets, np.int64), np.array(counts, np.int64))
    return number, place, [whole[a:b] for a, b in zip(first.tolist(), last.tolist(), strict=True)], at(starts, i), at(ends, j), within(sentence), within(paused)


def _prices(words: DataFrame, longest: int, common: int) -> tuple[dict[str, int], int, DataFrame | None]:
    """Costs of the ``common`` most frequent words and of single characters, that of an unknown unit, and
    gram and cost of the words that are left, None if there are none."""
    words = written(words, "dictionary")
    total = F.lit((words.agg(F.max("total")).first()[0] or 1)).cast("double")
    unknown = words.sparkSession.range(1).select(_cost(F.lit(1.0), total)).first()[0]
    priced = words.filter(F.char_length("word") <= longest).select(F.col("word").alias("gram"), _cost(F.col("n"), F.col("total")).alias("cost"), F.col("n").alias("_n"))
    longer = priced.filter(F.char_length("gram") > 1)
    few = longer.limit(common + 1).count() <= common
    head = longer if few else written(longer.orderBy(F.desc("_n"), "gram").limit(common), "common-words")
    costs = {r.gram: r.cost for r in head.unionByName(priced.filter(F.char_length("gram") == 1)).collect()}
    return costs, unknown, None if few else longer.join(F.broadcast(head), "gram", "left_anti").select("gram", "cost")


def segmented_documents(docs: DataFrame, words: DataFrame, tokens: str = "tokens", output: str = "words", longest: int = LONGEST, common: int = COMMON, then: Callable[[tuple], object] | None = None, kind: T.DataType = FOUND, build: Callable = struct_columns) -> DataFrame:
    """``docs`` with ``output`` in place of ``tokens`` (an array of text, start, end, jump and flags): their words in order.

    ``then`` makes of the words' columns what ``kind`` says, within the map.

    A map with the common words in every task. Where the dictionary has more, the rows' distinct grams are
    joined with the rest, and each row takes what it found there along.
    """
    costs, unknown, rare = _prices(words, longest, common)
    sent = docs.sparkSession.sparkContext.broadcast(costs)
    keep = [c for c in docs.columns if c not in (tokens, output)]
    docs = docs.withColumn(tokens, F.transform(tokens, lambda t: F.struct(*(t[c].alias(c) for c in TOKENS)))) if docs.schema[tokens].dataType.elementType.fieldNames() != list(TOKENS) else docs

    def own_words(t: Sequence[Sequence] | None, cost: Callable[[str], int | None]) -> object:
        found = found_words(t, cost, unknown, longest)
        return found if then is None else then(found)

    if rare is None:
        return map_documents(docs, [tokens], output, kind, lambda t: own_words(t, sent.value.get), keep, field_rows, build).drop(f"{output}_error")
    row, more = "_row", "_more"
    while {row, more} & set(docs.columns):
        row, more = f"_{row}", f"_{more}"
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "segmenter-rows")

    def asked(t: Sequence[Sequence] | None) -> list[str]:
        own, *_, begins = _columns(t)
        texts = ("".join(own[a:b]) for a, b in itertools.pairwise([*begins, len(own)]))
        return list(set().union(*(grams(x, unit_bounds(x), longest) for x in texts if _CJK.search(x))) - sent.value.keys())

    missed = map_documents(rows, [tokens], "gram", T.ArrayType(T.StringType()), asked, [row], field_rows).select(row, F.explode("gram").alias("gram"))
    found = missed.join(rare, "gram").groupBy(row).agg(F.collect_list(F.struct("gram", "cost")).alias(more))

    def apply(t: Sequence[Sequence] | None, own: Sequence[Sequence] | None) -> object:
        known = dict(zip(*own, strict=True)) if own else {}
        return own_words(t, lambda g: sent.value.get(g, known.get(g)))

    return map_documents(rows.join(found, row, "left"), [tokens, more], output, kind, apply, keep, field_rows, build).drop(f"{output}_error")


def segmented(tokens: DataFrame, words: DataFrame, key: str = "doc_id", order: str = "pos", longest: int = LONGEST, common: int = COMMON) -> DataFrame:
    """key, clause, at and the word (text, start, end, sentence_end, clause_end) of every clause of ``tokens``.

    Clauses without CJK characters have their tokens as words. ``words``: what ``dictionary`` gives;
    an empty one makes every unit a word. No tokens, no words. Columns beside those read are dropped.
    """
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in tokens.columns else F.lit(False).alias(c) for c in ("sentence_end", "clause_end", "jump")]
    token = F.struct(F.col(order).alias("pos"), F.col("text"), F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"), *flags)
    docs = tokens.groupBy(key).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    return segmented_documents(docs, words, longest=longest, common=common).select(key, F.inline("words"))


def word_arrays(words: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ``words``, each document's words in order: what caption lines are cut from."""
    return words.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("clause", "at", *WORDS))), lambda w: F.struct(*(w[c].alias(c) for c in WORDS))).alias("words"))
