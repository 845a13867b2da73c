"""Words of clauses against all paths, on made dictionaries."""

import math
import random
import re

import pytest

from kaptura.operators import segmenter

TOKENS = "doc_id long, pos int, text string, start double, end double, sentence_end boolean, clause_end boolean"


def paths(units, known):
    """Every way to cut units in known words and single units."""
    if not units:
        yield []
        return
    for n in range(1, min(4, len(units)) + 1):
        word = "".join(units[:n])
        if n == 1 or word in known and re.fullmatch("[一-鿿]+", word):
            for rest in paths(units[n:], known):
                yield [(n, word), *rest]


def best(text, counts):
    units = re.findall("[A-Za-z0-9]+|[^A-Za-z0-9]", text)
    total = sum(counts.values()) or 1
    cost = lambda w: round(1e6 * math.log(total / counts.get(w, 1)))
    ranked = min(paths(units, counts), key=lambda p: (sum(cost(w) for _, w in p), [-n for n, _ in p]))
    return [w for _, w in ranked]


def made(seed, n):
    rng = random.Random(seed)
    alphabet = "甲乙丙丁戊"
    words = ["".join(rng.choice(alphabet) for _ in range(rng.choice((1, 2, 2, 3, 3, 4, 5)))) for _ in range(60)]
    seen = [w for w in words for _ in range(rng.choice((1, 1, 2, 5)))]
    texts = ["".join(rng.choice([*alphabet, "己", "ab1", "。", "甲乙丙丁"]) for _ in range(rng.randrange(1, 13))) for _ in range(n)]
    return seen, texts


def tokens_of(text, doc, at=0.0):
    parts = re.findall("[a-z0-9]+|.", text)
    return [(doc, i, t, at + i * 0.2, at + i * 0.2 + 0.1, i % 3 == 2, i % 4 == 1) for i, t in enumerate(parts)]


@pytest.mark.parametrize("common", [65_536, 3, 0])
def test_words_are_the_best_of_all_paths(spark, common):
    seen, texts = made(common, 120)
    counts = {w: seen.count(w) for w in set(seen) if len(w) <= 4}
    words = segmenter.dictionary(spark.createDataFrame([(w,) for w in seen] + [(None,), ("",), ("abc",)], "word string"))
    assert {r.word: r.n for r in words.collect()} == counts
    rows = [r for i, t in enumerate(texts) for r in tokens_of(t, i)]
    found = segmenter.segmented(spark.createDataFrame(rows, TOKENS).repartition(5), words, common=common).collect()
    for i, text in enumerate(texts):
        own = sorted((r for r in found if r.doc_id == i), key=lambda r: r.at)
        tokens = tokens_of(text, i)
        if not re.search("[一-鿿]", text):
            assert [r.text for r in own] == [t[2] for t in tokens]
            continue
        assert [r.text for r in own] == best(text, counts), text
        owner = [t for t in tokens for _ in t[2]]
        for r in own:
            part = owner[r.at : r.at + len(r.text)]
            assert (r.start, r.end) == (part[0][3], part[-1][4])
            assert (r.sentence_end, r.clause_end) == (any(t[5] for t in part), any(t[6] for t in part))


def test_clauses_letters_and_odd_tokens(spark):
    none = segmenter.dictionary(spark.createDataFrame([], "word string"))
    assert segmenter.segmented(spark.createDataFrame([], TOKENS), none).collect() == []
    rows = [(1, 0, "甲", 0.0, 0.1, None, None), (1, 1, "t", 0.1, 0.2, False, False), (1, 2, "c", 0.2, 0.3, False, True), (1, 3, "", 0.3, 0.4, True, True), (1, 4, None, 0.4, 0.5, True, True), (1, 5, "x y", 2.0, 2.1, True, False), (None, 0, "乙", 0.0, 0.1, False, False)]
    docs = spark.createDataFrame(rows, TOKENS).selectExpr("*", "'clash' as word", "'clash' as at", "'clash' as run", "'clash' as kind")
    got = sorted(segmenter.segmented(docs, none).collect(), key=lambda r: (r.doc_id or 0, r.clause, r.at))
    assert [(r.doc_id, r.clause, r.text, r.start, r.end, r.sentence_end, r.clause_end) for r in got] == [(None, 0, "乙", 0.0, 0.1, False, False), (1, 0, "甲", 0.0, 0.1, False, False), (1, 0, "tc", 0.1, 0.3, False, True), (1, 1, "x y", 2.0, 2.1, True, False)]
    arrays = {r.doc_id: [w.text for w in r.words] for r in segmenter.word_arrays(segmenter.segmented(docs, none)).collect()}
    assert arrays == {1: ["甲", "tc", "x y"], None: ["乙"]}


def test_a_word_does_not_cross_a_breath_and_long_clauses_end(spark):
    words = segmenter.dictionary(spark.createDataFrame([("甲乙",)] * 9, "word string"))
    rows = [(1, 0, "甲", 0.0, 0.1, False, False), (1, 1, "乙", 0.9, 1.0, False, False), (1, 2, "甲", 1.0, 1.1, False, False), (1, 3, "乙", 1.1, 1.2, False, False)]
    got = sorted((r.clause, r.at, r.text) for r in segmenter.segmented(spark.createDataFrame(rows, TOKENS), words).collect())
    assert got == [(0, 0, "甲"), (1, 0, "乙"), (1, 1, "甲乙")]
    text = "甲乙丙" * 5000
    got = segmenter.segmented(spark.createDataFrame(tokens_of(text, 1), TOKENS), words).orderBy("at").collect()
    assert [r.text for r in got] == ["甲乙", "丙"] * 5000
