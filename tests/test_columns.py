"""Captions, words and runs by columns against the steps word by word."""

import random

import pytest
from pyspark.sql import functions as F

from kaptura.functions import text as tx
from kaptura.operators import align, classic, guard, lines, segmenter
from kaptura.operators.documents import LINE, struct_columns, structs
from kaptura.operators.lines import Word
from kaptura.plans import captions
from kaptura.plans.queries import document_exports, guard_documents
from kaptura.sources import srt, transcripts

VOCABULARY = "我们 的 然后 在 网络 TCP a b 了 对吧 好 那么 协议 所以 第 四 个 啊 OK ok 。 ， ... 1 16 是 这个 OK吗 是不是 hello déjà naïve, l'été -où ça… word. end? a1的 鿕 /c龥 得 得去 关于 其实因为 q longer here， 电脑网络 换句话说 3. ” Straße \"so\"".split() + ["x y", " k "]


def made(seed):
    """Words with odd texts, times and flags."""
    rng = random.Random(seed)
    own, at, out = rng.sample(VOCABULARY, rng.choice([3, 8, 20, len(VOCABULARY)])), 0.0, []
    for _ in range(rng.randrange(90)):
        at += rng.choice([0.0, 0.05, 0.07, 0.07, 0.2, 0.3, 0.5, 1.0])
        out.append(Word(rng.choice(own), at, at + rng.choice([0.1, 0.3, 1.1]), rng.random() < 0.05, rng.random() < 0.1))
        at = out[-1].end
    return out


@pytest.mark.parametrize("first", range(0, 2000, 500))
def test_lines_by_columns_are_those_of_the_steps(first):
    for seed in range(first, first + 500):
        words = made(seed)
        own = lines.Measured(*(map(list, zip(*words, strict=True)) if words else ([],) * 5))
        cuts = lines.first_cuts(words)
        assert own.first_cuts() == cuts, seed
        cuts = lines.merged(words, lines.shifted(words, cuts))
        assert own.cuts() == cuts, seed
        want = lines.timed([words[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
        assert own.lines() == [(i, a, b, t) for i, (a, b, t) in enumerate(want, 1) if t.strip()], seed


def test_words_of_one_shape_look_alike():
    for word in [*VOCABULARY, "ok.", "OK。", "Ünïcode", "12", "٣", "aé1,"]:
        assert word in lines._LISTED or lines._looked(word) == lines._looked(word.translate(lines._SHAPES)), word


def test_words_of_plain_texts_are_tokens_within_the_map(spark):
    texts = [None, "", "  \u2028 a", "one two. three\x1ffour\x0bfive six\u3000seven", "déjà vu, " * 60, "a b c | d # e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    tokens = transcripts.from_lines(docs, "doc_id", "text")
    for found, want in ((captions.captions(docs), lines.captioned(tokens, keep=["doc_id"])), (captions.classic_captions(docs), classic.captioned(tokens, keep=["doc_id"]))):
        assert "transform" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
        rows = sorted(map(tuple, found.collect()))
        assert rows == sorted(map(tuple, captions.caption_rows(want).collect())) and {r[0] for r in rows} >= {2, 3, 4, 5}


def test_exports_go_to_python_once(spark, sf_dir):
    plan = document_exports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_blocks_of_srt_are_split_once(spark):
    text = "1\n00:00:01,000 --> 00:00:02,500\na\nb\n\nx\n00:00:01,000 --> 00:00:02,500\nno number\n\n3\nno time\nc\n\n 4 \r\n 1:02:03,4-->1:02:04,5 more\r\n d \n\n5\n00:00:01,000 --> 00:00:02,500"
    found = srt.entries(spark.createDataFrame([("p", text), ("q", None)], "path string, value string"))
    want = [("p", 0, 1, "00:00:01,000 --> 00:00:02,500", 1.0, 2.5, "a b"), ("p", 3, 4, "1:02:03,4-->1:02:04,5 more", 3723.004, 3724.005, "d")]
    assert sorted(map(tuple, found.collect())) == want
    assert found._jdf.queryExecution().executedPlan().toString().count("split(") <= 4


def test_blanks_are_trimmed_without_a_search(spark):
    blanks = [c for c in map(chr, range(0x3002)) if c.isspace()]
    rows = spark.createDataFrame([(c + "a" + c + "b" + c,) for c in [*blanks, "\u200b", "好", ""]] + [(None,), (" \n",)], "t string")
    out = rows.select("t", tx.strip(F.col("t")).alias("s"))
    assert "regexp" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert all(r.s == (r.t and r.t.strip()) for r in out.collect())


def test_no_tokens_and_runs_of_cjk_only_are_priced():
    assert [len(c) for c in segmenter.found_words(None, {}.get, 1)] == [0] * 7
    asked = []

    def cost(gram):
        asked.append(gram)
        return {"甲乙": 1}.get(gram)

    columns = (["甲", "乙", "Ab", "1,", "丙"], [0.0, 0.1, 0.2, 0.3, 0.4], [0.05, 0.15, 0.25, 0.35, 0.45], [False] * 5, [False, True, False, False, False], [False] * 5)
    number, place, texts, start, end, sentence, _ = segmenter.found_words(columns, cost, 5)
    assert texts == ["甲乙", "Ab1", ",", "丙"] and list(place) == [0, 2, 5, 6] and list(sentence) == [True, False, False, False]
    assert list(start) == [0.0, 0.2, 0.3, 0.4] and list(end) == [0.15, 0.35, 0.35, 0.45] and set(asked) == {"甲", "乙", "甲乙", "丙"}


def test_built_columns():
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(T.ArrayType(LINE))
    rows = [[(1, 0.5, 1.0, "a"), (2, 1.0, 1.5, "b")], None, [], [(1, 0.0, 1.0, "好")]]
    want = [r if r is None else [dict(zip(LINE.fieldNames(), x, strict=True)) for x in r] for r in rows]
    assert structs(rows, kind).to_pylist() == want and structs([], kind).to_pylist() == []
    by_columns = [r if r is None else tuple(map(list, zip(*r, strict=True))) or ([],) * 4 for r in rows]
    assert struct_columns(by_columns, kind).to_pylist() == want


def test_runs_to_the_right_of_a_rejected_block_are_not_searched(monkeypatch):
    rng = random.Random(4)
    a = "".join(rng.choice("abcdefgh") for _ in range(600))
    b = a[:100] + a[104:300] + a[304:500] + "x" + a[503:]
    calls = []
    found = align._Runs.longest
    monkeypatch.setattr(align._Runs, "longest", lambda self, *at: calls.append(at) or found(self, *at))
    whole = align.common_runs(a, b)
    every, calls[:] = len(calls), []
    assert next(iter(guard.changes(a, b)))[0] == whole[0][2] and len(calls) < every
    monkeypatch.setattr(align._Runs, "FEW", 10_000)  # all row by row
    assert align.common_runs(a, b) == whole


def test_a_corrected_line_is_made_once(spark, sf_dir):
    plan = guard_documents(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


@pytest.mark.parametrize("variant", ["service", "cli"])
def test_short_texts_cut_to_a_fifth_are_no_stutter(variant):
    """Where ``guard_cheap_layers`` and its SQL part: what is left of so few letters passes the ratio."""
    got = guard.Guard(variant).verify("he. Ar. A.", "he")
    assert got == (False, "non_phonetic_change_ArA->")
    assert guard.Guard().verify("to. |", "t") == (False, "non_phonetic_change_o->")
