import json

import pytest
from pyspark.sql import functions as F

from kaptura.functions import spoken
from kaptura.functions import text as tx
from kaptura.operators import acoustic, classic, guard


def column(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in rows.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_native_text(spark):
    assert column(spark, tx.visual_length, "TCP 协议", "", None) == [8, 0, None]
    assert column(spark, tx.spaced, "在TCP中12个", "  a   b ") == ["在 TCP 中 12 个", "a b"]
    assert column(spark, tx.strip, "　 a\xa0\n", "") == ["a", ""]
    assert column(spark, tx.without_outer_punctuation, "，好的。", "好吗？", "· 、x，,", "") == ["好的", "好吗？", "x", ""]
    assert column(spark, lambda c: tx.srt_time(c.cast("double")), "59.9996", "-1", "3661.5") == ["00:01:00,000", "00:00:00,000", "01:01:01,500"]
    assert column(spark, tx.srt_seconds, "00:01:02,500", "00:01:02.5", "x") == [62.5, 62.005, None]
    assert column(spark, tx.digits, "八零2点幺") == ["8021"]
    assert column(spark, tx.answer_text, "<think>a\nb</think>```json\n{}```") == ["{}"]
    assert column(spark, lambda c: tx.with_terms(c, [("社恐", "时隙"), ("时隙", "x"), ("", "y")]), "社恐") == ["x"]
    text = "".join(chr(97 + i % 26) for i in range(3000))
    slices = f"【采样片段一 (前段)】\n{text[300:1133]}\n\n【采样片段二 (中段)】\n{text[1350:2183]}\n\n【采样片段三 (后段)】\n{text[2250:]}"
    assert column(spark, tx.three_slices, text[:2500], text) == [text[:2500], slices]
    assert column(spark, tx.has_cjk, "a中", "a", None) == [True, False, False]


@pytest.mark.parametrize(
    ("text", "want"),
    [("一百二十八", "128"), ("一千零二十四", "1024"), ("十", "10"), ("一百二", "102"), ("一万亿", "10000"), ("幺六八", "168"), ("零", "0"), ("", ""), ("百x", "百x")],
)
def test_numerals(text, want):
    assert spoken.number_value(text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("讲t c p协议", "讲 TCP 协议"), ("t c p", "t c p"), ("a b", "A/B"), ("he led us", "he LED us"), ("八零二点幺幺", "802.11"), ("二八二", "282"), ("一百二十八", "一百二十八"), ("一百二十八微秒", "128 微秒"), ("**重点**", "重点"), ("", ""), (None, None)],
)
def test_normaliser(text, want):
    assert spoken.normal_text(text) == want
    if text and text.isascii() and " " not in text:
        assert spoken.normal_text(want) == want


def test_glossary_and_letters(spark):
    g = spoken.Glossary({"csmaca": "CSMA/CA"}, (("社恐", "时隙"),))
    assert spoken.normal_text("c s m a c a社恐", g) == "CSMA/CA 时隙"
    assert spoken.joined_letters("t c p 的*p h*") == "tcp 的 ph"
    assert column(spark, lambda c: spoken.normalised(c, g), "社恐", None) == ["时隙", None]
    assert column(spark, lambda c: F.round(spoken.similar(c, F.lit("zheng")), 3), "zhen", None) == [0.889, None]
    assert spoken.fuzzy_syllables(["zheng", "ping", "lan", "kai"]) == ["zen", "bin", "nan", "gai"]
    assert spoken.fuzzy_syllables(["zhang", "qing", "lan", "ci", "fa"], "cli") == ["zan", "jin", "nan", "zi", "ha"]


# ------------------------------------------------------------------ guard

SERVICE = [
    ("你好", "", False, "empty_output"), ("你好", "你好", True, "identical"), ("你好", "你好。", True, "accepted_formatting_only"), ("。", "，", True, "accepted_punctuation_only"),
    ("自自己", "自己", True, "accepted_stutter_reduction"), ("二百", "三百", False, "digit_mismatch_2->3"), ("今天天气很好我们出去玩", "好", False, "length_ratio_0.09"),
    ("好好好的啊", "好的啊", False, "non_phonetic_change_好好->"), ("泛红", "泛洪", False, "non_phonetic_change_红->洪"), ("用mac", "用MAC", True, "accepted"), ("h零", "H0", True, "accepted"), ("一百千赫", "100kHz", True, "accepted"),
]


@pytest.mark.parametrize(("a", "b", "ok", "why"), SERVICE)
def test_guard(a, b, ok, why):
    got = guard.Guard().verify(a, b)
    assert got == (ok, why) or (a == "一百千赫" and got[1].startswith(("digit", "length")))


SYLLABLES = {"泛": "fan", "红": "hong", "洪": "hong", "针": "zhen", "帧": "zhen", "麦": "mai", "克": "ke", "布": "bu", "配": "pei", "分": "fen"}


def syllables(word):
    return [SYLLABLES.get(c, c) for c in word]


def test_guard_with_phonetics_profile_and_variants():
    g = guard.Guard(syllables=syllables)
    assert g.verify("泛红", "泛洪") == (True, "accepted")
    assert not g.verify("用针", "用水")[0]
    assert guard.Guard("cli").verify("好好好的啊", "好的啊") == (True, "accepted_stutter_reduction")
    profile = guard.Profile(jargon_list=["SIFS"], confusion_rules={"abc": "abd"})
    assert guard.Guard().verify("用SIF吧", "用SIFS吧", profile)[0] is False
    assert guard.Guard("cli").verify("sif", "sifs", profile)[0]
    assert guard.Guard().safely("a", "b", None) == (False, "guard_error") and guard.Guard().safely("a", "b", None, compat=True)[0]
    assert g.initials_alike("布", "配") and not guard.Guard().initials_alike("布", "配")


def test_guard_counts_frequent_letters_in_long_texts():
    text = "nnn" + "ana" * 100
    assert guard.Guard("cli").verify("n" + text, text) == (False, "non_phonetic_change_n->")
    assert list(guard.changes(text + "x" + text, text + "yz" + text)) == [(303, 304, 303, 305)]


def test_guard_columns(spark):
    rows = spark.createDataFrame([(a, b, ok, why) for a, b, ok, why in SERVICE if a != "一百千赫"] + [(None, None, False, "empty_output")], "a string, b string, ok boolean, why string")
    for r in rows.select("*", guard.verified(F.col("a"), F.col("b")).alias("g"), guard.native_reason(F.col("a"), F.col("b")).alias("c")).collect():
        assert (r.g.accepted, r.g.reason) == (r.ok, r.why)
        assert r.c in (None, r.why)


# ------------------------------------------------------------------ acoustic


def tokens(*rows):
    return [{"text": t, "start": a, "end": b} for t, a, b in rows]


def test_repair():
    got = acoustic.repair(tokens(("a", 0.0, 1.0), ("b", 1.1, 3.1)))
    assert got[1]["end"] == 1.6
    got = acoustic.repair(tokens(("a", 0.0, 1.0), ("b", 2.0, 4.0), ("c", 4.1, 4.2)))
    assert (got[1]["start"], got[1]["end"]) == (3.5, 4.0)
    got = acoustic.repair(tokens(("a", 0.0, 0.2), ("b", 5.0, 5.2), ("c", 1.0, 1.2)))
    assert got[2]["jump"] and got[1]["end"] == 0.95 and got[1]["start"] == pytest.approx(0.9)
    got = acoustic.repair(tokens(("a", 1.0, 1.2), ("b", 0.9, 0.95)))
    assert (got[1]["start"], got[1]["end"]) == (1.0, 1.05) and not got[1]["jump"]
    assert acoustic.repair(None) == []


def test_chunks():
    assert acoustic.chunk_bounds(250.0) == [(0.0, 250.0)]
    assert acoustic.chunk_bounds(700.0) == [(0.0, 300.0), (300.0, 600.0), (600.0, 700.0)]
    rate = 100
    wave = [1.0] * (400 * rate)
    wave[301 * rate : 302 * rate] = [0.0] * rate
    (_, cut), _ = acoustic.chunk_bounds(400.0, wave, rate)
    assert 301.0 <= cut <= 302.0


def test_native_and_grouped_clauses_agree(spark):
    from kaptura.operators import lines

    rows = tokens(("a", 0.0, 0.1), ("b", 0.2, 0.3), ("c", 0.8, 0.9), ("d", 0.95, 1.0), ("e", 1.15, 1.2))
    flagged = acoustic.repair(rows)
    flagged[3]["sentence_end"] = True
    want = [[t["text"] for t in c] for c in lines.clauses(flagged)]
    frame = spark.createDataFrame([(1, i, t["text"], t["start"], t["end"], t["sentence_end"], t["jump"]) for i, t in enumerate(flagged)], "doc_id int, pos int, text string, start double, end double, sentence_end boolean, jump boolean")
    got = {}
    for r in acoustic.breath_clauses(frame, "doc_id", ["pos"]).orderBy("pos").collect():
        got.setdefault(r.clause, []).append(r.text)
    assert list(got.values()) == want == [["a", "b"], ["c", "d"], ["e"]]


# ------------------------------------------------------------------ character-based segmenter


def test_classic_lines():
    text = "今天我们讲网络，然后看协议。好的"
    toks = tokens(*((c, 0.2 * i, 0.2 * i + 0.2) for i, c in enumerate(text) if c not in "，。"))
    got = classic.caption(text, toks)
    assert [x["text"] for x in got] == ["今天我们讲网络，然后看协议", "好的"]
    assert all(x["end_time"] > x["start_time"] for x in got)
    assert classic.caption("只有文字", None, offset=2.0) == [{"id": 1, "start_time": 2.0, "end_time": 5.0, "text": "只有文字"}]
    assert classic.caption("", tokens(("你好。", 0.0, 1.0), ("再见", 1.0, 2.0)))[1]["text"] == "再见"
    assert classic.caption(None, None) == []


def test_classic_connectors_and_smoothing():
    moved = classic.connectors_forward([classic.Clause("我们走了然后", 0.0, 3.0), classic.Clause("回家", 3.0, 4.0)])
    assert [(c.text, c.start, c.end) for c in moved] == [("我们走了", 0.0, 2.5), ("然后，回家", 2.5, 4.0)]
    got = classic.smoothed([classic.Clause("a", 0.0, 0.1), classic.Clause("  ", 1, 2), classic.Clause("b", 0.5, 0.6)])
    assert [(c.text, c.start, c.end) for c in got] == [("a", 0.0, 0.8), ("b", 0.8, 1.3)]
    long = "这是一个没有标点的很长的句子它会一直说下去直到超过限制所以必须拆开来看"
    parts = classic.packed(classic.cut_clauses([(c, i * 0.3, i * 0.3 + 0.3) for i, c in enumerate(long)]))
    assert "".join(p.text for p in parts).replace("，", "") == long and all(len(p.text) <= 24 for p in parts)
    assert json.dumps(classic.final_lines([{"text": "二八二", "start_time": 0.0, "end_time": 1.0}]), ensure_ascii=False).count("282") == 1
