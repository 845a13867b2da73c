import difflib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from kaptura.operators import acoustic, align, lines
from kaptura.operators.lines import Word


def joined(blocks):
    out = []
    for x in blocks:
        if out and out[-1][0] + out[-1][2] == x[0] and out[-1][1] + out[-1][2] == x[1]:
            out[-1] = (*out[-1][:2], out[-1][2] + x[2])
        else:
            out.append(tuple(x))
    return out


@given(st.text("abcd", max_size=40), st.text("abcdx", max_size=40))
@settings(max_examples=150, deadline=None)
def test_common_runs_are_those_of_difflib(a, b):
    want = difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()[:-1]
    assert joined(align.common_runs(a, b)) == [tuple(m) for m in want]


def tokens(texts, step=0.3):
    return acoustic.repair([{"text": t, "start": i * step, "end": i * step + 0.2} for i, t in enumerate(texts)])


def test_punctuation():
    got = align.punctuate(tokens("你好世界再见"), "你好，世界！再见")
    assert [t["punctuation"] for t in got] == ["", "，", "", "！", "", ""]
    assert [t["sentence_end"] for t in got] == [False, False, False, True, False, True] and got[1]["clause_end"]
    assert not any(t["sentence_end"] for t in align.punctuate(tokens("ab"), ""))
    skipped = align.punctuate(tokens(["a", "q", "b"]), "a。 b")
    assert [t["punctuation"] for t in skipped] == ["。", "", ""]


def words(*texts, step=0.3, **flags):
    return [Word(t, i * step, i * step + 0.25, *flags.get(f"w{i}", ())) for i, t in enumerate(texts)]


def test_printed_lines():
    assert lines.printed(words("用", "TCP", "IP", "协议", "，")) == "用 TCP IP 协议"
    assert lines.printed(words("a", "/", "b")) == "a/b"
    assert lines.printed(words("0.0.0.0")) == "0.0.0.0" and lines.printed(words("好", "。")) == "好" and lines.printed(words("好", "？")) == "好？"
    assert lines.width("TCP 协议") == 8


def test_predicates():
    assert Word("的", 0, 0).bound and not Word("得去", 0, 0).bound and Word("个", 0, 0).bound
    assert Word("在", 0, 0).open and not Word("现在", 0, 0).open
    assert lines.transition(words("好", "那么")) and not lines.transition(words("好", "人")) and not lines.transition([])


def test_cuts():
    w = words("我们", "讲完", "了", "然后", "继续", w2=(True, False))
    assert lines.first_cuts(w) == [0, 3, 5]
    assert lines.first_cuts([]) == [0] and lines.segment([]) == []
    assert lines.shifted(words("我们", "走", "然后", "回", "家"), [0, 3, 5]) == [0, 2, 5]
    assert lines.shifted(words("我们", "的", "书"), [0, 1, 3]) == [0, 2, 3]
    assert lines.shifted(words("我", "坐", "在", "这"), [0, 3, 4]) == [0, 2, 4]
    assert lines.merged(words("然后", "我们"), [0, 1, 2]) == [0, 2]
    assert lines.merged(words("我们讲完了这一部分内容", "对吧", w0=(True, False)), [0, 1, 2]) == [0, 2]
    assert lines.best_split(words(*["电脑网络"] * 6), 32) == 4


def test_timing():
    one = [[Word("四个汉字", 1.0, 2.0)]]
    assert lines.timed(one) == [(1.0, 2.25, "四个汉字")]
    assert lines.timed([*one, [Word("四个汉字", 2.1, 3.0)]]) == [(1.0, 2.05, "四个汉字"), (2.1, 3.25, "四个汉字")]
    assert lines.timed([[Word("。", 0, 1)]]) == []


def test_tokenizer_and_letters():
    toks = tokens(["c", "S", "m", "网", "络"])
    assert [w.text for w in lines.clause_words(toks, lambda s: ["cSm", "网络"])] == ["cSm", "网络"]
    assert [w.text for w in lines.words_of(tokens(["a", "b", "cd"]))] == ["ab", "cd"]


@given(st.integers(0, 10_000))
@settings(max_examples=120, deadline=None)
def test_properties(seed):
    rng = random.Random(seed)
    vocabulary = ["我们", "的", "然后", "在", "网络", "TCP", "a", "了", "对吧", "好", "那么", "协议", "所以", "第", "四", "个", "啊"]
    at, raw = 0.0, []
    for _ in range(rng.randrange(60)):
        at += rng.choice([0.0, 0.05, 0.2, 0.3, 0.5, 1.0, -0.6 if raw else 0.0])
        raw.append({"text": rng.choice(vocabulary), "start": max(at, 0.0), "end": max(at, 0.0) + rng.choice([0.1, 0.3, 1.5])})
        at = raw[-1]["end"]
    text = "".join(t["text"] + rng.choice(["", "", "，", "。"]) for t in raw)
    w = lines.words_of(align.punctuate(acoustic.repair(raw), text))
    cut = lines.segment(w)
    assert [x for line in cut for x in line] == list(w) and all(cut)
    got = lines.caption(raw, text)
    assert [x["id"] for x in got] == list(range(1, len(got) + 1))
    assert all(x["end_time"] > x["start_time"] for x in got)
