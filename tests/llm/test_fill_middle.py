"""Fill-in-middle against a plain version, on odd texts, chunk borders and other sentinels."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from kaptura.llm import fill_middle

ODD = [None, "", "\n", "\n\n", "a", "a\nb", "a\nb\n", "<", "<P", "a<P>b", "x<<S>\n", "<\nP>", "é\n中\n😀\n", "no end <M", "<M>", "tail <\n<P\n>\nS>", "\r\n \t\n", "<é>"]


def plain(own, text, rate=100, spm=50, seed="7"):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if own is None else own}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts(n=300):
    rng = random.Random(3)
    made = ["".join(rng.choice("ab<PSM>é中😀\n\n \x00") for _ in range(rng.randrange(80))) for _ in range(n)]
    long = ["".join(rng.choice(["word ", "中文", "😀\n", "<P", "line\n"]) for _ in range(60_000)), "x" * 200_000, "\n" * 150_000]
    return ODD + made + long


@pytest.mark.parametrize("chunk", [1 << 16, 7, 3, 1])
def test_scan_equals_a_plain_one(monkeypatch, chunk):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    scanner = fill_middle.Scanner()
    for text in (t or "" for t in texts(120)[:-3]):
        data, units = text.encode(), re.findall(r"[^\n]*\n|[^\n]+", text)
        counted = scanner.count(data)
        seen = [(len(text[: x.end()].encode()), "<P> <S> <M>".split().index(x.group())) for x in re.finditer("<[PSM]>", text)]
        assert (counted.points, counted.units, counted.seen) == (len(text), len(units), seen)
        for u in range(len(units) + 1):
            head = "".join(units[:u])
            assert scanner.cut(data, counted, u) == (len(head.encode()), len(head)), (text, u)


def test_a_state_depends_on_its_reach_alone():
    import itertools

    for sentinels in (fill_middle.SENTINELS, ("<<a>", "a<", "<a>")):
        scanner = fill_middle.Scanner(sentinels)
        for kinds in itertools.product(range(scanner.kinds), repeat=scanner.reach):
            states = set(range(len(scanner.next)))
            for kind in kinds:
                states = {int(scanner.next[s, kind]) for s in states}
            assert len(states) == 1


def test_other_sentinels():
    scanner = fill_middle.Scanner(("[[1]]", "[1", "é]"))
    assert scanner.count("x[[1]] [1 é] [[[1]]".encode()).seen == [(4, 1), (6, 0), (9, 1), (13, 2), (18, 1), (20, 0)]
    for bad in (("", "a", "b"), ("a\n", "b", "c")):
        with pytest.raises(ValueError):
            fill_middle.Scanner(bad)
    with pytest.raises(ValueError):
        fill_middle.Scanner().restore(b"<P>a<M>b<S>c", "psm")


def test_transform_and_restore(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc\n"), (5, "a\nb"), (5, "a\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("output", "n", "form", "restored")})
    for rate, spm in ((100, 50), (60, 100), (0, 50)):
        cut = fill_middle.restored(fill_middle.transform(docs, rate, spm))
        assert cut.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored"]
        got = sorted(map(str, (tuple(r) for r in cut.collect())))
        assert got == sorted(str((i, *plain(i, t, rate, spm), t or "")) for i, t in rows)
    assert fill_middle.transform(docs.limit(0)).collect() == []
    other = fill_middle.restored(fill_middle.transform(docs, sentinels=("<|pre|>", "<|suf|>", "<|mid|>")), ("<|pre|>", "<|suf|>", "<|mid|>"))
    assert other.filter("form <> 'plain'").count() > 100
    assert other.join(docs.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").filter("restored <> coalesce(text, '')").count() == 0
