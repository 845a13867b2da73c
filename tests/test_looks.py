"""Steps of captions that must not grow with what they print or send."""

from kaptura.operators import acoustic, classic, lines, segmenter, terms
from kaptura.operators.documents import map_documents
from kaptura.operators.lines import Word
from pyspark.sql import types as T


def test_widths_of_accented_words_are_added_up(monkeypatch):
    line = [Word(t, i / 3, (i + 0.8) / 3) for i, t in enumerate("déjà vu, l'été 'à côté/de' -où ça…  naïve".split())]
    want = [(lines.width(lines.printed(line[:k])), lines.width(lines.printed(line[k:]))) for k in range(1, len(line))]
    monkeypatch.setattr(lines, "printed", None)  # would fail if it were called
    assert lines.shown_widths(line) == want


def test_characters_behind_the_last_token_are_not_searched(monkeypatch):
    monkeypatch.setattr(acoustic, "_PLAIN", {"", "."})
    got = acoustic.character_times("ab.c" * 3, [{"text": "a", "start": 1.0, "end": 1.5}])
    want, end = [("a", 1.0, 1.5)], 1.5
    for c in "b.cab.cab.c":
        start, end = end, end if c == "." else end + 0.08
        want.append((c, start if c != "." else end, end))
    assert got == want


def test_a_clause_is_halved_where_its_parts_score_best():
    chars = [(c, i * 0.2, i * 0.2 + 0.2 - 0.15 * (i % 7 == 0)) for i, c in enumerate("我们今天来讲一讲网络但是先看看的这个协议以及它的用法好不好啊大家都说好")]
    text = "".join(c for c, _, _ in chars)
    n = len(chars)

    def score(k):
        gap = chars[k][1] - chars[k - 1][2]
        return -0.35 * abs(k - n / 2) + 10.0 * text[k:].startswith(classic.lex.SPLIT_LEADERS) + 6.0 * text[:k].endswith(classic.lex.SPLIT_TRAILERS) + (20.0 * gap if gap > 0.1 else 0.0)

    ks = range(max(4, int(n * 0.25)), min(n - 3, int(n * 0.75)) + 1)
    assert classic._balance(chars, text) == max(ks, key=lambda k: (score(k), -k))


def test_a_kept_column_goes_to_python_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    out = map_documents(docs, ["text", "text"], "n", T.IntegerType(), lambda a, b: len(a + b))
    assert out.first().n == 6 and "_in" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert map_documents(docs, ["text"], "text", T.StringType(), str.upper).first().text == "A B"


def test_texts_are_not_shuffled_to_replace_terms(spark, monkeypatch):
    table = [(i, f"w{i}x", f"w{i + 1}x" if i % 3 else f"<{i}>") for i in range(500)]
    docs = spark.createDataFrame([(1, "w1x w400x w0x"), (2, None)], "doc_id long, text string")
    schema = "order int, wrong string, right string"
    done = terms.replaced(docs, spark.createDataFrame(table, schema).repartition(7))
    assert "Exchange" not in done._jdf.queryExecution().executedPlan().toString()
    want = [(1, "<3> <402> <0>"), (2, None)]
    assert sorted(map(tuple, done.collect())) == want
    monkeypatch.setattr(terms, "BROADCAST", 0)
    assert [w for b in terms.blocks(spark.createDataFrame(table, schema).repartition(7)) for w, _ in b] == [w for _, w, _ in table]
    assert sorted(map(tuple, terms.replaced(docs, spark.createDataFrame(table, schema)).collect())) == want


def test_widths_of_mixed_words_are_added_up(monkeypatch):
    line = [Word(t, i / 3, (i + 0.8) / 3) for i, t in enumerate("用 TCP 协议 a1的 鿕 x 一b /c龥 2 。好 9 第".split())]
    want = [(lines.width(lines.printed(line[:k])), lines.width(lines.printed(line[k:]))) for k in range(1, len(line))]
    monkeypatch.setattr(lines, "printed", None)  # would fail if it were called
    assert lines.shown_widths(line) == want


def test_documents_are_segmented_without_a_shuffle(spark):
    words = segmenter.dictionary(spark.createDataFrame([("甲乙",)] * 3 + [("丙丁",)], "word string"))
    kind = "doc_id long, tokens array<struct<text:string,start:double,end:double,jump:boolean,sentence_end:boolean,clause_end:boolean>>"
    token = lambda i, c: (c, i * 0.2, i * 0.2 + 0.1, False, i % 3 == 2, False)
    docs = spark.createDataFrame([(1, [token(i, c) for i, c in enumerate("甲乙丙丁x")]), (1, None)], kind)
    found = segmenter.segmented_documents(docs, words)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    want = [(1, []), (1, ["甲乙", "丙丁", "x"])]
    assert sorted((r.doc_id, [w.text for w in r.words]) for r in found.collect()) == want
    assert sorted((r.doc_id, [w.text for w in r.words]) for r in segmenter.segmented_documents(docs, words, common=0).collect()) == want
