"""Every operator on null, empty and long texts, repeated rows, empty tables and clashing columns."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kaptura.llm import bpe, common, decontamination, html_text, licenses, pii, quality, simhash, sstable, suffix_dedup, token_counts

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
CLASHES = "n_words fp row doc ids n_tokens host m kept items runs label path copies sha rep component_id _row n_hit spans decoded".split()


@pytest.fixture(scope="module")
def odd(spark):
    long = "word " * 20_000 + "MIT License " + "x" * 5_000
    rows = [(1, None, "en", "s", None), (2, "", "en", None, 0), (3, long, "en", "s", 1), (3, long, "en", "s", 1), (None, "one two three", None, "t", 2), (4, " \n\t", "de", "t", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit("clash") for c in CLASHES})


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "alpha beta gamma"), (2, None), (3, "")], "item_id long, text string")


OPERATORS = {
    "simhash": lambda d, b: simhash.near_duplicates(d),
    "bpe": lambda d, b: bpe.token_digests(d, WORDS),
    "quality": lambda d, b: quality.judge(d),
    "licenses": lambda d, b: licenses.scan_licenses(d),
    "decontamination": lambda d, b: decontamination.judge_documents(d, b),
    "token ids": lambda d, b: sstable.token_id_table(d, WORDS),
    "token counts": lambda d, b: token_counts.token_counts(d, BYTES),
    "private data": lambda d, b: pii.find_private(d),
    "suffix arrays": lambda d, b: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(odd, items, name):
    for docs, n in ((odd, 6), (odd.limit(0), 0), (odd.filter("text is null"), 1)):
        got = OPERATORS[name](docs, items).collect()
        assert len(got) == n
        if n == 6:
            assert sorted((r.doc_id is None, r.doc_id) for r in got if r.doc_id is not None) == [(False, i) for i in (1, 2, 3, 3, 4)]
            twice = [r for r in got if r.doc_id == 3]
            assert name == "token ids" or twice[0] == twice[1]


def test_empty_pages(spark):
    pages = spark.createDataFrame([(1, "http://a/b", None, "clash"), (1, "http://a/b", None, "clash"), (None, None, "<p>x", "clash")], "page_id long, url string, html string, path string")
    got = sorted((str(r.page_id), r.text) for r in html_text.extract_text(pages).collect())
    assert got == [("1", ""), ("1", ""), ("None", "x")]


def test_stages_keep_the_columns(spark, odd, sf_dir):
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert set(docs.columns) <= set(out.columns), name
            assert name != "near_dedup" or out.count() in (0, 3)
            assert out.count() <= docs.count()


def test_scratch_tables_go(spark):
    frame = common.stored(spark.range(3), "x")
    assert frame.count() == 3
    common.clear_scratch(spark)
    with pytest.raises(Exception):  # noqa: B017, PT011
        frame.count()
