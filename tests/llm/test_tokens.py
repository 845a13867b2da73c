import hashlib
import io
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kaptura.llm import bpe, common, licenses, sstable, token_counts
from kaptura.llm.common import table

WORDS, BYTES = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = [
    "",
    " ",
    "\n\n  a \t b  ",
    "I'm can't WE'LL it's 'tis",
    "naïve café Σίσυφος ΟΔΟΣ İstanbul",
    "a\x1cb\x1d c\x85d\xa0e f",
    "<|endoftext|> x<|startoftext|>y <|endoftext|",
    "1234 ½ ² 中文字符 😀😀 é ́a",
    "x" * 3000,
    "####$$$$ !!! ?!",
    "foo \n bar\n\n\n baz  \n",
    " lead", "trail ", "a  b   c", "\ta", "a\n b",
]


def texts(n=250):
    rng = random.Random(4)
    alphabet = list("abcdefghij éÉñß'\n\t .,;:!?0123456789ABC Σςσ ́中😀\x1c<|>")
    return ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_merges_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), bpe.Bpe(WORDS, 1000)
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        got = own.encode(text)
        assert list(struct.unpack(f"<{len(got) // 4}I", got)) == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False), text


def test_a_full_cache_changes_nothing():
    small, large = bpe.Bpe(WORDS, 3), bpe.Bpe(WORDS, 10_000)
    for text in texts(60):
        assert small.encode(text) == large.encode(text)


def test_token_digests(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    rows = [r.text for r in table(spark, sf_dir, "documents").collect()] + ODD + [None, "same", "same"]
    for r in bpe.token_digests(frame(spark, rows), WORDS).collect():
        ids = library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_documents_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], "doc_id long, text string, ids0 string")
    got = bpe.encode_documents(docs, WORDS, ["doc_id", "ids0"]).collect()
    assert sorted((r.doc_id or 0, len(r.ids), r.decoded) for r in got) == [(0, 0, ""), (1, 8, "a</w> b</w>"), (1, 8, "a</w> b</w>")]


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    assert bpe.token_digests(none, WORDS).count() == 0
    assert token_counts.token_counts(none, BYTES).count() == 0
    assert sstable.token_id_table(none, WORDS).count() == 0


def test_token_counts(spark, sf_dir):
    library = Tokenizer.from_file(BYTES)
    rows = [r.text for r in table(spark, sf_dir, "documents").collect()] + texts() + [None]
    for head in (50, 1 << 16):
        for r in token_counts.token_counts(frame(spark, rows), BYTES, head=head).collect():
            text = rows[r.doc_id] or ""
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 512), text


def test_token_counts_of_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(7, "one two"), (7, "one two"), (None, "three")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(docs, BYTES, head=1).collect())
    assert got == [(0, 1), (7, 2), (7, 2)]


def test_shards_by_brute_force(spark, sf_dir):
    library = Tokenizer.from_file(WORDS)
    rows = [r.text for r in table(spark, sf_dir, "documents").collect()] + ODD + [None]
    start = 0
    for r in sorted(sstable.token_id_table(frame(spark, rows), WORDS).collect(), key=lambda r: r.doc_id):
        ids = library.encode(rows[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert r.doc_id == len(rows) - 1


def test_lookup_finds_every_key_and_no_other():
    sink = io.BytesIO()
    writer = sstable.Writer(sink, 2, block_bytes=64)
    keys = [None, -5, -5, 0, *range(10, 900, 3)]
    for k in keys:
        writer.add(sstable.key_of(k), struct.pack("<H", (k or 0) & 0xFFFF))
    writer.close()
    data = sink.getvalue()
    reader = sstable.Reader(io.BytesIO(data), len(data))
    assert (reader.n_docs, reader.n_ids) == (len(keys), len(keys))
    assert [sstable.doc_of(k) for k, _ in reader] == keys
    for k in range(-10, 1000):
        assert len(reader.lookup(sstable.key_of(k))) == keys.count(k)
    with pytest.raises(ValueError):
        sstable.Reader(io.BytesIO(bytes(100)), 100)


def test_shards_of_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(3, "b"), (None, "a"), (3, "a"), (-1, None)], "doc_id long, text string")
    got = sstable.token_id_table(docs, WORDS).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in got] == [(None, 0, 2), (-1, 2, 1), (3, 3, 2), (3, 5, 2)]


def test_rows_of_one_id_fill_several_shards(spark):
    rows = spark.range(20_000, numPartitions=6).selectExpr("case when id % 10 = 0 then id when id % 3 = 0 then null else 7 end as doc_id", "case when id % 4 = 0 then concat('text ', id) else 'the same text' end as text")
    shards = sstable.write_shards(rows, WORDS, 1, f"{common.scratch_path(spark, 'sst')}")
    assert len(shards) == 8 and max(s["n_docs"] for s in shards) < 20_000 / 8 * 2
    got = sstable.read_shards(spark, shards).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in rows.collect())
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_kept_columns_may_have_any_name(spark):
    docs = frame(spark, ["one two", None]).selectExpr("*", "'x' as _text")
    assert sorted((r.doc_id, r._text, len(r.ids) // 4) for r in bpe.encode_documents(docs, WORDS, ["doc_id", "_text"]).collect()) == [(0, "x", 2), (1, "x", 0)]
    found = licenses.license_places(frame(spark, ["the MIT License"]).selectExpr("*", "'x' as _text"), ["doc_id", "_text"])
    assert [(r._text, r.label, r.start_word) for r in found.collect()] == [("x", "mit", 1)]
