"""Documents to training data: quality rules, near duplicates, decontamination, private data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Empty
tables give empty tables; columns that the stages don't know are carried whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kaptura.llm import bpe, decontamination, jaccard, pii, quality
from kaptura.llm.common import stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that their own or their host's rules reject go. Null and empty texts have no words
    and go; a null source is a host of its own; repeated rows are judged each on its own."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (Jaccard similarity of five-word shingles 0.8 or
    more) stays: the one of the smallest doc_id, a null first, of equal ones the first written. Texts
    without words are copies of each other."""
    return jaccard.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; null and empty texts hold none and stay. Rows with
    one doc_id are judged each on its own."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars is that of the new text. Null
    texts stay null, with a null n_chars."""
    return pii.mask_private(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their number of tokens, the ids' digest and that of the decoded text, in
    place of columns of these names. Null texts have the tokens of an empty one."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    keep = [c for c in docs.columns if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    rows, at = docs.select(*keep), keep.index("text")
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.Bpe.load(vocabulary)
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column(at).to_pylist()]
            digests = [hashlib.sha256(e).hexdigest() for e in ids]
            decoded = [hashlib.sha256(coder.decode(memoryview(e).cast("I")).encode()).hexdigest() for e in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(e) // 4 for e in ids], pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], names=names)

    return rows.mapInArrow(run, schema)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mask_private", mask_private), ("tokenize", tokenize)]

#: The stages are not all expressible in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
