"""Queries of the term table: pairs of neighbouring words in the benchmark, each to be written the other
way round, so that replacements make and destroy terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from kaptura.operators import terms
from kaptura.plans.queries import query
from kaptura.session import spread, table

_TERMS = """(select distinct md5(w[i] || ' ' || w[i + 1]) o, w[i] || ' ' || w[i + 1] wrong, w[i + 1] || '-' || w[i] || ' ' || w[i + 1] r from (select w, unnest(range(1, len(w))) i from (select string_split(text, ' ') w from benchmark)) where w[i] <> '' and w[i + 1] <> '')"""


def word_pairs(rows):
    """order, wrong and right of each pair of words that stand side by side in a text."""
    words = F.split("text", " ")
    pairs = rows.select(words.alias("w"), F.explode(F.when(F.size(words) > 1, F.sequence(F.lit(1), F.size(words) - 1))).alias("i"))
    first, second = F.element_at("w", F.col("i")), F.element_at("w", F.col("i") + 1)
    pairs = pairs.select(first.alias("a"), second.alias("b")).filter("a <> '' and b <> ''").distinct()
    wrong = F.concat_ws(" ", "a", "b")
    return pairs.select(F.md5(wrong).alias("order"), wrong.alias("wrong"), F.concat("b", F.lit("-"), "a", F.lit(" "), "b").alias("right"))


@query(f"select doc_id, sha256(list_reduce((select list({{'wrong': wrong, 'r': r}} order by o) from {_TERMS}), lambda t, x: replace(t, x.wrong, x.r), text)) digest, length(list_reduce((select list({{'wrong': wrong, 'r': r}} order by o) from {_TERMS}), lambda t, x: replace(t, x.wrong, x.r), text)) n_chars from documents")
def terms_replaced(spark, sf_dir):
    """Every document with every pair of the benchmark replaced, one behind the other."""
    done = terms.replaced(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), word_pairs(table(spark, sf_dir, "benchmark")))
    return done.select("doc_id", F.sha2("text", 256).alias("digest"), F.char_length("text").alias("n_chars"))
