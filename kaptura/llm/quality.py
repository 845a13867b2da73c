"""Quality rules by document and by host, in DataFrame functions only.

Each document is measured without a shuffle: windows of words are hashed in place, and only a
document in which two hashes meet is looked at again, with 128 bits a window. Failures of each
rule are then counted by host (``source``), a beta prior is fitted to the hosts' rates by the
method of moments, and each host's rate is shrunk towards it. That decides how strictly the host's
documents are judged by the rules that don't reject one by themselves (all but the base rules): where
the shrunk rate is not below the prior's mean, documents that fail the rule go; a host that is better
than that has the benefit of the doubt. A host whose shrunk rate of some rule is over ``most`` loses
all its documents.

Null texts have no words and fail; a null host is a host of its own; a null doc_id is carried.
Host counts are summed within tasks before they move, and verdicts are broadcast only if there
are few hosts, by count; beyond that they are joined by host.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaptura.llm.common import stored

WINDOW = 8
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Each rule's name and its condition on the measures.
RULES = {
    "short": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "2 * n_symbols > n_words",
    "lines": "n_dup_lines > 0 and 2 * n_dup_lines > n_lines",
}
BASE_RULES = ("short", "repeats")
HOST_RULES = tuple(name for name in RULES if name not in BASE_RULES)
_WORDS_OF = re.compile(r"\b(n_\w+)")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: lambdas would evaluate it for each element."""
    return F.transform(F.array(value), use)[0]


def split_words(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, "[\\x20\\x09-\\x0D]+"))


def _repeated(words: Column, n: int) -> Column:
    """Words inside windows of ``n`` words that occur at least twice."""
    none = F.lit(0).cast("long")
    windows = F.sequence(F.lit(1), F.size(words) - (n - 1))

    def covered(marks: Column) -> Column:
        # marks: (hash, hash, place) in order; equal windows stand side by side.
        def same(i: Column, j: Column) -> Column:
            a, b = F.get(marks, i), F.get(marks, j)
            return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

        twice = F.filter(marks, lambda m, i: same(i, i - 1) | same(i, i + 1))
        places = F.array_sort(F.transform(twice, lambda m: m["p"]))
        start = F.struct(none.alias("sum"), F.lit(-n).alias("at"))
        return F.aggregate(places, start, lambda s, p: F.struct((s["sum"] + F.least(F.lit(n), p - s["at"])).alias("sum"), p.alias("at")), lambda s: s["sum"])

    def closely(w: Column) -> Column:
        marks = F.transform(windows_of(w), lambda i: F.struct(F.xxhash64(F.slice(w, i, n)).alias("h"), F.xxhash64(F.lit(n), F.slice(w, i, n)).alias("g"), i.alias("p")))
        return _let(F.array_sort(marks), covered)

    def windows_of(w: Column) -> Column:
        return F.sequence(F.lit(1), F.size(w) - (n - 1))

    def some_twice(hashes: Column) -> Column:
        return F.size(F.array_distinct(hashes)) < F.size(hashes)

    any_twice = _let(F.transform(windows, lambda i: F.xxhash64(F.slice(words, i, n))), some_twice)
    return F.when(F.size(words) <= n, none).when(any_twice, closely(words)).otherwise(none)


def measures(host: str = "source") -> Column:
    """A struct of the host and all measures of a row."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))

    def whole(w: Column) -> Column:
        return _let(
            lines,
            lambda x: F.struct(
                F.col(host).alias("host"),
                F.size(w).cast("long").alias("n_words"),
                F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
                symbols.cast("long").alias("n_symbols"),
                (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
                _repeated(w, WINDOW).alias("n_repeat_words"),
                F.size(x).cast("long").alias("n_lines"),
            ),
        )

    return _let(split_words(F.col("text")), whole)


def measure(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and the measures of every row."""
    return docs.select("doc_id", measures(host).alias("m")).select("doc_id", "m.*")


def host_verdicts(measured: DataFrame, most: float = 0.5) -> DataFrame:
    """host, each rule's shrunk rate ``rate_<rule>``, ``host_failed``, and ``strict_<rule>`` of the
    rules that only the host makes count.

    With m and v the mean and variance of the hosts' rates, the prior is beta(m k, (1 - m) k)
    with k = m (1 - m) / v - 1, held between 1 and 1000 (no variance: 1000).
    """
    fails = [F.count_if(F.expr(rule)).alias(f"fails_{name}") for name, rule in RULES.items()]
    hosts = measured.groupBy("host").agg(F.count("*").alias("n"), *fails)
    moments = []
    for name in RULES:
        rate = F.col(f"fails_{name}") / F.col("n")
        moments += [F.avg(rate).alias(f"m_{name}"), F.var_pop(rate).alias(f"v_{name}")]
    prior = hosts.agg(*moments)
    rated = hosts.crossJoin(F.broadcast(prior))  # one row
    rates = []
    for name in RULES:
        m, v = F.col(f"m_{name}"), F.col(f"v_{name}")
        k = F.when(v > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), m * (1 - m) / v - 1))).otherwise(F.lit(1000.0))
        rates.append(((F.col(f"fails_{name}") + m * k) / (F.col("n") + k)).alias(f"rate_{name}"))
    strict = [(F.round(F.col(f"rate_{name}"), 9) >= F.round(F.col(f"m_{name}"), 9)).alias(f"strict_{name}") for name in HOST_RULES]
    rated = rated.select("*", *rates).select("host", "n", *(f"rate_{name}" for name in RULES), *strict)
    return rated.withColumn("host_failed", F.greatest(*[F.col(f"rate_{name}") for name in RULES]) > most)


def _verdict(measured: DataFrame, most: float, few_hosts: int) -> tuple[DataFrame, Column, Column]:
    """``measured`` with its host's verdict beside it, and the columns base_failed and kept."""
    verdict = F.struct("host_failed", *(f"strict_{name}" for name in HOST_RULES)).alias("_verdict")
    verdicts = stored(host_verdicts(measured.select("m.*"), most).select(F.col("host").alias("_verdict_host"), verdict), "hosts")
    small = verdicts.limit(few_hosts + 1).count() <= few_hosts  # a count on the driver, no rows
    joined = measured.join(F.broadcast(verdicts) if small else verdicts, F.col("m.host").eqNullSafe(F.col("_verdict_host")), "left")
    fails = lambda rule: F.expr(_WORDS_OF.sub(r"m.\1", RULES[rule]))
    base, gone = F.lit(False), F.col("_verdict.host_failed")
    for rule in BASE_RULES:
        base = base | fails(rule)
    for rule in HOST_RULES:
        gone = gone | F.col(f"_verdict.strict_{rule}") & fails(rule)
    return joined, base, ~base & ~gone


def judge(docs: DataFrame, host: str = "source", most: float = 0.5, few_hosts: int = 50_000) -> DataFrame:
    """Measures of every row, ``base_failed`` and ``kept``."""
    measured = stored(docs.select("doc_id", measures(host).alias("m")), "quality")
    joined, base, kept = _verdict(measured, most, few_hosts)
    return joined.select("doc_id", "m.host", "m.n_words", "m.word_chars", "m.n_symbols", "m.n_dup_lines", "m.n_repeat_words", base.alias("base_failed"), kept.alias("kept"))


def keep_good(docs: DataFrame, host: str = "source", most: float = 0.5, few_hosts: int = 50_000) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    measured = stored(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), measures(host).alias("m")), "quality")
    joined, _, kept = _verdict(measured, most, few_hosts)
    return joined.filter(kept).select("doc.*")


#: The same in DuckDB SQL, over the view ``documents``.
ORACLE = """
with d as (select doc_id, source host, coalesce(text, '') t from documents),
w as (select doc_id, host, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') ws from d),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') x from (select doc_id, ws, unnest(range(1, len(ws) - 6)) i from w)),
twice as (select doc_id, i from win qualify count(*) over (partition by doc_id, x) > 1),
rep as (select doc_id, sum(least(8, coalesce(nxt - i, 8))) n from (select doc_id, i, lead(i) over (partition by doc_id order by i) nxt from twice) group by doc_id),
m as (select w.doc_id, host, len(ws)::bigint n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::bigint word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))::bigint n_lines,
  len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))))::bigint n_own,
  coalesce(rep.n, 0)::bigint n_repeat_words from w left join rep on rep.doc_id = w.doc_id),
f as (select *, n_lines - n_own n_dup_lines, n_words < 20 short, 100 * n_repeat_words > 30 * n_words repeats, 2 * n_symbols > n_words symbols, n_lines > n_own and 2 * (n_lines - n_own) > n_lines lines from m),
h as (select host, count(*) n, count(*) filter (short) a, count(*) filter (repeats) b, count(*) filter (symbols) c, count(*) filter (lines) e from f group by host),
p as (select avg(a / n) ma, var_pop(a / n) va, avg(b / n) mb, var_pop(b / n) vb, avg(c / n) mc, var_pop(c / n) vc, avg(e / n) me, var_pop(e / n) ve from h),
k as (select ma, mb, mc, me, case when va > 0 then greatest(1, least(1000, ma * (1 - ma) / va - 1)) else 1000 end ka, case when vb > 0 then greatest(1, least(1000, mb * (1 - mb) / vb - 1)) else 1000 end kb,
  case when vc > 0 then greatest(1, least(1000, mc * (1 - mc) / vc - 1)) else 1000 end kc, case when ve > 0 then greatest(1, least(1000, me * (1 - me) / ve - 1)) else 1000 end ke from p),
v as (select host, greatest((a + ma * ka) / (n + ka), (b + mb * kb) / (n + kb), (c + mc * kc) / (n + kc), (e + me * ke) / (n + ke)) > 0.5 host_failed, round((c + mc * kc) / (n + kc), 9) >= round(mc, 9) strict_symbols, round((e + me * ke) / (n + ke), 9) >= round(me, 9) strict_lines from h, k)
select doc_id, f.host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short or repeats base_failed, not (short or repeats) and not host_failed and not (strict_symbols and symbols) and not (strict_lines and lines) kept
from f join v on f.host is not distinct from v.host
"""
