"""Queries over CJK text made from the driver's tables, whose own texts hold none.

Lower-case words of documents and turns are written with a character for each letter, four at most, and
without blanks, so that words have to be found again; other words stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kaptura.functions import spoken
from kaptura.operators import lines, segmenter
from kaptura.operators.documents import structs
from kaptura.plans.captions import caption_rows
from kaptura.plans.queries import query
from kaptura.session import spread, table

LETTERS, CHARACTERS = "abcdefghijklmnopqrstuvwxyz", "的一是不了在人有我他这个们中来上大为和国地到以说时要"
#: Words of a clause: behind so many the speaker breathes.
BREATH = 16


def written_word(word: Column) -> Column:
    return F.when(word.rlike("^[a-z]+$"), F.translate(F.substring(word, 1, 4), LETTERS, CHARACTERS)).otherwise(word)


def cjk_words(rows: DataFrame, key: str) -> DataFrame:
    """key, w and word: the words of ``text`` as they are written here."""
    words = F.filter(F.split("text", r"[\s\x1c-\x1f]+"), lambda w: w != "")
    return rows.select(key, F.posexplode(words).alias("w", "word")).select(key, "w", written_word(F.col("word")).alias("word"))


def cjk_tokens(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and ``tokens``, a recogniser's: a character each of CJK words, other words whole; half a second
    a word, a long pause at breaths. Every 7th place ends a sentence, every 5th a clause."""
    words = F.filter(F.split("text", r"[\s\x1c-\x1f]+"), lambda w: w != "")
    pieces = lambda w: F.filter(F.when(w.rlike(segmenter.CJK_WORD), F.split(w, "")).otherwise(F.array(w)), lambda c: c != "")
    written = F.transform(words, lambda x, w: F.struct(w.alias("w"), pieces(written_word(x)).alias("parts")))

    def token(word: Column, text: Column, c: Column) -> Column:
        w, n = word["w"], F.size(word["parts"])
        at = F.floor(w / BREATH) * 100 + (w % BREATH) * 0.5
        pos = w * 8 + c
        end = at + F.when(c + 1 < n, c / 8 + 0.1).otherwise(0.45)
        return F.struct(text.alias("text"), (at + c / 8).alias("start"), end.alias("end"), F.lit(False).alias("jump"), (pos % 7 == 3).alias("sentence_end"), (pos % 5 == 1).alias("clause_end"))

    return rows.select(key, F.flatten(F.transform(written, lambda word: F.transform(word["parts"], lambda text, c: token(word, text, c)))).alias("tokens"))


def _written_sql(table_: str, key: str) -> str:
    """key, w and word of a table, in SQL."""
    words = "list_filter(regexp_split_to_array(text, '[\\s\\x1c-\\x1f]+'), lambda x: x <> '')"
    return f"(select {key}, w, case when regexp_full_match(x, '[a-z]+') then translate(substring(x, 1, 4), '{LETTERS}', '{CHARACTERS}') else x end word from (select {key}, unnest({words}) x, generate_subscripts({words}, 1) - 1 w from {table_}))"


_TOKENS = f"""(select doc_id, w // {BREATH} clause, w * 8 + c pos, p[c + 1] text, (w // {BREATH}) * 100 + (w % {BREATH}) * 0.5::double + c / 8 start,
(w // {BREATH}) * 100 + (w % {BREATH}) * 0.5::double + case when c + 1 < len(p) then c / 8 + 0.1::double else 0.45::double end stop, (w * 8 + c) % 7 = 3 sentence_end, (w * 8 + c) % 5 = 1 clause_end
from (select doc_id, w, p, unnest(range(len(p))) c from (select doc_id, w, case when regexp_full_match(word, '[一-鿿]+') then string_split(word, '') else [word] end p from {_written_sql("documents", "doc_id")})))"""

_CJK_WORDS = f"""with recursive single as (select *, regexp_full_match(text, '[A-Za-z0-9]') s from {_TOKENS}),
runs as (select *, sum(case when s and coalesce(p, false) then 0 else 1 end) over (partition by doc_id, clause order by pos rows unbounded preceding) run from (select *, lag(s) over (partition by doc_id, clause order by pos) p from single)),
joined as (select doc_id, clause, run, string_agg(text, '' order by pos) text, min(start) start, max(stop) stop, arg_max(sentence_end, pos) sentence_end, arg_max(clause_end, pos) clause_end from runs group by all),
placed as materialized (select *, coalesce(sum(length(text)) over (partition by doc_id, clause order by run rows between unbounded preceding and 1 preceding), 0) place, bool_or(regexp_matches(text, '[一-鿿]')) over (partition by doc_id, clause) cjk from joined),
units as (select doc_id, clause, regexp_extract_all(string_agg(text, '' order by run), '(?s)[A-Za-z0-9]+|[^A-Za-z0-9]') u from placed where cjk group by all),
seen as (select word, count(*) n from {_written_sql("conversations", "conv_id")} where regexp_full_match(word, '[一-鿿]{{1,4}}') group by word),
priced as (select word, round(1e6 * ln((select sum(n) from seen) / n))::bigint cost from seen),
grams as (select doc_id, clause, i, n, array_to_string(u[i + 1:i + n], '') gram from (select doc_id, clause, u, i, unnest(range(1, least(4, len(u) - i) + 1)) n from (select *, unnest(range(len(u))) i from units))),
options as materialized (select doc_id, clause, i, list({{'n': n, 'cost': coalesce(cost, round(1e6 * ln((select sum(n) from seen)))::bigint)}}) o from grams left join priced on word = gram where n = 1 or cost is not null group by all),
best as (select doc_id, clause, len(u) i, [0::bigint] costs, 0::bigint n from units
  union all select doc_id, clause, i, [b.cost] || costs[1:3], -b.less from (select o.doc_id, o.clause, o.i, costs, list_min(list_transform(o.o, lambda x: {{'cost': x.cost + costs[x.n], 'less': -x.n}})) b from best join options o on o.doc_id = best.doc_id and o.clause = best.clause and o.i = best.i - 1)),
steps as materialized (select doc_id, clause, i, n from best where n > 0),
walk as (select doc_id, clause, i, n from steps where i = 0 union all select s.doc_id, s.clause, s.i, s.n from walk join steps s on s.doc_id = walk.doc_id and s.clause = walk.clause and s.i = walk.i + walk.n),
words as (select doc_id, clause, coalesce(length(array_to_string(u[1:i], '')), 0) place, array_to_string(u[i + 1:i + n], '') text from walk join units using (doc_id, clause)),
timed as (select w.doc_id, w.clause, w.place, w.text, min(t.start) start, max(t.stop) stop, bool_or(t.sentence_end) sentence_end, bool_or(t.clause_end) clause_end
  from words w join placed t on t.doc_id = w.doc_id and t.clause = w.clause and t.place < w.place + length(w.text) and t.place + length(t.text) > w.place group by all)
select doc_id, clause::bigint clause, place::int place, text, round(start, 6) start, round(stop, 6) stop, sentence_end, clause_end from (select * from timed union all select doc_id, clause, place, text, start, stop, sentence_end, clause_end from placed where not cjk)"""


def clause_words(spark, sf_dir, **then) -> DataFrame:
    """doc_id and words of every document's clauses, by a dictionary counted in all turns of conversations,
    or what is made of them."""
    turns = cjk_words(table(spark, sf_dir, "conversations"), "conv_id")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return segmenter.segmented_documents(cjk_tokens(docs), segmenter.dictionary(turns), **then)


@query(_CJK_WORDS)
def cjk_clause_words(spark, sf_dir):
    found = clause_words(spark, sf_dir).select("doc_id", F.inline("words"))
    return found.select("doc_id", "clause", F.col("at").cast("int").alias("place"), "text", F.round("start", 6).alias("start"), F.round("end", 6).alias("stop"), "sentence_end", "clause_end")


@query()
def cjk_caption_lines(spark, sf_dir):
    """Caption lines of all documents as CJK text, cut between the words found."""
    return caption_rows(clause_words(spark, sf_dir, output="lines", then=lines.word_lines, kind=lines.LINES, build=structs))


# ---------------------------------------------------------------------------- numbers and letters

_DIGIT = "零一二三四五六七八九"
#: Units of the list, one of them in other letters than there.
_UNITS = ("微秒", "字节", "mbps", "分贝", "Hz")


def _spoken(digits: Column, one: str = "一") -> Column:
    return F.translate(digits, "0123456789", _DIGIT.replace("一", one))


def _section(x: Column) -> Column:
    """A number below 10,000 in Chinese; nothing for zero."""
    thousands, hundreds, tens, ones = (F.floor(x / p) % 10 for p in (1000, 100, 10, 1))
    part = lambda d, mark, gap: F.when(d > 0, F.concat(_spoken(d.cast("string")), F.lit(mark))).when(gap, "零").otherwise("")
    return F.concat(part(thousands, "千", F.lit(False)), part(hundreds, "百", (thousands > 0) & (x % 100 > 0)), part(tens, "十", (hundreds > 0) & (ones > 0)), F.when(ones > 0, _spoken(ones.cast("string"))).otherwise(""))


def numeral(n: Column) -> Column:
    """A number from 1 to 99,999,999 as it is spoken."""
    high, low = F.floor(n / 10_000), n % 10_000
    return F.concat(F.when(high > 0, F.concat(_section(high), F.lit("万"))).otherwise(""), F.when((high > 0) & (low > 0) & (low < 1000), "零").otherwise(""), _section(low))


_N = "(n_chars * 9973 + doc_id) % 99999999 + 1"


@query(
    f"""select doc_id, '延迟 ' || n || case when unit in ('mbps', 'Hz') then unit else ' ' || unit end || '，端口 ' || lpad((doc_id % 10000)::varchar, 4, '0') || ' 号，标准 802.' || doc_id % 97 || ' 协议，用 X' || chr(65 + (doc_id % 26)::int) || 'Z 传，HTTP 重点' normal,
  'xaz, 用 b ' || chr(97 + (doc_id % 26)::int) joined
from (select doc_id, {_N} n, {list(_UNITS)}[(doc_id % {len(_UNITS)} + 1)::int] unit from documents)"""
)
def spoken_numbers(spark, sf_dir):
    """A sentence for each document, with numbers made of its fields as they are spoken, normalised."""
    letter = F.char(F.lit(97) + F.col("doc_id") % 26)
    unit = F.element_at(F.array(*map(F.lit, _UNITS)), (F.col("doc_id") % len(_UNITS) + 1).cast("int"))
    port = _spoken(F.lpad((F.col("doc_id") % 10_000).cast("string"), 4, "0"), "幺")
    said = F.concat(F.lit("延迟"), numeral(F.expr(_N)), unit, F.lit("，端口"), port, F.lit("号，标准八零二点"), _spoken((F.col("doc_id") % 97).cast("string")), F.lit("协议，用x "), letter, F.lit(" z传，h t t p*重点*"))
    rows = table(spark, sf_dir, "documents").select("doc_id", said.alias("said"), F.concat(F.lit("x a  z, 用 *b* "), letter).alias("letters"))
    return rows.select("doc_id", spoken.normalised(F.col("said")).alias("normal"), spoken.letters_joined(F.col("letters")).alias("joined"))
