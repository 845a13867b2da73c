import hashlib
import itertools
import os
import random
import re
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from kaptura.llm import decontamination, html_text, licenses, pii, quality, words
from kaptura.llm.common import table
from kaptura.llm.queries import oracle_sql, queries


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def plain_words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = queries()[name](spark, sf_dir).select(*columns).collect()
    assert Counter(map(tuple, got)) == Counter(want.fetchall())


# ------------------------------------------------------------------ quality


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_quality_by_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", " \n\t ", "a b c", " a\x0bb\x0c\rc é😀 ", "x y " * 40, "one\none\n \n \none two"]
    for _ in range(80):
        texts.append("".join(rng.choice(["a", "b", "c", "#", "é"]) + rng.choice([" ", " ", "\n", "\t "]) for _ in range(rng.randrange(60))))
    docs = frame(spark, texts).selectExpr("*", "if(doc_id % 3 = 0, null, 'h') source", "1 n_words", "2 host")
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], plain_quality(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
    assert quality.judge(docs.limit(0)).count() == 0


def test_a_bad_host_loses_its_documents(spark):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(i, "short", "bad") for i in range(95)] + [(100 + i, f"{long} {i}", "bad") for i in range(5)] + [(200 + i, f"{long} {i}", "good") for i in range(50)] + [(300, "short", "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.keep_good(docs).collect()}
    assert kept == set(range(200, 250))
    assert {r.doc_id for r in quality.judge(docs, few_hosts=0).filter("kept").collect()} == kept


# ------------------------------------------------------------------ licences


def test_phrases_by_brute_force(spark, sf_dir):
    texts = [r.text for r in table(spark, sf_dir, "documents").collect()]
    texts += [None, "", "MIT-License, mit license!", "MIT MIT License General Public License", "the apache licenses", "éMIT License", "Lesser General Public License"]
    for r in licenses.scan_licenses(frame(spark, texts)).collect():
        w = plain_words(texts[r.doc_id])
        starts, labels = [], set()
        for phrase, label in licenses.BASE_PHRASES.items():
            p = phrase.split()
            found = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
            starts += found
            labels |= {label} if found else set()
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(labels)) and labels <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_expressions():
    def names(text):
        terms = licenses.evaluate(text)
        return terms and {tuple(sorted(c)) for c in terms.choices}

    assert names("mit") == {("mit",)}
    assert names("mit or apache-2.0 and isc") == {("mit",), ("apache-2.0", "isc")}
    assert names("(mit or apache-2.0) and isc") == {("isc", "mit"), ("apache-2.0", "isc")}
    assert names("gpl-2.0-or-later with classpath-exception-2.0 or mit") == {("gpl-2.0-or-later with classpath-exception-2.0",), ("mit",)}
    for bad in ("", "or mit", "mit or", "(mit", "mit)", "mit apache", "mit with (a or b)", "mit $"):
        assert licenses.evaluate(bad) is None
    deep = " and ".join(f"(a{i} or b{i})" for i in range(40))
    assert len(licenses.evaluate(deep).choices) <= 256
    assert licenses.family("lgpl-3.0-only") == "lgpl" and licenses.family("cc-by-nc-4.0") == "cc-by-nc" and licenses.family("x-1") == "x-1"


def test_tags_and_places(spark):
    texts = ["// SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH X-exception\ncode", "License: no such thing", "The MIT, License."]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, texts)).collect()}
    assert (got[0].labels, got[0].score, got[0].base_labels) == ("apache,gpl,mit", 1.0, "")
    assert (got[1].labels, got[2].labels) == ("", "mit")
    place = licenses.license_places(frame(spark, texts), ["doc_id"]).filter("doc_id = 2").first()
    assert texts[2][place.start : place.stop] == "MIT, License" and place.start_word == 1


# ------------------------------------------------------------------ benchmark


def plain_hits(text, items):
    w = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        b = plain_words(body)
        n = min(13, len(b))
        for i in range(len(b) - n + 1) if n else []:
            for j in range(len(w) - n + 1):
                if w[j : j + n] == b[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(item)
    return len(w), hit, found


def test_contamination_by_brute_force(spark, sf_dir):
    rng = random.Random(5)
    word = lambda: rng.choice(["aa", "bb", "c", "é"])
    items = [(i, " ".join(word() for _ in range(rng.choice([0, 1, 5, 13, 14, 30])))) for i in range(30)] + [(50, None), (51, "...")]
    items = [x for x in items if x[1] not in ("aa", "bb", "c", "é")] + [(60, "unique")]
    texts = [None, "", "Unique!"] + [" , ".join(word().upper() for _ in range(rng.randrange(60))) + " " + (rng.choice(items)[1] or "") for _ in range(40)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, texts)
    for chars in (1 << 20, 200):
        for r in decontamination.judge_documents(docs, benchmark, block_chars=chars).collect():
            n, hit, found = plain_hits(texts[r.doc_id], items)
            digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (n, len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= n), (chars, texts[r.doc_id])
    assert decontamination.judge_documents(docs.limit(0), benchmark).count() == 0
    assert not decontamination.judge_documents(docs, benchmark.limit(0)).filter("n_hit > 0").count()


def test_spans_point_into_the_original(spark):
    text = "Éa! One, TWO three; four five six seven eight nine ten eleven twelve THIRTEEN. End"
    benchmark = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven twelve thirteen")], "item_id long, text string")
    docs = frame(spark, [text]).selectExpr("*", "1 items", "2 n_words")
    (r,) = decontamination.benchmark_hits(docs, benchmark, ["doc_id"]).collect()
    assert [text[a:b] for a, b in r.spans] == ["One, TWO three; four five six seven eight nine ten eleven twelve THIRTEEN"]
    assert decontamination.drop_contaminated(docs, benchmark).count() == 0
    kept = decontamination.drop_contaminated(docs.withColumn("text", docs.text.substr(1, 30)), benchmark)
    assert kept.columns == docs.columns and kept.count() == 1


def test_a_hosts_rate_decides_on_its_odd_documents(spark):
    clean = " ".join(f"word{i}" for i in range(30))
    odd = " ".join(f"a{i}#$%" for i in range(30))
    rows = [(i, odd if i % 10 == 0 else clean, "bad") for i in range(200)] + [(i, odd if i == 500 else clean, "good") for i in range(300, 700)] + [(i, clean, None) for i in range(800, 900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    verdicts = {r.host: r for r in quality.host_verdicts(quality.measure(docs)).collect()}
    assert verdicts["bad"].strict_symbols and not verdicts["good"].strict_symbols and not verdicts["bad"].host_failed
    gone = {r.doc_id for r in quality.judge(docs).filter("not kept").collect()}
    assert gone == {i for i in range(0, 200, 10)}
    assert {r.doc_id for r in quality.keep_good(docs).collect()} == {r[0] for r in rows} - gone


# ------------------------------------------------------------------ pages

PAGE = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{}</style><script>var t="</p><p>x";</script></head><body class="layout">
<header><a href=/>Home</a> Site name</header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<div class="post post-%d"><div class="post-header"><h1>Big  title</h1></div><p>First <b>bold</b>word &lt;tag&gt; &eacute; and some more text to read here.<br>Next<p>Second
paragraph, unclosed, long enough to matter for the score <ul><li>point one<li>point two</ul>
<form>Name <input name=x></form><aside>Related</aside><div class="comments"><p>Nice article, I liked it very much indeed, thank you for it all</div></div>
<div class="sidebar"><p>Links <a href=/b>b</a></div><footer>&copy; Site</footer></body></html>"""
WANT = "Big title First boldword <tag> é and some more text to read here. Next Second paragraph, unclosed, long enough to matter for the score point one point two"


def test_main_text(spark):
    rows = [(i, "https://a.example.com/x", PAGE % i) for i in range(5)] + [(9, None, None), (10, "x", ""), (11, "http://b.example.com", "no tags &amp here"), (12, "http://b.example.com:80/", "<article><p>One</p>"), (12, "http://b.example.com:80/", "<article><p>One</p>"), (13, "http://c", "<html><head><title>T</title><article><p>No end of head</p><span class=ad>buy</span></article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for few in (100, 0):
        got = html_text.extract_text(pages, few).collect()
        assert [r.text for r in got if r.page_id < 9] == [WANT] * 5
        rest = sorted((r.page_id, r.text, r.n_chars) for r in got if r.page_id >= 9)
        assert rest == [(9, "", 0), (10, "", 0), (11, "no tags & here", 14), (12, "One", 3), (12, "One", 3), (13, "No end of head", 14)]
    assert html_text.extract_text(pages.limit(0)).count() == 0


AROUND = '<html><body><header>Site</header><nav><a href="/">Home</a></nav>%s<footer>End of site</footer></body></html>'
STORY = "<p>The story begins here and has a long first part.</p><p>It goes on, and ends.</p>"
TOLD = "The story begins here and has a long first part. It goes on, and ends."
KEPT = {
    '<div class="content has-sidebar"><article>%s</article></div>': TOLD,
    '<div class="layout sidebar-right"><div class="text">%s</div></div>': TOLD,
    '<div class="layout sidebar-right"><article>%s</article><div class="sidebar"><article><p>Read also</p></article></div></div>': TOLD,
    '<form id="aspnetForm"><article>%s</article></form>': TOLD,
    '<form id="aspnetForm"><div class="text">%s</div></form>': TOLD,
    '<article>%s<pre>x = 1 <span class="hljs-comment"># one</span> <span class="comment">two</span></pre></article>': TOLD + " x = 1 # one two",
    '<article>%s<p class="related">Related to this is that.</p></article>': TOLD + " Related to this is that.",
    '<main>%s<div class="cookie-recipe"><p>Take some flour.</p></div></main>': TOLD + " Take some flour.",
    '<article>%s<p>A <span class="notice">noticed</span> word</p></article>': TOLD + " A noticed word",
}
OUT = [
    '<p class="related"><a href="/b">Read this next</a></p>', '<div class="cookie-notice"><p>We use cookies</p></div>', '<p class="ad">Buy this</p>', '<span class="ad">Buy this</span>', '<div class="related"><article><p>Other</p></article></div>',
    '<form><label>Name</label> <input></form>', '<aside><p>Aside</p></aside>', '<div class="social-share"><a href="/x">Share</a></div>', '<div id="comments"><article><p>' + "I have read it and liked it. " * 20 + "</p></article></div>",
]


@pytest.mark.parametrize("page", KEPT)
def test_marks_lose_no_article(spark, page):
    whole = AROUND % page.replace("%s", STORY)
    assert html_text.Page(whole).text(None) == KEPT[page]
    rows = spark.createDataFrame([(i, "http://h/x", whole) for i in range(3)], "page_id long, url string, html string")
    assert [r.text for r in html_text.extract_text(rows).collect()] == [KEPT[page]] * 3


@pytest.mark.parametrize("part", OUT)
@pytest.mark.parametrize("holder", ["article", "main", 'div class="post"'])
def test_marks_of_parts_that_are_out(part, holder):
    assert html_text.Page(AROUND % f"<{holder}>{STORY}{part}</{holder.split()[0]}>").text(None) == TOLD


def test_the_host_decides(spark):
    usual = '<body><div class="story s%d"><p>' + "text of the story goes on and on here " * 4 + '</p></div><div class="other"><p>short</p></div></body>'
    odd = '<body><div class="story s77"><p>brief story</p></div><div class="other"><p>' + "much longer text that is no part of the story " * 5 + "</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h/x", usual % i) for i in range(6)] + [(99, "http://h/y", odd)], "page_id long, url string, html string")
    assert html_text.extract_text(pages).filter("page_id = 99").first().text == "brief story"


def test_articles_of_the_pages_table(spark, sf_dir):
    from html import unescape

    for r, page in zip(html_text.extract_text(table(spark, sf_dir, "pages")).orderBy("page_id").collect(), table(spark, sf_dir, "pages").orderBy("page_id").collect(), strict=True):
        body = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        assert r.text == " ".join(unescape(re.sub(r"<[^>]*>", "\0", body)).replace("\0", " ").split()), r.page_id


# ------------------------------------------------------------------ private data

CASES = ["", "mail joe.x+1@mail8.example.com, or a@b", "a@b@c.de.fr x@-.- @x.y", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 999.9.9.9.9 0001.2.3.4", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 4111111111111111", "call +1 (988) 555-2485 or +12 or +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "+1 (988) 555-2485 4111 1111 1111 1111", "é😀 a.b@c.d.e 10.0.0.1:80"]


def plain_base(text):
    patterns = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))
    out = []
    for k, (kind, pattern) in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m.group())
            ok = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m.group().split("."))) or (kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_patterns_by_brute_force(spark, sf_dir):
    rng = random.Random(8)
    texts = CASES + [r.text for r in table(spark, sf_dir, "documents").collect()]
    texts += ["".join(rng.choice("012345678.+- ()@abz-%\n") for _ in range(80)) for _ in range(300)]
    for t in texts:
        assert pii.base_spans(t) == plain_base(t), t
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_the_field_on_held_out_rows(field):
    table = pii.labelled_table(n=540, seed=77)
    edge = pii.shape_of.__globals__["_AT"]["edge"]
    got = field.decode([[edge, *map(pii.shape_of, w), edge] for w, _ in table])
    right = sum(sum(a == b for a, b in zip(g, y, strict=True)) for g, (_, y) in zip(got, table, strict=True))
    total = sum(len(y) for _, y in table)
    assert field.cuts and right / total > 0.97


def test_cutting_sequences_changes_nothing(field):
    rng = np.random.default_rng(3)
    lines = [" ".join(sum((w for w, _ in pii.labelled_table(n=4, seed=int(rng.integers(1e6)))), [])) for _ in range(60)]
    whole = pii.Field(field.emit, field.step)
    whole.cuts = False
    assert pii.field_spans(lines, field) == pii.field_spans(lines, whole)


def test_added_spans(spark, field):
    texts = ["call (988) 555-2485 now", "write joe42 [at] mail3.example.com today", "in 1999 - 2004 we sold 20 of 3.14", "+1 (988) 555-2485", None, ""]
    got = {r.doc_id: r for r in pii.find_private(frame(spark, texts), field).collect()}
    assert [got[i].spans for i in range(6)] == ["phone:5:19", "email:6:34", "", "phone:0:17", "", ""]
    assert (got[0].n_phone, got[3].n_phone) == (0, 1)
    assert pii.mask_private(frame(spark, texts), field=field).orderBy("doc_id").first().text == "call [PHONE] now"
    for r in got.values():
        assert r.base_sha256 == hashlib.sha256(pii.listed(plain_base(texts[r.doc_id])).encode()).hexdigest()


def test_no_spans_in_a_clean_text(spark, sf_dir, field):
    clean = [re.sub(r"[0-9@]", "", r.text) for r in table(spark, sf_dir, "documents").collect()]
    assert not any(s for _, s in pii.all_spans(clean, field))


def test_words():
    text = "Hi, É2e_x É"
    assert [w.decode() for w in words.fold_words(text)] == plain_words(text) == ["hi", "É2e", "x", "É"]
    assert [text[a:b] for a, b in words.original_spans(text, [(1, 3)])] == ["É2e_x"]


# ------------------------------------------------------------------ the pipeline


def plain_kept(rows):
    """doc_id and text of the rows (doc_id, text, source) that their own and their host's rules keep."""
    fails = {}
    for own, text, _ in rows:
        n, _, symbols, again, repeats = plain_quality(text)
        lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
        fails[own] = (n < 20, 100 * repeats > 30 * n, 2 * symbols > n, again > 0 and 2 * again > lines)
    hosts = defaultdict(list)
    for own, _, host in rows:
        hosts[host].append(fails[own])
    strict, failed = defaultdict(set), set()
    for rule in range(4):
        rates = {h: sum(f[rule] for f in own) / len(own) for h, own in hosts.items()}
        m = sum(rates.values()) / len(rates)
        v = sum((r - m) ** 2 for r in rates.values()) / len(rates)
        k = max(1.0, min(1000.0, m * (1 - m) / v - 1)) if v > 0 else 1000.0
        for h, own in hosts.items():
            shrunk = (sum(f[rule] for f in own) + m * k) / (len(own) + k)
            if shrunk > 0.5:
                failed.add(h)
            if rule > 1 and round(shrunk, 9) >= round(m, 9):
                strict[h].add(rule)
    return {own: text for own, text, host in rows if host not in failed and not any(fails[own][r] for r in (0, 1, *strict[host]))}


def test_pipeline_by_brute_force(spark, sf_dir, field):
    import struct

    import public_tokenizers

    import corpus_pipeline
    from kaptura.llm import bpe
    from tests.llm.test_dedup import plain_groups

    kept = plain_kept([(r.doc_id, r.text, r.source) for r in table(spark, sf_dir, "documents").collect()])
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    ids = sorted(kept)
    groups = plain_groups([kept[i] for i in ids])  # five words, Jaccard similarity 0.8 or more
    kept = {i: kept[i] for n, i in enumerate(ids) if groups[n] == n}
    windows = {w for _, t in items for w in decontamination.item_windows(t)}
    sizes = {len(w) for w in windows}

    def clean(text):
        w = words.fold_words(text)
        hit = {k for n in sizes for j in range(len(w) - n + 1) if tuple(w[j : j + n]) in windows for k in range(j, j + n)}
        return not hit or 20 * len(hit) < len(w)

    kept = {i: t for i, t in kept.items() if clean(t)}
    coder = bpe.Bpe(public_tokenizers.path("word_bpe_49k.json"), 10_000)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(got) == set(kept)
    for (i, t), (_, spans) in zip(kept.items(), pii.all_spans(list(kept.values()), field), strict=True):
        masked = pii.masked(t, spans)
        code = coder.encode(masked)
        assert (got[i].text, got[i].n_chars, got[i].n_tokens) == (masked, len(masked), len(code) // 4)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(code) // 4}I", *memoryview(code).cast("I"))).hexdigest()


def test_the_entry_point_without_this_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{root}/kaptura", tmp_path / "kaptura", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not [q for q in e.queries() if q.startswith('op') or q == 'pipeline']"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_items_without_an_id_as_in_sql(spark):
    benchmark = spark.createDataFrame([(None, "alpha beta"), (None, "gamma"), (7, "delta"), (8, None)], "item_id long, text string")
    docs = frame(spark, ["x alpha beta", "gamma alpha beta delta", "delta", "beta alpha"])
    con = duckdb.connect()
    for name, df in (("documents", docs), ("benchmark", benchmark)):
        con.register(name, df.toArrow())
    want = sorted(con.execute(decontamination.ORACLE).fetchall())
    assert want[0][2] == 2
    for chars in (1 << 20, 5):
        assert sorted(tuple(r) for r in decontamination.judge_documents(docs, benchmark, block_chars=chars).collect()) == want
    assert [r.doc_id for r in decontamination.drop_contaminated(docs, benchmark).collect()] == [3]


# ------------------------------------------------------------------ the random field itself


def test_viterbi_by_enumeration():
    rng = np.random.default_rng(4)
    k = len(pii.LABELS)
    field = pii.Field(rng.normal(size=(3, len(pii._NAMES), k)), rng.normal(size=(k, k)))
    shapes = rng.integers(0, len(pii._NAMES), (6, 6))
    scores = field.scores(shapes)

    def worth(row, labels):
        path = [0, *labels, 0]
        return sum(scores[row, t, y] for t, y in enumerate(labels)) + sum(field.step[a, b] for a, b in itertools.pairwise(path))

    best = [max(itertools.product(range(k), repeat=4), key=lambda y: worth(r, y)) for r in range(6)]
    assert field.decode(shapes.tolist()) == [list(y) for y in best]


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    k, n = len(pii.LABELS), len(pii._NAMES)
    emit, step = rng.normal(size=(3, n, k)), rng.normal(size=(k, k))
    groups = [(rng.integers(0, n, (4, size + 2)), rng.integers(0, k, (4, size))) for size in (1, 2, 5)]
    _, d_emit, d_step = pii.likelihood(groups, emit, step)
    small = 1e-5
    for params, slope in ((emit, d_emit), (step, d_step)):
        for at in rng.integers(0, params.size, 40).tolist():
            place = np.unravel_index(at, params.shape)
            params[place] += small
            more = pii.likelihood(groups, emit, step)[0]
            params[place] -= 2 * small
            less = pii.likelihood(groups, emit, step)[0]
            params[place] += small
            assert abs((more - less) / (2 * small) - slope[place]) < 1e-5


def test_secrets_of_the_documents(spark):
    """Held out: the documents' own secrets, which no line of the labelled table was made from."""
    truth = re.compile(r"AKIA[0-9A-Z]{16}|(?:(?<=password=)|(?<=token = \"))[0-9a-f]{12,}", re.I)
    texts = [r.text for r in table(spark, "/root/testdata/sf0.01", "documents").collect()]
    want = {(i, *m.span()) for i, t in enumerate(texts) for m in truth.finditer(t or "")}
    got = {(i, a, b) for i, (_, spans) in enumerate(pii.all_spans(texts, pii.train(pii.labelled_table()))) for a, kind, b in spans if kind == pii.SECRET}
    assert want and len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.9 * len(got)


# ------------------------------------------------------------------ odd pages


@pytest.mark.parametrize(
    "html",
    ["<a " * 20_000, '<div class="row">' * 16_000 + "x", '<p title="' * 100_000, "<p>" + "<a title='" * 50_000 + '">' * 50_000, "<span>" * 100_000 + "</p>" * 50_000, "<li>" * 100_000, "<!--" * 250_000, "<" * 500_000 + ">"],
    ids=["unclosed", "nested", "quotes", "mixed", "misnested", "siblings", "comments", "angles"],
)
def test_pages_are_read_in_linear_time(html):
    began = time.process_time()
    html_text.Page(html).text(None)
    assert time.process_time() - began < 5


def test_tags_that_do_not_end():
    assert html_text.Page('<article><p>a</p><p title="x>b</p></article>').text(None) == "a b"  # quotes don't count
    assert html_text.Page("<article><p>a</p><p>b < c <i").text(None) == "a b < c <i"
    assert html_text.Page("a < b").text(None) == "a < b"


def test_votes_by_brute_force(spark):
    rng = random.Random(8)
    pages = []
    for i in range(120):
        parts = [f'<div class="{rng.choice(["body1", "body2", "side"])}"><p>{" ".join(["word"] * rng.randrange(1, 30))} {i}</p></div>' for _ in range(3)]
        pages.append((i, f"http://host{rng.randrange(4)}.example/{i}", f"<html><body>{''.join(parts)}</body></html>"))
    votes = Counter()
    for _, url, html in pages:
        page = html_text.Page(html)
        worth = page.scores()
        best = html_text.top(worth)
        votes[url.split("/")[2], page.paths[best]] += round(worth[best] * 2)
    winning = {h: min((-v, p) for (host, p), v in votes.items() if host == h)[1] for h, _ in votes}
    rows = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract_text(rows).collect()}
    assert got == {i: html_text.Page(h).text(winning[u.split("/")[2]]) for i, u, h in pages}
    assert got == {r.page_id: r.text for r in html_text.extract_text(rows, few_hosts=1).collect()}


def test_tags_before_prose_are_no_licence():
    scan = licenses.Scanner.load().scan
    for text in ("License: see", "license: none", "licence: the file or the web", "License: mit or"):
        assert not scan(text)["labels"] and not scan(text)["terms"], text
    found = scan("x\n// SPDX-License-Identifier: (MIT or see) and GPL-2.0-only with Classpath-exception-2.0\n")
    assert found["labels"] == {"mit", "gpl"} and licenses.score(found) == 1.0
