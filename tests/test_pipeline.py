import json

import duckdb
import pytest
from pyspark.sql import functions as F

from kaptura.operators import correct, tasks
from kaptura.plans import queries
from kaptura.sources import media, sinks, srt, transcripts
from kaptura.streaming import live

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, con, name):
    df = queries.queries()[name](spark, sf_dir)
    rows = df.collect()
    assert rows
    if name in queries.oracle_sql():
        want = con.execute(queries.oracle_sql()[name])
        names = sorted(c[0] for c in want.description)
        place = [next(i for i, c in enumerate(want.description) if c[0] == n) for n in names]
        assert sorted(df.columns) == names
        shown = lambda x: repr(round(x, 9)) if isinstance(x, float) else repr(x)
        assert sorted(tuple(shown(r[n]) for n in names) for r in rows) == sorted(tuple(shown(r[i]) for i in place) for r in want.fetchall())


# ------------------------------------------------------------------ sources and sinks


def test_json_shapes(spark, tmp_path):
    shapes = {
        "a": {"language": "zh", "full_text": "甲，乙", "word_timestamps": [{"text": "甲", "start_time": 0.0, "end_time": 0.2}, {"word": "乙", "start": 0.3}, {"text": " "}]},
        "b": {"segments": [{"start": 0, "end": 1, "text": "hi there", "words": [{"word": "hi", "start": 0, "end": 0.4}, {"word": "there", "start": 0.5, "end": 0.4}]}]},
        "c": {"segments": [{"start": 1.0, "text": "only"}, {"text": ""}], "domain_profile": {"domain": "net"}},
        "d": [{"text": "list", "start": 0.0, "end": 2.0}],
    }
    for name, data in shapes.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, ensure_ascii=False))
    (tmp_path / "bad.json").write_text("{")
    files = transcripts.read_files(spark, str(tmp_path)).withColumn("path", F.regexp_extract("path", r"(\w+)\.json", 1))
    got = {r.path: r for r in transcripts.documents(files).collect()}
    assert [(t.text, t.start, t.end) for t in got["a"].tokens] == [("甲", 0.0, 0.2), ("乙", 0.3, 0.38)]
    assert [(t.text, t.start, t.end) for t in got["b"].tokens] == [("hi", 0.0, 0.4), ("there", 0.5, 0.55)] and got["b"].full_text == "hi there"
    assert [(t.text, t.start, t.end) for t in got["c"].tokens] == [("only", 1.0, 2.0)] and got["d"].tokens[0].end == 2.0
    assert got["bad"].tokens is None and got["bad"].error.startswith("JSONDecodeError")
    peek = {r.path: (r.n_segments, r.duration, r.domain) for r in transcripts.peeked(files).collect()}
    assert peek == {"a": (3, 0.0, ""), "b": (1, 1.0, ""), "c": (2, 0.0, "net"), "d": (1, 2.0, "")}
    one = spark.createDataFrame([("x", '{"segments":[],"words":[{"end":3.2}]}')], "path string, value string")
    assert transcripts.peeked(one).first().duration == 3.2


SRT = "1\n00:00:01,000 --> 00:00:02,500\nhello\nworld\n\nx\n00:00:03,000 --> 00:00:04,000\nno number\n\n3\nno time\ntext\n\n4\n00:00:05,000 --> 00:00:06,000 align\nlast"


def test_srt_round_trip(spark, tmp_path):
    (tmp_path / "a.srt").write_text(SRT + "\n\n")
    rows = srt.entries(srt.read_files(spark, str(tmp_path)))
    assert [(r.id, r.start, r.end, r.text) for r in rows.orderBy("pos").collect()] == [(1, 1.0, 2.5, "hello world"), (4, 5.0, 6.0, "last")]
    again = sinks.srt_as_read(rows).first().srt
    assert again == "1\n00:00:01,000 --> 00:00:02,500\nhello world\n\n4\n00:00:05,000 --> 00:00:06,000 align\nlast\n\n"


def test_outputs(spark, tmp_path):
    lines = spark.createDataFrame([(1, 2, 3.0, 4.0, "two"), (1, 1, 0.0, 2.5, "one"), (2, 1, 0.0, 1.0, "")], "doc_id int, id int, start_time double, end_time double, text string")
    text = {r.doc_id: r.srt for r in sinks.srt(lines).collect()}
    assert text[1] == "1\n00:00:00,000 --> 00:00:02,500\none\n\n2\n00:00:03,000 --> 00:00:04,000\ntwo\n"
    assert [r.txt for r in sinks.plain(lines).collect()] == ["one\ntwo"]
    sinks.write_each(sinks.srt(lines).filter("doc_id = 1"), "doc_id", "srt", str(tmp_path / "out"), ".srt")
    assert (tmp_path / "out" / "1.srt").read_text() == text[1] and len(list((tmp_path / "out").iterdir())) == 1
    files = spark.createDataFrame([("a.srt", str(tmp_path / "out" / "1.srt"))], "name string, path string")
    assert sinks.package(files, str(tmp_path / "p.tar.gz")) == 1
    path = str(tmp_path / "t")
    lines.write.parquet(path)
    sinks.replace_table(spark.read.parquet(path).filter("doc_id = 1"), path)
    assert spark.read.parquet(path).count() == 2


def test_scan(spark, tmp_path):
    for name in ("m/a.mp4", "m/b.MP3", "m/srt/a.srt", "m/c.txt", ".git/d.mp4", "m/.x.mp4", "m/e.wav", "m/e.srt"):
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text("x")
    files = media.scan(spark, str(tmp_path))
    found = {r.name: r.has_srt for r in media.media(files).collect()}
    assert found == {"a.mp4": True, "b.MP3": False, "e.wav": True}
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "task.json").write_text(json.dumps({"task_id": "1", "files": [{"path": "p"}]}))
    (tmp_path / "t" / "bad.json").write_text("{")
    assert [(r.task_id, r.status, r.progress) for r in media.task_records(spark, str(tmp_path / "t")).collect()] == [("1", "pending", 0.0)]
    (tmp_path / "g.json").write_text('{"acronyms": {"csmaca": "CSMA/CA"}, "terms": {"a": "b"}}')
    assert media.glossary(spark, str(tmp_path / "g.json")).canon()["CSMACA"] == "CSMA/CA"


# ------------------------------------------------------------------ correction


def test_correction_with_cache_and_resume(spark):
    lines = spark.createDataFrame([(1, i, f"line number {i}") for i in range(1, 61)] + [(2, 1, "泛红 a")], "doc_id long, id int, text string")
    cache = spark.createDataFrame([(1, "line number 3", "Line number 3"), (1, "line number 4", "something else entirely")], correct.CACHE)
    provider = correct.ReplayProvider({f"line number {i}": f"LINE number {i}" for i in range(1, 59)} | {"line number 9": "completely other words"})
    done = correct.correct_lines(lines, provider, cache, store=lambda df: df.cache())
    got = {(r.doc_id, r.id): r for r in done.lines.collect()}
    assert len(got) == 61
    assert (got[1, 3].corrected, got[1, 3].source) == ("Line number 3", "cache")
    assert (got[1, 4].corrected, got[1, 4].accepted) == ("line number 4", False)
    assert (got[1, 30].corrected, got[1, 30].source) == ("LINE number 30", "provider")
    assert got[1, 9].corrected == "line number 9" and got[1, 60].reason == "no_answer"
    cached = {r.text: r.candidate for r in done.cache.collect()}
    assert cached["line number 9"] == "completely other words" and "line number 60" not in cached and len(cached) == 58
    rest = correct.uncached(lines.select("doc_id", "text", "id"), done.cache)
    assert sorted((r.doc_id, r.id) for r in rest.collect()) == [(1, 59), (1, 60), (2, 1)]
    total = {r.doc_id: (r.n_lines, r.cache_hits) for r in correct.correction_summary(done.lines).collect()}
    assert total == {1: (60, 2), 2: (1, 0)}


def test_profiles(spark):
    raw = spark.createDataFrame([(1, '<think>x</think>```json\n{"domain":"net","jargon_list":["TCP"],"confusion_rules":{"a":"b"}}\n```'), (2, 'broken "domain": "med", "jargon_list": ["x", "y"'), (3, "")], "i int, raw string")
    got = {r.i: r.p for r in raw.select("i", correct.parsed_profile(F.col("raw")).alias("p")).collect()}
    assert (got[1].domain, got[1].jargon_list, got[1].confusion_rules) == ("net", ["TCP"], {"a": "b"})
    assert (got[2].domain, got[2].jargon_list, got[3].domain) == ("med", ["x", "y"], None)
    prompts = raw.select(correct.system_prompt(correct.parsed_profile(F.col("raw"))).alias("s")).collect()
    assert "Terms: TCP" in prompts[0].s and "a -> b" in prompts[0].s


def test_second_cache_key(spark):
    lines = spark.createDataFrame([(1, 1, "t c p"), (1, 2, "x")], "doc_id long, id int, text string")
    cache = spark.createDataFrame([(1, "tcp", "TCP")], correct.CACHE)
    got = correct.with_cached(lines, cache, F.regexp_replace("text", " ", "")).orderBy("id").collect()
    assert [r.candidate for r in got] == ["TCP", None]


def test_tasks(spark):
    files = spark.createDataFrame([("a", "completed", 50.0), ("a", "failed", 100.0), ("b", "skipped", 100.0), ("c", "running", 100.0)], "task_id string, status string, progress double")
    assert {r.task_id: r.progress for r in tasks.progress(files).collect()} == {"a": 100.0, "b": 100.0, "c": 99.0}
    assert {r.task_id: r.status for r in tasks.final_status(files).collect()} == {"a": "partial", "b": "completed", "c": "pending"}
    assert {r.task_id: r.status for r in tasks.final_status(files, False).collect()}["b"] == "pending"


# ------------------------------------------------------------------ streams


def test_live_captions_are_those_of_a_batch(spark, tmp_path):
    from kaptura.operators import lines as ln

    words = [("我们", 0.0), ("讲完", 0.3), ("了", 0.6), ("然后", 1.6), ("继续", 1.9), ("看", 2.2), ("协议", 2.5), ("对吧", 3.6), ("好", 4.8), ("那么", 5.0), ("开始", 5.3)]
    rows = [(d, i, t, a, a + 0.25, t == "了", i == len(words) - 1) for d in (1, 2) for i, (t, a) in enumerate(words)]
    schema = "doc_id long, pos int, text string, start double, end double, sentence_end boolean, last boolean"
    for n in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 4 == n], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.live_captions(stream).writeStream.format("memory").queryName("live_lines").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(120)
    toks = [{"text": t, "start": a, "end": b, "jump": False, "sentence_end": s, "clause_end": False} for d, _, t, a, b, s, _ in rows if d == 1]
    want = ln.timed(ln.segment(ln.words_of(toks)))
    for d in (1, 2):
        got = spark.sql(f"select * from live_lines where doc_id = {d} order by id").collect()
        assert [r.text for r in got] == [t for _, _, t in want]


TOKEN_ROWS = "doc_id long, pos int, text string, start double, end double, sentence_end boolean, last boolean"


def long_document(rng, doc, n):
    """Rows of a document of n tokens, some of them cut off, bound, or letters one by one."""
    pool = ["a", "b", "word", "longerword", "Hi.", "的", "了", "然后", "但是", "对吧", "在", "关于", "好", "网络", "x" * 30]
    at, rows = 0.0, []
    for i in range(n):
        at = round(at + rng.choice([0, 0.02, 0.1, 0.2, 0.3, 0.5, 1.0]), 3)
        end = round(at + rng.choice([0.1, 0.3, 0.8]), 3)
        rows.append((doc, i, rng.choice(pool), at, end, rng.random() < 0.1, i == n - 1))
        at = end
    return rows


def batch_lines(rows):
    from kaptura.operators import lines as ln

    tokens = [{"text": t, "start": a, "end": b, "jump": False, "sentence_end": s, "clause_end": False} for _, _, t, a, b, s, _ in rows]
    return [(i, a, b, t) for i, (a, b, t) in enumerate(ln.timed(ln.segment(ln.words_of(tokens))), 1)]


def test_resumed_lines_are_those_of_the_whole():
    import random

    from kaptura.operators import lines as ln
    from kaptura.operators import resume

    in_twos = lambda text: [text[i : i + 2] for i in range(0, len(text), 2)]
    for seed in range(200):
        rows = long_document(random.Random(seed), 1, seed if seed < 199 else 5000)
        tokens = [{"text": t, "start": a, "end": b, "jump": False, "sentence_end": s, "clause_end": False} for _, _, t, a, b, s, _ in rows]
        for tokenizer in (None, in_twos):
            told, got, most = resume.Resumable(), [], 0
            for t in tokens:
                got += told.token(ln.Word(t["text"], t["start"], t["end"], t["sentence_end"]), tokenizer)
                most = max(most, len(told.words) + len(told.held))
            got += told.finish(tokenizer)
            assert got == [(i, a, b, x) for i, (a, b, x) in enumerate(ln.timed(ln.segment(ln.words_of(tokens, tokenizer))), 1)]
            assert most < 150


def test_live_state_stays_flat_over_a_restart(spark, tmp_path):
    """A long document in parts, some tokens early and some twice, the query started anew half-way; the
    state's rows don't grow."""
    import random

    rng = random.Random(3)
    rows = long_document(rng, 1, 1200)
    parts = [rows[i : i + 200] for i in range(0, 1200, 200)]
    parts[1].append(parts[2].pop(50))
    parts[3] += parts[2][10:20]
    sizes, folder = [], str(tmp_path / "in")

    def run():
        stream = spark.readStream.schema(TOKEN_ROWS).option("maxFilesPerTrigger", 1).parquet(folder)
        q = live.live_captions(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(300)
        sizes.extend(p["stateOperators"][0]["numRowsTotal"] for p in map(json.loads, (x.json for x in q.recentProgress)) if p["numInputRows"])

    for n, part in enumerate(parts):
        spark.createDataFrame(part, TOKEN_ROWS).coalesce(1).write.mode("append").parquet(folder)
        if n in (2, 5):
            run()
    got = sorted(tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == batch_lines(rows)
    assert len(sizes) == 6 and max(sizes) < 150


def test_an_idle_document_is_over(spark, tmp_path):
    import random
    import time

    rows = [r[:6] + (False,) for r in long_document(random.Random(5), 7, 60)]
    spark.createDataFrame(rows, TOKEN_ROWS).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(TOKEN_ROWS).parquet(str(tmp_path / "in"))
    q = live.live_captions(stream, idle=1.0).writeStream.format("memory").queryName("idle_lines").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 120
        while time.time() < until and spark.sql("select * from idle_lines").count() < len(batch_lines(rows)):
            time.sleep(1)
    finally:
        q.stop()
    assert sorted(tuple(r)[1:] for r in spark.sql("select * from idle_lines").collect()) == batch_lines(rows)


def test_progress_table(spark, tmp_path):
    schema = "file_id string, seq long, progress double, status string"
    for part in ([("f", 1, 10.0, "run"), ("g", 2, 5.0, "run")], [("f", 3, 60.0, "run"), ("f", 4, 50.0, "fix")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.publish(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    last = sorted(p.name for p in (tmp_path / "out").glob("v*"))[-1]
    got = {r.file_id: (r.seq, r.progress, r.status) for r in spark.read.parquet(str(tmp_path / "out" / last)).collect()}
    assert got == {"f": (4, 60.0, "fix"), "g": (2, 5.0, "run")}


def test_subscribers_see_the_snapshot_and_every_change_once(spark, tmp_path):
    from pyspark.sql.types import StructType

    from kaptura.streaming import progress

    schema = "file_id string, seq long, progress double, status string"
    source, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "seen")

    def published(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
        live.publish(spark.readStream.schema(schema).parquet(source), out, str(tmp_path / "cp")).awaitTermination(120)

    def read():
        stream = progress.subscribed(spark, out, StructType.fromDDL(schema))
        stream.writeStream.format("parquet").option("path", seen).option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted((tuple(r)[:3] for r in spark.read.schema(schema).parquet(seen).collect()), key=str)

    published(("f", 1, 10.0, "run"), ("g", 2, 5.0, "run"))
    published(("f", 3, 20.0, "run"), ("f", 4, 30.0, "run"))
    first = read()
    assert first == [("f", 4, 30.0), ("g", 2, 5.0)]
    assert read() == first
    published(("g", 5, 50.0, "run"))
    published(("f", 6, 25.0, "fix"), (None, 7, 1.0, "run"))
    assert sorted(map(str, read())) == sorted(map(str, [*first, ("g", 5, 50.0), ("f", 6, 30.0), (None, 7, 1.0)]))


def test_a_files_snapshots_are_throttled(spark, tmp_path):
    import time

    from kaptura.streaming import progress

    schema, source = "file_id string, seq long, progress double, done boolean", str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)
    put(("f", 1, 1.0, False), ("f", 2, 2.0, False), ("g", 1, 1.0, False))
    q = progress.throttled(spark.readStream.schema(schema).parquet(source), every=6.0).writeStream.format("memory").queryName("throttled").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="500 milliseconds").start()

    def until(condition):
        end = time.time() + 120
        while time.time() < end:
            got = sorted(tuple(r)[:2] for r in spark.sql("select * from throttled").collect())
            if condition(got):
                return got
            time.sleep(0.3)
        raise AssertionError(got)

    try:
        until(lambda got: got == [("f", 2), ("g", 1)])
        put(("f", 3, 3.0, False), ("f", 4, 4.0, False), ("g", 2, 9.0, True))
        got = until(lambda got: ("g", 2) in got)  # the last is sent at once
        until(lambda got: got == [("f", 2), ("f", 4), ("g", 1), ("g", 2)])  # the newest once the time is over
    finally:
        q.stop()


def test_glossary_of_each_batch(spark, tmp_path):
    for n, text in enumerate(("社恐", "社恐")):
        spark.createDataFrame([(n, text)], "id int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen, path = [], tmp_path / "g.json"
    path.write_text('{"terms": {"社恐": "时隙"}}')

    def sink(batch, number):
        seen.extend(r.text for r in batch.collect())
        path.write_text("{}")

    live.normalise_stream(stream, str(path), sink, str(tmp_path / "cp")).awaitTermination(120)
    assert seen == ["时隙", "社恐"]


def test_sessions(spark, sf_dir):
    events = queries.table(spark, sf_dir, "events")
    got = live.session_clauses(events, "user_id", "ts")
    assert got.agg(F.sum("n")).first()[0] == events.count()
