import json

from kaptura.operators import correct
from kaptura.operators.taskstore import TaskStore
from kaptura.plans import jobs
from kaptura.sources import recogniser, sinks
from kaptura.sources.srt import read_files


class Sounds:
    def duration(self, path):
        if "bad" in path:
            raise OSError("gone")
        return 700.0

    def samples(self, path, first, last):
        return [0.1] * 1000

    def transcribe(self, samples, language):
        return {"text": "你好，世界。", "language": language, "tokens": [{"text": c, "start": 0.3 * i, "end": 0.3 * i + 0.2} for i, c in enumerate("你好世界")]}

    def health(self):
        return False


def test_media_to_documents(spark):
    files = spark.createDataFrame([(1, "a.mp3"), (2, "bad.mp3")], "doc_id long, path string")
    media = recogniser.probed(files, Sounds())
    assert {r.path: (r.duration, r.duration_error) for r in media.collect()} == {"a.mp3": (700.0, None), "bad.mp3": (None, "OSError: gone")}
    (doc,) = jobs.transcribe(media.filter("duration is not null").select("doc_id", "path", "duration"), Sounds(), Sounds(), "zh").collect()
    assert doc.full_text == "你好，世界。" * 3 and len(doc.tokens) == 12
    assert [(x.id, x.text) for x in doc.lines] == [(1, "你好，世界"), (2, "你好，世界"), (3, "你好，世界")] and doc.lines[1].start_time == 300.0
    assert next(recogniser.status_of({"asr": Sounds(), "x": object()})).available.tolist() == [False, True]


def test_transcript_job(spark, tmp_path):
    data = {"full_text": "我们讲完了。然后继续看协议。", "words": [{"text": c, "start": 0.3 * i, "end": 0.3 * i + 0.2} for i, c in enumerate("我们讲完了然后继续看协议")]}
    files = spark.createDataFrame([("p/a.json", json.dumps(data)), ("p/b.json", "no json")], "path string, value string")
    job = jobs.correct_transcripts(files, correct.ReplayProvider({"我们讲完了": "我们讲完啦"}))
    rows = [r.final for r in job.lines.orderBy("id").collect()]
    assert "".join(rows) == "我们讲完了然后继续看协议" and job.outputs.count() == 1
    assert job.outputs.first().srt.startswith("1\n00:00:00,000 --> ")
    again = jobs.correct_transcripts(files, correct.ReplayProvider(), job.cache)
    assert again.lines.filter("source = 'cache'").count() == 1


def test_srt_job(spark, tmp_path):
    (tmp_path / "a.srt").write_text("5\n00:00:01,000 --> 00:00:02,000\n用 t c p 协议\n\n9\n00:00:03,000 --> 00:00:04,000\n自自己\n")
    files = read_files(spark, str(tmp_path))
    cache = jobs.numbered_documents(files).selectExpr("doc_id", "'用 tcp 协议' text", "'用 TCP 协议' candidate")
    job = jobs.correct_srt(files, correct.ReplayProvider({"自自己": "自己"}), cache)
    assert [r.final for r in job.lines.orderBy("id").collect()] == ["用 TCP 协议", "自己"]
    assert job.outputs.first().srt == "5\n00:00:01,000 --> 00:00:02,000\n用 TCP 协议\n\n9\n00:00:03,000 --> 00:00:04,000\n自己\n\n"
    sinks.write_each(job.outputs, "doc_id", "srt", str(tmp_path / "out"), ".srt")
    assert len(list((tmp_path / "out").iterdir())) == 1


def test_task_store(spark, tmp_path):
    store = TaskStore(spark, str(tmp_path / "tasks"))
    key = store.create([{"path": "/m/a.mp3", "duration": 3}, {"path": "/m/a.mp3"}, {"path": "/m/b.mp3"}])
    other = store.create([{"path": "x"}], "json_correction")
    assert [f["name"] for f in store.get(key)["files"]] == ["a.mp3", "b.mp3"]
    assert [r.task_id for r in store.listed(1).collect()] == [other]
    done = []
    assert store.run(key, lambda t: spark.range(len(t["files"])), lambda df: done.append(df.count())) == "completed"
    assert done == [2] and store.get(key)["progress"] == 100.0
    assert store.cancel(other) and not store.cancel(key) and store.run(other, None, None) == "cancelled"
    assert store.clear() == 2 and store.get(key) is None
