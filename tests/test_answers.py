"""Answers committed as they come: a run that is killed or stopped leaves them to the next one."""

import os

import pytest
from pyspark.sql import functions as F

from kaptura.operators import correct


class Counting:
    """Notes each prompt it is asked in a folder; from its ``dies``-th call in all, the worker is killed."""

    def __init__(self, folder, dies=None, fails=()):
        self.folder, self.dies, self.fails = folder, dies, fails

    def answer(self, system, user):
        import uuid

        open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
        if self.dies and len(os.listdir(self.folder)) >= self.dies:
            os._exit(1)
        if user in self.fails:
            raise RuntimeError(user)
        return f"[1] {user}!"


def prompts(spark, n):
    return spark.createDataFrame([(i, "s", f"u{i}") for i in range(n)], "doc_id long, system string, user string").coalesce(1)


def calls(folder):
    return len(os.listdir(folder))


def test_a_killed_run_asks_for_the_rest_only(spark, tmp_path):
    first, second, third = (str(tmp_path / n) for n in ("first", "second", "third"))
    for folder in (first, second, third):
        os.mkdir(folder)
    log, rows = str(tmp_path / "log"), prompts(spark, 100)
    with pytest.raises(Exception, match="(?i)crash|exit|abort|EOF|lost"):
        correct.answers_logged(rows, Counting(first, dies=47), log, every=10).collect()
    kept = len(set(os.listdir(f"{log}/answers")))
    got = {r.doc_id: r.answer for r in correct.answers_logged(rows, Counting(second), log, every=10).collect()}
    assert got == {i: f"[1] u{i}!" for i in range(100)}
    assert kept == 4 and calls(first) == 47 and calls(second) == 60
    assert len(correct.answers_logged(rows, Counting(third), log).collect()) == 100 and calls(third) == 0


def test_a_stopped_run_keeps_what_it_has(spark, tmp_path):
    folder, log, rows = str(tmp_path / "calls"), str(tmp_path / "log"), prompts(spark, 20)
    os.mkdir(folder)
    correct.stop_asking(log)
    assert {r.answer for r in correct.answers_logged(rows, Counting(folder), log).collect()} == {None} and calls(folder) == 0
    correct.ask_again(log)
    done = correct.answers_logged(rows.unionByName(rows), Counting(folder, fails=("u3",)), log, tries=2)
    assert {r.doc_id for r in done.filter("answer is null").collect()} == {3} and done.count() == 40
    assert calls(folder) == 21  # a prompt of two rows is asked once, the failing one twice
    assert calls(folder) == 21 and correct.answers_logged(rows, Counting(folder), log).filter("answer is null").count() == 0
    assert calls(folder) == 22


def test_lines_are_corrected_by_the_log(spark, tmp_path):
    folder, log = str(tmp_path / "calls"), str(tmp_path / "log")
    os.mkdir(folder)
    lines = spark.createDataFrame([(d, i, f"line {i} of it") for d in (1, 2) for i in range(60)], "doc_id long, id int, text string")

    class Told(Counting):
        def answer(self, system, user):
            super().answer(system, user)
            return user

    want = sorted(tuple(r) for r in correct.correct_lines(lines, correct.IdentityProvider()).lines.collect())
    for n in (6, 6):  # three batches for each document, the second time none
        done = correct.correct_lines(lines, Told(folder), log=log)
        assert sorted(tuple(r) for r in done.lines.collect()) == want and done.cache.count() == 120
        assert calls(folder) <= n


def test_helper_columns_clash_with_none_of_the_lines(spark):
    lines = spark.createDataFrame([(1, 1, "a b"), (1, 2, "c")], "doc_id long, id int, text string").selectExpr("*", "'x' as _d", "'x' as _t", "'x' as _c", "'x' as __key")
    cache = spark.createDataFrame([(1, "ab", "AB"), (1, "c", "C")], correct.CACHE)
    found = correct.with_cached(lines, cache, F.replace("text", F.lit(" ")))
    assert sorted((r.id, r.candidate, r._d) for r in found.collect()) == [(1, "AB", "x"), (2, "C", "x")]
