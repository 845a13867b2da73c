import pyarrow as pa
from pyspark.sql import functions as F

from kaptura.operators import acoustic, align
from kaptura.operators.documents import PART_BYTES, PART_ROWS, parts, python_rows

TOKENS = pa.list_(pa.struct([("text", pa.string()), ("start", pa.float64()), ("jump", pa.bool_())]))


def test_rows_as_python_objects():
    column = pa.array([[{"text": "a", "start": 1.5, "jump": True}], None, [], [{"text": None, "start": 1.0, "jump": None}, {"text": "好", "start": None, "jump": False}]], TOKENS)
    for part in (column, column.slice(1), column.slice(3, 1), pa.array([[None]], TOKENS), pa.array(["x", None])):
        assert python_rows(part) == part.to_pylist()


def test_a_batch_is_taken_in_small_parts():
    column = pa.array([[{"text": "word", "start": float(i), "jump": False} for i in range(500)] for _ in range(1000)], TOKENS)
    batch = pa.RecordBatch.from_arrays([column], ["tokens"])
    found = list(parts(batch))
    assert pa.Table.from_batches(found).column(0).to_pylist() == column.to_pylist()
    assert max(p.nbytes for p in found) <= PART_BYTES and max(p.num_rows for p in found) <= PART_ROWS


def test_letters_come_together_within_the_row(spark):
    texts = ["a b c word d e", "x", "", "ab c d\u2028 e f.", "1 2 é 3 4", "t c p i p"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").withColumn("w", F.filter(F.split("text", " "), lambda w: w != ""))
    got = rows.select("doc_id", F.posexplode(acoustic.letters_together(F.col("w"))).alias("pos", "text"))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    tokens = rows.select("doc_id", F.posexplode("w").alias("pos", "text")).withColumns({"start": F.lit(0.0), "end": F.lit(0.0)})
    want = acoustic.letter_runs(tokens, ["doc_id"], "pos").select("doc_id", (F.col("run") - 1).cast("int"), "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_symbols_between_words_need_no_search(monkeypatch):
    words = "the # quick # brown # fox # jumps # over # a # lazy # dog".split(" ")
    a, b = list("".join(words)), list("".join(w for w in words if w != "#"))
    own = align.common_runs(a, b)
    monkeypatch.setattr(align, "_longest", None)  # would fail if it were called
    assert align.common_runs(a, b) == own and sum(n for _, _, n in own) == len(b)
    monkeypatch.undo()
    monkeypatch.setattr(align, "_own_runs", lambda a, b: None)
    assert align.common_runs(a, b) == own
