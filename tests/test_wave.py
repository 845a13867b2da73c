"""WAV files by ranges against the whole file at once."""

import struct

import numpy as np
import pytest

from kaptura.operators import acoustic
from kaptura.plans import jobs
from kaptura.sources import wave


def riff(rate, channels, width, data, kind=1, before=b"", extensible=False):
    fields = struct.pack("<HHIIHH", 0xFFFE if extensible else kind, channels, rate, rate * channels * width, channels * width, 8 * width)
    fields += struct.pack("<HHIH", 22, 8 * width, 0, kind) + b"\0" * 14 if extensible else b""
    return b"RIFF" + struct.pack("<I", 0) + b"WAVE" + before + b"fmt " + struct.pack("<I", len(fields)) + fields + b"data" + struct.pack("<I", len(data)) + data


def test_formats(tmp_path):
    rng = np.random.default_rng(1)
    x = rng.integers(-32768, 32768, (1000, 2)).astype("<i2")
    cases = {
        "mono": (riff(100, 1, 2, x[:, 0].tobytes()), x[:, 0] / 32768),
        "stereo": (riff(100, 2, 2, x.tobytes(), before=b"LIST\x03\0\0\0abc\0"), x.mean(1) / 32768),
        "bytes": (riff(100, 1, 1, bytes(range(256))), (np.arange(256) - 128) / 128),
        "float": (riff(100, 1, 4, x[:, 0].astype("<f4").tobytes(), kind=3, extensible=True), x[:, 0]),
        "long": (riff(100, 1, 4, (x[:, 0].astype("<i4") << 16).tobytes()), x[:, 0] / 32768),
        "cut off": (riff(100, 1, 2, x[:, 0].tobytes())[:-101], x[:949, 0] / 32768),
        "none": (riff(100, 1, 2, b""), np.zeros(0)),
    }
    for name, (data, want) in cases.items():
        path = tmp_path / f"{name}.wav"
        path.write_bytes(data)
        with wave.Wave(str(path)) as w:
            assert np.allclose(w.samples(0, 1e6), want, atol=1e-6), name
            read = w.bytes_read
            assert np.allclose(w.samples(1.5, 2.25), want[150:225], atol=1e-6)
            assert w.bytes_read - read == len(want[150:225]) * w.format.width * w.format.channels
    for bad in (b"", b"nothing of the kind", b"RIFF\0\0\0\0WAVE", riff(100, 1, 3, b"abc"), riff(0, 1, 2, b"ab")):
        (tmp_path / "bad.wav").write_bytes(bad)
        with pytest.raises(ValueError):
            wave.Wave(str(tmp_path / "bad.wav"))


def test_plans_read_around_cuts_only(spark, tmp_path):
    rng, rate = np.random.default_rng(2), 200
    lengths = {"a": 1000, "b": 2000, "c": 4000, "short": 30, "none": 0}
    sounds = {n: (rng.standard_normal(s * rate) * 3000).astype("<i2") for n, s in lengths.items()}
    rows = spark.createDataFrame([(str(tmp_path / f"{n}.wav"), s.tolist()) for n, s in sounds.items()] + [(str(tmp_path / "null.wav"), None)], "path string, samples array<short>")
    assert {r.n_frames for r in wave.write_waves(rows, rate).collect()} == {s * rate for s in lengths.values()}
    files = spark.createDataFrame([(i, str(tmp_path / f"{n}.wav"), "clash") for i, n in enumerate([*sounds, "gone"])], "doc_id long, path string, chunk string")
    plan = wave.planned(files).collect()
    read = {}
    for i, (n, s) in enumerate(sounds.items()):
        own = sorted((r.chunk, r.chunk_start, r.chunk_end) for r in plan if r.doc_id == i)
        assert own == [(k, *b) for k, b in enumerate(acoustic.chunk_bounds(len(s) / rate, s / 32768, rate))]
        read[n] = plan[[r.doc_id for r in plan].index(i)].bytes_read
    assert read["c"] < 0.04 * 2 * rate * 4000 and read["c"] < 2.3 * read["b"] < 2.3 * 2.3 * read["a"]
    (gone,) = [r for r in plan if r.doc_id == 5]
    assert gone.chunk is None and "FileNotFound" in gone.error
    for r in wave.heard(wave.planned(files)).collect():
        s = list(sounds.values())[r.doc_id]
        assert np.allclose(r.samples, s[int(r.chunk_start * rate) : int(r.chunk_end * rate)] / 32768)
    assert wave.planned(files.limit(0)).count() == 0


class Loudness:
    def transcribe(self, samples, language):
        return {"text": f"{len(samples)}。", "language": language, "tokens": [{"text": str(len(samples)), "start": 0.0, "end": 1.0}]}


def test_wave_files_are_transcribed_by_chunks(spark, tmp_path):
    rows = spark.createDataFrame([(str(tmp_path / "a.wav"), [0] * (700 * 20))], "path string, samples array<short>")
    wave.write_waves(rows, 20).collect()
    (doc,) = jobs.transcribe(spark.createDataFrame([(1, str(tmp_path / "a.wav"))], "doc_id long, path string"), None, Loudness(), at_once=2).collect()
    bounds = acoustic.chunk_bounds(700.0, [0.0] * 14_000, 20)
    assert doc.full_text == "".join(f"{int(b * 20) - int(a * 20)}。" for a, b in bounds) and len(doc.tokens) == 3
