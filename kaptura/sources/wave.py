"""WAV files read by ranges: to plan a file's chunks only what lies around its cuts is read, to hear a
chunk only its own bytes. So all that is read grows with the file, and a file's chunks are read by as
many tasks as there are."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kaptura.operators.acoustic import cuts_into_chunks
from kaptura.operators.documents import map_documents
from kaptura.session import filesystem

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
PLANNED = "duration double, chunk int, chunk_start double, chunk_end double, bytes_read long, error string"


class Format(NamedTuple):
    """What a file's header says: kind of number, channels, frames a second, bytes a number, and where
    the frames begin and how many there are."""

    kind: int
    channels: int
    rate: int
    width: int
    at: int
    frames: int


class Wave:
    """An open file; ``bytes_read`` counts what has been read of it."""

    def __init__(self, path: str):
        files, root = filesystem(path)
        self.file, self.bytes_read = files.open_input_file(root), 0
        self.format = self._header()

    def _bytes(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        got = self.file.read(n)
        self.bytes_read += len(got)
        return got

    def _header(self) -> Format:
        size = self.file.size()
        if self._bytes(0, 12)[:4] != b"RIFF":
            raise ValueError("not a WAV file")
        at, kind = 12, None
        while at + 8 <= size:
            name, length = struct.unpack("<4sI", self._bytes(at, 8))
            if name == b"fmt ":
                fields = self._bytes(at + 8, min(length, 26))
                kind, channels, rate, _, frame, bits = struct.unpack("<HHIIHH", fields[:16])
                if kind == EXTENSIBLE and len(fields) >= 26:
                    kind = struct.unpack("<H", fields[24:26])[0]
            elif name == b"data" and kind is not None:
                if kind not in (PCM, FLOAT) or not channels or not rate or bits not in (8, 16, 32):
                    raise ValueError(f"format {kind} of {bits} bits isn't read")
                return Format(kind, channels, rate, bits // 8, at + 8, min(length, size - at - 8) // (channels * (bits // 8)))
            at += 8 + length + length % 2
        raise ValueError("no sound in the file")

    def seconds(self) -> float:
        return self.format.frames / self.format.rate

    def samples(self, first: float, last: float) -> np.ndarray:
        """Mono samples from -1 to 1 between two times; only their bytes are read."""
        f = self.format
        a, b = (min(max(int(t * f.rate), 0), f.frames) for t in (first, last))
        raw = self._bytes(f.at + a * f.channels * f.width, max(0, b - a) * f.channels * f.width)
        if f.kind == FLOAT:
            values = np.frombuffer(raw, "<f4").astype(np.float32)
        elif f.width == 1:
            values = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
        else:
            values = np.frombuffer(raw, f"<i{f.width}").astype(np.float32) / np.float32(1 << (8 * f.width - 1))
        return values.reshape(-1, f.channels).mean(axis=1, dtype=np.float32) if f.channels > 1 else values

    def __enter__(self) -> Wave:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


def planned(files: DataFrame, longest: float = 300.0) -> DataFrame:
    """The columns of ``files`` (path, ...) and a row for each chunk: duration, chunk, chunk_start,
    chunk_end, and bytes_read to plan the file. A file that can't be read has one row with its error."""
    names = [c for c in files.columns if c not in T.StructType.fromDDL(PLANNED).fieldNames()]
    rows = files.select(*names)
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL(PLANNED).fields])
    at, kinds = names.index("path"), (pa.float64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.string())
    columns = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            source: list[int] = []
            for i, path in enumerate(batch.column(at).to_pylist()):
                try:
                    with Wave(path) as wave:
                        total = wave.seconds()
                        bounds = cuts_into_chunks(total, lambda a, b: np.abs(wave.samples(a, b)), wave.format.rate, longest)
                        own = [(total, n, a, b, wave.bytes_read, None) for n, (a, b) in enumerate(bounds)]
                except Exception as e:  # noqa: BLE001  kept with the file
                    own = [(None, None, None, None, None, f"{type(e).__name__}: {e}")]
                found += own
                source += [i] * len(own)
            kept = batch.take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([x[j] for x in found], kind) for j, kind in enumerate(kinds))], names=columns)

    return rows.mapInArrow(run, schema)


def heard(chunks: DataFrame) -> DataFrame:
    """``samples`` of each chunk (path, chunk, chunk_start, chunk_end), a file's chunks by different tasks."""

    def read(path: str, start: float, end: float) -> list[float]:
        with Wave(path) as wave:
            return wave.samples(start, end)

    kind = T.ArrayType(T.FloatType())
    usable = chunks.filter(F.col("chunk").isNotNull())
    return map_documents(usable.repartition("path", "chunk"), ["path", "chunk_start", "chunk_end"], "samples", kind, read)


def write_waves(rows: DataFrame, rate: int, path: str = "path", samples: str = "samples") -> DataFrame:
    """path, n_frames of each row's samples (16-bit numbers) written as a mono WAV file; one that is written
    again is the same. A null array writes an empty file."""

    def write(name: str, wave: list[int] | None) -> int:
        data = np.asarray(wave or [], "<i2").tobytes()
        files, root = filesystem(name)
        files.create_dir(root.rpartition("/")[0], recursive=True)
        with files.open_output_stream(root) as out:
            out.write(struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, PCM, 1, rate, 2 * rate, 2, 16, b"data", len(data)) + data)
        return len(data) // 2

    done = map_documents(rows.select(F.col(path).alias("path"), F.col(samples).alias("samples")), ["path", "samples"], "n_frames", T.LongType(), write, ["path"])
    return done.select("path", "n_frames")
