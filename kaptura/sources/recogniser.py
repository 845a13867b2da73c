"""Connectors to what is outside the engine: media probes, decoders and speech recognisers.

An implementation is a small object that is sent to the tasks; it must give equal answers to
equal questions, as a task may run again.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kaptura.operators.documents import TOKEN, map_documents


class Probe(Protocol):
    def duration(self, path: str) -> float | None:
        """Seconds of media; None if it can't be told."""


class Decoder(Protocol):
    def samples(self, path: str, first: float, last: float) -> list[float]:
        """16 kHz mono samples between two times; what lies outside isn't to be decoded."""


class Recogniser(Protocol):
    def transcribe(self, samples: list[float], language: str | None) -> dict:
        """text, language and tokens (text, start, end)."""


RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("language", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN))])


def probed(files: DataFrame, probe: Probe) -> DataFrame:
    """``duration`` of each path; a probe that fails leaves null and its error."""
    return map_documents(files, ["path"], "duration", T.DoubleType(), probe.duration)


def chunk_samples(chunks: DataFrame, decoder: Decoder) -> DataFrame:
    """``samples`` of rows (path, chunk, chunk_start, chunk_end), one chunk in a row, a file's chunks by
    different tasks."""
    return map_documents(chunks.repartition("path", "chunk"), ["path", "chunk_start", "chunk_end"], "samples", T.ArrayType(T.FloatType()), decoder.samples)


def recognised(chunks: DataFrame, recogniser: Recogniser, language: str | None = None, at_once: int | None = None) -> DataFrame:
    """``result`` of each chunk's samples; ``at_once`` bounds how many tasks ask at a time."""
    rows = chunks.repartition(at_once) if at_once else chunks  # not coalesced: reading stays as wide as it is
    return map_documents(rows, ["samples"], "result", RESULT, lambda s: recogniser.transcribe(s, language), [c for c in chunks.columns if c != "samples"])


def status_of(checks: dict[str, object]) -> Iterator[pd.DataFrame]:
    """Health of providers by name: each has a ``health`` method or counts as reachable."""
    rows = []
    for name, provider in checks.items():
        try:
            rows.append((name, bool(getattr(provider, "health", lambda: True)()), None))
        except Exception as e:  # noqa: BLE001  the state is what is asked for
            rows.append((name, False, f"{type(e).__name__}: {e}"))
    yield pd.DataFrame(rows, columns=["name", "available", "error"])
