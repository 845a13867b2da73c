"""How an order-dependent operator runs over documents.

A document is one row with its tokens or lines in an array, so such an operator is a map over
rows: no shuffle, and a task holds one batch of documents. Failures of one document are kept in
its row and don't end the job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

TOKEN = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())])
FLAGGED = T.StructType([*TOKEN.fields, T.StructField("jump", T.BooleanType()), T.StructField("punctuation", T.StringType()), T.StructField("sentence_end", T.BooleanType()), T.StructField("clause_end", T.BooleanType())])
LINE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("start_time", T.DoubleType()), T.StructField("end_time", T.DoubleType()), T.StructField("text", T.StringType())])


#: Rows and bytes of columns that are Python objects at a time, however many rows come in a batch.
PART_ROWS, PART_BYTES = 256, 1 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices that are small as Python objects; a single row is as large as it is."""
    for at in range(0, batch.num_rows, PART_ROWS):
        todo = [batch.slice(at, PART_ROWS)]
        while todo:
            part = todo.pop()
            half = part.num_rows // 2
            if half and part.nbytes > PART_BYTES:
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def _flat(column: pa.Array) -> list:
    """The values of a column of strings or numbers."""
    return column.to_pylist() if column.null_count and not pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False).tolist()


def python_rows(column: pa.Array) -> list:
    """What ``to_pylist`` gives; arrays of flat structs are built field by field, which is faster."""
    kind = column.type
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return column.to_pylist()
    inner, fields = column.flatten(), list(kind.value_type)
    if inner.null_count or not all(pa.types.is_string(f.type) or pa.types.is_floating(f.type) or pa.types.is_integer(f.type) or pa.types.is_boolean(f.type) for f in fields):
        return column.to_pylist()
    names = [f.name for f in fields]
    flat = [dict(zip(names, row, strict=True)) for row in zip(*map(_flat, inner.flatten()), strict=True)]
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else flat[at : at + n])
        at += n or 0
    return out


def field_rows(column: pa.Array) -> list:
    """Arrays of structs as a list of values for each field; what is no array of structs as ``python_rows``."""
    kind = column.type
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return python_rows(column)
    fields = [_flat(f) for f in column.flatten().flatten()]
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append(None if n is None else [f[at : at + n] for f in fields])
        at += n or 0
    return out


def structs(rows: list, kind: pa.DataType) -> pa.Array:
    """What ``pa.array`` gives of rows of tuples, built field by field."""
    if not pa.types.is_list(kind) or not pa.types.is_struct(kind.value_type):
        return pa.array(rows, kind)
    ends = np.cumsum([0, *(len(row or ()) for row in rows)])
    fields = list(kind.value_type)
    flat = list(zip(*(x for row in rows if row for x in row), strict=True)) or [()] * len(fields)
    inner = pa.StructArray.from_arrays([pa.array(values, f.type) for values, f in zip(flat, fields, strict=True)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=pa.array([row is None for row in rows], pa.bool_()))


def struct_columns(rows: list, kind: pa.DataType) -> pa.Array:
    """The same of rows that are columns themselves, a list or an array of numbers for each field."""

    def joined(parts: list, own: pa.DataType) -> pa.Array:
        if parts and all(isinstance(p, np.ndarray) for p in parts):
            return pa.array(np.concatenate(parts), own)
        return pa.array([x for p in parts for x in (p.tolist() if isinstance(p, np.ndarray) else p)], own)

    ends = np.cumsum([0, *(0 if row is None else len(row[0]) for row in rows)])
    fields = list(kind.value_type)
    inner = pa.StructArray.from_arrays([joined([row[i] for row in rows if row is not None], f.type) for i, f in enumerate(fields)], fields=fields)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=kind, mask=pa.array([row is None for row in rows], pa.bool_()))


def map_documents(docs: DataFrame, inputs: list[str], output: str, kind: T.DataType, apply: Callable, keep: list[str] | None = None, read: Callable = python_rows, build: Callable = pa.array) -> DataFrame:
    """``keep`` (all columns if None), ``output`` = apply(*inputs) of each row, and ``<output>_error``.

    ``read`` makes a column Python objects, ``build`` the results a column.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in (output, f"{output}_error")]
    beside = [c for c in dict.fromkeys(inputs) if c not in keep]  # a column that is kept goes to Python once
    rows = docs.select(*keep, *[docs[c].alias(f"_in{i}") for i, c in enumerate(beside)])
    n = len(keep)
    at = [keep.index(c) if c in keep else n + beside.index(c) for c in inputs]
    arrow = to_arrow_type(kind)
    schema = T.StructType([*docs.select(*keep).schema.fields, T.StructField(output, kind), T.StructField(f"{output}_error", T.StringType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            values, errors = [], []
            for args in zip(*(read(batch.column(i)) for i in at), strict=True):
                try:
                    values.append(apply(*args))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  kept with the document
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], build(values, arrow), pa.array(errors, pa.string())], names=names)

    return rows.mapInArrow(run, schema)
