"""Columns computed from whole texts by Python functions over Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from datascry.llm import common

#: From the Arrow array of texts of a batch to one array for each new column.
Compute = Callable[[pa.Array], Sequence[pa.Array]]


def add_columns(
    df: DataFrame, text: str, compute: Compute, fields: str, keep: Sequence[str] | None = None
) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) and the new ``fields`` (DDL).

    New columns whose names clash with kept ones get leading underscores.
    Rows stay where they are: there is no shuffle.
    """
    common.small_batches(df.sparkSession)
    kept = list(df.columns if keep is None else keep)
    added = T._parse_datatype_string(fields)
    names = common.fresh(df.select(*[_quoted(c) for c in kept]), *[f.name for f in added])
    added = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, added, strict=True)])
    out = T.StructType([df.schema[c] for c in kept] + list(added))
    added_arrow = to_arrow_schema(added)
    sent = df.select(*[_quoted(c) for c in kept], df[_quoted(text)].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            new = compute(batch.column(batch.num_columns - 1))
            new = [pa.array(a).cast(f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for a, f in zip(new, added_arrow, strict=True)]
            arrays = batch.columns[:-1] + new
            yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])

    return sent.mapInArrow(run, out)


def emit_rows(df: DataFrame, text: str, carry: Sequence[str], produce: Callable, fields: str) -> DataFrame:
    """Any number of rows for each text.

    ``produce(texts)`` yields ``(rows, arrays)``: the index of the text that each
    new row is of, and an array for each field.  Columns ``carry`` are repeated
    for each new row and come first.
    """
    common.small_batches(df.sparkSession)
    added = T._parse_datatype_string(fields)
    out = T.StructType([df.schema[c] for c in carry] + list(added))
    added_arrow = to_arrow_schema(added)
    sent = df.select(*[_quoted(c) for c in carry], df[_quoted(text)].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, new in produce(batch.column(batch.num_columns - 1)):
                if not len(rows):
                    continue
                at = pa.array(rows)
                arrays = [c.take(at) for c in batch.columns[:-1]]
                arrays += [pa.array(a).cast(f.type) for a, f in zip(new, added_arrow, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out])

    return sent.mapInArrow(run, out)


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
