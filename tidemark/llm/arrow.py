"""Passing Arrow batches through Python."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .tokens import pieces


def fresh(taken: list[str], name: str) -> str:
    """name, with underscores added until no column has it (Spark ignores case)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def each_piece(batches, text: str, limit: int = 1 << 20):
    """The batches in pieces of about so many text bytes."""
    for batch in batches:
        yield from pieces(batch, text, limit)


def add_column(docs: DataFrame, name: str, kind: T.DataType, text: str, make: Callable[[pa.RecordBatch], pa.Array], limit: int = 1 << 20) -> DataFrame:
    """docs with one more column, made from each piece of rows; all columns of docs pass unchanged."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, kind)])

    def run(batches):
        for piece in each_piece(batches, text, limit):
            yield pa.RecordBatch.from_arrays([*piece.columns, make(piece)], names=[*piece.schema.names, name])

    return docs.mapInArrow(run, schema)
