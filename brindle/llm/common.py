"""What the training-data operators share: tables in the shared folder, text helpers, Arrow row mapping."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brindle.storage import map_batches, shared_dir, stash

__all__ = ["SPACE_BYTES", "WORD_PATTERN", "map_batches", "map_rows", "pick", "renamed", "shared_dir", "stash"]

#: The separators between words, as a regular-expression class and as bytes (also what ``bytes.split()`` splits on).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"


def renamed(df: DataFrame) -> DataFrame:
    """The same columns as x0, x1, ..., so that their own names, dots and repeats included, cannot clash with others."""
    return df.toDF(*(f"x{i}" for i in range(len(df.columns))))


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns as c0, c1, ...; of columns with equal names the first."""
    return renamed(df).select(*(F.col(f"x{df.columns.index(n)}").alias(f"c{i}") for i, n in enumerate(names)))


def map_rows(df: DataFrame, schema: str | StructType, rows: Callable[[Iterator[tuple]], Iterable[tuple]], chunk: int = 4096) -> DataFrame:
    """``mapInArrow`` over plain tuples: ``rows`` gets an iterator of row tuples and yields output tuples, written in chunks.

    Only ``chunk`` output rows are held at a time; input comes in Spark's Arrow batches.
    """
    out = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read() -> Iterator[tuple]:
            for batch in batches:
                # slices keep the number of Python objects small when rows are long
                for at in range(0, batch.num_rows, 512):
                    part = batch.slice(at, 512)
                    yield from zip(*(c.to_pylist() for c in part.columns))

        held: list[tuple] = []
        for row in rows(read()):
            held.append(row)
            if len(held) >= chunk:
                yield _batch(held, arrow)
                held = []
        if held:
            yield _batch(held, arrow)

    return map_batches(df, run, out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)
