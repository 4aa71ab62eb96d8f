"""Python over rows with texts, in slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .shipping import ship

SLICE_ROWS, SLICE_BYTES = 1024, 1 << 20


def slices(batch: pa.RecordBatch, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Halves of a batch, and halves of these, down to some rows and bytes or to one row."""
    if batch.num_rows <= 1 or batch.num_rows <= rows and batch.nbytes <= size:
        yield batch
        return
    half = batch.num_rows // 2
    yield from slices(batch.slice(0, half), rows, size)
    yield from slices(batch.slice(half), rows, size)


def map_rows(rows: DataFrame, found: Callable[[Iterable[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """The tuples that ``found`` makes of the tuples of some rows.

    A task holds a batch as Arrow, and one slice of it with what is found in it as Python objects, however long the texts of a batch are together.
    """
    held = to_arrow_schema(StructType.fromDDL(schema))

    def whole(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), held.types)], schema=held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = 0

        def fed() -> Iterator[tuple]:
            nonlocal read
            for batch in batches:
                for some in slices(batch):
                    read += 1
                    yield from zip(*(c.to_pylist() for c in some.columns))

        out, at = [], 0
        for row in found(fed()):
            if read != at and out:  # of a slice before
                yield whole(out)
                out = []
            at = read
            out.append(row)
        if out:
            yield whole(out)

    return rows.mapInArrow(run, schema)


ship(__name__)
