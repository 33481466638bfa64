"""Arrow UDFs whose memory follows neither the batch nor the results of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of arguments that are read at once, and whose results are given back at once; a larger row goes by itself.
SLICE_BYTES = 1 << 18


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about SLICE_BYTES."""
    n, start = len(columns[0]), 0
    size = -(-sum(c.nbytes for c in columns) // max(n, 1)) or 1  # of a row, as a rule
    step = max(1, SLICE_BYTES // size)
    while start < n:
        end = min(n, start + step)
        while end - start > 1 and sum(c[start:end].nbytes for c in columns) > 2 * SLICE_BYTES:
            end = start + (end - start) // 2
        yield start, end
        start = end


def by_slices(kind: T.DataType) -> Callable:
    """A UDF from a function of one row's values.  An Arrow batch can have 10,000 rows of any length, and results are many
    times larger than texts; they are made and given back by slices, so a worker's memory does not follow the batch."""
    made = to_arrow_type(kind)

    def add(f: Callable) -> Callable:
        def each(columns: tuple[pa.Array, ...]) -> Iterator[pa.Array]:
            for i, j in slices(columns):
                yield pa.array([f(*row) for row in zip(*(c[i:j].to_pylist() for c in columns), strict=True)], made)

        def one(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for b in batches:
                yield from each((b,))

        def more(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            for b in batches:
                yield from each(b)

        run = one if f.__code__.co_argcount == 1 else more
        run.__name__ = run.__qualname__ = f.__name__
        run.__doc__ = f.__doc__
        return F.arrow_udf(run, kind)

    return add
