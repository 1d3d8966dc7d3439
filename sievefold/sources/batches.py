"""Results of helpers in small Arrow batches: a worker holds what it makes of a few rows, however many come in a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

#: Rows and bytes, about, that leave together; a larger result leaves alone.
ROWS, SIZE = 256, 1 << 20


def in_batches(one: Callable[..., tuple[object, int]], batches: Iterable[tuple[pa.Array, ...]], kind: DataType) -> Iterator[pa.Array]:
    """The results of one, which takes a row's values and gives its result and the result's size, as arrays of a type."""
    arrow = to_arrow_type(kind)
    for columns in batches:
        held, size = [], 0
        for row in zip(*columns, strict=True):
            result, n = one(*(v.as_py() for v in row))
            held.append(result)
            size += n
            if len(held) >= ROWS or size >= SIZE:
                yield pa.array(held, arrow)
                held, size = [], 0
        if held:
            yield pa.array(held, arrow)


def made(one: Callable[..., bytes], batches: Iterable[tuple[pa.Array, ...]], kind: DataType) -> Iterator[pa.Array]:
    """in_batches for results that are one value of bytes or characters each; a row of nulls gives null."""

    def sized(*values) -> tuple[object, int]:
        own = None if values[0] is None else one(*values)
        return own, len(own or b"")

    return in_batches(sized, batches, kind)
