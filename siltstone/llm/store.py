"""What the operators share: scratch tables, bound values in columns, and texts as bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.scratch import drop_table, shared_dir, write_table

__all__ = ["drop_table", "let", "pieces", "shared_dir", "texts", "write_table"]

#: Rows of a batch that are worked on at a time.
ROWS = 1000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once: what a lambda does not bind is computed again in each of its steps."""
    return F.element_at(F.transform(F.array(value), body), 1)


def texts(batch, name: str = "text") -> list[bytes | None]:
    """A column's UTF-8 bytes, undecoded."""
    import pyarrow as pa

    return batch.column(name).cast(pa.large_binary()).to_pylist()


def pieces(batches: Iterator) -> Iterator:
    """The batches in slices of ROWS rows, so that only so many texts are copied and held as Python values at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)
