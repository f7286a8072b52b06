"""Files or texts to rows: a Python function over Arrow batches, its rows collected over many inputs."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an output batch, about; an input's rows stay together.
ROWS = 4096


def map_rows(df: DataFrame, columns: list[str], fn: Callable[..., Iterable[tuple]], schema: str, rows: int = ROWS) -> DataFrame:
    """The rows (tuples in the order of schema) that fn makes of the values of columns, input by input."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), target, strict=True)], schema=target)

        for b in batches:
            for values in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held += fn(*values)
                if len(held) >= rows:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return df.select(*columns).mapInArrow(run, schema)
