"""Python functions over Arrow columns, a bounded number of values at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Values that are Python objects at the same time; a batch has up to 10,000.
AT_ONCE = 128


def runs(rows: int, size: int = AT_ONCE) -> Iterator[tuple[int, int]]:
    """(begin, number) of runs of rows."""
    return ((at, min(size, rows - at)) for at in range(0, rows, size))


def spread(rows: DataFrame) -> DataFrame:
    """Narrow rows dealt over all cores: a file of few bytes is one task, however long Python takes for each of its rows."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def text_udf(fn: Callable):
    """A column function of one column with a text each; nulls are given to ``fn`` as None."""

    @F.arrow_udf(StringType())
    def run(values: pa.Array) -> pa.Array:
        parts = [pa.array([fn(x) for x in values.slice(at, n).to_pylist()], pa.string()) for at, n in runs(len(values))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return run
