"""Arrow batches in slices of bounded size, so that a task holds few rows as Python objects whatever a batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Bytes of a slice, unless one row has more.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        some = max(1, min(n, SLICE_BYTES * n // max(1, batch.nbytes)))
        for first in range(0, n, some):
            yield batch.slice(first, some)


def map_slices(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: T.StructType) -> DataFrame:
    """df.mapInPandas(run, schema), with slices of its batches in turn."""
    plain = to_arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(part.to_pandas(integer_object_nulls=True) for part in slices(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=plain, preserve_index=False)

    return df.mapInArrow(each, schema)
