"""Row functions over Arrow batches in small slices, so that a worker's memory does not follow the batch size."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE = 256


def map_rows(df: DataFrame, function: Callable[[dict], Iterable[tuple]], schema: str | StructType, per_slice: int = SLICE) -> DataFrame:
    """function takes a row as a dict and gives any number of tuples in the order of the schema."""
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, per_slice):
                rows = [t for row in batch.slice(k, per_slice).to_pylist() for t in function(row)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return df.mapInArrow(run, target)
