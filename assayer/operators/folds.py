"""Ordered folds: state that a decision feeds back into, over rows of a key in order, in bounded memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def ordered_fold(df: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], dict], step: Callable[[dict, dict], dict | list[dict]], schema: str) -> DataFrame:
    """``step(state, row)`` for every row of a key in ``order``; it may change the state and returns rows.

    Keys are hashed to partitions and sorted there, so a task streams its rows and holds one key's state,
    however many rows that key has. A key's rows go through one task, since each decision needs the last.
    """

    out_schema = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, current = start(), None
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != current:
                    state, current = start(), key
                got = step(state, row)
                out += got if isinstance(got, list) else [got]
            yield pa.RecordBatch.from_pylist(out, out_schema)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
