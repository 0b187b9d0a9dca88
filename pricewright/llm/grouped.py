"""Run a numpy function on each group of a table, many small groups to a batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def by_group(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str) -> DataFrame:
    """fn gets all rows of one combination of keys. Callers bound the rows of a group; here
    one group at a time is held, whatever a task holds. fn returns rows of schema or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> Iterator[pa.RecordBatch]:
            out = fn(pa.Table.from_batches(held))
            if out is not None and out.num_rows:
                yield from out.to_batches()

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in keys]
            at, lo = list(zip(*columns, strict=True)), 0
            for i in range(len(at)):
                if at[i] != last:
                    if i > lo:
                        held.append(batch.slice(lo, i - lo))
                    if held:
                        yield from done()
                    held, lo, last = [], i, at[i]
            if lo < len(at):
                held.append(batch.slice(lo))
        if held:
            yield from done()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
