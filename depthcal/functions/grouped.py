"""Groups of rows worked on with numpy, many groups to a batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema


def map_sorted(df: DataFrame, run: Callable[[dict[str, np.ndarray], np.ndarray], dict[str, list]], schema: str, key: str = "group_key") -> DataFrame:
    """The rows that ``run(columns, edges)`` gives for whole groups, as columns by the names of ``schema``.

    Rows are dealt by key and sorted, so that a group is a run of rows, which lie between its edges; a task holds a batch
    and one group at a time.
    """
    names = [x.split()[0] for x in schema.split(", ")]
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def go(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            place = batch.schema.names.index(key)
            keys = batch.column(place).to_numpy(zero_copy_only=False)
            if held[0].column(place)[0].as_py() == keys[-1]:
                continue  # still one group
            last = np.flatnonzero(keys != keys[-1])
            last = int(last[-1]) + 1 if len(last) else 0
            yield from done([*held[:-1], batch.slice(0, last)])
            held = [batch.slice(last)]
        if held:
            yield from done(held)

    def done(parts):
        table = pa.Table.from_batches(parts)
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        edges = np.flatnonzero(np.concatenate([[True], columns[key][1:] != columns[key][:-1], [True]]))
        out = run(columns, edges)
        if len(out[names[0]]):
            yield pa.RecordBatch.from_arrays([pa.array(out[n], arrow.field(n).type) for n in names], schema=arrow)

    return df.repartition(key).sortWithinPartitions(key).mapInArrow(go, schema)


def map_groups(df: DataFrame, run: Callable[[str, dict[str, np.ndarray]], dict[str, list]], schema: str, key: str = "group_key") -> DataFrame:
    """As :func:`map_sorted`, with ``run(key, columns)`` called for one group at a time."""
    names = [x.split()[0] for x in schema.split(", ")]

    def each(columns, edges):
        out: dict[str, list] = {n: [] for n in names}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            for n, values in run(columns[key][a], {c: v[a:b] for c, v in columns.items()}).items():
                out[n].extend(values)
        return out

    return map_sorted(df, each, schema, key)
