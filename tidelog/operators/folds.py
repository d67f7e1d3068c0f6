"""Ordered folds: computations in which a row depends on all rows before it in its group, and which no window frame expresses.

Rows are hashed by group and sorted, and Python reads each Spark partition as a stream of Arrow batches, so a group is never held
whole: memory is a batch and the fold's own state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


def _listed(column: pa.Array) -> list:
    """The values of a column; a value by itself costs Arrow a microsecond or more, so columns without nulls and of nulls only are read as wholes."""
    if column.null_count == len(column):
        return [None] * len(column)
    if column.null_count == 0 and (pa.types.is_integer(column.type) or pa.types.is_floating(column.type)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


def _starts(keys: list[pa.Array], n: int) -> list[int]:
    """Rows of a batch at which the group is another one than in the row before, the first row included."""
    changed = np.zeros(max(n - 1, 0), dtype=bool)
    for key in keys:
        after, before = key.slice(1), key.slice(0, max(n - 1, 0))
        if pa.types.is_nested(key.type):
            changed |= np.array([a != b for a, b in zip(after.to_pylist(), before.to_pylist())], dtype=bool)
        else:
            one_null = pc.xor(after.is_null(), before.is_null())
            changed |= pc.coalesce(pc.not_equal(after, before), one_null).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(changed) + 1).tolist()] if n else []


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], inputs: list[str], start: Callable[[], object], step: Callable[[object, tuple], tuple], added: str) -> DataFrame:
    """df with the columns added (a DDL string): for each row in order, step(state, values of inputs) gives the values; state is what
    start() made for the group."""
    schema = df.schema
    names = df.columns
    extra = [f.name for f in StructType.fromDDL(added).fields]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields] + [added])
    key_at, input_at = [names.index(k) for k in keys], [names.index(c) for c in inputs]

    kinds = [to_arrow_type(f.dataType) for f in StructType.fromDDL(added).fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for batch in batches:
            rows = list(zip(*(_listed(batch.column(i)) for i in input_at)))
            out = []
            cuts = [*_starts([batch.column(i) for i in key_at], len(rows)), len(rows)]
            for low, high in zip(cuts, cuts[1:]):
                group = tuple(batch.column(i)[low].as_py() for i in key_at)
                if state is None or group != current:
                    current, state = group, start()
                out.extend([step(state, row) for row in rows[low:high]])
            columns = list(zip(*out)) if out else [()] * len(extra)
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=[*names, *extra])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, ddl)


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Adds name: dense numbers from 0 within keys, by order. Without ranges a group is one task's window. With ranges the values of order[0] (a time or an
    integer) are cut at quantiles: each piece of a group is numbered by itself and starts behind the counts of the pieces before, so a group of any size spreads over
    that many tasks. The counts are a row for each group and range. Equal values of order[0] stay together, so the numbers are the same either way."""
    if not ranges or ranges < 2:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long") - 1)
    kind = df.schema[order[0]].dataType.simpleString()
    value = F.unix_micros(F.col(order[0]).cast("timestamp")) if kind.startswith("timestamp") else F.col(order[0]).cast("long")
    bounds = sorted({int(b) for b in df.select(value.alias("v")).approxQuantile("v", [i / ranges for i in range(1, ranges)], 0.1 / ranges)})

    def place(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value >= bounds[middle], place(middle + 1, high)).otherwise(place(low, middle))

    cut = df.withColumn("_range", place(0, len(bounds)))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_n")).withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order)).cast("long") - 1
    return cut.join(starts, [*keys, "_range"]).withColumn(name, rank + F.col("_start")).drop("_range", "_start")
