"""Running totals over a whole table in a given order, without one task that holds a whole group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloneflow.session import materialize


def with_totals(df: DataFrame, order: list, weight: str, name: str = "before") -> DataFrame:
    """`df` with the sum of `weight` (a long) over all rows that come before a row in the given order.

    Ranges of the order are sorted and summed by themselves and written; then every range is shifted by the ranges before it, one
    number each. Rows that are equal in the order come in any order, so callers give one without ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            sizes = batch.column(weight).to_numpy(zero_copy_only=False).astype(np.int64)
            sums = total + np.cumsum(sizes)
            total = int(sums[-1]) if len(sums) else total
            columns = [*batch.columns, pa.array(np.full(len(sizes), part), pa.int32()), pa.array(sums - sizes)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_range", name])

    schema = T.StructType([*df.schema.fields, T.StructField("_range", T.IntegerType()), T.StructField(name, T.LongType())])
    made = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema), "ordered")
    sums = {r[0]: r[1] for r in made.groupBy("_range").agg(F.sum(weight)).collect()}
    shift, shifts = 0, []
    for part in sorted(sums):
        shifts.append((part, shift))
        shift += sums[part]
    moved = df.sparkSession.createDataFrame(shifts, "_range int, _shift long")
    return made.join(F.broadcast(moved), "_range").withColumn(name, F.col(name) + F.col("_shift")).select(*df.columns, name)
