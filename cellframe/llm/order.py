"""Positions of rows in one global order, from the totals of its partitions.

The rows are dealt out by ranges and sorted, every task runs up its own counts and sums, and what lies before a task is
the running total of the tasks' totals: one row a task, whatever the number of rows. No window runs over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from cellframe.session import cut


def positions(rows: DataFrame, order: Sequence[str], by: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """``rows`` with row_no and before_<s>: how many rows of the same group, and what sum of s, lie before each.

    ``by``, the first columns of ``order``, makes the groups and holds no nulls; ``sums`` are whole numbers of 0 or
    more. Adds group_first (the number of rows before the whole group, which tells groups apart and follows their
    order) and group_rows. Nulls come first. Rows equal in ``order`` follow one another in the order of the input; they
    are dealt over several tasks where they are many.
    """
    numbered = cut(rows.withColumn("_at", F.monotonically_increasing_id()))
    ordered = numbered.repartitionByRange(*order, "_at").sortWithinPartitions(*order, "_at").drop("_at")
    places = [ordered.columns.index(s) for s in sums]
    counted = ["_part", "_row", *[f"_run_{s}" for s in sums]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, totals = TaskContext.get().partitionId(), 0, np.zeros(len(places), np.int64)
        for batch in batches:
            more = [pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(n + np.arange(batch.num_rows))]
            for i, place in enumerate(places):
                values = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
                upto = totals[i] + np.cumsum(values)
                more.append(pa.array(upto - values))
                totals[i] += values.sum()
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, *counted])

    schema = StructType([*ordered.schema.fields, *[StructField(c, IntegerType() if c == "_part" else LongType(), False) for c in counted]])
    local = cut(ordered.mapInArrow(run, schema))
    parts = local.groupBy("_part", *by).agg(
        F.min("_row").alias("_first"), F.count("*").alias("_n"),
        *[F.min(f"_run_{s}").alias(f"_first_{s}") for s in sums], *[F.sum(s).alias(f"_sum_{s}") for s in sums],
    )
    # one row a task
    tasks = parts.groupBy("_part").agg(F.sum("_n").alias("_n"))
    tasks = tasks.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_task_first"))
    group = Window.partitionBy(*by)
    upto = group.orderBy("_part")
    offsets = parts.join(tasks, "_part").select(
        "_part", *by, F.min(F.col("_task_first") + F.col("_first")).over(group).alias("group_first"), F.sum("_n").over(group).alias("group_rows"),
        (F.sum("_n").over(upto) - F.col("_n") - F.col("_first")).alias("_shift"),
        *[(F.sum(f"_sum_{s}").over(upto) - F.col(f"_sum_{s}") - F.col(f"_first_{s}")).alias(f"_shift_{s}") for s in sums],
    )
    return local.join(offsets, ["_part", *by]).select(
        *rows.columns, (F.col("_row") + F.col("_shift")).alias("row_no"),
        *[(F.col(f"_run_{s}") + F.col(f"_shift_{s}")).alias(f"before_{s}") for s in sums], "group_first", "group_rows",
    )
