"""Exact positions and running sums over a globally ordered table.

A window without a bounded partition sends a whole group to one task. Here the
rows are range-partitioned once on the full sort key, so a group with a third of
all rows spreads over many tasks. Sums inside a partition run along as it is
written; only one total per (partition, group) is added up afterwards, so rows move once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from palimpsest.workspace import stored

#: Totals that are sent to every executor; more are joined by key. There is one for each group and one more for each border between partitions.
BROADCAST_TOTALS = 1 << 18


def _running(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their place and the amounts before them, both within the partition's run of their group."""
    part, last, rows, amounts = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column, amount = batch.column(group), batch.column("_amount").to_numpy(zero_copy_only=False)
        same = pc.fill_null(pc.equal(column[1:], column[:-1]), False).to_numpy(zero_copy_only=False) if n > 1 else np.zeros(0, bool)
        none = column.is_null().to_numpy(zero_copy_only=False)
        fresh = np.ones(n, bool)
        fresh[1:] = ~(same | (none[1:] & none[:-1]))
        fresh[0] = last is None or last != (column[0].as_py(),)
        if fresh[0]:
            rows = amounts = 0
        starts = np.flatnonzero(fresh)
        upto = np.cumsum(amount) - amount
        run = np.searchsorted(starts, np.arange(n), "right") - 1  # -1: the run that the batch before began
        begin = np.append(starts, 0)[run]
        place = np.where(run < 0, np.arange(n) + rows, np.arange(n) - begin)
        before = np.where(run < 0, upto + amounts, upto - upto[begin])
        rows, amounts = int(place[-1]) + 1, int(before[-1] + amount[-1])
        last = (column[n - 1].as_py(),)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(place), pa.array(before)], names=[*batch.schema.names, "_part", "_place", "_before"]
        )


def with_running_totals(
    spark: SparkSession,
    frame: DataFrame,
    group: str,
    order: list[str],
    value: str | None = None,
    position: str = "position",
    before: str = "before",
) -> DataFrame:
    """Add each row's 0-based ``position`` in its group and the sum of ``value`` ``before`` it.

    ``group`` may hold null, which is a group of its own. Rows equal in all of
    ``order`` keep the order in which the exchange left them; the written
    table fixes it.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    amount = F.coalesce(F.col(value).cast("long"), F.lit(0)) if value else F.lit(0).cast("long")
    keyed = frame.withColumn("_amount", amount).repartitionByRange(parts, group, *order).sortWithinPartitions(group, *order)
    schema = StructType([*keyed.schema.fields, *(StructField(x, LongType()) for x in ("_part", "_place", "_before"))])
    fixed = stored(spark, keyed.mapInArrow(lambda batches: _running(batches, group), schema), "ordered")
    totals = fixed.groupBy("_part", F.col(group).alias("_group")).agg(F.sum("_amount").alias("_total"), F.count("*").alias("_rows"))
    # one row for each partition that holds rows of the group
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col("_part").alias("_p"),
        "_group",
        F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_sum_before"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows_before"),
    )
    offsets = stored(spark, offsets, "totals")
    offsets = F.broadcast(offsets) if offsets.count() <= BROADCAST_TOTALS else offsets
    result = fixed.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_group")))
    result = result.withColumn(position, F.col("_rows_before") + F.col("_place"))
    if value:
        result = result.withColumn(before, F.col("_sum_before") + F.col("_before"))
    return result.drop("_amount", "_part", "_place", "_before", "_p", "_group", "_sum_before", "_rows_before")
