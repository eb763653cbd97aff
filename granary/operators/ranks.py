"""Exact ranks within groups of any size.

Where the table is small, or its largest group by a count, a window gives them: its rows fit a task. Beyond that the
rows are range-partitioned by group and order, and a rank is the place in the partition plus the rows
of the group in the partitions before, so that a group spreads over as many tasks as it needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.session import cut

#: Rows of a group that one task ranks at most, and bytes of a plan, as Spark estimates them, whose groups aren't counted.
WINDOW_ROWS, SMALL_BYTES = 1_000_000, 16 << 20


def small(df: DataFrame) -> bool:
    """Whether Spark estimates all of df at no more than SMALL_BYTES, so that any group of it fits a task."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= SMALL_BYTES


def largest(df: DataFrame, by: list[str]) -> int:
    """Rows of the largest group: a count with partial sums, of which one row comes back. 0 for a small table, which isn't counted."""
    if small(df):
        return 0
    return df.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def ranked(df: DataFrame, by: list[str], order: list[Column], most: int | None = None, running: str | None = None) -> DataFrame:
    """df with _r (rank from 1 by the order within `by`), _n (rows of the group) and, with `running`, _before (the sum of that column over the rows before).

    The order should end in a key, so that ranks don't depend on the run. `most` is the size of the
    largest group, where it is known; else it is counted.
    """
    if (largest(df, by) if most is None else most) <= WINDOW_ROWS:
        w = Window.partitionBy(*by)
        o = w.orderBy(*order)
        out = df.withColumns({"_r": F.row_number().over(o), "_n": F.count("*").over(w)})
        return out.withColumn("_before", F.coalesce(F.sum(running).over(o.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))) if running else out

    cols = [*map(F.col, by), *order]
    # Cut, since ranges come from a sample: read again they could fall otherwise.
    rows = df.repartitionByRange(*cols).sortWithinPartitions(*cols)
    rows = cut(rows.withColumns({"_p": F.spark_partition_id(), "_m": F.monotonically_increasing_id()}))
    total = F.sum(running) if running else F.lit(0.0)
    counts = rows.groupBy(*by, "_p").agg(F.count("*").alias("_c"), F.min("_m").alias("_first"), total.alias("_s"))
    # A row for each partition and each group that it holds a part of.
    group = Window.partitionBy(*by)
    ahead = group.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*by, "_p", "_first", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_start"), F.sum("_c").over(group).alias("_n"), F.coalesce(F.sum("_s").over(ahead), F.lit(0.0)).alias("_s"))
    a, b = rows.alias("a"), starts.alias("b")
    same = F.col("a._p") == F.col("b._p")
    for c in by:
        same &= F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    out = a.join(b, same).select("a.*", "b._first", "b._start", "b._n", "b._s").withColumn("_r", F.col("_m") - F.col("_first") + F.col("_start") + 1)
    if running:  # within a partition's part of a group, which fits a task
        part = Window.partitionBy("_p", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("_before", F.col("_s") + F.coalesce(F.sum(running).over(part), F.lit(0.0)))
    return out.drop("_p", "_m", "_first", "_start", "_s")
