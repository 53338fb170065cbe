"""Dense global numbering without a global window.

The rows are sorted by range over all partitions, written once with their place in the
partition, and numbered by adding the sizes of the earlier partitions. Only one row per
partition reaches the driver, and no task sees more than its own range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.sources.stage import write_stage

# The high bits of monotonically_increasing_id() hold the partition.
PARTITION_BITS = 33


def _ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    placed = df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    return write_stage(placed, name).select(
        *df.columns,
        F.shiftright("_place", PARTITION_BITS).cast("int").alias("_range"),
        F.col("_place").bitwiseAND((1 << PARTITION_BITS) - 1).alias("_row"),
    )


def _offsets(sizes: DataFrame) -> tuple[DataFrame, int]:
    """Exclusive running totals of ``sizes(_range, _size)``, one row per partition."""
    total, offsets = 0, []
    for part, size in sorted(tuple(r) for r in sizes.collect()):
        offsets.append((part, total))
        total += size
    return sizes.sparkSession.createDataFrame(offsets, "_range int, _offset bigint"), total


def dense_index(
    df: DataFrame, order: list[Column], index: str = "idx", name: str = "index"
) -> tuple[DataFrame, int]:
    """Add the 0-based position of each row in ``order``; also return the row count.

    ``order`` must be total, so that the positions do not depend on the partitioning.
    """
    placed = _ranges(df, order, name)
    offsets, total = _offsets(placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size")))
    # More rows than an int can number are possible where every document is a label.
    kind = "int" if total < 1 << 31 else "long"
    indexed = placed.join(F.broadcast(offsets), "_range").select(
        (F.col("_offset") + F.col("_row")).cast(kind).alias(index), *df.columns
    )
    return indexed, total


def running_offset(
    df: DataFrame, order: list[Column], size: str, offset: str = "offset", name: str = "offset"
) -> tuple[DataFrame, int, int]:
    """Add the sum of ``size`` over all earlier rows in ``order``.

    Also return the total of ``size`` and the number of rows.

    The running sum within a range uses a window per range, never one over all rows.
    """
    placed = _ranges(df, order, name)
    sizes = placed.groupBy("_range").agg(F.sum(size).alias("_size"))
    (offsets, total), n_rows = _offsets(sizes), placed.count()
    earlier = Window.partitionBy("_range").orderBy("_row").rowsBetween(
        Window.unboundedPreceding, -1
    )
    within = F.coalesce(F.sum(size).over(earlier), F.lit(0))
    return (
        placed.withColumn("_within", within)
        .join(F.broadcast(offsets), "_range")
        .select(*df.columns, (F.col("_offset") + F.col("_within")).alias(offset)),
        total,
        n_rows,
    )
