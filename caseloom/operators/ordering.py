"""Ordered computations that do not put one key's rows into one task.

A window over ``partitionBy(key)`` sorts each key in a single task, which fails
when a third of all rows share the key. The helpers here range-partition by
(key, order) first, work inside each slice, and carry a small per-slice summary
across slice borders. The range-partitioned rows are checkpointed because slice
numbers must not change between the two passes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stable


def ordered_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows in (key, order) ranges with the range number in ``_slice``."""
    spread = df.repartitionByRange(*[F.col(c) for c in (*keys, *order)])
    return stable(spread.withColumn("_slice", F.spark_partition_id()))


def running_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """0-based position of each row in its key, ordered by ``order`` (unique)."""
    rows = ordered_slices(df, keys, order)
    sizes = rows.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        rows.join(offsets, [*keys, "_slice"])
        .withColumn(name, F.row_number().over(inside) - F.lit(1) + F.col("_off"))
        .drop("_slice", "_off")
    )


def last_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, name: str, inclusive: bool = False
) -> DataFrame:
    """Latest non-null ``value`` among the earlier rows of the same key."""
    rows = ordered_slices(df.withColumn("_v", value), keys, order)
    tails = rows.groupBy(*keys, "_slice").agg(
        F.max_by(F.col("_v"), F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_tail")
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.select(*keys, "_slice", F.last("_tail", ignorenulls=True).over(before).alias("_carry"))
    inside = (
        Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    return (
        rows.join(carried, [*keys, "_slice"])
        .withColumn(name, F.coalesce(F.last("_v", ignorenulls=True).over(inside), F.col("_carry")))
        .drop("_slice", "_v", "_carry")
    )


# Arrays are unnested with the outer form of explode throughout: for the plain
# form the optimizer infers a "not empty" filter and evaluates the whole array
# expression a second time below the generator.


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], n: int, rank: str = "rank") -> DataFrame:
    """First ``n`` rows per key. Spark keeps only n rows per key and task before
    the shuffle (window group limit), so a hot key stays cheap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)
