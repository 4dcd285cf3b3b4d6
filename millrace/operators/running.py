"""Running sums and gap-free numbers in levels, so that no key has to fit in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import stored


def running_sums(df: DataFrame, by: list[str], order: list[str], value: Column, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``value`` over the rows of the same ``by`` that come before in ``order`` (of different values).

    Rows are dealt out by ranges of (by, order) and written, so that a key may lie in many parts; sums run inside a part
    and the parts' totals, one row for each part that a key lies in, give what came before it.  Nulls are keys of their own.
    """
    ranges = [F.col(c) for c in (*by, *order)]
    placed = stored(df.withColumn("_value", value.cast("long")).repartitionByRange(*ranges).withColumn("_part", F.spark_partition_id()), "running")
    totals = placed.groupBy("_part", *by).agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    carried = totals.select(F.col("_part").alias("_at"), *(F.col(c).alias(f"_by_{c}") for c in by), F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_carried"))
    same = F.col("_part") == F.col("_at")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    return summed.join(carried, same).select(*df.columns, (F.col("_inside") + F.col("_carried")).alias(name))


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "nth") -> DataFrame:
    """``df`` with its rows numbered from 0, without gaps, in ``order`` inside each ``by`` (of the whole table, where that is empty)."""
    return running_sums(df, by, order, F.lit(1), name)


def with_ids(table: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """``table`` with its null ids filled: they go on after the largest one, in ``order``; ids that are there stay."""
    missing = numbered(table.where(F.col(id_column).isNull()), [], order, "_nth")
    top = table.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("_top"))
    filled = missing.crossJoin(F.broadcast(top)).withColumn(id_column, (F.col("_top") + F.col("_nth") + 1).cast(table.schema[id_column].dataType))  # one row
    return table.where(F.col(id_column).isNotNull()).unionByName(filled.select(*table.columns))
