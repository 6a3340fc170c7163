"""Ordered state of usage logs: context fills, cumulative counters, ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def up_to(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def before(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def fill(value: Column, w: WindowSpec) -> Column:
    """The last non-null value; wrap fields in a struct to carry an overwrite with null."""
    return F.last(value, ignorenulls=True).over(w)


def delta(current: Column, previous: Column) -> Column:
    """Growth of a cumulative counter; a reset gives 0."""
    return F.greatest(F.lit(0).cast("long"), current - F.coalesce(previous, F.lit(0)))


def baseline_usable(total: Column, last: Column, w: WindowSpec) -> Column:
    """Whether earlier rows leave the cumulative baseline complete: a total restores it, a bare last breaks it."""
    return F.coalesce(F.last(F.when(total.isNotNull(), F.lit(True)).when(last.isNotNull(), F.lit(False)), ignorenulls=True).over(w), F.lit(True))


def choose_usage(total: Column, last: Column, w: WindowSpec, fields: list[str]) -> Column:
    """The call's own usage, else the growth of the total while the baseline is usable, else null. total, last: structs of longs."""
    previous = F.last(total, ignorenulls=True).over(w)
    grown = F.struct(*(delta(total[f], previous[f]).alias(f) for f in fields))
    return F.coalesce(last, F.when(total.isNotNull() & baseline_usable(total, last, w), grown))


def exclusive_input(total: Column, read: Column, write: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), total - read - write)


def suffix_duplicates(df: DataFrame, ident: str, order: list[str]) -> DataFrame:
    """The n-th row (n > 1) of an id gets the suffix `:n`."""
    n = F.row_number().over(Window.partitionBy(ident).orderBy(*order))
    return df.withColumn("_n", n).withColumn(ident, F.when(F.col("_n") > 1, F.concat(F.col(ident), F.lit(":"), F.col("_n"))).otherwise(F.col(ident))).drop("_n")


def batches(df: DataFrame, size: int, keys: list[str], order: list[str], runs: list[str] | None = None) -> DataFrame:
    """Adds batch_id: rows of each key in order, `size` to a batch.

    runs: leading columns of the order (or columns that grow with it), by which a key's rows are cut into runs. Rows are
    then numbered within a run, after the rows of the earlier runs, which are counted with map-side combining, so that a key
    with a third of all rows is many tasks.
    """
    if not runs:
        n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("batch_id", F.floor((n - 1) / size).cast("long"))
    part = [*keys, *runs]
    earlier = Window.partitionBy(*keys).orderBy(*runs).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*part).agg(F.count(F.lit(1)).alias("__n"))
    counts = counts.select(*[F.col(c).alias(f"__{c}") for c in part], F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in part))
    n = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
    out = df.withColumn("__n", n).join(counts, same).withColumn("batch_id", F.floor((F.col("__before") + F.col("__n") - 1) / size).cast("long"))
    return out.select(*df.columns, "batch_id")


def first_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
