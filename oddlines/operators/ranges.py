"""Running totals, ranks and quantiles over range partitions: no window holds a whole group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add, and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.stages import written


def _running(rows: DataFrame, order: list[str | Column], made: dict[str, str], by: tuple[str, ...], fold: Callable[[str], Column], both: Callable[[Column, Column], Column]) -> DataFrame:
    """rows with, for each out: column, fold of the column over a row and all before it in order, anew for each group of
    by; both brings two folds together. Rows are range-partitioned by both; what meets in one place is a row for each
    partition of one group."""
    ranged = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    ends = ranged.groupBy("_part", *by).agg(*[fold(c).alias(f"_{out}") for out, c in made.items()])
    line = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select("_part", *by, *[F.coalesce(fold(f"_{out}").over(line), F.lit(0)).alias(f"_{out}") for out in made])
    within = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = ranged.withColumns({out: fold(c).over(within) for out, c in made.items()})
    before = before.withColumnsRenamed({k: f"_of_{k}" for k in ("_part", *by)})
    met = own.join(before, reduce(and_, [own[k].eqNullSafe(before[f"_of_{k}"]) for k in ("_part", *by)]))
    return met.select(*rows.columns, *[both(F.col(out), F.col(f"_{out}")).alias(out) for out in made])


def running_totals(rows: DataFrame, order: list[str | Column], sums: dict[str, str], by: tuple[str, ...] = ()) -> DataFrame:
    """rows with, for each out: column, the column's sum over a row and all before it in order, anew for each group of by."""
    return _running(rows, order, sums, by, F.sum, add)


def running_greatest(rows: DataFrame, order: list[str | Column], greatest: dict[str, str]) -> DataFrame:
    """rows with, for each out: column, the column's greatest value (0 at least) over a row and all before it in order."""
    return _running(rows, order, greatest, (), F.max, F.greatest)


def ranked(rows: DataFrame, order: list[str | Column], by: tuple[str, ...] = (), out: str = "rank") -> DataFrame:
    """rows with their number, from 1, in order within their group."""
    return running_totals(rows.withColumn("_one", F.lit(1).cast("long")), order, {out: "_one"}, by).drop("_one")


def quantiles(rows: DataFrame, by: tuple[str, ...], value: str, **wanted: float) -> DataFrame:
    """by, n and for each out=share the quantile of value, linear between neighbours, and out_low, the neighbour below
    or at share of the rows (of two middle values the lower one); from counts of distinct values. Nulls are left out."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    line = running_totals(counts, [value], {"_upto": "_c"}, by)
    n = counts.groupBy(*by).agg(F.sum("_c").alias("n"))
    if by:
        n = n.withColumnsRenamed({k: f"_of_{k}" for k in by})
        line = line.join(n, reduce(and_, [line[k].eqNullSafe(n[f"_of_{k}"]) for k in by])).select(*line.columns, "n")
    else:
        line = line.crossJoin(F.broadcast(n))  # one row beside each
    made = []
    for out, share in wanted.items():
        at = (F.col("n") - 1) * F.lit(share)
        least = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
        low, high, part = least(F.floor(at)), least(F.least(F.floor(at) + 1, F.col("n") - 1)), F.max(at - F.floor(at))
        made += [(low + (high - low) * part).alias(out), F.min(F.when(F.col("_upto") >= F.col("n") * F.lit(share), F.col(value))).alias(f"{out}_low")]
    return line.groupBy(*by).agg(F.max("n").alias("n"), *made)
