"""Ranks and running sums within groups that no task could hold: by ranges of values and their totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.sources.io import stored


def sums_before(counts: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """``counts`` with before_<x>: the sum of each x over the rows of the same group with smaller values.

    One row for each group and value. Rows are put in ranges of (group, value); totals of the
    ranges, a row for each range and group, give what lies before a range.
    """
    order = [*by, value]
    placed = counts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    placed = stored(placed, "ranges")  # the ranges are fixed from here on
    totals = placed.groupBy("__part", *by).agg(*[F.sum(x).alias(f"__{x}") for x in sums])
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__part", *by, *[F.coalesce(F.sum(f"__{x}").over(earlier), F.lit(0)).alias(f"__{x}") for x in sums])
    inside = Window.partitionBy("__part", *by).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = placed.join(offsets, ["__part", *by])
    before = [(F.col(f"__{x}") + F.coalesce(F.sum(x).over(inside), F.lit(0))).alias(f"before_{x}") for x in sums]
    return joined.select(*counts.columns, *before)


def value_ranks(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value, n, total, rank: of each distinct non-null value its rows, those of its group, and the mean
    rank of its rows as a share of the group's."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    placed = sums_before(counts, by, value, ["n"])
    sizes = placed.groupBy(*by).agg(F.sum("n").alias("total"))  # a row for each group
    ranked = placed.join(F.broadcast(sizes), by) if by else placed.join(F.broadcast(sizes), F.lit(True))
    return ranked.select(*by, value, "n", "total", ((F.col("before_n") + (F.col("n") + 1) / 2) / F.col("total")).alias("rank"))


def medians(rows: DataFrame, by: list[str], value: str, accuracy: int = 1000) -> DataFrame:
    """by, n, middle: of each group its number of non-null values and their exact median, null where there is none.

    A sketch of bounded size brackets the middle of each group; what lies below the bracket is
    counted, and only the values inside are put in order, by ranges. No task holds a group's values.
    Groups that the sketch's bracket misses are ordered whole.
    """
    x = rows.select(*by, F.col(value).cast("double").alias("__x"))
    share = 2 / accuracy
    sketch = F.percentile_approx("__x", F.array(F.lit(0.5 - share), F.lit(0.5 + share)), F.lit(accuracy))
    groups = stored(x.groupBy(*by).agg(F.count("__x").alias("n"), sketch.alias("__edge")), "median-groups")
    found = stored(_middles(x, groups, by), "medians")
    missed = found.where("middle is null and n > 0").select(*by)
    if not missed.isEmpty():
        whole = F.array(F.lit(float("-inf")), F.lit(float("inf")))
        again = groups.join(missed, by, "left_semi").withColumn("__edge", whole)
        found = found.join(missed, by, "left_anti").unionByName(_middles(x.join(missed, by, "left_semi"), again, by))
    return found


def _middles(x: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    low, high = F.col("__edge")[0], F.col("__edge")[1]
    inside = x.join(groups.where("n > 0").select(*by, "__edge"), by).where(F.col("__x") <= high)
    counts = inside.groupBy(*by, F.when(F.col("__x") >= low, F.col("__x")).alias("__x")).agg(F.count(F.lit(1)).alias("__n"))
    counts = stored(counts, "median-counts")
    below = counts.where("__x is null").select(*by, F.col("__n").alias("__below"))
    placed = sums_before(counts.where("__x is not null"), by, "__x", ["__n"])
    sized = placed.join(groups.select(*by, "n"), by).join(below, by, "left")
    before = F.coalesce("__below", F.lit(0)) + F.col("before___n")
    holds = lambda k: F.max(F.when((before < k) & (k <= before + F.col("__n")), F.col("__x")))
    middle = sized.groupBy(*by).agg(holds(F.floor((F.col("n") + 1) / 2)).alias("__a"), holds(F.floor(F.col("n") / 2) + 1).alias("__b"))
    return groups.select(*by, "n").join(middle.select(*by, ((F.col("__a") + F.col("__b")) / 2).alias("middle")), by, "left")
