"""Sorts, limits and choices of one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def excerpt(blocks: DataFrame, duration: str, target, doc="doc_id", order="block_id", measured: str | None = None) -> DataFrame:
    """K-1: the prefix of whole blocks whose duration is nearest to the target.

    Blocks count up to the first at which the running sum reaches the target, and stop before one that isn't wholly
    measured. Of equal distances the shorter prefix wins.
    """
    w = W.partitionBy(doc).orderBy(order)
    run = w.rowsBetween(W.unboundedPreceding, 0)
    summed = blocks.withColumn("running", F.sum(duration).over(run))
    if measured:
        summed = summed.withColumn("_ok", F.min(F.col(measured).cast("int")).over(run)).where("_ok = 1").drop("_ok")
    kept = summed.withColumn("_n", F.row_number().over(w)).where(F.col("running") - F.col(duration) < target)
    best = kept.withColumn("_best", F.min(F.struct(F.abs(F.col("running") - target), F.col("_n"))).over(W.partitionBy(doc))["_n"])
    return best.where(F.col("_n") <= F.col("_best")).drop("_n", "_best")


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def best_take(takes: DataFrame, keys: list[str], problems="n_problems", score="score", attempt="attempt") -> DataFrame:
    """K-2: fewest problems, then highest score, then earliest."""
    return first_by(takes, keys, F.asc(problems), F.desc(score), F.asc(attempt))


def first_reference(takes: DataFrame, keys: list[str], seconds: str, text: str, said: str, order: str) -> DataFrame:
    """K-3: the first take of 5 to 18 seconds, 60 characters or more, at 7 to 25 characters a second, that says its text."""
    rate = F.length(text) / F.col(seconds)
    good = takes.where(F.col(seconds).between(5, 18) & (F.length(text) >= 60) & rate.between(7, 25) & (F.col(text) == F.col(said)))
    return first_by(good, keys, F.asc(order))


def shortest(rows: DataFrame, text: str, n: int, *ties: str) -> DataFrame:
    """K-4: a report of the n shortest texts."""
    return rows.orderBy(F.length(text), *ties).limit(n)


def nearest(ends: Column, target: int) -> Column:
    """K-5: the value of an array nearest to a target, the smaller of two."""
    return F.array_min(F.transform(ends, lambda i: F.struct(F.abs(i - target).alias("d"), i.alias("i"))))["i"]


def cap_per_key(rows: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """K-6: n rows of each key."""
    return rows.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def farthest(candidates: DataFrame, keys: list[str], value: str, distance: str) -> DataFrame:
    """K-7: the farthest candidate of each key, the smaller of equals."""
    return first_by(candidates, keys, F.desc(distance), F.asc(value))


def until_duration(rows: DataFrame, weight: str, target, doc="doc_id", order="seg_order") -> DataFrame:
    """K-8 and FLD-8: whole rows up to the one that reaches the target."""
    before = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.sum(weight).over(before), F.lit(0))).where(F.col("before") < target)
