"""Tails, ranges, derived columns and a book's metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DERIVED = "derived"


def from_first(rows: DataFrame, keys: list[str], order: str, holds: Column) -> DataFrame:
    """PRJ-6: the rows of each key from the first on for which a condition holds; keys without one give none."""
    first = rows.where(holds).groupBy(*keys).agg(F.min(order).alias("_first"))
    return rows.join(first, keys).where(F.col(order) >= F.col("_first")).drop("_first")


def range_bounds(rows: DataFrame, keys: list[str], order: str, block: str, start, end) -> DataFrame:
    """(keys, first, last, fault): where the blocks ``start`` and ``end`` stand; fault: ``missing``, ``reversed`` or null."""
    at = lambda f, v: f(F.when(F.col(block) == v, F.col(order)))
    found = rows.groupBy(*keys).agg(at(F.min, start).alias("first"), at(F.max, end).alias("last"))
    fault = F.when(F.col("first").isNull() | F.col("last").isNull(), "missing").when(F.col("first") > F.col("last"), "reversed")
    return found.withColumn("fault", fault)


def between_keys(rows: DataFrame, keys: list[str], order: str, block: str, start, end, strict: bool = True) -> DataFrame:
    """PRJ-7: the rows from the block ``start`` to the end of the block ``end``. A key in which a bound is missing, or the end
    stands before the start, fails the job; with ``strict=False`` it gives no rows and ``range_bounds`` tells why."""
    bounds = range_bounds(rows, keys, order, block, start, end)
    if strict:
        told = F.assert_true(F.col("fault").isNull(), F.concat(F.lit("bound "), F.col("fault")))  # null where it holds
        bounds = bounds.select(*keys, *[F.when(told.isNull(), F.col(c)).alias(c) for c in ("first", "last")])  # whichever is asked for first
    else:
        bounds = bounds.where("fault IS NULL")
    placed = rows.join(bounds.select(*keys, F.col("first").alias("_a"), F.col("last").alias("_b")), keys)
    return placed.where((F.col(order) >= F.col("_a")) & (F.col(order) <= F.col("_b"))).drop("_a", "_b")


def with_derived(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed from the text, marked so in its metadata."""
    return df.withColumn(name, value).withMetadata(name, {DERIVED: True})


def drop_derived(df: DataFrame, prefix: str = "tts_") -> DataFrame:
    """PRJ-10: without the columns that are marked as derived or have their prefix, so that a new split of the text never
    carries what was computed from the old one."""
    return df.drop(*[f.name for f in df.schema if f.metadata.get(DERIVED) or f.name.startswith(prefix)])


def strip_part(title: Column, marker: str = " — часть ") -> Column:
    """A part's title without the marker and what follows it."""
    return F.trim(F.substring_index(title, marker, 1))


def book_meta(books: DataFrame, parts: DataFrame, keys: list[str], part: str = "part", marker: str = " — часть ") -> DataFrame:
    """PRJ-11: (keys, title, author): the whole book's, blanks collapsed, where it has one; else the first part's that has one,
    its title without the part's marker. Books without any have empty ones."""
    tidy = lambda c: F.nullif(F.trim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")), F.lit(""))
    own = books.groupBy(*keys).agg(F.max(tidy("title")).alias("_t"), F.max(tidy("author")).alias("_a"))
    title, author = F.nullif(strip_part(tidy("title"), marker), F.lit("")), tidy("author")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col(part)))
    fallback = parts.groupBy(*keys).agg(first(title).alias("_pt"), first(author).alias("_pa"))
    both = own.unionByName(fallback, allowMissingColumns=True).groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("_t", "_a", "_pt", "_pa")])  # null keys are one key
    return both.select(*keys, F.coalesce("_t", "_pt", F.lit("")).alias("title"), F.coalesce("_a", "_pa", F.lit("")).alias("author"))
