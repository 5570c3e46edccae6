"""Greedy folds over ordered rows: batches, merges, balanced parts.

A long document's rows lie in several sorted range partitions, and ``ordered.piece_numbers`` passes states between them; only
orders, sizes and hashes of keys travel, never texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.functions.text import trim_near
from fabula.operators.ordered import GreedyBatches, ShortJoins, piece_numbers, running_sums
from fabula.session import materialize


def _size(col: Column) -> Column:
    return F.greatest(F.coalesce(col.cast("long"), F.lit(0)), F.lit(0)).cast("long")


def batch_by_size(rows: DataFrame, keys: list[str], order: str, size: str, limit: int, break_on: str | None = None, partitions: int | None = None) -> DataFrame:
    """FLD-1, FLD-2: (keys, order, batch). A batch is closed before the row that would take it over the limit, and where
    ``break_on`` changes (a null is a value of its own); a row beyond the limit is a batch of its own. Null sizes and those
    under 0 count as 0."""
    fields = {"w": _size(F.col(size)), "g": F.xxhash64(F.col(break_on).cast("string")) if break_on else F.lit(0).cast("long")}
    return piece_numbers(rows, keys, order, GreedyBatches(limit), fields, partitions=partitions).withColumnRenamed("piece", "batch")


def batch_by_count(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """FLD-3."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy(order)) - 1) / n))


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on keys where nulls are alike; the left keys stay."""
    renamed = right.select(*[F.col(k).alias(f"_{k}_") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}_")) for k in keys], how)


def split_balanced(rows: DataFrame, keys: list[str], order: str, weight: str, parts: int, partitions: int | None = None) -> DataFrame:
    """FLD-6: (keys, order, part). A part is closed when its sum reaches total / parts and enough rows are left for the
    parts to come; the sum starts anew at each part, so there can be fewer parts. Null weights count as 0.

    Each of the parts - 1 cuts is the first row whose running sum is far enough beyond the last cut's: a pass over running sums
    that are written once.
    """
    sums = materialize(running_sums(rows, keys, order, F.coalesce(F.col(weight).cast("long"), F.lit(0).cast("long")), partitions), "running-sums")
    cut = sums.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("_at"), F.lit(0).cast("long").alias("_gone"))
    cuts = []
    for n in range(parts - 1):
        reach = (F.col("_before") + F.col("_w") - F.col("_gone")) * parts >= F.col("_total")
        first = _beside(sums, cut, keys).where((F.col("_rank") >= F.col("_at")) & reach).groupBy(*keys).agg(F.min(F.struct((F.col("_rank") + 1).alias("_at"), (F.col("_before") + F.col("_w")).alias("_gone"), "_rows")).alias("_c"))
        cut = materialize(first.where(F.col("_c._rows") - F.col("_c._at") >= parts - 1 - n).select(*keys, "_c._at", "_c._gone"), "cuts")
        cuts.append(cut)
    if not cuts:
        return sums.select(*keys, order, F.lit(0).cast("long").alias("part"))
    every = reduce(DataFrame.unionByName, cuts).groupBy(*keys).agg(F.collect_list("_at").alias("_cuts"))
    part = F.size(F.filter("_cuts", lambda c: c <= F.col("_rank"))).cast("long")
    return _beside(sums, every, keys, "left").select(*keys, order, F.when(F.col("_cuts").isNull(), F.lit(0).cast("long")).otherwise(part).alias("part"))


def parts_needed(total: Column, limit: Column | float) -> Column:
    """FLD-7."""
    return F.greatest(F.lit(1), F.ceil(total / limit))


def merge_short(segments: DataFrame, minimum=100, maximum=260, doc="doc_id", chapter="chapter_id", order="seg_order", doc_fields=("block_id", "speaker", "char_start", "char_end", "block_len", "size", "pause_ms", "needs_review", "reason")) -> DataFrame:
    """FLD-4: joins short neighbours of one speaker and chapter.

    A row goes on in the row before if either is under ``minimum``, both with a space fit into ``maximum``, and they touch
    in one block or are whole blocks in a row. The last pause, any review flag and the first reason stay. Returns
    (doc, chapter, first order, pieces, size, speaker, pause_ms, needs_review, reason) per merged segment.
    """
    block, speaker, a, b, whole, size, pause, review, reason = doc_fields
    at = lambda c, none: F.coalesce(F.col(c).cast("long"), F.lit(none).cast("long"))
    fields = {
        "w": _size(F.col(size)), "s": F.xxhash64(speaker), "b": F.when(F.col(block).isNotNull(), F.xxhash64(F.col(block).cast("string"))).otherwise(F.xxhash64(F.lit("no block"), order)),
        "x": at(a, -1), "y": at(b, -2), "whole": at(whole, -3), "can": F.lit(1).cast("long"),
    }
    rows = segments.select(doc, chapter, F.col(order).cast("long").alias(order), *[F.col(c) for c in doc_fields if c not in (doc, chapter, order)])
    rows = piece_numbers(rows, [doc, chapter], order, ShortJoins(minimum, maximum), fields, tuple(doc_fields))
    o, why = F.col(order), F.when(F.col(reason) != "", F.col(reason))
    flags = F.when(F.max(F.col(review).cast("int")) == 1, True).when(F.count_if(F.col(review).isNull()) > 0, None).otherwise(False)
    piece = F.struct(o.alias("o"), F.col(block).cast("string").alias("b"), F.col(a).cast("int").alias("x"), F.col(b).cast("int").alias("y"))
    merged = rows.groupBy(doc, chapter, "piece").agg(
        F.min(o).alias("_first"), F.array_sort(F.collect_list(piece)).alias("pieces"), (F.sum(_size(F.col(size))) + F.count("*") - 1).cast("int").alias("_size"), F.max_by(speaker, o).alias("_speaker"),
        F.max_by(F.col(pause).cast("int"), o).alias("_pause"), flags.alias("_review"), F.coalesce(F.min_by(why, F.when(why.isNotNull(), o)), F.max_by(reason, o)).alias("_reason"),
    )
    return merged.select(doc, chapter, F.col("_first").alias(order), "pieces", F.col("_size").alias("size"), F.col("_speaker").alias("speaker"), F.col("_pause").alias("pause_ms"), F.col("_review").alias("needs_review"), F.col("_reason").alias("reason"))


def join_same_key(groups: DataFrame, keys: list[str], order: str, key: str, size: str, minimum: int, maximum: int) -> DataFrame:
    """FLD-5: (keys, order, joined): groups in a row of one reference key (not null) become one while either is short and both fit."""
    none = F.lit(0).cast("long")
    fields = {"w": _size(F.col(size)), "s": F.xxhash64(F.col(key).cast("string")), "b": none, "x": none, "y": none, "whole": none, "can": F.col(key).isNotNull().cast("long")}
    return piece_numbers(groups, keys, order, ShortJoins(minimum, maximum), fields).withColumnRenamed("piece", "joined")


def sample_text(spans: DataFrame, keys: list[str], order: str, text: str, target=80, cap=120, default="") -> DataFrame:
    """FLD-9: texts in order until the cap is reached, cut at the sentence end nearest to the target; a default if short."""
    before = W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    used = spans.withColumn("_before", F.coalesce(F.sum(F.length(text) + 1).over(before), F.lit(0))).where(F.col("_before") < cap)
    joined = used.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"))
    whole = F.array_join(F.transform("_t", lambda x: x[text]), " ")
    cut = trim_near(whole, target, cap)
    return joined.select(*keys, F.when(F.length(cut) >= target // 2, cut).otherwise(F.lit(default) if default else cut).alias("sample"))
