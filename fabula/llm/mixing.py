"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled order, served in proportion to its weight. A document's
virtual finish time is the words its source has queued up to its end divided by the source's weight; a source is
queued ``max_epochs`` times over, so it runs dry at that multiple of its size and the others share what it leaves.
The mix is the globally range-sorted stream of finish times, cut at the virtual time at which the total budget is used.

Defined cases: a null text has size 0 and is never taken; a null source is one source, ordered last; repeated rows are
documents of their own; an empty table gives an empty mix. Columns of the names that are added replace those of the documents,
whose ``mix_range``, ``end_inside``, ``mix_source``, ``base_range`` and ``range_start`` are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.llm.common import WORD, documents, materialize

WEIGHTS = (3.0, 1.0, 2.0)
BUDGET = 1.5
EPOCHS = 2
#: Ranges of the shuffled order in which a source's running sum is built; a source of a third of 10**10 rows leaves a million rows in each.
RANGE_BITS = 12


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text, 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """Adds ``size`` and the shuffle key ``mix_key`` (a hash of id and text, so reruns agree)."""
    return docs.withColumn("size", word_count(F.col("text"))).withColumn("mix_key", F.xxhash64("doc_id", "text", F.lit(20)))


def source_targets(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: rank, source_size, weight, target.

    The deadline V is the virtual time at which sum(min(cap, V * weight)) is the budget. That sum is concave in V, so V is
    the largest of the deadlines got by holding the first i sources (by cap / weight) at their caps. The windows run over
    one row per source, not over documents.
    """
    own = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = own.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    after = W.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(every) * float(budget)
    capped = F.sum("cap").over(every) - F.sum("cap").over(after)
    timed = ranked.withColumn("held", (total - capped) / F.sum("weight").over(after))
    timed = timed.withColumn("deadline", F.greatest(F.max("held").over(every), F.lit(0.0)))
    return timed.select("source", "rank", "source_size", "weight", F.least("cap", F.col("deadline") * F.col("weight")).alias("target"))


def weighted_fair_mix(docs: DataFrame, sizes: DataFrame | None = None, whole: bool = False, weights=WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """Adds source_size, target, taken and finish (virtual time of the document's first service) to sized documents.

    Running sums are built in two levels, so a source that holds a third of all rows is spread over many tasks: sums of
    ranges of the shuffled order, then sums inside a range. ``whole`` takes the documents whose middle is before the
    deadline wholly (``taken`` is a multiple of size); otherwise the document in service at the deadline counts for the
    words served by then. ``sizes`` gives the same rows for the small aggregates when ``docs`` carries texts.
    """
    small = docs if sizes is None else sizes
    targets = source_targets(small.select("source", "size"), weights, budget, epochs)
    span = F.shiftrightunsigned(F.col("mix_key"), 64 - RANGE_BITS)
    base = (
        small.select("source", "size", span.alias("mix_range"))
        .groupBy("source", "mix_range")
        .agg(F.sum("size").alias("range_size"))
        .withColumn("range_start", F.sum("range_size").over(W.partitionBy("source").orderBy("mix_range")) - F.col("range_size"))
    )
    base = base.join(targets, base["source"].eqNullSafe(targets["source"])).select(base["source"].alias("mix_source"), F.col("mix_range").alias("base_range"), "range_start", "source_size", "weight", "target")
    inside = W.partitionBy("source", "mix_range").orderBy("mix_key", "doc_id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = docs.withColumn("mix_range", span).withColumn("end_inside", F.sum("size").over(inside))
    placed = placed.join(base, placed["source"].eqNullSafe(F.col("mix_source")) & (F.col("mix_range") == F.col("base_range")))
    start = F.col("range_start") + F.col("end_inside") - F.col("size")
    goal = F.round("target").cast("long")
    taken = F.lit(0).cast("long")
    for epoch in range(epochs):
        begun = start + F.col("source_size") * epoch
        if whole:
            part = F.when(begun + F.col("size") / 2 < goal, F.col("size")).otherwise(F.lit(0).cast("long"))
        else:
            part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - begun))
        taken = taken + part
    out = placed.withColumn("taken", taken).withColumn("finish", (start + F.col("size")) / F.col("weight"))
    return out.drop("mix_range", "end_inside", "mix_source", "base_range", "range_start")


def mixed_stream(mixed: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """The mix as rows in the order in which they are served: a row for each time a document is taken, range-sorted."""
    served = mixed.where(F.col("taken") > 0).withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.ceil(F.col("taken") / F.col("size")).cast("int") - 1)))
    served = served.withColumn("served_at", F.col("finish") + F.col("mix_epoch") * F.col("source_size") / F.col("weight"))
    return served.orderBy("served_at", "doc_id", "mix_key")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    small = materialize(sized(docs).drop("text"), "op9-sizes")
    return weighted_fair_mix(small).select("doc_id", "size", "source_size", "target", "taken", "finish")
