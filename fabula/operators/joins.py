"""Joins: labels by content, overrides, positional checks, neighbours, bands. Equi keys throughout; bands and ranges are
bucketed so that they stay equi joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.operators import annotators


def label_by_hash(blocks: DataFrame, labels: DataFrame, text="text", label="label", order="ord", default=None) -> DataFrame:
    """JN-4: labels found again by the text's SHA-1; the last of several wins, a default where none is."""
    last = labels.groupBy("text_sha1").agg(F.max_by(label, order).alias("_label"))
    joined = blocks.withColumn("text_sha1", F.sha1(F.col(text).cast("binary"))).join(last, "text_sha1", "left")
    return joined.withColumn(label, F.coalesce("_label", F.lit(default))).drop("_label")


def apply_overrides(rows: DataFrame, overrides: DataFrame, key: str, value: str) -> DataFrame:
    """JN-5: an override replaces a value."""
    over = overrides.select(key, F.col(value).alias("_over"))
    return rows.join(over, key, "left").withColumn(value, F.coalesce("_over", value)).drop("_over")


def bad_overrides(rows: DataFrame, overrides: DataFrame, key: str) -> DataFrame:
    """Override keys that are unknown or stand twice: (key, rule)."""
    unknown = overrides.join(rows.select(key).distinct(), key, "left_anti").select(key, F.lit("unknown").alias("rule")).distinct()
    twice = overrides.groupBy(key).count().where("count > 1").select(key, F.lit("duplicate").alias("rule"))
    return unknown.unionByName(twice)


def measured_or_estimate(segments: DataFrame, measured: DataFrame, keys: list[str], text="text", value="seconds", estimate="estimate") -> DataFrame:
    """JN-6: a measurement where there is one of the same text, else the estimate."""
    own = measured.select(*keys, F.col(text).alias("_text"), F.col(value).alias("_value"))
    joined = segments.join(own, keys, "left")
    used = F.col("_value").isNotNull() & F.col("_text").eqNullSafe(F.col(text))
    return joined.withColumn("measured", used).withColumn(value, F.when(used, F.col("_value")).otherwise(F.col(estimate))).drop("_text", "_value")


def _ranked(df: DataFrame, doc: str, order: list[str], cols: list[str], prefix: str) -> DataFrame:
    n = F.row_number().over(W.partitionBy(doc).orderBy(*order))
    return df.select(F.col(doc), n.alias("_n"), *[F.col(c).alias(f"{prefix}{c}") for c in cols])


def positional_mismatch(left: DataFrame, right: DataFrame, cols: list[str], doc="doc_id", left_order=("seg_order",), right_order=("seg_order",)) -> DataFrame:
    """JN-7, JN-8: rows of two ordered tables that differ at the same place: (doc, position, rule)."""
    a, b = _ranked(left, doc, list(left_order), cols, "a_"), _ranked(right, doc, list(right_order), cols, "b_")
    both = a.withColumn("_a", F.lit(True)).join(b.withColumn("_b", F.lit(True)), [doc, "_n"], "full")
    differ = [F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), c) for c in cols]
    rule = F.when(F.col("_b").isNull(), "missing").when(F.col("_a").isNull(), "extra").otherwise(F.concat_ws(",", *differ))
    return both.select(doc, (F.col("_n") - 1).alias("position"), rule.alias("rule")).where("rule <> ''")


def first_mismatch(mismatches: DataFrame, doc="doc_id") -> DataFrame:
    return mismatches.groupBy(doc).agg(F.min(F.struct("position", "rule")).alias("m")).select(doc, "m.position", "m.rule")


def verify_timeline(segments: DataFrame, timeline: DataFrame, cols: list[str], doc="doc_id", order="seg_order") -> DataFrame:
    """JN-7 with the order of times: no row starts before the row before it ends."""
    wrong = positional_mismatch(segments, timeline, cols, doc, (order,), (order,))
    w = W.partitionBy(doc).orderBy(order)
    late = timeline.withColumn("_p", F.lag("end").over(w)).withColumn("position", (F.row_number().over(w) - 1)).where((F.col("start") < F.col("_p")) | (F.col("end") < F.col("start")))
    return wrong.unionByName(late.select(doc, "position", F.lit("time").alias("rule")))


def mention_context(blocks: DataFrame, names: DataFrame, own: DataFrame, key: str, block="block_id", text="text", name="name") -> DataFrame:
    """JN-10: (key, block): blocks that name a key, or that are its own.

    A name counts where its first word stands as a word and the text holds it. Up to ``SHARED_ENTRIES`` names are found by one
    automaton in a pass over the texts; more of them meet the blocks' distinct words in an equi join first.
    """
    word = r"[^\p{L}\p{N}_#]+"
    parts = names.select(key, F.lower(name).alias("_name"), F.get(F.array_remove(F.split(F.lower(name), word), ""), F.lit(0)).alias("_word"))
    if names.limit(annotators.SHARED_ENTRIES + 1).count() <= annotators.SHARED_ENTRIES:
        held = annotators.names_in(blocks, text, names, name, [block, text]).withColumnRenamed("name", "_name")
        spoken = F.array_contains(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), word), F.col("_word"))
        named = held.join(parts.where("_word is not null"), "_name").where(spoken).select(key, block)
        return named.unionByName(own.select(key, block)).distinct()
    words = blocks.select(block, text, F.explode(F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), word), ""))).alias("_word"))
    named = words.join(parts, "_word").where(F.contains(F.lower(text), F.col("_name"))).select(key, block)
    return named.unionByName(own.select(key, block)).distinct()


def neighbours(blocks: DataFrame, keys: DataFrame, before: int, after: int, doc="doc_id", order="block_order") -> DataFrame:
    """JN-11: rows within ``before`` and ``after`` of the key rows, each once. The few offsets are exploded, so the join is on equal orders."""
    spread = keys.select(doc, F.explode(F.sequence(F.col(order) - before, F.col(order) + after)).alias(order)).distinct()
    return blocks.join(spread, [doc, order], "left_semi")


def twin_pairs(stats: DataFrame, group: str, ident: str, pitch: str, range_: str, rate: str, semitones=1.0, range_gap=1.5, low=0.9, high=1.11) -> DataFrame:
    """JN-12: near pairs of a group: pitch within a semitone, range and tempo close. Pitch is cut into semitone cells, and a
    row looks into its own cell and the next ones, so no group is joined with itself whole."""
    tone = F.log2(pitch) * 12
    a = stats.where(F.col(pitch) > 0).select(group, F.col(ident).alias("a"), tone.alias("ta"), F.col(range_).alias("ra"), F.col(rate).alias("va"), F.floor(tone / semitones).alias("cell"))
    b = stats.where(F.col(pitch) > 0).select(group, F.col(ident).alias("b"), tone.alias("tb"), F.col(range_).alias("rb"), F.col(rate).alias("vb"), F.explode(F.array(*[F.floor(tone / semitones) + i for i in (-1, 0, 1)])).alias("cell"))
    near = (F.abs(F.col("ta") - F.col("tb")) < semitones) & (F.abs(F.col("ra") - F.col("rb")) < range_gap) & (F.col("va") / F.col("vb") > low) & (F.col("va") / F.col("vb") < high)
    return a.join(b, [group, "cell"]).where((F.col("a") < F.col("b")) & near).select(group, "a", "b")


def missing(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """JN-13."""
    return expected.select(*key).distinct().join(actual.select(*key), key, "left_anti")


def keep_used(df: DataFrame, used: DataFrame, key: list[str]) -> DataFrame:
    """JN-14."""
    return df.join(used.select(*key).distinct(), key, "left_semi")


def with_context(rows: DataFrame, context: DataFrame, keys: list[str], order: str, text="text", name="context") -> DataFrame:
    """JN-15: a key's texts in order, on each of its rows."""
    joined = context.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_c"))
    return rows.join(joined.select(*keys, F.array_join(F.transform("_c", lambda x: x[text]), " ").alias(name)), keys, "left")


def canonical_key(rows: DataFrame, allowed: DataFrame, col: str, slug: Column) -> DataFrame:
    """JN-16: a key as it is if allowed, else its slug if allowed, else null."""
    known = allowed.select(F.col(col).alias("_k")).distinct()
    once = rows.withColumn("_slug", slug).join(known.withColumnRenamed("_k", "_exact"), F.col(col) == F.col("_exact"), "left")
    both = once.join(known.withColumnRenamed("_k", "_by_slug"), F.col("_slug") == F.col("_by_slug"), "left")
    return both.withColumn("key", F.coalesce("_exact", "_by_slug")).drop("_slug", "_exact", "_by_slug")


def reassign(rows: DataFrame, dropped: DataFrame, fallback: DataFrame, key: str, attribute: str) -> DataFrame:
    """JN-17: rows of a dropped key go to the fallback of their attribute."""
    gone = dropped.select(key).distinct().withColumn("_gone", F.lit(True))
    back = fallback.select(attribute, F.col(key).alias("_back"))
    return rows.join(gone, key, "left").join(back, attribute, "left").withColumn(key, F.when(F.col("_gone"), F.col("_back")).otherwise(F.col(key))).drop("_gone", "_back")


def apply_gain(rows: DataFrame, gains: DataFrame, key: str, value: str, gain="gain_db") -> DataFrame:
    """JN-18."""
    return rows.join(gains.select(key, gain), key, "left").withColumn(value, F.col(value) * F.pow(F.lit(10.0), F.coalesce(gain, F.lit(0.0)) / 20)).drop(gain)


def cosine(a: Column, b: Column) -> Column:
    """JN-19: cosine of two vectors; null if either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def remap_ids(rows: DataFrame, id_map: DataFrame, part="part", old="old_id", new="new_id", col="chapter_id") -> DataFrame:
    """JN-20."""
    return rows.join(id_map.select(part, F.col(old).alias(col), new), [part, col], "left").withColumn(col, F.coalesce(new, col)).drop(new)


def carry_over(whole: DataFrame, parts: DataFrame, cols: list[str], doc="doc_id", whole_order=("seg_order",), part_order=("part", "seg_order")) -> DataFrame:
    """JN-21: columns of the parts' rows on the whole's rows of the same rank."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(*whole_order))
    return whole.withColumn("_n", n).join(_ranked(parts, doc, list(part_order), cols, "carried_"), [doc, "_n"], "left").drop("_n")
