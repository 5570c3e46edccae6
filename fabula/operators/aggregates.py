"""Aggregations, registers, set checks, JSON and array helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def corpus_stats(segments: DataFrame, keys: list[str], text="text", review="needs_review") -> DataFrame:
    """AGG-1."""
    return segments.groupBy(*keys).agg(F.count("*").alias("segments"), F.count_if(F.col(review)).alias("to_review"), F.max(F.length(text)).alias("max_chars"), F.sum(F.length(text)).alias("chars"))


def lines_per_speaker(spans: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-2."""
    return spans.groupBy(*keys).agg(F.count("*").alias("lines"))


def duration_by(segments: DataFrame, keys: list[str], ms: str) -> DataFrame:
    """AGG-3: in whole milliseconds."""
    return segments.groupBy(*keys).agg(F.sum(ms).alias("total_ms"))


def histogram(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-4."""
    return tokens.groupBy(*keys).agg(F.count("*").alias("n"))


def length_report(segments: DataFrame, keys: list[str], text="text", short=60, tiny=25) -> DataFrame:
    """AGG-5. The upper median is the value at rank floor(n / 2) counted from 0; lengths are counted first, so a group
    gathers one entry per different length."""
    from pyspark.sql import Window as W

    lengths = segments.groupBy(*keys, F.length(text).alias("len")).agg(F.count("*").alias("n"))
    upto = lengths.withColumn("upto", F.sum("n").over(W.partitionBy(*keys).orderBy("len"))).withColumn("all", F.sum("n").over(W.partitionBy(*keys)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("all") / 2), F.col("len")))
    return upto.groupBy(*keys).agg(
        F.sum("n").alias("segments"), F.sum(F.when(F.col("len") < short, F.col("n")).otherwise(0)).alias("short"), F.sum(F.when(F.col("len") < tiny, F.col("n")).otherwise(0)).alias("tiny"),
        middle.alias("upper_median"), F.min("len").alias("min_len"), F.max("len").alias("max_len"),
    )


def gain_plan(levels: DataFrame, keys: list[str], role: str, lufs="lufs", peak="true_peak_db", target=-20.0, limit=-1.5) -> DataFrame:
    """AGG-6: one common level that no role's peak forbids, and each role's gain; silent roles get 0."""
    from pyspark.sql import Window as W

    every = W.partitionBy(*keys)
    heard = F.col(lufs).isNotNull() & ~F.isnan(lufs) & (F.abs(F.col(lufs)) != float("inf"))
    common = F.least(F.lit(target), F.min(F.when(heard, F.col(lufs) + limit - F.col(peak) - 0.1)).over(every))
    return levels.withColumn("common", F.when(F.count_if(heard).over(every) > 0, common)).withColumn("gain_db", F.when(F.col("common").isNull(), None).when(heard, F.col("common") - F.col(lufs)).otherwise(0.0))


def run_report(takes: DataFrame, keys: list[str], audio: str, wall: str, fresh: str, score: str, problems: str) -> DataFrame:
    """AGG-7."""
    return takes.groupBy(*keys).agg(
        F.sum(audio).alias("audio_ms"), F.sum(wall).alias("wall_ms"), F.count_if(F.col(fresh)).alias("fresh"), F.count_if(~F.col(fresh)).alias("cached"), F.count_if(F.col(problems) > 0).alias("with_problems"),
        F.percentile(score, F.lit(0.5)).alias("median_score"), F.min(score).alias("min_score"),
    )


def merge_registry(rows: DataFrame, keys: list[str], name="name", gender="gender", order="ord") -> DataFrame:
    """AGG-8: the first name wins, other spellings are sorted aliases, the first known gender stays."""
    known = F.col(gender).isin("male", "female")
    got = rows.groupBy(*keys).agg(F.min_by(name, order).alias("name"), F.collect_set(name).alias("_all"), F.min_by(gender, F.when(known, F.col(order))).alias("_gender"))
    return got.select(*keys, "name", F.array_sort(F.array_except("_all", F.array("name"))).alias("aliases"), F.coalesce("_gender", F.lit("unknown")).alias("gender"))


def first_seen(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """AGG-9."""
    return df.groupBy(*keys).agg(F.min_by(value, order).alias(value), F.min(order).alias("first_order"))


def unambiguous(df: DataFrame, key: str, value: str) -> DataFrame:
    """AGG-10: (key, variants, value): the value only where it is the one variant."""
    got = df.groupBy(key).agg(F.count_distinct(value).alias("variants"), F.min(value).alias("_v"))
    return got.select(key, "variants", F.when(F.col("variants") == 1, F.col("_v")).alias(value))


def mark_stats(segments: DataFrame, keys: list[str], text: str, original: str) -> DataFrame:
    """AGG-12."""
    marks = lambda c: F.regexp_count(F.col(c), F.lit("[́ёЁ]"))
    return segments.groupBy(*keys).agg(F.sum(marks(text)).alias("marks"), F.sum(F.greatest(F.lit(0), marks(text) - marks(original))).alias("restored"))


def arbitration_summary(audit: DataFrame, keys: list[str]) -> DataFrame:
    """AGG-13."""
    return audit.groupBy(*keys).agg(F.count("*").alias("disputes"), F.count_if(F.col("before") != F.col("after")).alias("changed"), F.count_if(F.col("error").isNotNull()).alias("errors"))


def ordered_groups(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """AGG-14: groups with their first order, to sort by."""
    return df.groupBy(*keys).agg(F.min(order).alias("first_order"), F.count("*").alias("n"))


def review_list(segments: DataFrame, default="check") -> DataFrame:
    """AGG-15."""
    return segments.where("needs_review").withColumn("reason", F.coalesce(F.nullif("reason", F.lit("")), F.lit(default)))


# sets
def union_parts(*parts: tuple[int, DataFrame], col="id", width=2) -> DataFrame:
    """SET-1: rows of parts with their ids prefixed by part."""
    out = None
    for n, df in parts:
        own = df.withColumn(col, F.concat(F.lit(f"p{n:0{width}d}-"), F.col(col).cast("string"))).withColumn("part", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def same_keys(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """SET-2: keys that are missing, extra or answered twice: (key, rule)."""
    a = expected.groupBy(key).agg(F.count("*").alias("want"))
    b = actual.groupBy(key).agg(F.count("*").alias("got"))
    rule = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("got") > F.col("want"), "duplicate")
    return a.join(b, key, "full").select(key, rule.alias("rule")).where("rule IS NOT NULL")


def union_keys(key: str, *dfs: DataFrame) -> DataFrame:
    """SET-3."""
    out = dfs[0].select(key)
    for df in dfs[1:]:
        out = out.union(df.select(key))
    return out.distinct()


def alias_set(a: Column, b: Column, name: Column) -> Column:
    """SET-4."""
    return F.array_sort(F.array_except(F.array_union(a, b), F.array(name)))


def lost_identity(before: DataFrame, after: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """SET-5: keys that are gone or changed: (key, rule)."""
    new = after.select(key, *[F.col(c).alias(f"_{c}") for c in attributes], F.lit(True).alias("_there"))
    joined = before.join(new, key, "left")
    differ = [F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in attributes]
    return joined.select(key, F.when(F.col("_there").isNull(), "lost").otherwise(F.concat_ws(",", *differ)).alias("rule")).where("rule <> ''")


# JSON, arrays, maps
def parse_reply(col: Column) -> Column:
    """JSN-1: the JSON object of an answer: fences stripped, the first {...} kept, null if it isn't an object."""
    bare = F.regexp_replace(F.trim(col), r"^```[a-zA-Z]*\s*|\s*```$", "")
    found = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\})", 1), F.lit(""))
    return F.when(F.json_object_keys(found).isNotNull(), found)


def exact_fields(col: Column, names: list[str]) -> Column:
    """JSN-2."""
    return F.coalesce(F.array_sort(F.json_object_keys(col)) == F.array(*[F.lit(n) for n in sorted(names)]), F.lit(False))


def prop(col: Column, path: str) -> Column:
    """JSN-3."""
    return F.get_json_object(col, path)


def token_diff(df: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    """ARR-1: positions at which two token arrays differ."""
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(F.col(a).alias("before"), F.col(b).alias("after"))).alias("pos", "t"))
    return zipped.select(*keys, "pos", F.col("t.before").alias("before"), F.col("t.after").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def size_mismatch(df: DataFrame, a: str, b: str) -> DataFrame:
    """ARR-2."""
    return df.where(F.size(a) != F.size(b))
