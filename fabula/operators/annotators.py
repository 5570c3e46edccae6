"""A second annotator as a plugged-in model, and many fragments or names looked for in one pass over the texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions.rules import ACUTE
from fabula.functions.text import letters

WORD = rf"[\p{{L}}{ACUTE}]+"
#: Readings or names that every worker may hold; more are joined.
SHARED_ENTRIES = 200_000


def _words(col: Column) -> Column:
    return F.regexp_extract_all(col, F.lit(WORD), F.lit(0))


def second_annotator(segments: DataFrame, block: list[str], order: str, text: str, fallback: str, make: Callable[[], Callable[[str], str]]) -> DataFrame:
    """UDF-1: the segments with ``annotated`` and ``annotator_valid``.

    A block's segments are put together, their marks are taken off, and a model says the block as a whole; ``make`` builds the
    model once in a task. A saying is valid if it has the block's words in order, whose letters, marks aside, are
    the same (ё may stand for е). Its words then go back to the segments by their counts, between the segments' own signs; else
    the whole block keeps ``fallback`` (the dictionary's text). A null text or saying counts as empty; an empty table gives
    no rows; other columns stay.
    """
    said, valid, place = "annotated", "annotator_valid", "_segment"

    @F.pandas_udf("string")
    def say(blocks: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in blocks:
            yield texts.map(lambda t: model(t) if t else t)

    body = F.coalesce(F.col(text), F.lit(""))
    rows = segments.withColumn(place, F.struct(F.col(order).alias("o"), body.alias("t"), F.coalesce(F.col(fallback), body).alias("f"), F.struct(*[F.col(c) for c in segments.columns]).alias("row")))
    whole = rows.groupBy(*block).agg(F.array_sort(F.collect_list(place), lambda a, b: F.when(a["o"] < b["o"], -1).when(a["o"] > b["o"], 1).otherwise(0)).alias("_s"))
    whole = whole.withColumn("_clean", F.array_join(F.transform("_s", lambda s: F.replace(s["t"], F.lit(ACUTE), F.lit(""))), " "))
    whole = whole.withColumn("_said", _words(F.coalesce(say("_clean"), F.lit("")))).withColumn("_own", _words(F.col("_clean")))
    same = (F.size("_said") == F.size("_own")) & F.forall(F.arrays_zip(F.col("_own").alias("a"), F.col("_said").alias("b")), lambda w: letters(w["a"]).eqNullSafe(letters(w["b"])))
    counts = F.transform("_s", lambda s: F.size(_words(s["t"])))
    before = F.transform(counts, lambda _, i: F.aggregate(F.slice(F.col("_n"), F.lit(1), i), F.lit(0), lambda a, b: a + b))
    placed = whole.withColumn("_valid", same).withColumn("_n", counts).withColumn("_from", before)
    each = placed.select("_said", "_valid", F.inline(F.arrays_zip("_s", "_n", "_from")))
    gaps = F.split(F.col("_s.t"), WORD)
    own = F.slice("_said", F.col("_from") + 1, F.greatest(F.col("_n"), F.lit(0)))
    marked = F.array_join(F.zip_with(gaps, own, lambda g, w: F.concat(F.coalesce(g, F.lit("")), F.coalesce(w, F.lit("")))), "")
    return each.select("_s.row.*", F.when(F.col("_valid"), marked).otherwise(F.col("_s.f")).alias(said), F.col("_valid").alias(valid))


def _few(df: DataFrame) -> bool:
    return df.limit(SHARED_ENTRIES + 1).count() <= SHARED_ENTRIES


def replace_fragments(df: DataFrame, keys: list[str], text: str, readings: DataFrame, pattern: str) -> DataFrame:
    """MAP-1: fragments of a text (what ``pattern`` finds) by their readings, others as they are.

    Up to SHARED_ENTRIES readings go to all tasks and each text is put together where it is; more are joined to the exploded
    fragments. A fragment with several readings takes the least; a null text stays null.
    """
    table = readings.where(F.col("fragment").isNotNull()).groupBy("fragment").agg(F.min("reading").alias("reading"))
    parts, found = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if not _few(table):
        numbered = df.withColumn("_parts", parts).withColumn("_found", found)
        each = numbered.select(*keys, F.posexplode("_found").alias("_i", "fragment")).join(table, "fragment", "left")
        said = each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("reading", "fragment").alias("_r")))).alias("_said"))
        joined = numbered.join(said, keys, "left")
        own = F.coalesce(F.transform("_said", lambda x: x["_r"]), F.array().cast("array<string>"))
        return joined.withColumn(text, F.array_join(F.zip_with("_parts", own, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")).drop("_parts", "_found", "_said")
    shared = df.sparkSession.sparkContext.broadcast(dict(table.toPandas().itertuples(index=False)))  # SHARED_ENTRIES at most
    names = df.columns

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            said = [None if p is None else "".join([x for a, b in zip(p, [*f, ""], strict=True) for x in (a, get(b, b))]) for p, f in zip(batch.column("_p").to_pylist(), batch.column("_f").to_pylist(), strict=True)]
            kept = [pa.array(said, pa.string()) if c == text else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(kept, names)

    return df.withColumn("_p", parts).withColumn("_f", found).mapInArrow(replaced, df.schema)


def names_in(df: DataFrame, text: str, names: DataFrame, name: str, keep: list[str]) -> DataFrame:
    """(keep columns, name, times): which of up to SHARED_ENTRIES names a text holds, in any case, by one automaton over all names."""
    import ahocorasick

    distinct = [r[0] for r in names.where(F.length(name) > 0).select(F.lower(name)).distinct().collect()]  # the caller has checked their number
    if not distinct:
        return df.select(*keep, F.lit("").alias("name"), F.lit(0).cast("long").alias("times")).where("false")
    shared = df.sparkSession.sparkContext.broadcast(distinct)
    low = df.select(*keep, F.lower(F.coalesce(F.col(text), F.lit(""))).alias("_low"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for k, n in enumerate(shared.value):
            machine.add_word(n, k)
        machine.make_automaton()
        for batch in batches:
            rows, which, times = [], [], []
            for i, t in enumerate(batch.column("_low").to_pylist()):
                own: dict[int, int] = {}
                for _, k in machine.iter(t):
                    own[k] = own.get(k, 0) + 1
                rows += [i] * len(own)
                which += [shared.value[k] for k in own]
                times += own.values()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in keep], pa.array(which, pa.string()), pa.array(times, pa.int64())], [*keep, "name", "times"])

    kinds = {f.name: f.dataType.simpleString() for f in low.schema}
    return low.mapInArrow(found, ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", name string, times long")
