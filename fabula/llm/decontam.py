"""Benchmark decontamination with DataFrame functions only.

A benchmark item of n words is compared with document windows of the item's size. The similarity knows no order, so windows
come from the places where shingles of the item stand, wherever in the item those are: a window of similarity s holds at
least s times the item's size of them, and a whole one 2s / (1 + s) times. Every start that has so many is made and no other:
no window that can match goes unmade, be the words inserted, deleted or moved. Windows and items get a SimHash of
their shingles with multiplicities as weights. Fingerprints are cut into RADIUS + 1 blocks: two within the radius agree in
a block at least (pigeonhole), so the join on blocks finds all of them. The exact similarity, the sum of the smaller over
the sum of the larger multiplicities, then decides.

Defined cases: text and items are lower-cased and split at ``[\\x20\\x09-\\x0D]+``; items of fewer than five words are one
shingle; windows stop at a document's ends; null or wordless texts and items match nothing, nor does a null doc_id; rows that repeat a document
give its pairs once; a repeated item_id counts as the item of its smallest text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import SPACE, documents, materialize, new_name, table

WORDS = 5
SIMILARITY = 0.8
BITS = 64
#: Of 64 bits about 9.7 +- 2.9 differ at similarity 0.8; 24 is five deviations above.
RADIUS = 24
#: Shingles of items that are broadcast; with more, the join is a shuffle.
BROADCAST_ROWS = 1_000_000


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), f"[{SPACE}]+"), "")


def _shingles(text: Column, k: int) -> Column:
    """Hashes of the runs of k words, in order. The words are bound once, not split anew for every run."""
    inner = lambda w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    return F.element_at(F.transform(F.array(_words(text)), inner), 1)


def item_shingles(benchmark: DataFrame) -> DataFrame:
    """(item_id, k, item_size, j, h): the shingles of each item by place; k is 5, or the words of a shorter item."""
    items = benchmark.where(F.col("item_id").isNotNull()).groupBy("item_id").agg(F.min("text").alias("text"))
    sized = items.withColumn("k", F.least(F.size(_words(F.col("text"))), F.lit(WORDS)))
    parts = [sized.where(F.col("k") == k).select("item_id", "k", _shingles(F.col("text"), k).alias("hs")) for k in range(1, WORDS + 1)]
    whole = reduce(DataFrame.unionByName, parts)
    return whole.select("item_id", "k", F.size("hs").alias("item_size"), F.posexplode("hs").alias("j", "h"))


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """SimHash of each key's shingles ``h``, one row per occurrence: bit b is set if most of them have it."""
    counts = [F.sum(F.shiftright("h", b).bitwiseAND(F.lit(1))).alias(f"b{b}") for b in range(BITS)]
    sums = rows.groupBy(*keys).agg(F.count("*").alias("n"), *counts)
    bit = lambda b: F.when(F.col(f"b{b}") * 2 > F.col("n"), F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
    return sums.select(*keys, "n", reduce(lambda x, y: x.bitwiseOR(y), [bit(b) for b in range(BITS)]).alias("print"))


def hamming_blocks(fingerprint: Column, radius: int = RADIUS) -> Column:
    """radius + 1 blocks of the fingerprint as (block, value) structs."""
    cuts = [BITS * i // (radius + 1) for i in range(radius + 2)]
    parts = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << b - a) - 1)).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return F.array(*parts)


def _least(share: Column, size: Column) -> Column:
    """The least whole number that is not under a share of the size."""
    return F.ceil(share * size - F.lit(1e-9)).cast("int")


def window_starts(places: Column, size: Column, length: Column, similarity: float) -> Column:
    """Ranges (a, b) of the starts of all windows with enough of the sorted ``places``; no start is in two of them.

    With p the places, a window of ``size`` holds c of them if and only if it starts in p[r + c - 1] - size + 1 .. p[r] for
    some r; both ends grow with r, so cutting each range at p[r - 1] makes them disjoint. Windows over an end of the
    ``length`` shingles are shorter, which lowers c.
    """

    def ranges(c: Column, low: Column, high: Column) -> Column:
        each = F.filter(F.sequence(F.lit(0), F.size(places) - 1), lambda r: r + c <= F.size(places))
        cut = lambda r: F.struct(F.greatest(F.get(places, r + c - 1) - size + 1, F.get(places, r - 1) + 1, low).alias("a"), F.least(F.get(places, r), high).alias("b"))
        return F.filter(F.transform(each, cut), lambda x: x["a"] <= x["b"])

    part, full = _least(F.lit(similarity), size), _least(F.lit(2 * similarity / (1 + similarity)), size)
    last = length - size
    return F.concat(ranges(part, -size, F.lit(-1)), ranges(full, F.lit(0), last), ranges(part, F.greatest(last + 1, F.lit(0)), length))


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """Pairs (doc_id, item_id) with their best window: window_start (in shingles), hamming, similarity, text_hash."""
    items = materialize(item_shingles(benchmark), "benchmark-shingles")
    kinds = {r.k: r.n for r in items.groupBy("k").agg(F.count("*").alias("n")).collect()}  # five rows at most
    if not kinds:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, window_start int, hamming int, similarity double, text_hash long")
    small = sum(kinds.values()) <= BROADCAST_ROWS
    docs = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    hits = []
    for k in kinds:
        own = items.where(F.col("k") == k).select("item_id", "item_size", "h").distinct()
        exploded = docs.select("doc_id", "text_hash", F.posexplode(_shingles(F.col("text"), k)).alias("i", "h"))
        hits.append(exploded.join(F.broadcast(own) if small else own, "h").select("doc_id", "text_hash", "item_id", "item_size", F.lit(k).alias("k"), "i"))
    hits = reduce(DataFrame.unionByName, hits)
    # the overlap must reach the similarity times the item's size, and each shared occurrence has a place of its own
    lines = hits.groupBy("doc_id", "text_hash", "item_id", "item_size", "k").agg(F.sort_array(F.collect_set("i")).alias("places"))
    lines = materialize(lines.where(F.size("places") >= _least(F.lit(similarity), F.col("item_size"))), "benchmark-hits")
    whole = docs.join(lines.select("doc_id", "text_hash").distinct(), ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
    whole = materialize(whole.withColumn("n_words", F.size(_words(F.col("text")))), "benchmark-docs")
    sized = lines.join(whole.select("doc_id", "text_hash", "n_words"), ["doc_id", "text_hash"])
    ranges = sized.select("doc_id", "text_hash", "item_id", "item_size", "k", F.inline(window_starts(F.col("places"), F.col("item_size"), F.col("n_words") - F.col("k") + 1, similarity)))
    spots = ranges.select("doc_id", "text_hash", "item_id", "item_size", "k", F.explode(F.sequence("a", "b")).alias("window_start"))
    found = []
    for k in kinds:
        arrays = whole.select("doc_id", "text_hash", _shingles(F.col("text"), k).alias("hs"))
        first = F.greatest(F.col("window_start"), F.lit(0))
        last = F.least(F.col("window_start") + F.col("item_size"), F.size("hs"))
        cut = spots.where(F.col("k") == k).join(arrays, ["doc_id", "text_hash"]).where(last > first)
        found.append(cut.select("doc_id", "text_hash", "item_id", "item_size", "window_start", F.explode(F.slice("hs", first + 1, last - first)).alias("h")))
    keys = ["doc_id", "text_hash", "item_id", "item_size", "window_start"]
    windows = materialize(reduce(DataFrame.unionByName, found), "benchmark-windows")
    sought = fingerprints(items, ["item_id"]).select("item_id", F.col("print").alias("item_print"), F.explode(hamming_blocks(F.col("print"), radius)).alias("part"))
    prints = fingerprints(windows, keys).select(*keys, "n", "print", F.explode(hamming_blocks(F.col("print"), radius)).alias("part"))
    near = prints.join(sought, ["item_id", "part"]).select(*keys, "n", F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))).alias("hamming")).where(F.col("hamming") <= radius).distinct()
    counted = windows.groupBy(*keys, "h").agg(F.count("*").alias("in_window"))
    known = items.groupBy("item_id", "h").agg(F.count("*").alias("in_item"))
    shared = counted.join(known, ["item_id", "h"]).groupBy(*keys).agg(F.sum(F.least("in_window", "in_item")).alias("shared"))
    exact = near.join(shared, keys).withColumn("similarity", F.col("shared") / (F.col("n") + F.col("item_size") - F.col("shared")))
    best = exact.where(F.col("similarity") >= similarity).groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("similarity", -F.col("window_start"), "hamming")).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.col2")).alias("window_start"), F.col("best.hamming").alias("hamming"), F.col("best.similarity").alias("similarity"), "text_hash")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents whose text holds no benchmark item."""
    key = new_name("text_hash", docs)
    found = contaminated(docs, benchmark).select("doc_id", F.col("text_hash").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(found, ["doc_id", key], "left_anti").select(*docs.columns)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text_hash")
