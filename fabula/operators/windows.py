"""Order-dependent window operators: pauses, timelines, islands, ranks. Every one is partitioned by document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.operators.ordered import running_medians

_TAIL = r"[\s»”\"'’)\]}—–-]+$"


def _over(doc: str, order: str):
    return W.partitionBy(doc).orderBy(order)


def boundary_pause(rows: DataFrame, doc="doc_id", order="seg_order", block="block_id", speaker="speaker", text="text", sentence_ms=450, paragraph_ms=800) -> DataFrame:
    """W-1: ``pause_ms`` from a row's ending and the next row; a block's end wins over punctuation."""
    w = _over(doc, order)
    tail = F.regexp_replace(F.coalesce(text, F.lit("")), _TAIL, "")
    new_block = ~F.lead(block).over(w).eqNullSafe(F.col(block)) | F.lead(F.lit(True)).over(w).isNull()
    pause = (
        F.when(new_block, paragraph_ms)
        .when(tail.rlike(r"(…|\.\.\.)$"), max(sentence_ms, 700))
        .when(tail.rlike(r"[?!]$"), max(sentence_ms, 600))
        .when(tail.rlike(r"\.$"), sentence_ms)
        .when(~F.lead(speaker).over(w).eqNullSafe(F.col(speaker)), 180)
        .otherwise(100)
    )
    return rows.withColumn("pause_ms", pause)


def seal_groups(rows: DataFrame, group: str, doc="doc_id", order="seg_order", pause="pause_ms") -> DataFrame:
    """W-2: no pause where the next row is in the same (non-null) group."""
    same = F.lead(group).over(_over(doc, order)) == F.col(group)
    return rows.withColumn(pause, F.when(F.coalesce(same, F.lit(False)), 0).otherwise(F.col(pause)))


def final_pauses(rows: DataFrame, block="block_id", chapter="chapter_id", doc="doc_id", order="seg_order", pause="pause_ms", block_ms=300, chapter_ms=700) -> DataFrame:
    """W-3: the last row of a block, then of a chapter, has its own pause."""
    last = lambda key: F.row_number().over(W.partitionBy(doc, key).orderBy(F.desc(order))) == 1
    return rows.withColumn(pause, F.when(last(chapter), chapter_ms).when(last(block), block_ms).otherwise(F.col(pause)))


def timeline(rows: DataFrame, audio: str, pause: str, doc="doc_id", order="seg_order") -> DataFrame:
    """W-4: start and end in whole units (frames or milliseconds), so that sums are exact."""
    before = _over(doc, order).rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col(audio) + F.col(pause)).over(before), F.lit(0))
    return rows.withColumn("start", start).withColumn("end", F.col("start") + F.col(audio))


def clip_ends(rows: DataFrame, total: Column, start="start", doc="doc_id", order="seg_order") -> DataFrame:
    """W-5: a clip ends where the next starts, the last at the total."""
    return rows.withColumn("clip_end", F.coalesce(F.lead(start).over(_over(doc, order)), total))


def chapter_marks(rows: DataFrame, total="total", chapter="chapter_id", doc="doc_id", start="start") -> DataFrame:
    """W-6: (doc, chapter, mark_start, mark_end)."""
    first = rows.groupBy(doc, chapter).agg(F.min(start).alias("mark_start"), F.max(total).alias("total"))
    return first.withColumn("mark_end", F.coalesce(F.lead("mark_start").over(W.partitionBy(doc).orderBy("mark_start")), F.col("total"))).drop("total")


def part_offsets(parts: DataFrame, seconds: str, part="part", doc="doc_id") -> DataFrame:
    """W-7: sum of the earlier parts."""
    before = W.partitionBy(doc).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("offset", F.coalesce(F.sum(seconds).over(before), F.lit(0)))


def islands(rows: DataFrame, key: str, doc="doc_id", order="seg_order", name="island") -> DataFrame:
    """W-8: number of the run of equal keys a row is in; a null key stands alone."""
    w = _over(doc, order)
    new = F.when(F.lag(key).over(w) == F.col(key), 0).otherwise(1)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_new")


def merge_seam_chapters(chapters: DataFrame, doc="doc_id", part="part", order="chapter_order", href="href") -> DataFrame:
    """W-9: whether a part's first chapter goes on from the last one of the part before."""
    w = W.partitionBy(doc).orderBy(part, order)
    first = F.row_number().over(W.partitionBy(doc, part).orderBy(order)) == 1
    return chapters.withColumn("continues", F.coalesce(first & (F.lag(href).over(w) == F.col(href)), F.lit(False)))


def rank_voices(cast: DataFrame, doc="doc_id", reserved="reserved", lines="lines", order="ord", base=17000) -> DataFrame:
    """W-10: numbers and seeds, reserved voices last, then by lines."""
    n = F.row_number().over(W.partitionBy(doc).orderBy(reserved, F.desc(lines), order))
    return cast.withColumn("voice_no", n).withColumn("seed", F.lit(base) + n)


def renumber(rows: DataFrame, prefix="seg", width=6, doc="doc_id", order="seg_order") -> DataFrame:
    """W-11: dense orders and ids."""
    n = F.row_number().over(_over(doc, order))
    return rows.withColumn("new_order", n - 1).withColumn("new_id", F.concat(F.lit(prefix), F.lpad(n.cast("string"), width, "0")))


def alternate(rows: DataFrame, doc="doc_id", order="seg_order") -> DataFrame:
    """W-12: sides A and B in turn."""
    return rows.withColumn("side", F.when(F.pmod(F.row_number().over(_over(doc, order)) - 1, F.lit(2)) == 0, "A").otherwise("B"))


def adaptive_floor(takes: DataFrame, score: str, key: str, order: str, floor=0.5, slack=0.1, least=5) -> DataFrame:
    """W-13: 0.5 until five values are seen, then their median less a slack, not under 0.5."""
    rows = running_medians(takes, [key], [order], score, "_median", "_seen")
    return rows.withColumn("floor", F.when(F.col("_seen") >= least, F.greatest(F.lit(floor), F.col("_median") - slack)).otherwise(floor)).drop("_median", "_seen")


def adaptive_band(takes: DataFrame, tempo: str, key: str, order: str, low=0.6, high=1.45, least=6.0, most=20.0) -> DataFrame:
    """W-14: band around the running median of all earlier tempos, clamped (the gate that leaves out flagged takes is streaming.running_gate)."""
    rows, median = running_medians(takes, [key], [order], tempo, "_median", "_seen"), F.col("_median")
    clamp = lambda c: F.least(F.greatest(c, F.lit(least)), F.lit(most))
    return rows.withColumn("tempo_low", F.coalesce(clamp(median * low), F.lit(least))).withColumn("tempo_high", F.coalesce(clamp(median * high), F.lit(most))).drop("_median", "_seen")


def pause_runs(frames: DataFrame, voiced="voiced", clip="clip_id", frame="frame", least=90) -> DataFrame:
    """W-15: runs of at least ``least`` unvoiced frames between a clip's first and last voiced frame."""
    every = W.partitionBy(clip)
    spoken = frames.withColumn("_a", F.min(F.when(F.col(voiced), F.col(frame))).over(every)).withColumn("_b", F.max(F.when(F.col(voiced), F.col(frame))).over(every))
    inside = spoken.where(F.col(frame).between(F.col("_a"), F.col("_b")))
    runs = islands(inside.withColumn("_v", F.col(voiced).cast("int")), "_v", clip, frame)
    return runs.where(~F.col(voiced)).groupBy(clip, "island").agg(F.min(frame).alias("run_start"), F.count("*").alias("run_frames")).where(F.col("run_frames") >= least).drop("island")


def share(rows: DataFrame, group: list[str], metric: str, weight: str) -> DataFrame:
    """W-16: a group's metric by weight."""
    return rows.withColumn("share", F.col(metric) * F.col(weight) / F.sum(weight).over(W.partitionBy(*group)))


def overlaps(rows: DataFrame, start="start", end="end", doc="doc_id", order="seg_order") -> DataFrame:
    """W-17: rows that start before the row before them ends."""
    return rows.withColumn("previous_end", F.lag(end).over(_over(doc, order))).where(F.col(start) < F.col("previous_end"))


def cumulative(rows: DataFrame, weight: str, doc="doc_id", order="seg_order") -> DataFrame:
    """W-18: running sum."""
    return rows.withColumn("running", F.sum(weight).over(_over(doc, order).rowsBetween(W.unboundedPreceding, 0)))
