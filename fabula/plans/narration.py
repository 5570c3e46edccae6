"""Queries on conversations as narrated segments: a conversation is a document, a turn a block, a role a speaker."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.operators import aggregates as A
from fabula.operators import annotators, folds, joins, projections, segments, topk, windows
from fabula.plans.registry import query
from fabula.session import table


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Rows of segments: the lines of each turn in order, numbered from 0 in each conversation."""
    from pyspark.sql import Window as W

    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line", "text"))
    n = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "line")) - 1
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("block_id"), F.floor(F.col("turn") / 4).cast("long").alias("chapter_id"), F.col("role").alias("speaker"), "text", n.cast("long").alias("seg_order"))


def timed(spark: SparkSession, d: str) -> DataFrame:
    """Segments with pauses and their places on a timeline in milliseconds; reading speed 14 characters a second."""
    paused = windows.boundary_pause(lines(spark, d))
    return windows.timeline(paused.withColumn("audio_ms", F.floor(F.length("text") * 1000 / 14)), "audio_ms", "pause_ms")


SEG = """WITH ex AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS line FROM conversations),
seg AS (SELECT conv_id AS doc_id, turn AS block_id, turn // 4 AS chapter_id, role AS speaker, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, line) - 1 AS seg_order FROM ex)"""
TIMED = (
    SEG
    + r""", nxt AS (SELECT *, lead(block_id) OVER w AS nb, lead(speaker) OVER w AS ns, regexp_replace(text, '[\s»”"''’)\]}—–-]+$', '') AS tail FROM seg WINDOW w AS (PARTITION BY doc_id ORDER BY seg_order)),
paused AS (SELECT * EXCLUDE (nb, ns, tail), CASE WHEN nb IS DISTINCT FROM block_id THEN 800 WHEN regexp_matches(tail, '(…|\.\.\.)$') THEN 700 WHEN regexp_matches(tail, '[?!]$') THEN 600
 WHEN regexp_matches(tail, '\.$') THEN 450 WHEN ns IS DISTINCT FROM speaker THEN 180 ELSE 100 END AS pause_ms FROM nxt),
tl AS (SELECT *, (length(text) * 1000 // 14)::BIGINT AS audio_ms, coalesce(sum(length(text) * 1000 // 14 + pause_ms) OVER (PARTITION BY doc_id ORDER BY seg_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM paused),
timed AS (SELECT *, start + audio_ms AS "end" FROM tl)"""
)


@query(
    TIMED
    + """, b AS (SELECT doc_id, block_id, sum(audio_ms + pause_ms) AS ms FROM timed GROUP BY ALL),
r AS (SELECT *, sum(ms) OVER (PARTITION BY doc_id ORDER BY block_id) AS running, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS n FROM b),
k AS (SELECT * FROM r WHERE running - ms < 60000), best AS (SELECT doc_id, min((abs(running - 60000), n)) AS m FROM k GROUP BY 1)
SELECT doc_id, block_id, ms::BIGINT AS ms, running::BIGINT AS running FROM k JOIN best USING (doc_id) WHERE n <= m[2]"""
)
def timeline_excerpt(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: pauses, timeline, and the prefix of turns of each conversation nearest to a minute."""
    blocks = timed(spark, d).groupBy("doc_id", "block_id").agg(F.sum(F.col("audio_ms") + F.col("pause_ms")).alias("ms"))
    return topk.excerpt(blocks, "ms", 60_000).select("doc_id", "block_id", "ms", "running")


@query(
    TIMED
    + """, i AS (SELECT *, CASE WHEN lag(speaker) OVER (PARTITION BY doc_id ORDER BY seg_order) = speaker THEN 0 ELSE 1 END AS new FROM timed),
g AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY seg_order) AS island FROM i),
s AS (SELECT *, CASE WHEN lead(island) OVER (PARTITION BY doc_id ORDER BY seg_order) = island THEN 0 ELSE pause_ms END AS sealed_ms FROM g)
SELECT doc_id, seg_order, pause_ms::INTEGER AS pause_ms, sealed_ms::INTEGER AS sealed_ms, island::BIGINT AS island,
 (CASE WHEN row_number() OVER (PARTITION BY doc_id, chapter_id ORDER BY seg_order DESC) = 1 THEN 700 WHEN row_number() OVER (PARTITION BY doc_id, block_id ORDER BY seg_order DESC) = 1 THEN 300 ELSE pause_ms END)::INTEGER AS final_ms FROM s"""
)
def pause_rules(spark: SparkSession, d: str) -> DataFrame:
    rows = windows.islands(timed(spark, d), "speaker").withColumn("sealed_ms", F.col("pause_ms")).withColumn("final_ms", F.col("pause_ms"))
    rows = windows.final_pauses(windows.seal_groups(rows, "island", pause="sealed_ms"), pause="final_ms")
    return rows.select("doc_id", "seg_order", "pause_ms", "sealed_ms", "island", "final_ms")


@query(
    TIMED
    + """, t AS (SELECT doc_id, chapter_id, min(start) AS mark_start, max(total) AS total FROM (SELECT *, max("end" + pause_ms) OVER (PARTITION BY doc_id) AS total FROM timed) GROUP BY ALL)
SELECT doc_id, chapter_id, mark_start, coalesce(lead(mark_start) OVER (PARTITION BY doc_id ORDER BY mark_start), total)::BIGINT AS mark_end FROM t"""
)
def chapter_marks(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    rows = timed(spark, d).withColumn("total", F.max(F.col("end") + F.col("pause_ms")).over(W.partitionBy("doc_id")))
    return windows.chapter_marks(rows)


@query(TIMED + """SELECT doc_id, seg_order, start, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY seg_order), max("end" + pause_ms) OVER (PARTITION BY doc_id))::BIGINT AS clip_end FROM timed""")
def clip_ends(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    total = F.max(F.col("end") + F.col("pause_ms")).over(W.partitionBy("doc_id"))
    return windows.clip_ends(timed(spark, d), total).select("doc_id", "seg_order", "start", "clip_end")


@query(SEG + """SELECT speaker, count(*) AS lines, count(DISTINCT doc_id) AS docs FROM seg GROUP BY 1""")
def speaker_lines(spark: SparkSession, d: str) -> DataFrame:
    each = A.lines_per_speaker(lines(spark, d), ["speaker", "doc_id"])
    return each.groupBy("speaker").agg(F.sum("lines").alias("lines"), F.count("*").alias("docs"))


@query(
    SEG
    + """, c AS (SELECT doc_id, speaker, count(*) AS lines, min(seg_order) AS ord, speaker = 'system' AS reserved FROM seg GROUP BY 1, 2)
SELECT doc_id, speaker, lines, row_number() OVER (PARTITION BY doc_id ORDER BY reserved, lines DESC, ord)::INTEGER AS voice_no, (17000 + row_number() OVER (PARTITION BY doc_id ORDER BY reserved, lines DESC, ord))::INTEGER AS seed FROM c"""
)
def voice_ranks(spark: SparkSession, d: str) -> DataFrame:
    cast = lines(spark, d).groupBy("doc_id", "speaker").agg(F.count("*").alias("lines"), F.min("seg_order").alias("ord")).withColumn("reserved", F.col("speaker") == "system")
    return windows.rank_voices(cast).select("doc_id", "speaker", "lines", "voice_no", "seed")


@query(
    SEG
    + """SELECT doc_id, seg_order, (row_number() OVER w - 1)::INTEGER AS new_order, 'seg' || lpad((row_number() OVER w)::VARCHAR, 6, '0') AS new_id,
 CASE WHEN (row_number() OVER w - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS side FROM seg WHERE length(text) >= 40 WINDOW w AS (PARTITION BY doc_id ORDER BY seg_order)"""
)
def renumbered(spark: SparkSession, d: str) -> DataFrame:
    long = lines(spark, d).where(F.length("text") >= 40)
    return windows.alternate(windows.renumber(long)).select("doc_id", "seg_order", "new_order", "new_id", "side")


@query(TIMED + """SELECT doc_id, block_id, seg_order, round(1000.0 * length(text) / sum(length(text)) OVER (PARTITION BY doc_id, block_id), 6) AS share FROM timed WHERE length(text) > 0""")
def proportional_share(spark: SparkSession, d: str) -> DataFrame:
    rows = timed(spark, d).where(F.length("text") > 0).withColumn("w", F.length("text")).withColumn("metric", F.lit(1000.0))
    return windows.share(rows, ["doc_id", "block_id"], "metric", "w").select("doc_id", "block_id", "seg_order", F.round("share", 6).alias("share"))


@query(TIMED + """SELECT doc_id, seg_order, start::BIGINT AS before_ms FROM timed WHERE start < 20000""")
def until_seconds(spark: SparkSession, d: str) -> DataFrame:
    """Whole rows of each conversation up to the one that reaches 20 seconds."""
    rows = timed(spark, d).withColumn("ms", F.col("audio_ms") + F.col("pause_ms"))
    return topk.until_duration(rows, "ms", 20_000).select("doc_id", "seg_order", F.col("before").cast("long").alias("before_ms"))


@query(SEG + """SELECT doc_id, min(seg_order) AS first_order FROM seg WHERE speaker = 'assistant' GROUP BY 1""")
def first_reply(spark: SparkSession, d: str) -> DataFrame:
    return A.ordered_groups(lines(spark, d).where("speaker = 'assistant'"), ["doc_id"], "seg_order").select("doc_id", "first_order")


@query(
    SEG
    + """, s AS (SELECT doc_id, min(seg_order) AS f FROM seg WHERE speaker = 'assistant' GROUP BY 1)
SELECT seg.doc_id, seg_order FROM seg JOIN s USING (doc_id) WHERE seg_order >= f AND block_id BETWEEN 1 AND 3"""
)
def tail_in_range(spark: SparkSession, d: str) -> DataFrame:
    """PRJ-6, PRJ-7: from the first reply on, within a range of turns."""
    tail = projections.from_first(lines(spark, d), ["doc_id"], "seg_order", F.col("speaker") == "assistant")
    return tail.where(F.col("block_id").between(1, 3)).select("doc_id", "seg_order")


@query(
    SEG
    + """, k AS (SELECT doc_id, seg_order FROM seg WHERE speaker = 'system' OR text LIKE '%?%' OR seg_order % 7 = 3)
SELECT DISTINCT seg.doc_id, seg.seg_order FROM seg JOIN k ON seg.doc_id = k.doc_id AND seg.seg_order BETWEEN k.seg_order - 2 AND k.seg_order + 1"""
)
def neighbour_context(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    keys = rows.where((F.col("speaker") == "system") | F.col("text").contains("?") | (F.col("seg_order") % 7 == 3))
    return joins.neighbours(rows, keys, 2, 1, order="seg_order").select("doc_id", "seg_order")


@query(
    SEG
    + r""", n AS (SELECT item_id AS key, lower(regexp_extract(text, '[^\s]+')) AS name FROM benchmark),
w AS (SELECT DISTINCT doc_id, seg_order, lower(text) AS t, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_#]+'), lambda x: x <> ''))) AS word FROM seg),
p AS (SELECT key, name, (list_filter(regexp_split_to_array(name, '[^\p{L}\p{N}_#]+'), lambda x: x <> ''))[1] AS word FROM n)
SELECT DISTINCT key, doc_id, seg_order FROM w JOIN p USING (word) WHERE contains(t, name)"""
)
def mention_context(spark: SparkSession, d: str) -> DataFrame:
    """Lines that name the first word of a benchmark item."""
    rows = lines(spark, d).withColumn("place", F.struct("doc_id", "seg_order"))
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), F.regexp_extract("text", r"[^\s]+", 0).alias("name"))
    own = names.select("key", F.lit(None).cast("struct<doc_id:bigint,seg_order:bigint>").alias("place")).where("false")
    return joins.mention_context(rows, names, own, "key", "place").select("key", "place.doc_id", "place.seg_order")


@query(
    SEG
    + """, r AS (SELECT doc_id, speaker, count(*) AS lines FROM seg GROUP BY 1, 2), f AS (SELECT doc_id, CASE WHEN speaker = 'system' THEN 'user' ELSE speaker END AS speaker, lines FROM r)
SELECT doc_id, speaker, sum(lines)::BIGINT AS lines FROM f GROUP BY 1, 2"""
)
def reassigned_lines(spark: SparkSession, d: str) -> DataFrame:
    """JN-17: lines of a dropped voice go to the fallback of its kind."""
    counts = A.lines_per_speaker(lines(spark, d), ["doc_id", "speaker"]).withColumn("kind", F.lit("any"))
    dropped = counts.where("speaker = 'system'").select("speaker")
    fallback = counts.select("kind").distinct().withColumn("speaker", F.lit("user"))
    return joins.reassign(counts, dropped, fallback, "speaker", "kind").groupBy("doc_id", "speaker").agg(F.sum("lines").alias("lines"))


@query(
    SEG
    + """, a AS (SELECT doc_id, seg_order, text, speaker, row_number() OVER (PARTITION BY doc_id ORDER BY seg_order) AS n FROM seg),
p AS (SELECT doc_id, text, CASE WHEN seg_order % 11 = 5 THEN 'other' ELSE speaker END AS speaker, row_number() OVER (PARTITION BY doc_id ORDER BY chapter_id, seg_order) AS n FROM seg WHERE NOT (doc_id % 13 = 4 AND chapter_id = 1))
SELECT coalesce(a.doc_id, p.doc_id) AS doc_id, min(coalesce(a.n, p.n) - 1)::INTEGER AS position FROM a FULL JOIN p ON a.doc_id = p.doc_id AND a.n = p.n
WHERE a.text IS DISTINCT FROM p.text OR a.speaker IS DISTINCT FROM p.speaker GROUP BY 1"""
)
def seam_check(spark: SparkSession, d: str) -> DataFrame:
    """JN-8: parts (chapters) put together against the whole; some parts are missing, some speakers changed."""
    whole = lines(spark, d)
    parts = whole.where(~((F.col("doc_id") % 13 == 4) & (F.col("chapter_id") == 1))).withColumn("speaker", F.when(F.col("seg_order") % 11 == 5, "other").otherwise(F.col("speaker")))
    wrong = joins.positional_mismatch(whole, parts, ["text", "speaker"], left_order=("seg_order",), right_order=("chapter_id", "seg_order"))
    return joins.first_mismatch(wrong).select("doc_id", "position")


@query(
    TIMED
    + """, s AS (SELECT doc_id, chapter_id AS part, sum(audio_ms + pause_ms)::BIGINT AS ms FROM timed GROUP BY ALL)
SELECT doc_id, part, ms, coalesce(sum(ms) OVER (PARTITION BY doc_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM s"""
)
def part_offsets(spark: SparkSession, d: str) -> DataFrame:
    parts = timed(spark, d).groupBy("doc_id", F.col("chapter_id").alias("part")).agg(F.sum(F.col("audio_ms") + F.col("pause_ms")).alias("ms"))
    return windows.part_offsets(parts, "ms")


@query(
    SEG
    + """, q AS (SELECT 1 AS part, seg_order, doc_id FROM seg WHERE chapter_id = 0 UNION ALL SELECT 2, seg_order, doc_id FROM seg WHERE chapter_id > 0)
SELECT doc_id, 'p0' || part || '-' || seg_order AS id, part::INTEGER AS part FROM q"""
)
def parts_union(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("id", F.col("seg_order").cast("string"))
    return A.union_parts((1, rows.where("chapter_id = 0")), (2, rows.where("chapter_id > 0"))).select("doc_id", "id", "part")


@query(
    SEG
    + """SELECT doc_id, string_agg(t, chr(10) ORDER BY block_id) AS text FROM (SELECT doc_id, block_id, string_agg(text, ' ' ORDER BY seg_order) AS t FROM seg GROUP BY 1, 2) GROUP BY 1"""
)
def exported_text(spark: SparkSession, d: str) -> DataFrame:
    from fabula.sources.blocks import export_text

    return export_text(lines(spark, d))


@query(
    SEG.replace("WITH ex", "WITH RECURSIVE ex")
    + """, p AS (SELECT *, length(text) AS size, sum(length(text)) OVER (PARTITION BY doc_id, block_id ORDER BY seg_order) AS y, sum(length(text)) OVER (PARTITION BY doc_id, block_id) AS whole, row_number() OVER (PARTITION BY doc_id, chapter_id ORDER BY seg_order) AS r FROM seg),
m AS (SELECT doc_id, chapter_id, r, seg_order, seg_order AS first, size AS held, speaker, block_id, y, whole FROM p WHERE r = 1
UNION ALL SELECT doc_id, chapter_id, r, seg_order, CASE WHEN ok THEN first ELSE seg_order END, CASE WHEN ok THEN held + 1 + size ELSE size END, speaker, block_id, y, whole
FROM (SELECT p.*, m.first, m.held, p.speaker = m.speaker AND ((p.block_id = m.block_id AND m.y = p.y - p.size) OR (m.y = m.whole AND p.y = p.size)) AND least(m.held, p.size) < 100 AND m.held + 1 + p.size <= 260 AS ok
 FROM m JOIN p ON p.doc_id = m.doc_id AND p.chapter_id = m.chapter_id AND p.r = m.r + 1))
SELECT doc_id, chapter_id, first AS seg_order, max(held)::INTEGER AS size, count(*) AS pieces, any_value(speaker) AS speaker, max(seg_order) AS last FROM m GROUP BY 1, 2, 3"""
)
def merged_segments(spark: SparkSession, d: str) -> DataFrame:
    """FLD-4: the merged segments with their first and last line, size and number of pieces."""
    from pyspark.sql import Window as W

    rows = lines(spark, d).withColumn("size", F.length("text"))
    upto = W.partitionBy("doc_id", "block_id").orderBy("seg_order").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("char_end", F.sum("size").over(upto)).withColumn("char_start", F.col("char_end") - F.col("size")).withColumn("block_len", F.sum("size").over(W.partitionBy("doc_id", "block_id")))
    rows = rows.withColumn("pause_ms", F.lit(100)).withColumn("needs_review", F.lit(False)).withColumn("reason", F.lit(""))
    merged = folds.merge_short(rows, 100, 260)
    return merged.select("doc_id", "chapter_id", "seg_order", "size", F.size("pieces").cast("long").alias("pieces"), "speaker", F.element_at("pieces", -1)["o"].alias("last"))


@query(TIMED + """SELECT a.doc_id, a.seg_order FROM timed a JOIN timed b ON a.doc_id = b.doc_id AND a.seg_order = b.seg_order + 1 WHERE a.start - 500 < b."end" """)
def overlapping_rows(spark: SparkSession, d: str) -> DataFrame:
    """W-17 on times moved to the front by 500 ms: rows whose pause before is shorter than that."""
    rows = timed(spark, d).withColumn("start", F.when(F.col("seg_order") > 0, F.col("start") - 500).otherwise(F.col("start")))
    return windows.overlaps(rows).select("doc_id", "seg_order")


@query(SEG + """SELECT doc_id, block_id, string_agg(text, ' ' ORDER BY seg_order) AS context, count(*) AS n FROM seg GROUP BY 1, 2""")
def block_context(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d)
    return joins.with_context(rows, rows, ["doc_id", "block_id"], "seg_order").groupBy("doc_id", "block_id").agg(F.max("context").alias("context"), F.count("*").alias("n"))


@query(SEG + """SELECT doc_id, seg_order, speaker FROM seg QUALIFY row_number() OVER (PARTITION BY doc_id, speaker ORDER BY seg_order) <= 2""")
def capped_context(spark: SparkSession, d: str) -> DataFrame:
    return topk.cap_per_key(lines(spark, d), ["doc_id", "speaker"], 2, F.asc("seg_order")).select("doc_id", "seg_order", "speaker")


@query(SEG + """SELECT doc_id, count(DISTINCT speaker)::BIGINT AS kinds FROM seg GROUP BY 1 HAVING count(DISTINCT speaker) > 1""")
def mixed_groups(spark: SparkSession, d: str) -> DataFrame:
    from fabula.operators.audits import check_groups

    return check_groups(lines(spark, d), ["doc_id"], "speaker")


@query(SEG + """SELECT doc_id, seg_order, CASE WHEN seg_order % 9 = 2 THEN 'null' ELSE 'unknown' END AS rule FROM seg WHERE seg_order % 9 = 2 OR speaker = 'system'""")
def unresolved_speakers(spark: SparkSession, d: str) -> DataFrame:
    from fabula.operators import audits

    rows = lines(spark, d).withColumn("speaker", F.when(F.col("seg_order") % 9 != 2, F.col("speaker")))
    voices = lines(spark, d).where("speaker <> 'system'").select(F.col("speaker").alias("id"))
    return audits.unresolved_speakers(rows, voices, ["doc_id", "seg_order"])


@query(
    SEG
    + """, m AS (SELECT doc_id, seg_order, text || CASE WHEN seg_order % 5 = 0 THEN '!' ELSE '' END AS text, 5000 + seg_order AS ms FROM seg WHERE seg_order % 3 <> 1)
SELECT seg.doc_id, seg.seg_order, m.text IS NOT NULL AND m.text = seg.text AS measured, (CASE WHEN m.text = seg.text THEN ms ELSE length(seg.text) * 1000 // 14 END)::BIGINT AS ms FROM seg LEFT JOIN m ON m.doc_id = seg.doc_id AND m.seg_order = seg.seg_order"""
)
def measured_or_estimate(spark: SparkSession, d: str) -> DataFrame:
    rows = lines(spark, d).withColumn("estimate", F.floor(F.length("text") * 1000 / 14))
    made = rows.where("seg_order % 3 <> 1").select("doc_id", "seg_order", F.when(F.col("seg_order") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("text"), (F.col("seg_order") + 5000).alias("ms"))
    return joins.measured_or_estimate(rows, made, ["doc_id", "seg_order"], value="ms").select("doc_id", "seg_order", "measured", "ms")


@query(TIMED + """SELECT doc_id, position, 'time' AS rule FROM (SELECT doc_id, seg_order::INTEGER AS position, start - CASE WHEN seg_order % 5 = 3 THEN 1000 ELSE 0 END AS start, lag("end") OVER (PARTITION BY doc_id ORDER BY seg_order) AS past FROM timed) WHERE start < past""")
def timeline_check(spark: SparkSession, d: str) -> DataFrame:
    """JN-7: a timeline against its segments; some rows start a second early."""
    rows = timed(spark, d)
    early = rows.withColumn("start", F.when(F.col("seg_order") % 5 == 3, F.col("start") - 1000).otherwise(F.col("start")))
    return joins.verify_timeline(lines(spark, d), early, ["text", "speaker"])


@query(SEG + """, b AS (SELECT doc_id, block_id, bool_or(contains(text, '?')) AS odd FROM seg GROUP BY 1, 2) SELECT doc_id, seg_order, NOT odd AS annotator_valid, CASE WHEN odd THEN text ELSE replace(text, 'a', 'a' || chr(769)) END AS annotated FROM seg JOIN b USING (doc_id, block_id)""")
def annotated_segments(spark: SparkSession, d: str) -> DataFrame:
    """UDF-1: a toy annotator marks every a, and adds a word to turns that ask."""
    model = lambda: lambda t: t.replace("a", "a\u0301") + (" more" if "?" in t else "")
    rows = annotators.second_annotator(lines(spark, d), ["doc_id", "block_id"], "seg_order", "text", "text", model)
    return rows.select("doc_id", "seg_order", "annotator_valid", "annotated")


@query(
    SEG.replace("WITH ex", "WITH RECURSIVE ex")
    + """, c AS (SELECT doc_id, seg_order, 0 AS piece, CASE WHEN length(t) > 60 THEN NULL ELSE t END AS part, t AS rest, length(t) <= 60 AS done FROM (SELECT doc_id, seg_order, trim(text) AS t FROM seg WHERE trim(text) <> '')
UNION ALL SELECT doc_id, seg_order, CASE WHEN n.part IS NULL AND length(rest) > 60 THEN piece + 1 ELSE piece + 1 END, CASE WHEN length(rest) > 60 THEN trim(left(rest, cut)) ELSE rest END, CASE WHEN length(rest) > 60 THEN trim(substr(rest, cut + 1)) ELSE '' END, length(rest) <= 60
 FROM (SELECT *, CASE WHEN instr(reverse(left(rest, 60)), ' ') BETWEEN 1 AND 59 THEN 61 - instr(reverse(left(rest, 60)), ' ') ELSE 60 END AS cut FROM c) n WHERE NOT done),
p AS (SELECT doc_id, seg_order, piece, part, done AS last, row_number() OVER (PARTITION BY doc_id ORDER BY seg_order, piece) AS r FROM c WHERE part <> ''),
f AS (SELECT doc_id, r, part, last, length(part) AS held, 0::BIGINT AS chunk FROM p WHERE r = 1
UNION ALL SELECT p.doc_id, p.r, p.part, p.last, CASE WHEN f.last AND p.last AND f.held + 1 + length(p.part) <= 60 THEN f.held + 1 + length(p.part) ELSE length(p.part) END, f.chunk + CASE WHEN f.last AND p.last AND f.held + 1 + length(p.part) <= 60 THEN 0 ELSE 1 END
 FROM f JOIN p ON p.doc_id = f.doc_id AND p.r = f.r + 1)
SELECT doc_id, chunk, string_agg(part, ' ' ORDER BY r) AS chunk_text FROM f GROUP BY 1, 2"""
)
def packed_texts(spark: SparkSession, d: str) -> DataFrame:
    """SEG-2: lines packed up to 60 characters, longer ones cut at blanks."""
    return segments.pack_texts(lines(spark, d), ["doc_id"], "seg_order", "text", 60)
