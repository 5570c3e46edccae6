"""Queries on vectors, events, pages, orders and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.operators import aggregates as A
from fabula.operators import audits, joins, lexicon, signal, topk, windows
from fabula.plans.registry import query
from fabula.session import fresh_path, table
from fabula.sources import blocks as B
from fabula.streaming import incremental as S


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def takes(spark: SparkSession, d: str) -> DataFrame:
    """Events as takes: a user is a voice, the value a tempo, ``k`` of the properties a number of characters."""
    e = table(spark, d, "events")
    return e.select("event_id", "user_id", "event_type", "value", A.prop(F.col("props"), "$.k").cast("int").alias("k"))


@query("""SELECT vec_id, len(embedding)::INTEGER AS n, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS peak, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) / len(embedding)), 6) AS rms FROM embeddings""")
def vector_metrics(spark: SparkSession, d: str) -> DataFrame:
    """AGG-11 on vectors as clips."""
    m = signal.signal_metrics(F.col("embedding"), 64)
    return vectors(spark, d).select("vec_id", F.size("embedding").alias("n"), m.alias("m")).select("vec_id", "n", F.round("m.peak", 6).alias("peak"), F.round("m.rms", 6).alias("rms"))


@query("""SELECT vec_id, (i - 1)::INTEGER AS frame, round(sqrt(list_sum(list_transform(embedding[i * 16 - 15 : i * 16], lambda x: x::DOUBLE * x::DOUBLE)) / 16), 6) AS rms FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) // 16 + 1)) AS i FROM embeddings)""")
def framed_levels(spark: SparkSession, d: str) -> DataFrame:
    """SIG-1: frames of 16 samples."""
    return vectors(spark, d).select("vec_id", F.posexplode(signal.framed_rms(F.col("embedding"), 16)).alias("frame", "rms")).withColumn("rms", F.round("rms", 6))


@query("""WITH r AS (SELECT label, arg_min(embedding, vec_id) AS ref FROM embeddings GROUP BY 1)
SELECT vec_id, round(list_dot_product(list_transform(embedding, lambda x: x::DOUBLE), list_transform(ref, lambda x: x::DOUBLE)) / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(ref, lambda x: x::DOUBLE * x::DOUBLE)))), 6) AS similarity FROM embeddings JOIN r USING (label)""")
def reference_similarity(spark: SparkSession, d: str) -> DataFrame:
    """JN-19: cosine to the first vector of the label."""
    v = vectors(spark, d)
    ref = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("ref"))
    return v.join(ref, "label").select("vec_id", F.round(joins.cosine(F.col("embedding"), F.col("ref")), 6).alias("similarity"))


_BAND = "PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""SELECT event_id, round(CASE WHEN count(value) OVER ({_BAND}) >= 5 THEN greatest(0.5, quantile_cont(value, 0.5) OVER ({_BAND}) - 0.1) ELSE 0.5 END, 6) AS floor,
 round(coalesce(least(greatest(quantile_cont(value, 0.5) OVER ({_BAND}) * 0.6, 6.0), 20.0), 6.0), 6) AS tempo_low, round(coalesce(least(greatest(quantile_cont(value, 0.5) OVER ({_BAND}) * 1.45, 6.0), 20.0), 20.0), 6) AS tempo_high FROM events""")
def adaptive_bounds(spark: SparkSession, d: str) -> DataFrame:
    """W-13 and W-14 per user."""
    rows = windows.adaptive_band(windows.adaptive_floor(takes(spark, d), "value", "user_id", "event_id"), "value", "user_id", "event_id")
    return rows.select("event_id", *[F.round(c, 6).alias(c) for c in ("floor", "tempo_low", "tempo_high")])


@query("""SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY json_extract_string(props, '$.k')::INT, value DESC, event_id) AS r FROM events) WHERE r = 1""")
def best_takes(spark: SparkSession, d: str) -> DataFrame:
    """K-2: fewest problems (``k``), then the highest value, then the earliest."""
    return topk.best_take(takes(spark, d), ["user_id", "event_type"], "k", "value", "event_id").select("user_id", "event_type", "event_id", "value")


@query("""SELECT event_type, sum((value * 100)::BIGINT)::BIGINT AS audio_ms, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS wall_ms, count(*) FILTER (WHERE user_id % 2 = 0) AS fresh, count(*) FILTER (WHERE user_id % 2 <> 0) AS cached,
 count(*) FILTER (WHERE json_extract_string(props, '$.k')::INT > 90) AS with_problems, round(quantile_cont(value, 0.5), 6) AS median_score, min(value) AS min_score FROM events GROUP BY 1""")
def run_report(spark: SparkSession, d: str) -> DataFrame:
    rows = takes(spark, d).withColumn("audio", F.round(F.col("value") * 100).cast("long")).withColumn("wall", F.col("k").cast("long")).withColumn("fresh", F.col("user_id") % 2 == 0).withColumn("problems", F.greatest(F.lit(0), F.col("k") - 90))
    return A.run_report(rows, ["event_type"], "audio", "wall", "fresh", "value", "problems").withColumn("median_score", F.round("median_score", 6))


@query("""WITH s AS (SELECT user_id % 7 AS grp, user_id, avg(value) AS pitch, count(*)::DOUBLE AS rng, 1.0 + (user_id % 10) / 100.0 AS rate FROM events GROUP BY user_id)
SELECT a.grp, a.user_id AS a, b.user_id AS b FROM s a JOIN s b ON a.grp = b.grp AND a.user_id < b.user_id WHERE abs(12 * log2(a.pitch) - 12 * log2(b.pitch)) < 1.0 AND abs(a.rng - b.rng) < 1.5 AND a.rate / b.rate > 0.9 AND a.rate / b.rate < 1.11""")
def twin_pairs(spark: SparkSession, d: str) -> DataFrame:
    """JN-12: users whose mean values, counts and rates are close."""
    s = takes(spark, d).groupBy("user_id").agg(F.avg("value").alias("pitch"), F.count("*").cast("double").alias("rng")).withColumn("grp", F.col("user_id") % 7).withColumn("rate", 1.0 + (F.col("user_id") % 10) / 100.0)
    return joins.twin_pairs(s, "grp", "user_id", "pitch", "rng", "rate")


@query("""WITH l AS (SELECT event_type, user_id % 20 AS role, -40 + max(value) / 20 AS lufs, -min(value) AS peak FROM events GROUP BY 1, 2), c AS (SELECT event_type, least(-20.0, min(lufs - 1.5 - peak - 0.1)) AS common FROM l GROUP BY 1)
SELECT event_type, role, round(common, 6) AS common, round(common - lufs, 6) AS gain_db FROM l JOIN c USING (event_type)""")
def gain_plan(spark: SparkSession, d: str) -> DataFrame:
    """AGG-6: common level of the roles of each type."""
    levels = takes(spark, d).groupBy("event_type", (F.col("user_id") % 20).alias("role")).agg((F.max("value") / 20 - 40).alias("lufs"), (-F.min("value")).alias("true_peak_db"))
    return A.gain_plan(levels, ["event_type"], "role").select("event_type", "role", F.round("common", 6).alias("common"), F.round("gain_db", 6).alias("gain_db"))


@query("""WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame, value > 30 AS voiced FROM events), s AS (SELECT *, min(frame) FILTER (WHERE voiced) OVER (PARTITION BY user_id) AS a, max(frame) FILTER (WHERE voiced) OVER (PARTITION BY user_id) AS b FROM e),
i AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY frame) AS isl FROM (SELECT *, CASE WHEN lag(voiced) OVER (PARTITION BY user_id ORDER BY frame) = voiced THEN 0 ELSE 1 END AS n FROM s WHERE frame BETWEEN a AND b))
SELECT user_id AS clip_id, min(frame)::INTEGER AS run_start, count(*) AS run_frames FROM i WHERE NOT voiced GROUP BY user_id, isl HAVING count(*) >= 4""")
def pause_runs(spark: SparkSession, d: str) -> DataFrame:
    """W-15: runs of at least four low values between a user's first and last high one."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id")) - 1
    frames = takes(spark, d).select(F.col("user_id").alias("clip_id"), n.alias("frame"), (F.col("value") > 30).alias("voiced"))
    return windows.pause_runs(frames, least=4)


@query("""SELECT event_id, array_to_string(list_filter([CASE WHEN k > 95 THEN 'click' END, CASE WHEN value < 6 THEN 'slow' END, CASE WHEN value > 90 THEN 'fast' END, CASE WHEN k = 0 THEN 'swallowed' END, CASE WHEN k / 100.0 < 0.05 THEN 'voice' END], lambda x: x IS NOT NULL), ',') AS problems
FROM (SELECT event_id, value, json_extract_string(props, '$.k')::INT AS k FROM events)""")
def judged_takes(spark: SparkSession, d: str) -> DataFrame:
    """SIG-8 with given metrics."""
    k, v = F.col("k"), F.col("value")
    problems = signal.judge(F.when(k > 95, 1).otherwise(0), v, F.lit(6.0), F.lit(90.0), F.lit(0), k == 0, k / 100.0, F.lit(0.05))
    return takes(spark, d).select("event_id", F.array_join(problems, ",").alias("problems"))


@query("""WITH g AS (SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN 6.0 WHEN 'R' THEN -6.0 END AS db FROM (SELECT DISTINCT l_returnflag FROM lineitem))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity * pow(10, coalesce(db, 0) / 20), 6) AS level FROM lineitem JOIN g USING (l_returnflag)""")
def applied_gain(spark: SparkSession, d: str) -> DataFrame:
    """JN-18: a row of gains a flag, which goes to all tasks; a shuffle by flag would give nearly all lines to three of them."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").alias("level"))
    gains = rows.select("l_returnflag").distinct().withColumn("gain_db", F.when(F.col("l_returnflag") == "A", 6.0).when(F.col("l_returnflag") == "R", -6.0))
    return joins.apply_gain(rows, F.broadcast(gains), "l_returnflag", "level").drop("l_returnflag").withColumn("level", F.round("level", 6))


@query("""SELECT o_orderkey, rule FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 9 = 0 THEN ['missing'] ELSE list_filter([CASE WHEN abs(o_totalprice / 1000 - 100) > 90 THEN 'level' END, CASE WHEN o_totalprice / 10000 > 15.15 THEN 'peak' END], lambda x: x IS NOT NULL) END) AS rule FROM orders)""")
def level_checks(spark: SparkSession, d: str) -> DataFrame:
    """DQ-17: one order in nine was lost on the way."""
    after = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("lufs"), (F.col("o_totalprice") / 10000).alias("true_peak_db"))
    return audits.check_levels(after.select("o_orderkey"), after.where("o_orderkey % 9 <> 0"), ["o_orderkey"], F.lit(100.0), 15.0, 90.0).select("o_orderkey", "rule")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS frames, (l_quantity + l_tax * 30)::BIGINT AS expected FROM lineitem WHERE abs(l_quantity::BIGINT - (l_quantity + l_tax * 30)::BIGINT) > 1""")
def length_checks(spark: SparkSession, d: str) -> DataFrame:
    """DQ-18: lengths that differ by more than a frame from what is expected."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    n = F.row_number().over(W.partitionBy(*keys).orderBy("l_extendedprice", "l_shipdate", "l_quantity", "l_tax"))  # the keys name no single row
    rows = table(spark, d, "lineitem").select(*keys, n.alias("n"), F.col("l_quantity").cast("long").alias("frames"), F.bround(F.col("l_quantity") + F.col("l_tax") * 30).cast("long").alias("expected"))
    return audits.check_lengths(rows.select(*keys, "n", "frames"), rows.select(*keys, "n", "expected"), [*keys, "n"], "frames", "expected").drop("n")


@query("""SELECT event_type, json_extract_string(props, '$.k')::INT % 10 AS digit, count(*) AS n, count(*) FILTER (WHERE json_keys(props) = ['k']) AS exact FROM events GROUP BY 1, 2""")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """JSN-1 to JSN-3: properties out of fenced answers."""
    reply = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    rows = table(spark, d, "events").select("event_type", A.parse_reply(reply).alias("o"))
    return rows.groupBy("event_type", (A.prop(F.col("o"), "$.k").cast("int") % 10).alias("digit")).agg(F.count("*").alias("n"), F.count_if(A.exact_fields(F.col("o"), ["k"])).alias("exact"))


@query()
def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """SRC-2: leaf blocks of pages."""
    return B.html_blocks(table(spark, d, "pages"))


@query()
def page_titles(spark: SparkSession, d: str) -> DataFrame:
    """SRC-3: the first heading of a page, else its URL's last part."""
    rows = B.html_blocks(table(spark, d, "pages"))
    titles = B.chapter_titles(rows, ["page_id"], F.lit(None).cast("string"))
    stem = F.regexp_extract("url", r"([^/?#]*)/?(?:[?#].*)?$", 1)
    return table(spark, d, "pages").join(titles, "page_id", "left").select("page_id", F.coalesce("title", stem).alias("title"))


@query()
def lossless_gate(spark: SparkSession, d: str) -> DataFrame:
    """SRC-4: whether a page's blocks are all the text that it shows (tests hold it against pages of both kinds)."""
    pages = table(spark, d, "pages")
    lost = audits.lossless_check(B.visible_text(pages), B.html_blocks(pages), "page_id").withColumn("lost", F.lit(True))
    return pages.select("page_id").join(lost, "page_id", "left").select("page_id", F.col("lost").isNull().alias("lossless"))


@query(r"""SELECT source, min(doc_id) FILTER (WHERE r = m) AS doc_id, m::INTEGER AS rule FROM (SELECT *, min(r) OVER (PARTITION BY source) AS m FROM (SELECT source, doc_id, CASE WHEN contains(text, '@') THEN 0 WHEN n_chars > 5000 THEN 1 WHEN lang = 'fr' THEN 2 END AS r FROM documents)) WHERE m IS NOT NULL GROUP BY source, m""")
def picked_assets(spark: SparkSession, d: str) -> DataFrame:
    """SRC-5: of each source the first document of the best rule."""
    rules = [F.col("text").contains("@"), F.col("n_chars") > 5000, F.col("lang") == "fr"]
    return B.pick_asset(table(spark, d, "documents"), rules, "source", "doc_id").select("source", "doc_id", "rule")


@query("""WITH p AS (SELECT o_custkey % 40 AS doc_id, (o_orderkey % 9 + 1)::INTEGER AS part, ['text.json', 'audio.wav', 'cover.jpg'][o_orderkey::INT % 3 + 1] AS m FROM orders WHERE o_orderkey % 9 <> 4), g AS (SELECT doc_id, part, list(DISTINCT m) AS ms FROM p GROUP BY 1, 2)
SELECT doc_id, part, array_to_string(list_sort(list_filter(['text.json', 'audio.wav'], lambda x: NOT list_contains(ms, x))), ',') AS missing, part - coalesce(lag(part) OVER (PARTITION BY doc_id ORDER BY part), 0) > 1 AS hole FROM g""")
def discovered_parts(spark: SparkSession, d: str) -> DataFrame:
    """SRC-9 on paths made from orders: parts, members they lack, holes in the numbering."""
    member = F.get(F.array(*map(F.lit, ("text.json", "audio.wav", "cover.jpg"))), (F.col("o_orderkey") % 3).cast("int"))
    paths = table(spark, d, "orders").where("o_orderkey % 9 <> 4").select((F.col("o_custkey") % 40).alias("doc_id"), F.concat(F.lit("x/part"), F.lpad((F.col("o_orderkey") % 9 + 1).cast("string"), 2, "0"), F.lit("/"), member).alias("path"))
    return B.discover_parts(paths, ["text.json", "audio.wav"]).select("doc_id", "part", F.array_join("missing", ",").alias("missing"), "hole")


MARKED = r"""WITH t AS (SELECT doc_id, (i - 1)::INTEGER AS idx, ts[i] AS original FROM (SELECT doc_id, ts, unnest(range(1, len(ts) + 1)) AS i FROM (SELECT item_id AS doc_id, regexp_extract_all(text, '[a-z]{3,}') AS ts FROM benchmark))),
w AS (SELECT *, CASE WHEN idx % 3 = 0 THEN original[1:1] || chr(769) || original[2:] ELSE original END AS a, CASE WHEN idx % 5 = 0 THEN original[1:2] || chr(769) || original[3:] WHEN idx % 7 = 1 THEN original || 'x' ELSE original END AS b FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS n FROM w WHERE a <> b AND lower(replace(a, chr(769), '')) = lower(replace(b, chr(769), '')))"""


def _annotated(spark: SparkSession, d: str) -> DataFrame:
    """Words of the benchmark with the marks of two made-up annotators."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.posexplode(F.regexp_extract_all("text", F.lit("[a-z]{3,}"), F.lit(0))).alias("idx", "original"))
    mark = lambda n: F.concat(F.substring("original", 1, n), F.lit("\u0301"), F.substring("original", n + 1, 1000))
    i = F.col("idx")
    return words.withColumn("a", F.when(i % 3 == 0, mark(1)).otherwise(F.col("original"))).withColumn("b", F.when(i % 5 == 0, mark(2)).when(i % 7 == 1, F.concat("original", F.lit("x"))).otherwise(F.col("original")))


@query(MARKED + """SELECT doc_id, idx, CASE WHEN n % 2 = 1 THEN a ELSE b END AS side_a, CASE WHEN n % 2 = 1 THEN b ELSE a END AS side_b FROM d""")
def disputes(spark: SparkSession, d: str) -> DataFrame:
    """DQ-15 on the words of the benchmark."""
    found = lexicon.disputes(_annotated(spark, d), ["doc_id"])
    return found.select("doc_id", "idx", F.col("candidates")["A"].alias("side_a"), F.col("candidates")["B"].alias("side_b"))


@query(MARKED + """SELECT w.doc_id, w.idx, original AS before, CASE WHEN n IS NULL OR w.idx % 4 = 3 THEN original WHEN n % 2 = 1 THEN a ELSE b END AS token FROM w LEFT JOIN (SELECT doc_id, idx, n FROM d) USING (doc_id, idx)""")
def applied_decisions(spark: SparkSession, d: str) -> DataFrame:
    """JN-9 and DQ-9: side A is chosen, but some are unknown."""
    words = _annotated(spark, d)
    found = lexicon.disputes(words, ["doc_id"])
    final = lexicon.reconcile(found.withColumn("choice", F.when(F.col("idx") % 4 == 3, "unknown").otherwise("A")), F.lit(None).cast("string"))
    return lexicon.apply_decisions(words.withColumn("token", F.col("original")), found, final, ["doc_id"]).select("doc_id", "idx", "before", "token")


@query(MARKED + """, h AS (SELECT DISTINCT regexp_extract(text, '[a-z]{3,}') AS key FROM benchmark), e AS (SELECT CASE WHEN h.key IS NOT NULL AND lower(replace(b, chr(769), '')) = original THEN 'homograph' WHEN a <> original THEN 'dictionary'
 WHEN lower(replace(b, chr(769), '')) = original AND b <> original THEN 'unknown' ELSE 'unchanged' END AS engine FROM w LEFT JOIN h ON h.key = original) SELECT engine, count(*) AS n FROM e GROUP BY 1""")
def hybrid_choice(spark: SparkSession, d: str) -> DataFrame:
    """DQ-14 and AGG-4: whose mark each word takes; the first words of items count as homographs."""
    homographs = table(spark, d, "benchmark").select(F.regexp_extract("text", "[a-z]{3,}", 0).alias("key"))
    return A.histogram(lexicon.hybrid_choice(_annotated(spark, d), homographs), ["engine"])


# streams over what is there
def _events(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream; the source path is a folder of one file, or one file's folder."""
    static = table(spark, d, "events")
    return spark.readStream.schema(static.schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, d, "events"))


def _folder(spark: SparkSession, d: str, name: str) -> str:
    """A folder that a file stream can read: the table's rows, written once to the shared folder."""
    path = fresh_path(spark, f"stream-{name}")
    table(spark, d, name).write.parquet(path)
    return path


@query("""SELECT event_type, count(*) AS n, max(event_id) AS latest FROM events GROUP BY 1""")
def progress_counts(spark: SparkSession, d: str) -> DataFrame:
    """ST-3: counters of a stream run to the end of what is there."""
    return S.run_available(spark, S.progress(_events(spark, d), "event_type", "event_id"))


@query("""SELECT user_id, (count(DISTINCT event_type) + count(DISTINCT event_type) FILTER (WHERE user_id % 5 = 0 AND event_type > 'd'))::BIGINT AS times FROM events GROUP BY 1""")
def incremental_once(spark: SparkSession, d: str) -> DataFrame:
    """ST-1: how often work was done for each user by a stream that is run three times, the last time with other signatures for
    some: once for each key and signature, whatever was sent again."""
    done = fresh_path(spark, "done")
    work = lambda df: df.select("user_id", "event_type", F.lit(True).alias("done"))
    changed = F.when((F.col("user_id") % 5 == 0) & (F.col("event_type") > "d"), F.concat("event_type", F.lit("+"))).otherwise(F.col("event_type"))
    for signature in (F.col("event_type"), F.col("event_type"), changed):
        S.incremental(_events(spark, d).withColumn("event_type", signature), done, ["user_id"], "event_type", work, fresh_path(spark, "incremental"))
    return spark.read.parquet(done).groupBy("user_id").agg(F.count("*").alias("times"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
g AS (SELECT DISTINCT user_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::DOUBLE AS value, NULL::BOOLEAN AS accepted, []::DOUBLE[] AS seen FROM events
UNION ALL SELECT user_id, r, event_id, value, ok, CASE WHEN ok THEN list_append(seen, value) ELSE seen END FROM (SELECT e.*, g.seen,
 len(g.seen) < 5 OR e.value BETWEEN 0.6 * list_aggregate(g.seen, 'median') AND 1.45 * list_aggregate(g.seen, 'median') AS ok FROM g JOIN e ON e.user_id = g.user_id AND e.r = g.r + 1))
SELECT user_id, event_id, value, accepted FROM g WHERE r > 0""")
def running_gate(spark: SparkSession, d: str) -> DataFrame:
    """ST-2 in batch: values inside the band of the accepted ones before them."""
    return S.running_gate(takes(spark, d), "user_id", "event_id", "value")


@query("""WITH l AS (SELECT e.event_type AS key, count(*)::VARCHAR AS value FROM events e WHERE event_type < 'r' GROUP BY 1) SELECT event_id, event_type, coalesce(l.value, event_type) AS value FROM events LEFT JOIN l ON key = event_type""")
def enriched_stream(spark: SparkSession, d: str) -> DataFrame:
    """ST-4: a stream joined with a static lexicon."""
    lexicon = table(spark, d, "events").where("event_type < 'r'").groupBy(F.col("event_type").alias("key")).agg(F.count("*").cast("string").alias("value"))
    return S.run_available(spark, S.enrich(_events(spark, d).select("event_id", "event_type"), lexicon, "event_type"), "append").select("event_id", "event_type", "value")


@query("""WITH r AS (SELECT user_id, event_id, json_extract_string(props, '$.k')::INT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events WHERE event_type = 'error'),
l AS (SELECT user_id, count(*) AS tries, bool_or(k > 70) AS ok, arg_max(k % 2 = 0, attempt) AS cut FROM r WHERE attempt <= 4 AND (user_id % 3 > 0 OR attempt <= 2) GROUP BY 1), u AS (SELECT DISTINCT user_id FROM events)
SELECT u.user_id, CASE WHEN ok THEN 'done' WHEN coalesce(tries, 0) >= 3 THEN 'failed' ELSE 'pending' END AS state, (CASE WHEN ok OR coalesce(tries, 0) >= 3 THEN NULL WHEN cut THEN least(80000, 16000 * pow(2, tries)) ELSE 16000 END)::BIGINT AS next_budget FROM u LEFT JOIN l USING (user_id)""")
def request_ledger(spark: SparkSession, d: str) -> DataFrame:
    """ST-5: users as requests, their errors as answers."""
    n = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    replies = takes(spark, d).where("event_type = 'error'").withColumn("attempt", n).where("attempt <= 4 AND (user_id % 3 > 0 OR attempt <= 2)").select("user_id", "attempt", (F.col("k") > 70).alias("valid"), (F.col("k") % 2 == 0).alias("cut"))
    requests = takes(spark, d).select("user_id").distinct().withColumn("budget", F.lit(16_000).cast("long"))
    return S.request_ledger(requests, replies, "user_id", "budget", "valid", "cut").select("user_id", "state", "next_budget")
