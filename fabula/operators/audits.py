"""Data-quality jobs: each returns rows that break a rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.functions.rules import ACUTE, REPORTING, RU_VOWELS
from fabula.functions.text import letters


def run_rules(df: DataFrame, keys: list[str], rules: dict[str, str | Column], detail: str | None = None) -> DataFrame:
    """UDF-2: rules as data, each a predicate that holds for a bad row; one scan: (keys, rule, detail)."""
    tests = [F.when(F.coalesce(F.expr(p) if isinstance(p, str) else p, F.lit(False)), F.lit(name)) for name, p in rules.items()]
    broken = F.array_compact(F.array(*tests))
    return df.select(*keys, F.explode(broken).alias("rule"), (F.col(detail).cast("string") if detail else F.lit(None).cast("string")).alias("detail"))


def check_registry(cast: DataFrame, doc="doc_id") -> DataFrame:
    """DQ-1: unique slug ids, known genders, texts that are there, descriptions that differ, a narrator."""
    rows = run_rules(cast, [doc, "id"], {"slug": ~F.col("id").rlike("^[a-z][a-z0-9_]*\\z"), "gender": ~F.col("gender").isin("male", "female", "unknown"), "name": F.coalesce(F.trim("name"), F.lit("")) == ""})
    twice = cast.groupBy(doc, "id").count().where("count > 1").select(doc, "id", F.lit("duplicate").alias("rule"), F.lit(None).cast("string").alias("detail"))
    same = cast.groupBy(doc, "voice_description").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n > 1").select(doc, "id", F.lit("description").alias("rule"), F.lit(None).cast("string").alias("detail"))
    mute = cast.groupBy(doc).agg(F.count_if(F.col("id") == "narrator").alias("n")).where("n = 0").select(doc, F.lit("narrator").alias("id"), F.lit("narrator").alias("rule"), F.lit(None).cast("string").alias("detail"))
    return reduce(DataFrame.unionByName, [rows, twice, same, mute])


def reporting_faults(value: Column, speaker: Column, verbs: list[str] | None = None, reach: int = 110) -> dict[str, Column]:
    """The guard of reporting clauses, as rules on a span: a clause behind a dash whose first ``reach`` characters have a verb
    of speech is the narrator's (``insert``), and a narrator's span may not begin with a reply before it (``swallowed``): the
    first clause with a whole verb decides, so a word that ``reach`` cuts into a verb is none there. A span is split once."""
    verb = rf"(?iu)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(verbs or REPORTING)})(?![\p{{L}}\p{{N}}_])"
    clauses = F.split(value, r"\s+[—–]\s+")
    bound = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  (an expression worked out once, by name)
    reports = lambda c: F.substring(c, 1, reach).rlike(verb)
    reply = lambda cs: F.regexp_replace(F.get(cs, F.lit(0)), "^[–— ]+", "") != ""
    told = lambda cs, n: (n > 1) & reports(F.get(cs, (n - 1).cast("int"))) & ((n > 2) | reply(cs))
    swallowed = bound(clauses, lambda cs: bound(F.array_position(F.transform(cs, lambda c: c.rlike(verb)), True), lambda n: told(cs, n)))
    insert = F.exists(F.slice(clauses, 2, 1_000_000_000), reports)
    return {"insert": ~speaker.eqNullSafe("narrator") & insert, "swallowed": speaker.eqNullSafe("narrator") & value.rlike("^[–—]") & swallowed}


def check_spans(blocks: DataFrame, spans: DataFrame, cast: DataFrame, doc="doc_id", block="block_id", verbs: list[str] | None = None) -> DataFrame:
    """DQ-2: spans give back their block exactly, speakers are known, unsure ones (or no speaker at all) have a reason, and
    reporting clauses are the narrator's."""
    keys = [doc, block]
    w = W.partitionBy(*keys).orderBy("span_order")
    placed = spans.join(blocks.select(*keys, F.col("text").alias("_block")), keys, "left").join(cast.select(doc, F.col("id").alias("speaker"), F.lit(True).alias("_known")).distinct(), [doc, "speaker"], "left")
    placed = placed.withColumn("_from", F.coalesce(F.lag("end").over(w), F.lit(0))).withColumn("_last", F.lead("end").over(w).isNull())
    return run_rules(placed, [*keys, "span_order"], {
        "gap": F.col("start") != F.col("_from"), "tail": F.col("_last") & (F.col("end") != F.length("_block")), "text": F.col("text") != F.substring(F.col("_block"), F.col("start") + 1, F.col("end") - F.col("start")),
        "speaker": F.col("speaker").isNotNull() & F.col("_known").isNull(), "reason": (F.col("speaker").isNull() | ~F.col("confidence").eqNullSafe("high")) & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "block": F.col("_block").isNull(),
    } | reporting_faults(F.col("text"), F.col("speaker"), verbs))


def check_segments(segments: DataFrame, blocks: DataFrame, maximum=260, doc="doc_id", order="seg_order", block="block_id") -> DataFrame:
    """DQ-3: orders are dense, sizes capped, pieces in order without gap or overlap, and each block is covered."""
    w = W.partitionBy(doc).orderBy(order)
    b = W.partitionBy(doc, block).orderBy(order)
    placed = segments.join(blocks.select(doc, block, F.length("text").alias("_len")), [doc, block], "left")
    placed = placed.withColumn("_n", F.row_number().over(w) - 1).withColumn("_from", F.coalesce(F.lag("char_end").over(b), F.lit(0))).withColumn("_last", F.lead("char_end").over(b).isNull())
    return run_rules(placed, [doc, order], {"order": F.col(order) != F.col("_n"), "size": F.length("text") > maximum, "gap": F.col("char_start") > F.col("_from"), "overlap": F.col("char_start") < F.col("_from"), "tail": F.col("_last") & (F.col("char_end") != F.col("_len")), "block": F.col("_len").isNull()})


_WORD = rf"[\p{{L}}\p{{N}}{ACUTE}]+"
_STOPS = ".!?…"


def _kept_in_order(wanted: Column, had: Column) -> Column:
    """Whether the signs of one text stand in another in order, with others between."""
    return F.aggregate(F.split(had, ""), wanted, lambda left, c: F.when((c != "") & left.startswith(c), F.substring(left, 2, 1_000_000)).otherwise(left)) == ""


def check_edits(df: DataFrame, keys: list[str], original: str, prepared: str, families: dict[str, str] | None = None) -> DataFrame:
    """DQ-4: an edited text keeps its words, letters, links, ё and the author's marks, its skeleton (all but words, commas,
    stops and dashes) and, between two words, its stops in order; marks stand behind vowels, one in a word; markup isn't added.

    ``families`` (word to number) lets a number word take another form of the same number, in the same case of its first
    letter. A null or blank edited text breaks ``empty``; keys of rows that break nothing are not returned.

    Words are found once; what is equal is not compared sign by sign, and links are looked for where their signs are.
    """
    o, p, wo, wp = map(F.col, ("_original", "_prepared", "_words_o", "_words_p"))
    words = lambda c: F.regexp_extract_all(c, F.lit(_WORD), F.lit(0))
    df = df.select(*keys, F.coalesce(F.col(original), F.lit("")).alias("_original"), F.coalesce(F.col(prepared), F.lit("")).alias("_prepared"))
    df = df.withColumns({"_words_o": words(o), "_words_p": words(p)})
    bare = lambda c: F.replace(c, F.lit(ACUTE), F.lit(""))
    links = lambda c: F.regexp_extract_all(c, F.lit(r"(?:https?://|www\.)[^\s<>]+|[\w.+-]+@[\w.-]+\.[A-Za-z]+"), F.lit(0))
    skeleton = lambda c: F.regexp_replace(F.regexp_replace(c, _WORD, "W"), "[,.!?;:—–…]", "")
    linked = lambda c: c.contains("@") | c.contains("://") | c.contains("www.")
    pairs = F.arrays_zip(wo.alias("o"), wp.alias("p"))
    upper = lambda c: F.substring(c, 1, 1).rlike(r"\p{Lu}")
    number = F.create_map(*[F.lit(x) for pair in (families or {"": ""}).items() for x in pair])
    alike = lambda t: F.coalesce((F.element_at(number, F.lower(bare(t["o"]))) == F.element_at(number, F.lower(bare(t["p"])))) & (upper(t["o"]) == upper(t["p"])), F.lit(False))
    same = lambda t: letters(t["o"]).eqNullSafe(letters(t["p"])) | alike(t)
    stops = lambda g: F.regexp_replace(g, f"[^{_STOPS}]", "")
    gaps = F.arrays_zip(F.split(o, _WORD).alias("o"), F.split(p, _WORD).alias("p"))
    markup = lambda c, sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit("")))
    counted = (F.size(wo) == F.size(wp)) & (F.trim(p) != "")
    changed = counted & (wo != wp)
    return run_rules(df, keys, {
        "empty": F.trim(p) == "", "words": (F.size(wo) != F.size(wp)) & (F.trim(p) != ""), "letters": changed & F.exists(pairs, lambda t: ~same(t)), "links": (o != p) & (linked(o) | linked(p)) & (links(o) != links(p)),
        "yo": changed & F.exists(pairs, lambda t: F.lower(t["o"]).contains("ё") & ~F.lower(t["p"]).contains("ё")), "mark": changed & F.exists(pairs, lambda t: t["o"].contains(ACUTE) & (t["o"] != t["p"])),
        "bad mark": p.contains(ACUTE) & F.exists(wp, lambda w: w.rlike(f"{ACUTE}.*{ACUTE}") | w.rlike(rf"(?iu)(?<![{RU_VOWELS}]){ACUTE}")), "skeleton": counted & (o != p) & (skeleton(o) != skeleton(p)),
        "stops": counted & (o != p) & F.exists(gaps, lambda g: (g["o"] != g["p"]) & ~_kept_in_order(stops(g["o"]), stops(g["p"]))), "markup": p.rlike("[<>`]") & ((markup(p, "<") != markup(o, "<")) | (markup(p, ">") != markup(o, ">")) | (markup(p, "`") != markup(o, "`"))),
    })


def stale_rows(df: DataFrame, keys: list[str], text: Column, stored: str) -> DataFrame:
    """DQ-5: rows whose stored hash isn't that of the text computed anew."""
    return df.withColumn("_now", F.sha2(text, 256)).where(~F.col("_now").eqNullSafe(F.col(stored))).select(*keys)


def repair_drift(df: DataFrame, original: str, proposed: str, floor=2, share=20) -> DataFrame:
    """DQ-6: a few changed words go back to the source's, if no number is among them; else the proposal is refused."""
    pairs = F.arrays_zip(F.col(original).alias("o"), F.col(proposed).alias("p"))
    changed = F.filter(pairs, lambda t: ~letters(t["o"]).eqNullSafe(letters(t["p"])))
    few = (F.size(original) == F.size(proposed)) & (F.size(changed) <= F.greatest(F.lit(floor), F.floor(F.size(original) / share))) & ~F.exists(changed, lambda t: F.coalesce(t["o"], F.lit("")).rlike(r"\d") | F.coalesce(t["p"], F.lit("")).rlike(r"\d"))
    mended = F.transform(pairs, lambda t: F.when(letters(t["o"]).eqNullSafe(letters(t["p"])), t["p"]).otherwise(t["o"]))
    return df.withColumn("repaired", F.when(few, mended)).withColumn("accepted", few)


def check_profiles(profiles: DataFrame, blocks: DataFrame, keys: list[str], evidence="evidence", block="block_id") -> DataFrame:
    """DQ-10: certainty is of its domain and every piece of evidence is a block."""
    bad = run_rules(profiles, keys, {"certainty": ~F.col("certainty").isin("low", "medium", "high"), "profile": F.coalesce(F.trim("profile"), F.lit("")) == "", "evidence": F.size(F.coalesce(evidence, F.array().cast("array<string>"))) == 0})
    each = profiles.select(*keys, F.explode(evidence).alias(block))
    lost = each.join(blocks.select(F.col(block).cast("string").alias(block)).distinct(), block, "left_anti").select(*keys, F.lit("unknown block").alias("rule"), F.col(block).cast("string").alias("detail"))
    return bad.unionByName(lost)


def check_instructions(df: DataFrame, keys: list[str], text: str, least=20, most=2500, words=120, extra: list[str] | None = None) -> DataFrame:
    """DQ-11: length, number of words, Latin letters without Cyrillic ones, and no request for sounds (``extra``)."""
    from fabula.functions.text import asks_extra

    rules = {"short": F.length(text) < least, "long": F.length(text) > most, "words": F.size(F.split(F.trim(text), r"\s+")) > words, "script": ~F.col(text).rlike("[A-Za-z]") | F.col(text).rlike("[\u0400-\u052f]")}
    return run_rules(df, keys, rules | ({"sounds": asks_extra(F.col(text), extra)} if extra else {}))


def numeral_value(words: DataFrame, values: DataFrame, a: str, b: str) -> DataFrame:
    """DQ-12: pairs of words that name one number: (.., same_value)."""
    va, vb = values.select(F.col("word").alias(a), F.col("n").alias("_na")), values.select(F.col("word").alias(b), F.col("n").alias("_nb"))
    return words.join(va, a, "left").join(vb, b, "left").withColumn("same_value", F.coalesce(F.col("_na") == F.col("_nb"), F.lit(False))).drop("_na", "_nb")


def audit_changes(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """DQ-16: changed tokens by position."""
    zipped = df.select(*keys, F.posexplode(F.arrays_zip(F.col(before).alias("b"), F.col(after).alias("a"))).alias("pos", "t"))
    return zipped.select(*keys, "pos", F.col("t.b").alias("before"), F.col("t.a").alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def check_levels(before: DataFrame, after: DataFrame, keys: list[str], target: Column, limit=-1.5, slack=0.3, peak_slack=0.15) -> DataFrame:
    """DQ-17."""
    got = before.select(*keys).join(after.select(*keys, "lufs", "true_peak_db"), keys, "left")
    return run_rules(got, keys, {"missing": F.col("lufs").isNull(), "level": F.abs(F.col("lufs") - target) > slack, "peak": F.col("true_peak_db") > limit + peak_slack})


def check_lengths(clips: DataFrame, timeline: DataFrame, keys: list[str], frames: str, expected: str) -> DataFrame:
    """DQ-18: clips whose frames differ by more than one from the timeline."""
    return clips.join(timeline.select(*keys, expected), keys).where(F.abs(F.col(frames) - F.col(expected)) > 1).select(*keys, frames, expected)


def check_groups(rows: DataFrame, group: list[str], key: str) -> DataFrame:
    """DQ-19."""
    return rows.groupBy(*group).agg(F.count_distinct(key).alias("kinds")).where("kinds > 1")


def unresolved_speakers(segments: DataFrame, voices: DataFrame, keys: list[str], speaker="speaker") -> DataFrame:
    """DQ-20."""
    known = voices.select(F.col("id").alias(speaker)).distinct()
    nobody = segments.where(F.col(speaker).isNull()).select(*keys, F.lit("null").alias("rule"))
    strange = segments.where(F.col(speaker).isNotNull()).join(known, speaker, "left_anti").select(*keys, F.lit("unknown").alias("rule"))
    return nobody.unionByName(strange)


def lossless_check(visible: DataFrame, blocks: DataFrame, key: str, order="block_order", text="text") -> DataFrame:
    """SRC-4: sources whose extracted text isn't their visible text, blanks aside."""
    got = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_b"))
    joined = visible.join(got, key, "left").withColumn("_got", F.coalesce(F.regexp_replace(F.array_join(F.transform("_b", lambda x: x[text]), ""), r"\s", ""), F.lit("")))
    return joined.where(F.regexp_replace(F.coalesce(F.col("visible"), F.lit("")), r"\s", "") != F.col("_got")).select(key)
