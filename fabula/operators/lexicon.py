"""Token annotation from layered lexicons, and the reconciling of two annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.functions.text import letters, vowel_count

LAYERS = ("correction", "exception", "grammar", "bulk")


def tokens(df: DataFrame, keys: list[str], text: str, pattern: str = r"[\p{L}́]+") -> DataFrame:
    """STR-23: (keys, idx, start, token). A token's place is the running length of the parts before it; keys name a row."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.split(text, pattern)
    each = df.select(*keys, F.posexplode(F.arrays_zip(gaps.alias("gap"), found.alias("token"))).alias("idx", "t"))
    before = W.partitionBy(*keys).orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.length("t.gap") + F.coalesce(F.length("t.token"), F.lit(0))).over(before), F.lit(0))
    placed = each.withColumn("start", (passed + F.length("t.gap")).cast("int"))
    return placed.where(F.col("t.token").isNotNull()).select(*keys, "idx", "start", F.col("t.token").alias("token"))


def phrase_match(toks: DataFrame, texts: DataFrame, phrases: DataFrame, keys: list[str], text: str) -> DataFrame:
    """JN-2: (keys, idx, value): for a token, the longest phrase of its key that stands around this very occurrence."""
    near = toks.withColumn("key", F.lower("token")).join(phrases, "key").join(texts.select(*keys, text), keys)
    low = F.lower(text)
    inside = F.exists(
        F.sequence(F.greatest(F.lit(1), F.col("start") + 1 + F.length("token") - F.length("phrase")), F.col("start") + 1), lambda i: F.substring(low, i, F.length("phrase")) == F.lower("phrase")
    )
    rank = F.row_number().over(W.partitionBy(*keys, "idx").orderBy(F.desc(F.length("phrase")), "phrase", "value"))
    return near.where((F.length("phrase") >= F.length("token")) & inside).withColumn("_r", rank).where("_r = 1").select(*keys, "idx", "value")


def annotate_tokens(toks: DataFrame, lexicon: DataFrame, homographs: DataFrame, phrase_hits: DataFrame | None = None, keys=("doc_id",), min_vowels=2) -> DataFrame:
    """JN-1: each token with the value of the first layer that has it: phrase, correction, (a homograph stops here),
    exception, grammar with one variant, bulk of the same letters. Tokens that are marked, hold ё, or have under two vowels
    stay. One join on the distinct lower-case keys; the layers are columns of the lexicon's pivot."""
    layer = lambda name: F.max(F.when(F.col("layer") == name, F.col("value"))).alias(name)
    last = lexicon.withColumn("_r", F.row_number().over(W.partitionBy("layer", "key").orderBy(F.desc("ord")))).where("_r = 1 OR layer = 'grammar'")
    variants = F.count_distinct(F.when(F.col("layer") == "grammar", F.col("value"))).alias("n_grammar")
    wide = last.groupBy("key").agg(*[layer(n) for n in LAYERS], variants)
    marked = homographs.select("key").distinct().withColumn("is_homograph", F.lit(True))
    out = toks.withColumn("key", F.lower("token")).join(wide, "key", "left").join(marked, "key", "left")
    if phrase_hits is not None:
        out = out.join(phrase_hits.withColumnRenamed("value", "phrase"), [*keys, "idx"], "left")
    else:
        out = out.withColumn("phrase", F.lit(None).cast("string"))
    fixed = F.col("token").contains("́") | F.col("key").contains("ё") | (vowel_count(F.col("token")) < min_vowels) if min_vowels else F.lit(False)
    same = letters(F.col("bulk")) == letters(F.col("token"))
    grammar = F.when(F.col("n_grammar") == 1, F.col("grammar"))
    lower = F.when(F.col("is_homograph"), None).otherwise(F.coalesce("exception", grammar, F.when(same, F.col("bulk"))))
    value = F.when(fixed, None).otherwise(F.coalesce("phrase", "correction", lower))
    source = (
        F.when(fixed, "author").when(F.col("phrase").isNotNull(), "phrase").when(F.col("correction").isNotNull(), "correction").when(F.col("is_homograph"), "homograph")
        .when(F.col("exception").isNotNull(), "exception").when(grammar.isNotNull(), "grammar").when(same, "bulk").otherwise("unknown")
    )
    return out.select(*keys, "idx", "start", "token", F.coalesce(value, F.col("token")).alias("value"), source.alias("source"))


def prefix_match(toks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """JN-3: the value of a prefix, only for a token that a hyphen follows (column ``next_char``)."""
    return toks.join(prefixes.select(F.col("key").alias("_k"), F.col("value").alias("_v")), (F.lower("token") == F.col("_k")) & (F.col("next_char") == "-"), "left").withColumn("value", F.coalesce("_v", "token")).drop("_k", "_v")


def disputes(words: DataFrame, keys: list[str], a="a", b="b", original="original") -> DataFrame:
    """DQ-15: words two annotators mark differently: same letters, not marked by the author; sides change places in turn."""
    differ = words.where((F.col(a) != F.col(b)) & (letters(F.col(a)) == letters(F.col(b))) & ~F.col(original).contains("́"))
    turn = F.pmod(F.row_number().over(W.partitionBy(*keys).orderBy("idx")) - 1, F.lit(2))
    return differ.select(*keys, "idx", F.when(turn == 0, F.create_map(F.lit("A"), F.col(a), F.lit("B"), F.col(b))).otherwise(F.create_map(F.lit("A"), F.col(b), F.lit("B"), F.col(a))).alias("candidates"))


def reconcile(decided: DataFrame, picked: Column) -> DataFrame:
    """DQ-9: the choice, or what the reason picks at its end if that contradicts it; with a note."""
    side = F.when(picked == F.col("candidates")["A"], "A").when(picked == F.col("candidates")["B"], "B")
    return decided.withColumn("final", F.coalesce(side, F.when(F.col("choice").isin("A", "B"), F.col("choice")), F.lit("unknown"))).withColumn("contradiction", F.coalesce(side != F.col("choice"), F.lit(False)))


def apply_decisions(toks: DataFrame, found: DataFrame, final: DataFrame, keys: list[str]) -> DataFrame:
    """JN-9: tokens replaced by what was decided; an unknown decision leaves them."""
    got = found.join(final.select(*keys, "idx", "final"), [*keys, "idx"]).select(*keys, "idx", F.when(F.col("final").isin("A", "B"), F.element_at("candidates", F.col("final"))).alias("_new"))
    return toks.join(got, [*keys, "idx"], "left").withColumn("before", F.col("token")).withColumn("token", F.coalesce("_new", "token")).drop("_new")


def hybrid_choice(words: DataFrame, homographs: DataFrame, original="original", first="a", second="b") -> DataFrame:
    """DQ-14: author's mark, else the second annotator for homographs and ё, else the dictionary, else the second, else as is."""
    marked = homographs.select(F.col("key").alias("_k")).distinct()
    out = words.join(marked, F.lower(original) == F.col("_k"), "left")
    valid = letters(F.col(second)) == letters(F.col(original))
    engine = (
        F.when(F.col(original).contains("́"), "author").when(F.col("_k").isNotNull() & valid, "homograph").when(F.col(second).contains("ё") & ~F.col(original).contains("ё") & valid, "yo")
        .when(F.col(first) != F.col(original), "dictionary").when(valid & (F.col(second) != F.col(original)), "unknown").otherwise("unchanged")
    )
    value = F.when(engine.isin("author", "unchanged"), F.col(original)).when(engine == "dictionary", F.col(first)).otherwise(F.col(second))
    return out.withColumn("engine", engine).withColumn("value", value).drop("_k")


def transfer_marks(rows: DataFrame, original: str, predicted: str) -> DataFrame:
    """DQ-13: predicted marks where every word keeps its letters, else the original and a note."""
    good = (F.size(original) == F.size(predicted)) & F.forall(F.arrays_zip(F.col(original).alias("o"), F.col(predicted).alias("p")), lambda t: letters(t["o"]).eqNullSafe(letters(t["p"])))
    return rows.withColumn("transferred", F.when(good, F.col(predicted)).otherwise(F.col(original))).withColumn("fell_back", ~good)


def apply_review(toks: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-7: only a mark that is there and isn't the author's may be removed; each issue's action is told."""
    joined = issues.join(toks, [*keys, "idx"], "left")
    action = F.when(F.col("token").isNull(), "missing").when(F.col("is_author"), "author").when(~F.col("token").contains("́"), "no_mark").when(F.col("verdict") == "remove", "removed").otherwise("kept")
    return joined.withColumn("action", action).withColumn("token", F.when(action == "removed", F.replace("token", F.lit("́"), F.lit(""))).otherwise(F.col("token")))


def confirm_votes(issues: DataFrame, votes: DataFrame, keys: list[str]) -> DataFrame:
    """DQ-8: two votes of one mind decide, anything else is unknown; issues without two votes are told."""
    got = votes.groupBy(*keys).agg(F.count("*").alias("votes"), F.count_distinct("vote").alias("minds"), F.min("vote").alias("vote"))
    out = issues.join(got, keys, "left")
    return out.withColumn("final", F.when(F.coalesce("votes", F.lit(0)) != 2, "incomplete").when((F.col("minds") == 1) & F.col("vote").isin("keep", "remove"), F.col("vote")).otherwise("unknown")).drop("minds", "vote")
