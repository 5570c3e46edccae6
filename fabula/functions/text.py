"""Column functions for text: cleaning, spelling of symbols, marks of stress, predicates. All run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fabula.functions.rules import ACUTE, DASHES, HYPHENS, LATIN, RU_LATIN, RU_VOWELS, SYMBOL_WORDS, UNSTRESSED, UNSTRESSED_AFTER_HYPHEN

RU = "а-яёА-ЯЁ"


def _each(col: Column, pairs) -> Column:
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), pairs, col)


def _quoted(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~-])", r"\\\1", text)


# STR-1 to STR-6
def clean_space(col: Column) -> Column:
    """Blanks and zero-width spaces to spaces, hyphens of all kinds to ``-``, words hyphenated at a line's end rejoined."""
    spaced = F.regexp_replace(col, r"[   -​  　\u0085\t\x0b\f]", " ")
    return F.regexp_replace(F.translate(spaced, HYPHENS, "-" * len(HYPHENS)), rf"(?<=[{RU}])-\s*\r?\n\s*(?=[{RU}])", "")


def collapse_space(col: Column) -> Column:
    return F.trim(F.regexp_replace(col, r"\s+", " "))


def drop_footnotes(col: Column) -> Column:
    return F.regexp_replace(col, r"\[[0-9]{1,5}\]", "")


# An address is looked for at the start of a run of its signs (or where the last find ended), so that a long run is tried once.
OPAQUE = r"https?://[^\s<>]+|www\.[^\s<>]+|(?:(?<![A-Za-z0-9_.+-])|\G)[A-Za-z0-9_.+-]++@[A-Za-z0-9_.-]+\.[A-Za-z]+"


def opaque_spans(col: Column, pattern: str = OPAQUE) -> Column:
    """URLs and e-mails of a text, in order."""
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(0))


# A mask is a private-use sign and a second one; a text's own first sign is written as itself and a third, so none is taken for a mask.
_MASK, _SPAN, _OWN = "\ue000", "\ue001", "\ue002"


def mask_opaque(col: Column, pattern: str = OPAQUE) -> Column:
    """The text with a mark for each opaque span; ``unmask`` puts the spans back in order, whatever signs the text holds."""
    return F.regexp_replace(own_masks(col), pattern, _MASK + _SPAN)


def own_masks(col: Column) -> Column:
    """A text's own first signs of a mask, written so that none is taken for a mask."""
    return F.replace(col, F.lit(_MASK), F.lit(_MASK + _OWN))


def unmask(col: Column, spans: Column) -> Column:
    """The masked text's parts with the spans between them."""
    parts = F.split(col, _MASK + _SPAN)
    return F.array_join(F.zip_with(parts, spans, lambda p, s: F.concat(F.replace(p, F.lit(_MASK + _OWN), F.lit(_MASK)), F.coalesce(s, F.lit("")))), "")


def expand_abbreviations(col: Column, rules: dict[str, str], closed: bool = True) -> Column:
    """Whole words of a rule table, in any case; ``closed`` also asks for a word's end. A text is looked through once for any of
    them, and rule by rule only if it has one."""
    end = r"(?![\w])" if closed else ""
    each = lambda text: reduce(lambda c, p: F.regexp_replace(c, rf"(?iuU)(?<![\w]){_quoted(p[0])}{end}", p[1]), rules.items(), text)
    some = rf"(?iu)(?:{'|'.join(map(_quoted, rules))})"
    return F.get(F.transform(F.array(col), lambda t: F.when(t.rlike(some), each(t)).otherwise(t)), F.lit(0))


def fix_spacing(col: Column, letters: str = RU) -> Column:
    """A space after punctuation that a letter follows; a currency sign goes behind its amount."""
    spaced = F.regexp_replace(col, rf"([,.!?;:…])(?=[{letters}])", "$1 ")
    return F.regexp_replace(spaced, r"([$€₽])\s*([0-9]+(?:[,.][0-9]+)?)", "$2 $1")


def widen_years(col: Column) -> Column:
    """``1813-14`` to ``1813-1814``; an end that starts with 0 is a month and stays."""
    return F.regexp_replace(col, r"(?<![\w.,:/-])([0-9]{2})([0-9]{2})([-–—])([1-9][0-9])(?![-–—]?[0-9])", "$1$2$3$1$4")


# MTH-8, MTH-10, STR-12 to STR-16
def join_thousands(col: Column, pairs: bool = False) -> Column:
    """``2 000`` to ``2000``: the blanks of a number go that is written in groups of three after a first of one to three digits.
    Each such number is found once, whatever its length. ``pairs`` joins any digit with the three after a space instead,
    whatever stands before, each digit in one pair at most."""
    if pairs:
        return F.regexp_replace(col, "([0-9]) ([0-9]{3})(?![0-9A-Za-z_])", "$1$2")
    number = "(?<![\\w])[0-9]{1,3}(?:[\u0020\u00a0\u202f][0-9]{3}(?![\\w]))++"
    said = F.transform(F.regexp_extract_all(col, F.lit(number), F.lit(0)), lambda n: F.translate(n, "\u0020\u00a0\u202f", ""))
    return F.array_join(F.zip_with(F.split(col, number), said, lambda p, n: F.concat(p, F.coalesce(n, F.lit("")))), "")


def phone_groups(col: Column) -> Column:
    """A phone number's digits as 1, 3, 3, 2, 2; a group that starts with 0 is read digit by digit."""
    digits = F.regexp_replace(col, "[^0-9]", "")
    groups = F.array(*[F.substring(digits, a, n) for a, n in ((1, 1), (2, 3), (5, 3), (8, 2), (10, 2))])
    return F.flatten(F.transform(groups, lambda g: F.when(g.startswith("0"), F.array_remove(F.split(g, ""), "")).otherwise(F.array(g))))


LEFTOVER = r"[0-9][0-9A-Za-z_.,:/–—-]*"


def unresolved_numbers(col: Column) -> Column:
    """What a normalised text still has of digits."""
    return F.regexp_extract_all(col, F.lit(LEFTOVER), F.lit(0))


def speech_punctuation(col: Column) -> Column:
    """A dash between numbers becomes a hyphen. One inside a word, or before a blank, is silent: it goes, and with it the
    blank if an opening sign stands before. A dash right before a word or number stays."""
    dash, word = f"[{DASHES}-]+", rf"\p{{L}}\p{{N}}_{ACUTE}"
    opening = "«„\"'(\\[<"
    ranged = F.regexp_replace(col, rf"(?<=[0-9])\s*{dash}\s*(?=[0-9])", "-")
    silent = rf"(?<=[{opening}]){dash}\s+|(?<=[\p{{L}}{ACUTE}]){dash}(?=\p{{L}})|(?<![^\s{word}]){dash}(?=\s|$)"
    return F.trim(F.regexp_replace(F.regexp_replace(ranged, silent, ""), r"[ \t]{2,}", " "))


def symbol_words(col: Column, words: dict[str, str] = SYMBOL_WORDS) -> Column:
    """Symbols as words, asterisks out, quotes of all kinds as guillemets, blanks collapsed."""
    said = F.replace(_each(col, [(k, f" {v} ") for k, v in words.items()]), F.lit("*"), F.lit(" "))
    said = F.regexp_replace(F.regexp_replace(said, "„([^“”„]*)[“”]", "«$1»"), "“([^”“]*)”", "«$1»")
    return F.trim(F.regexp_replace(F.translate(said, "“„‹”›", "«««»»"), " {2,}", " "))


def spoken_brackets(col: Column, opened: str = "скобка открывается", closed: str = "скобка закрывается") -> Column:
    """Brackets as words between commas; brackets around nothing go; punctuation keeps its place.

    A text is its parts between brackets, and each bracket is read by the parts on its two sides alone: what ends or begins
    there decides between a comma, a blank and nothing, and a stop right before a closing bracket is said behind it.
    """
    left, right = r"\(\[\{（［｛", r"\)\]\}）］｝"
    either = f"[{left}{right}]"
    bare = F.regexp_replace(col, rf"[{left}]([^\p{{L}}\p{{N}}{left}{right}]*+)[{right}]", "$1")
    marks, parts, many = F.regexp_extract_all(bare, F.lit(either), F.lit(0)), F.split(bare, either), 1_000_000_000
    later = lambda c: F.slice(c, 2, many)
    shifted = lambda c: F.concat(F.array(F.lit(None).cast("string")), c)
    # each bracket with the parts before and behind it, and the brackets (and the part) next to those
    beside = F.slice(F.arrays_zip(marks.alias("m"), parts.alias("a"), later(parts).alias("b"), shifted(marks).alias("m0"), shifted(parts).alias("a0"), later(marks).alias("m2")), F.lit(1), F.size(marks))
    shuts = lambda m: F.coalesce(m.rlike(f"[{right}]"), F.lit(False))
    open_end = lambda c: F.regexp_replace(c, r"(?<![\s,])[\s,]++$", "")
    stops = lambda m, a: F.when(shuts(m), F.regexp_extract(open_end(a), "(?<![.!?…])([.!?…]++)$", 1)).otherwise("")

    def body(part: Column, ahead: Column, behind: Column) -> Column:
        """A part without what the bracket behind it takes over, and without blanks at brackets."""
        own = F.when(behind.isNull(), part).when(shuts(behind), F.regexp_replace(open_end(part), "(?<![.!?…])[.!?…]++$", "")).otherwise(open_end(part))
        return F.when(ahead.isNull(), own).otherwise(F.regexp_replace(own, r"^\s+", ""))

    def said(x: Column) -> Column:
        mark, a, b, stop = x["m"], body(x["a"], x["m0"], x["m"]), body(x["b"], x["m"], x["m2"]), stops(x["m"], x["a"])
        nothing = F.when(x["m0"].isNull(), "").when(stops(x["m0"], x["a0"]) != "", " ").otherwise(", ")
        to_it = F.when(a == "", nothing).when(a.endswith("«"), "").when(~shuts(mark) & a.rlike("[.!?…]$"), " ").otherwise(", ")
        from_it = F.when(b == "", "").when(stop != "", " ").when(b.rlike("^[,.!?…;:»]"), "").otherwise(", ")
        return F.concat(to_it, F.when(shuts(mark), F.lit(closed)).otherwise(F.lit(opened)), stop, from_it, b)

    whole = F.concat(body(F.get(parts, F.lit(0)), F.lit(None).cast("string"), F.get(marks, F.lit(0))), F.array_join(F.transform(beside, said), ""))
    return F.trim(F.regexp_replace(F.regexp_replace(whole, r"(?<!\s)\s++,", ","), r"\s{2,}+", " "))


def _fold_table(letters: dict[str, str]):
    """Letters with marks that the table doesn't have, by their base letter (a rule, not a table)."""
    import unicodedata

    out = dict(letters)
    for code in range(0xC0, 0x250):
        char = chr(code).lower()
        base = unicodedata.normalize("NFKD", char)[0]
        if char.isalpha() and char not in out and base != char and base in letters:
            out[char] = letters[base]
    return out


def transliterate(col: Column, letters: dict[str, str] = LATIN) -> Column:
    """Latin letters, with any marks, by a table of readings, in lower case; other scripts stay."""
    table = _fold_table(letters)
    lowered = F.translate(col, "".join(c.upper() for c in table if len(c.upper()) == 1), "".join(c for c in table if len(c.upper()) == 1))
    single = {k: v for k, v in table.items() if len(v) == 1}
    one = F.translate(lowered, "".join(single), "".join(single.values()))
    return _each(one, [(k, v) for k, v in table.items() if len(v) != 1])


def slug_id(col: Column) -> Column:
    """Transliterated, folded snake case; ``c_`` before an id that starts with no letter."""
    import unicodedata

    folded = {chr(c).lower(): unicodedata.normalize("NFKD", chr(c).lower())[0] for c in range(0xC0, 0x250)}
    folded = {k: v for k, v in folded.items() if len(k) == 1 and v.isascii() and v.isalpha()}
    low = F.translate(F.lower(col), "".join(folded), "".join(folded.values()))
    latin = _each(low, list(RU_LATIN.items()))
    slug = F.btrim(F.regexp_replace(latin, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(slug.rlike("^[a-z]"), slug).otherwise(F.concat(F.lit("c_"), slug))


def file_safe(col: Column, fallback: str, limit: int = 120) -> Column:
    """PRJ-4: a display name without characters that file systems refuse."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(col, r'[\\/:*?"<>|\x00-\x1f]+', " - "), r"\s+", " "))
    return F.coalesce(F.nullif(F.btrim(F.substring(clean, 1, limit), F.lit(" .")), F.lit("")), F.lit(fallback))


def strip_suffix(col: Column, marker: str) -> Column:
    """PRJ-5: what stands before a marker."""
    return F.trim(F.split_part(col, F.lit(marker), F.lit(1)))


# STR-18 to STR-22: marks of stress
_V = RU_VOWELS + RU_VOWELS.upper()


def to_acute(col: Column) -> Column:
    """``+`` before a vowel to an acute after it; none over ё."""
    marked = F.regexp_replace(col, rf"\+([{_V}])", f"$1{ACUTE}")
    return F.regexp_replace(marked, f"([ёЁ]){ACUTE}", "$1")


def to_plus(col: Column) -> Column:
    return F.regexp_replace(col, f"([{_V}]){ACUTE}", "+$1")


def well_marked(col: Column) -> Column:
    """Whether each ``+`` stands before a vowel and no word has two."""
    return ~col.rlike(rf"\+(?![{_V}])|\+[{RU}]*\+")


def letters(col: Column) -> Column:
    """Lower-case letters without marks, ё as е."""
    return F.translate(F.lower(col), "ё" + ACUTE + "+", "е")


def vowel_count(col: Column) -> Column:
    return F.length(F.regexp_replace(F.lower(col), f"[^{RU_VOWELS}]", ""))


def stress_info(col: Column) -> Column:
    """Shown form, ordinal of the stressed vowel (0: none), number of vowels, and whether ё stands in the word."""
    before = F.when(F.instr(col, ACUTE) > 0, F.substring_index(col, ACUTE, 1))
    yo = F.when(F.lower(col).contains("ё"), F.concat(F.substring_index(F.lower(col), "ё", 1), F.lit("ё")))
    place = F.coalesce(vowel_count(before), vowel_count(yo), F.lit(0))
    return F.struct(col.alias("shown"), place.alias("stressed"), vowel_count(col).alias("vowels"), F.lower(col).contains("ё").alias("has_yo"))


def needs_mark(word: Column, previous_char: Column) -> Column:
    """A Russian word of several vowels without mark or ё; the particles that share the stress of the word before their
    hyphen, and the unstressed preposition, need none."""
    particle = F.lower(word).isin(*UNSTRESSED_AFTER_HYPHEN) & F.coalesce(previous_char == "-", F.lit(False))
    return word.rlike(f"^[{RU}]+$") & (vowel_count(word) > 1) & ~F.lower(word).contains("ё") & ~particle & ~F.lower(word).isin(*UNSTRESSED)


def restore_case(target: Column, original: Column) -> Column:
    """The target's letters in the original's case; marks are passed over."""
    plain = F.array_remove(F.split(F.replace(original, F.lit(ACUTE), F.lit("")), ""), "")
    chars = F.array_remove(F.split(target, ""), "")
    step = lambda acc, c: F.struct(
        F.concat(acc["out"], F.when((c != ACUTE) & (F.get(plain, acc["i"]) != F.lower(F.get(plain, acc["i"]))), F.upper(c)).otherwise(c)).alias("out"),
        (acc["i"] + F.when(c == ACUTE, 0).otherwise(1)).alias("i"),
    )
    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), step, lambda acc: acc["out"])


# STR-24 to STR-30, PRJ
def foreign_fragments(col: Column, letter: str = "A-Za-zÀ-ÖØ-öø-ɏ") -> Column:
    """Runs of words in a foreign script. The pattern gives nothing back, so a text of any length needs no deep stack."""
    return F.regexp_extract_all(col, F.lit(rf"[{letter}]++(?:[ '’-]++[{letter}]++)*+"), F.lit(0))


def fragment_contexts(df: DataFrame, key: str, text: str, size: int = 200) -> DataFrame:
    """STR-24: (fragment, n, first, context): in how many rows a fragment stands, the first of them by key, and that row's first
    characters. Fragments travel with their row's key alone (and a hash of its text, where rows share a key); each row's
    context is joined to them at the end."""
    row = F.struct(F.col(key).alias("k"), F.xxhash64(text).alias("h"))
    each = df.select(row.alias("row"), F.explode(F.array_distinct(foreign_fragments(F.col(text)))).alias("fragment"))
    found = each.groupBy("fragment").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    contexts = df.select(row.alias("first"), F.substring(text, 1, size).alias("context")).dropDuplicates(["first"])
    return found.join(contexts, "first").select("fragment", "n", F.col("first.k").alias("first"), "context")


def _word_parts(col: Column) -> Column:
    """Words with the blank or hyphen that follows each."""
    return F.regexp_extract_all(col, F.lit("[^ -]+[ -]*|^[ -]+"), F.lit(0))


def tidy_reading(col: Column) -> Column:
    """Words of one syllable, the parts of hyphenated ones too, lose their mark; a grave is an acute."""
    clean = F.replace(F.trim(F.regexp_replace(col, r"\s+", " ")), F.lit("\u0300"), F.lit(ACUTE))
    return F.array_join(F.transform(_word_parts(clean), lambda w: F.when(vowel_count(w) <= 1, F.replace(w, F.lit(ACUTE), F.lit(""))).otherwise(w)), "")


def valid_reading(col: Column) -> Column:
    """Russian words between single blanks or hyphens; each has a vowel, and one mark, behind a vowel, if it has several
    vowels and no ё, else none."""
    marks = lambda w: F.length(w) - F.length(F.replace(w, F.lit(ACUTE), F.lit("")))
    wanted = lambda w: F.when((vowel_count(w) > 1) & ~F.lower(w).contains("ё"), 1).otherwise(0)
    shape = col.rlike(rf"^[{RU}{ACUTE}]+(?:[ -][{RU}{ACUTE}]+)*$") & ~col.rlike(f"(?<![{_V}]){ACUTE}")
    return F.coalesce(shape & F.forall(F.split(col, "[ -]"), lambda w: (vowel_count(w) > 0) & (marks(w) == wanted(w))), F.lit(False))


_CLOSERS = r"[»”\"')\]]*"


def close_phrase(col: Column) -> Column:
    """A full stop at an open end: commas, colons, dashes and blanks there give way. Text without a letter or digit, or with
    a stop before its closing quotes and brackets, stays."""
    body = F.rtrim(F.regexp_replace(col, r"(?<!\s)\s++$", ""))
    said = body.rlike(r"[\p{L}\p{N}]") & ~body.rlike(rf"[.!?…]{_CLOSERS}$")
    return F.when(said, F.concat(F.regexp_replace(body, r"(?<![\s,;:—–-])[\s,;:—–-]++$", ""), F.lit("."))).otherwise(col)


def spoken_weight(col: Column) -> Column:
    """Letters and digits, one at least."""
    return F.greatest(F.lit(1), F.length(F.regexp_replace(col, r"[^\p{L}\p{N}]", "")))


def spoken_variants(col: Column) -> Column:
    """Spellings to try in turn: closed, without marks, with an ellipsis, with an exclamation."""
    base = close_phrase(col)
    plain = F.replace(base, F.lit(ACUTE), F.lit(""))
    stem = F.regexp_replace(plain, rf"[.!?…]+({_CLOSERS})$", "$1")
    return F.array_distinct(F.array(base, plain, F.concat(stem, F.lit("…")), F.concat(stem, F.lit("!"))))


def balance_quotes(col: Column) -> Column:
    """Quotes without a partner go."""
    opened, closed = F.regexp_count(col, F.lit("«")), F.regexp_count(col, F.lit("»"))
    return F.when(opened == closed, col).otherwise(F.translate(col, "«»", ""))


def trim_near(col: Column, target: int, cap: int) -> Column:
    """The text up to the sentence end nearest to ``target`` (the earlier of two) and not beyond ``cap``; else up to the cap."""
    spots = F.filter(F.sequence(F.lit(1), F.least(F.length(col), F.lit(cap))), lambda i: F.substring(col, i, F.lit(1)).isin(".", "!", "?", "…"))
    best = F.array_min(F.transform(spots, lambda i: F.struct(F.abs(i - target).alias("d"), i.alias("i"))))
    return F.when(F.length(col) <= cap, col).otherwise(F.rtrim(F.substring(col, F.lit(1), F.coalesce(best["i"], F.lit(cap)))))


def has_reporting(col: Column, verbs: list[str], reach: int = 110) -> Column:
    """Whether a verb of speech stands within ``reach`` characters after a dash."""
    return F.exists(F.slice(F.split(col, f"[{DASHES}]"), 2, 1_000_000), lambda p: F.substring(p, 1, reach).rlike(rf"(?iuU)\b(?:{'|'.join(verbs)})"))


#: Ways in which a reason names its choice: after a word of choosing, at its end after a dash, before a word of approval.
PICKS = (r"(?iuU)(?:выбира\w*|выбор|вариант|ответ|choose|pick)\s*:?\s*<?([AB](?![\w\u0301])|[АВ](?![\w\u0301])|[\p{L}\u0301]{2,})>?", r"[—–-]\s*([AB])\s*\.?\s*$", r"(?uU)(?<![\w\u0301])([AB])\s+(?:верн|правильн)")


def _named(reason: Column, pattern: str) -> Column:
    """What a pattern finds, with the length of what follows its last occurrence."""
    after = lambda m: F.length(F.call_function("substring_index", reason, m, F.lit(-1)))
    return F.transform(F.regexp_extract_all(reason, F.lit(pattern), F.lit(0)), lambda m: F.struct(after(m).alias("left"), F.regexp_extract(m, pattern, 1).alias("name")))


def final_pick(reason: Column, candidates: Column) -> Column:
    """STR-31: the candidate that a reason names last. A and B (in either script) are the first and second of ``candidates``,
    anything else must be one of them."""
    label = lambda x: F.when(x.isin("A", "А"), F.get(candidates, F.lit(0))).when(x.isin("B", "В"), F.get(candidates, F.lit(1))).when(F.array_contains(candidates, x), x)
    found = F.transform(F.concat(*[_named(reason, p) for p in PICKS]), lambda x: F.struct(x["left"].alias("left"), label(x["name"]).alias("pick")))
    return F.array_min(F.filter(found, lambda x: x["pick"].isNotNull()))["pick"]


def asks_extra(col: Column, words: list[str]) -> Column:
    """STR-32: whether a sentence of an instruction asks for one of the unwanted sounds without a "no"."""
    return F.exists(F.split(col, r"[.!?;\n]"), lambda s: s.rlike(rf"(?iuU)\b(?:{'|'.join(words)})") & ~s.rlike(r"(?iuU)\b(?:no|not|without|без|не|нет)\b"))


def unwanted_words(instruction: Column, source: Column, words: list[str]) -> Column:
    """Unwanted words of an instruction that its source doesn't have."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(instruction), w) & ~F.contains(F.lower(source), w))


def est_seconds(text: Column, pause_ms: Column, cps: float = 14) -> Column:
    """PRJ-2: characters by reading speed, and the pause."""
    return F.length(text) / F.lit(float(cps)) + pause_ms / F.lit(1000.0)


def needs_review(speaker: Column, confidence: Column, boundary: Column) -> Column:
    """PRJ-3."""
    return speaker.isNull() | ~confidence.eqNullSafe("high") | boundary.eqNullSafe("word")


def effective_gender(gender: Column, fallback: str = "female") -> Column:
    """PRJ-8."""
    return F.when(gender.isin("male", "female"), gender).otherwise(fallback)


def speech_text(text: Column, prepared: Column, keep_marks: bool = True) -> Column:
    """PRJ-9: prepared text if there is one, without marks if asked; blank gives null."""
    chosen = F.coalesce(prepared, text)
    chosen = chosen if keep_marks else F.replace(chosen, F.lit(ACUTE), F.lit(""))
    return F.when(F.trim(chosen) != "", chosen)


def row_identity(*cols: str) -> Column:
    """PRJ-1: SHA-256 over declared columns in their order."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)
