"""Segmentation: size windows, sentences, dialogue, spans. The two that need a running decision over a text are table functions."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fabula.operators.projections import drop_derived

# Where a piece may end, the best first.
_ENDS = {"sentence": r"""[.!?…][»”"')\]]*\s+""", "clause": r"""[,;:][»”"')\]]*\s+|\s+[—–]\s+""", "word": r"\s+"}


def _nearest(spots: list[int], low: int, high: int, goal: int) -> int | None:
    """The spot of ``[low, high]`` nearest to ``goal``, the earlier of two."""
    a, b = bisect_left(spots, low), bisect_right(spots, high)
    k = bisect_left(spots, goal, a, b)
    return min(spots[max(a, k - 1) : min(b, k + 1)], key=lambda e: (abs(e - goal), e), default=None)


def windows_of(text: str, target: int, maximum: int, minimum: int):
    """Pieces (start, end, boundary) of at most ``maximum`` characters that add up to the text.

    The spots where sentences, clauses and words end are found once. A piece ends at the sentence's spot nearest to
    ``target``, else at a clause's, else at a word's; spots from ``minimum`` on (then from 60) come first. A word longer
    than the maximum is cut off with boundary ``error``.
    """
    spots = {name: [m.end() for m in re.finditer(pattern, text)] for name, pattern in _ENDS.items()}
    at = 0
    while at + maximum < len(text):
        tries = ((name, _nearest(own, at + max(least, 1), at + maximum, at + target)) for name, own in spots.items() for least in (minimum, min(60, target), 1))
        name, end = next((t for t in tries if t[1] is not None), ("error", at + maximum))
        yield at, end, name
        at = end
    if at < len(text):
        yield at, len(text), "end"


class SplitWindow:
    """SEG-1 as a table function: (piece, char_start, char_end, boundary)."""

    def eval(self, text: str, target: int, maximum: int, minimum: int):
        for i, (a, b, name) in enumerate(windows_of(text or "", target, maximum, minimum)):
            yield i, a, b, name


# Opening quotes with what may close each, stops, and the lengths of a long fragment and of a piece that may be cut off it.
QUOTES = {"«": "»", "„": "“”", "“": "”", "‹": "›", "‚": "‘’", "‘": "’", '"': '"'}
CLOSING = frozenset("".join(QUOTES.values()))
STOPS, ENDS = frozenset(",.!?…:;"), frozenset(".!?…")
LONG_FRAGMENT, SHORT_FRAGMENT = 160, 40
_SIGN = re.compile(r"""\w+|[^\w\s]""")


class Signs:
    """A paragraph's words and signs, with whether a blank stands before each and which quotes are a pair in no other."""

    def __init__(self, text: str):
        found = list(_SIGN.finditer(text))
        self.text, self.at, self.said = text, [m.start() for m in found], [m[0] for m in found]
        self.blank = [k == 0 or self.at[k - 1] + len(self.said[k - 1]) < self.at[k] for k in range(len(found))]
        self.pairs = list(self._pairs())

    def _apostrophe(self, k: int) -> bool:
        beside = self.text[max(0, self.at[k] - 1) : self.at[k]] + self.text[self.at[k] + 1 : self.at[k] + 2]
        return self.said[k] == "‘" and len(beside) == 2 and beside.isalpha()

    def _pairs(self):
        wanted, first = [], 0  # what closes the open quotes, from the outermost
        for k, sign in enumerate(self.said):
            if wanted and sign in wanted[-1]:
                wanted.pop()
                if not wanted:
                    yield first, k
            elif sign in QUOTES and not self._apostrophe(k):
                first = first if wanted else k
                wanted.append(QUOTES[sign])

    def ends_sentence(self, k: int) -> bool:
        """Whether stops, with closing quotes among them, stand right before the blank before sign ``k``."""
        ended, j = False, k - 1
        while j >= 0 and (self.said[j] in ENDS or self.said[j] in CLOSING):
            ended |= self.said[j] in ENDS
            if self.blank[j]:
                break
            j -= 1
        return ended and self.blank[k]

    def speech(self, a: int, b: int) -> bool:
        """Whether a pair of quotes holds something said: it opens the paragraph, follows a colon or dash, or is a sentence."""
        inside = self.said[a + 1 : b]
        words = sum(s[0].isalnum() or s[0] == "_" for s in inside)
        return a == 0 or self.said[a - 1] in (":", "—", "–") or words > 1 and not ENDS.isdisjoint(inside)

    def turns(self) -> set[int]:
        """The signs at which speech and narrator change."""
        found = {k for k in range(1, len(self.said)) if self.said[k] in ("—", "–") and self.blank[k] and (self.said[k - 1] in STOPS or self.said[k - 1] in CLOSING)}
        for a, b in self.pairs:
            if self.speech(a, b):
                k = b + 1
                while k < len(self.said) and self.said[k] in STOPS and not self.blank[k]:
                    k += 1
                found |= {s for s, before in ((a, a - 1), (k, k)) if s and before < len(self.said) and self.said[before] not in ("—", "–")}
        return found


def outer_quotes(text: str):
    """(start, end) of the quotations that stand in no other; unclosed ones and apostrophes are none."""
    signs = Signs(text)
    for a, b in signs.pairs:
        yield signs.at[a], signs.at[b] + 1


def fragments_of(text: str, limit: int):
    """Fragments (start, end) of speech and narrator, long ones also cut at sentences; all but the blanks around them."""
    signs = Signs(text)
    edges = [0, *sorted(signs.at[k] for k in signs.turns()), len(text)]
    new = [at for k, at in enumerate(signs.at) if k and text[at].isupper() and signs.ends_sentence(k)]
    for a, b in zip(edges, edges[1:], strict=False):
        inner = [] if b - a <= limit else [at for at in new[bisect_left(new, a + SHORT_FRAGMENT) : bisect_right(new, b - SHORT_FRAGMENT)]]
        for x, y in zip([a, *inner], [*inner, b], strict=True):
            part = text[x:y]
            if part.strip():
                yield x + len(part) - len(part.lstrip()), x + len(part.rstrip())


class SpeechFragments:
    """SEG-6 as a table function: (fragment, char_start, char_end)."""

    def eval(self, text: str, limit: int):
        for n, (a, b) in enumerate(fragments_of(text or "", limit)):
            yield n, a, b


class TokenOps:
    """UDTF-2: how one token list becomes another: (op, a_start, a_end, b_start, b_end, fresh_number)."""

    def eval(self, a: list, b: list):
        import difflib

        for op, i, j, x, y in difflib.SequenceMatcher(None, a or [], b or [], autojunk=False).get_opcodes():
            if op != "equal":
                yield op, i, j, x, y, any(any(c.isdigit() for c in t) for t in (a or [])[i:j]) and not any(any(c.isdigit() for c in t) for t in (b or [])[x:y])


def register(spark: SparkSession) -> None:
    """UDTF-1: makes the table functions known to SQL."""
    spark.udtf.register("split_window", F.udtf(SplitWindow, returnType="piece int, char_start int, char_end int, boundary string"))
    spark.udtf.register("speech_fragments", F.udtf(SpeechFragments, returnType="fragment int, char_start int, char_end int"))
    spark.udtf.register("cut_long", F.udtf(CutLong, returnType="piece int, part string, last boolean"))
    spark.udtf.register("token_ops", F.udtf(TokenOps, returnType="op string, a_start int, a_end int, b_start int, b_end int, fresh_number boolean"))


def _lateral(df: DataFrame, call: str, columns: list[str]) -> DataFrame:
    spark = df.sparkSession
    register(spark)
    return spark.sql(f"SELECT {', '.join(['d.' + c for c in df.columns] + ['f.' + c for c in columns])} FROM {{rows}} d, LATERAL {call} f", rows=df)


def split_window(df: DataFrame, text="text", target=220, maximum=260, minimum=100) -> DataFrame:
    """SEG-1: every column but those derived from the whole text, and the pieces."""
    df = drop_derived(df)
    return _lateral(df, f"split_window(d.{text}, {target}, {maximum}, {minimum})", ["piece", "char_start", "char_end", "boundary"])


def speech_fragments(df: DataFrame, text="text", limit=LONG_FRAGMENT) -> DataFrame:
    """SEG-6."""
    return _lateral(df, f"speech_fragments(d.{text}, {limit})", ["fragment", "char_start", "char_end"])


def fragment_texts(df: DataFrame, text="text", limit=LONG_FRAGMENT) -> DataFrame:
    """SEG-6 with a row a text: ``text`` gives way to ``fragments``, their texts in order. No text is repeated beside its
    fragments or shuffled."""
    rest = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                made = [[t[a:b] for a, b in fragments_of(t, limit)] for t in (x or "" for x in batch.column(text).to_pylist())]
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rest], pa.array(made, pa.list_(pa.string()))], [*rest, "fragments"])

    return df.mapInArrow(run, T.StructType([*[df.schema[c] for c in rest], T.StructField("fragments", T.ArrayType(T.StringType()))]))


def token_ops(df: DataFrame, a: str, b: str) -> DataFrame:
    """UDTF-2."""
    return _lateral(df, f"token_ops(d.{a}, d.{b})", ["op", "a_start", "a_end", "b_start", "b_end", "fresh_number"])


#: A sentence ends at a stop with its closers and the blanks after it; not after a single capital (an initial).
SENTENCE = r"(?s).*?(?:(?<!(?<!\p{L})\p{Lu})[.!?…]+[»”\"')\]]*(?:\s+[—–-]+)?(?:\s+|\z)|\z)"


def sentences(df: DataFrame, keys: list[str], text="text", ident: str | None = None) -> DataFrame:
    """SEG-3: (keys, sentence, char_start, char_end, sentence_text[, sentence_id]): sentences that add up to the text; a tail
    of punctuation alone stays with the sentence before. Offsets are running lengths of the pieces."""
    raw = F.filter(F.regexp_extract_all(text, F.lit(SENTENCE), F.lit(0)), lambda s: s != "")
    joined = F.aggregate(raw, F.array().cast("array<string>"), lambda out, s: F.when((F.size(out) > 0) & ~s.rlike(r"[\p{L}\p{N}]"), F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.concat(F.element_at(out, -1), s))).otherwise(F.array_append(out, s)))
    placed = df.select(*keys, F.posexplode(joined).alias("sentence", "sentence_text"))
    run = W.partitionBy(*keys).orderBy("sentence").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumn("char_end", F.sum(F.length("sentence_text")).over(run).cast("int")).withColumn("char_start", F.col("char_end") - F.length("sentence_text"))
    return out.withColumn("sentence_id", F.concat(F.col(ident).cast("string"), F.lit("_s"), F.lpad((F.col("sentence") + 1).cast("string"), 3, "0"))) if ident else out


class CutLong:
    """A sentence over the limit in pieces, (piece, part, last): each cut at the last blank before the limit, else at the limit."""

    def eval(self, text: str, limit: int):
        rest, n = (text or "").strip(), 0
        while len(rest) > limit:
            blank = rest.rfind(" ", 0, limit)
            cut = blank + 1 if blank > 0 else limit
            yield n, rest[:cut].strip(), False
            rest, n = rest[cut:].strip(), n + 1
        yield n, rest, True


def pack_texts(df: DataFrame, keys: list[str], order: str, text: str, limit=250) -> DataFrame:
    """SEG-2: (keys, chunk, chunk_text): sentences in order, with a space between, packed up to a limit; what is cut off an
    overlong one stands alone, and its rest is packed on. Blank sentences are left out, a null text counts as blank."""
    from fabula.operators.ordered import GreedyBatches, piece_numbers

    rows = df.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(*keys, F.col(order).alias("_o"), F.col(text).alias("_t"))
    cut = _lateral(rows, f"cut_long(d._t, {limit})", ["piece", "part", "last"]).where("part <> ''")
    cut = cut.withColumn("_at", F.struct("_o", "piece"))
    alone = F.when(F.col("last"), F.lit(0)).otherwise(F.xxhash64("_o", "piece"))
    fields = {"w": (F.length("part") + 1).cast("long"), "g": alone.cast("long")}
    packed = piece_numbers(cut, keys, "_at", GreedyBatches(limit + 1), fields, ("part",))
    texts = packed.groupBy(*keys, "piece").agg(F.array_sort(F.collect_list(F.struct("_at", "part"))).alias("_p"))
    return texts.select(*keys, F.col("piece").alias("chunk"), F.array_join("_p.part", " ").alias("chunk_text"))


def pack_sentences(df: DataFrame, keys: list[str], order: str, size: str, limit=250) -> DataFrame:
    """SEG-2: sentences packed up to a limit."""
    from fabula.operators.folds import batch_by_size

    return batch_by_size(df, keys, order, size, limit)


def explode_pieces(segments: DataFrame, keys: list[str], sources="sources") -> DataFrame:
    """SEG-4: a merged segment back to a row per block; a plain one is its own piece."""
    own = F.array(F.struct(F.col("block_id").cast("string").alias("block_id"), F.col("text").alias("text"), F.col("char_start").cast("int").alias("char_start"), F.col("char_end").cast("int").alias("char_end")))
    piece = F.coalesce(F.when(F.size(F.coalesce(F.col(sources), F.array().cast("array<struct<block_id:string,text:string,char_start:int,char_end:int>>"))) > 0, F.col(sources)), own)
    return segments.select(*keys, F.posexplode(piece).alias("piece", "p")).select(*keys, "piece", "p.*")


def dialogue_spans(df: DataFrame, keys: list[str], text="text") -> DataFrame:
    """SEG-5: a reply that starts with a dash alternates between speech and the narrator at its later dashes."""
    parts = F.split(text, r"(?=(?<=[,.!?…]\s)[—–]\s)")
    placed = df.select(*keys, F.col(text).rlike(r"^\s*[—–]").alias("_reply"), F.posexplode(parts).alias("span", "span_text"))
    run = W.partitionBy(*keys).orderBy("span").rowsBetween(W.unboundedPreceding, 0)
    out = placed.withColumn("end", F.sum(F.length("span_text")).over(run).cast("int")).withColumn("start", F.col("end") - F.length("span_text"))
    return out.withColumn("kind", F.when(F.col("_reply") & (F.pmod("span", F.lit(2)) == 0), "dialogue").otherwise("narrator")).drop("_reply")


def spans_to_segments(spans: DataFrame, blocks: DataFrame, keys: list[str], maximum=260) -> DataFrame:
    """SEG-7: the text of each span, cut into size windows with offsets in the block."""
    placed = spans.join(blocks.select(*keys, F.col("text").alias("block_text")), keys)
    cut = placed.withColumn("span_text", F.substring(F.col("block_text"), F.col("start") + 1, F.col("end") - F.col("start"))).drop("block_text")
    pieces = split_window(cut, "span_text", maximum=maximum)
    return pieces.withColumn("text", F.substring(F.col("span_text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))).withColumn("char_start", F.col("start") + F.col("char_start")).withColumn("char_end", F.col("start") + F.col("char_end")).drop("span_text")


def group_text(rows: DataFrame, keys: list[str], order="seg_order", block="block_id", text="text") -> DataFrame:
    """STR-33: rows of a group as one phrase: a full stop at an open end before another block; rows without letters are left out."""
    from fabula.functions.text import close_phrase

    said = rows.where(F.col(text).rlike(r"[\p{L}\p{N}]"))
    seam = ~F.lead(block).over(W.partitionBy(*keys).orderBy(order)).eqNullSafe(F.col(block))
    closed = said.withColumn("_t", F.when(seam, close_phrase(F.col(text))).otherwise(F.trim(text)))
    got = closed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "_t"))).alias("_g"))
    return got.select(*keys, F.array_join(F.transform("_g", lambda x: x["_t"]), " ").alias("phrase"))
