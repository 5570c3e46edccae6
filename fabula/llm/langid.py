"""Language identification by language-bitmask n-gram filters.

Training counts the byte n-grams (words with a space on both sides, lower case) of every learning document per language and
keeps for a language those with at least ``MIN_SHARE`` of its n-grams and at least ``MIN_RATIO`` of their share in the
language that uses them most; shares add up to one, so the kept set has a size bound that doesn't depend on the corpus.
A bit-sliced Bloom filter holds them: each slot is a bitmask of languages, of as many 64-bit words as they need, and the AND
of an n-gram's slots, word by word, is the set of all languages that (may) have kept it. A document's popcount per language, corrected for that language's false-positive
rate, decides.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without any learning row every text is
``und``; ties go to the first language by code point; repeated rows count as often as they stand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import documents, id_fold, materialize, mix64, pieces, utf8

ORDERS = (2, 3, 4)
MIN_SHARE = 1 / 20_000
MIN_RATIO = 0.25
HASHES = 3
PIECE = 2_000_000


def _normal(raw: np.ndarray) -> np.ndarray:
    """Lower-cased UTF-8 with all but letters (and bytes beyond ASCII) as spaces."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    return table[raw]


def _grams(raw: np.ndarray, offsets: np.ndarray, n: int):
    """Packed n-grams of each document with the row they are in: length in the top byte, bytes below.

    A space stands before and after each document, and n-grams with two adjacent spaces are left out.
    """
    rows = len(offsets) - 1
    padded = np.full(len(raw) + 2 * rows, 32, np.uint8)
    keep = np.ones(len(padded), bool)
    starts = offsets[:-1] + 2 * np.arange(rows)
    ends = offsets[1:] + 2 * np.arange(rows) + 1
    keep[starts] = False
    keep[ends] = False
    padded[keep] = raw
    if len(padded) < n:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    m = len(padded) - n + 1
    keys = np.full(m, n, np.uint64)
    for i in range(n):
        keys = (keys << np.uint64(8)) | padded[i : i + m]
    blank = padded == 32
    pair = np.concatenate(([0], np.cumsum(blank[1:] & blank[:-1])))
    good = pair[n - 1 : n - 1 + m] == pair[:m]
    at = np.concatenate((starts, [len(padded)]))
    good_before = np.concatenate(([0], np.cumsum(good)))
    return keys[good], good_before[np.minimum(at, m)]


def _lowered(batch: pa.RecordBatch):
    return utf8(pc.utf8_lower(pc.fill_null(batch.column("text").cast(pa.large_string()), "")))


def _count(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        raw, offsets = _lowered(batch)
        raw = _normal(raw)
        langs = np.asarray(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs)):
            for rows in np.array_split(np.flatnonzero(langs == lang), 1 + int((offsets[1:] - offsets[:-1])[langs == lang].sum() // PIECE)):
                if not len(rows):
                    continue
                text = np.concatenate([raw[offsets[r] : offsets[r + 1]] for r in rows])
                at = np.concatenate(([0], np.cumsum(offsets[rows + 1] - offsets[rows])))
                for n in ORDERS:
                    keys, _ = _grams(text, at, n)
                    if len(keys):
                        keys.sort()
                        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                        counts = np.diff(np.concatenate((first, [len(keys)])))
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first)), pa.array([n] * len(first), pa.int32()), pa.array(keys[first].astype(np.int64)), pa.array(counts)], ["lang", "n", "gram", "uses"])


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, n, gram, uses) over whole texts."""
    part = docs.select("text", "lang").mapInArrow(_count, "lang string, n int, gram long, uses long")
    return part.groupBy("lang", "n", "gram").agg(F.sum("uses").alias("uses"))


def language_grams(docs: DataFrame) -> DataFrame:
    """The n-grams that mark a language: rows (lang, gram), at most len(ORDERS) / MIN_SHARE for each language."""
    counts = materialize(gram_counts(docs), "gram-counts")
    whole = counts.groupBy("lang", "n").agg(F.sum("uses").alias("whole"))
    shares = counts.join(F.broadcast(whole), ["lang", "n"]).withColumn("share", F.col("uses") / F.col("whole")).where(F.col("share") >= MIN_SHARE)
    most = shares.groupBy("gram").agg(F.max("share").alias("most"))
    return shares.join(most, "gram").where(F.col("share") >= MIN_RATIO * F.col("most")).select("lang", "gram")


class LanguageFilter:
    """The bit-sliced Bloom filter: ``slots`` of language bits, a row for each word of the mask, HASHES probes a key."""

    def __init__(self, langs: list[str], size: int):
        self.langs = langs
        bits = max(10, int(np.ceil(np.log2(max(size, 1) * 8))))
        width = next((t for t in (np.uint8, np.uint16, np.uint32) if len(langs) <= np.dtype(t).itemsize * 8), np.uint64)
        self.bits = np.dtype(width).itemsize * 8
        self.slots = np.zeros((max(1, -(-len(langs) // self.bits)), 1 << bits), width)

    def _probes(self, keys: np.ndarray):
        h = mix64(keys)
        for i in range(HASHES):
            yield mix64(h + np.uint64(i)) & np.uint64(self.slots.shape[1] - 1)

    def add(self, keys: np.ndarray, lang: int) -> None:
        word, bit = divmod(lang, self.bits)
        for at in self._probes(keys):
            self.slots[word, at] |= self.slots.dtype.type(1 << bit)

    def languages(self, keys: np.ndarray) -> np.ndarray:
        """Bitmasks of all languages that contain each key: a row for each key, a column for each word."""
        probes = list(self._probes(keys))
        mask = np.empty((len(self.slots), len(keys)), self.slots.dtype)
        for word, own in zip(self.slots, mask, strict=True):
            own[:] = word[probes[0]]
            for at in probes[1:]:
                own &= word[at]
        return mask.T

    def has(self, mask: np.ndarray, lang: int) -> np.ndarray:
        """1 where a mask with a column for each word has the language's bit."""
        word, bit = divmod(lang, self.bits)
        return (mask[:, word] >> mask.dtype.type(bit)) & mask.dtype.type(1)

    def false_rates(self) -> np.ndarray:
        return np.array([self.has(self.slots.T, i).mean() ** HASHES for i in range(len(self.langs))])


def fit(docs: DataFrame) -> LanguageFilter:
    """Learns from (text, lang); rows without a language are left out."""
    grams = language_grams(docs.where(F.col("lang").isNotNull()))
    found = grams.toPandas()  # bounded: len(ORDERS) / MIN_SHARE rows a language
    langs = sorted(found["lang"].unique())
    made = LanguageFilter(langs, found["gram"].nunique())
    for i, lang in enumerate(langs):
        made.add(found.loc[found["lang"] == lang, "gram"].to_numpy().astype(np.uint64), i)
    return made


def predictor(filter_of):
    """A mapInArrow function: rows of documents to rows with ``lang_pred`` and ``score``."""

    def predict(batches):
        model = filter_of.value
        rates = model.false_rates()
        for batch in batches:
            raw, offsets = _lowered(batch)
            texts = batch.column("text")
            letters = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False))
            hits = np.zeros((len(model.langs), batch.num_rows))
            seen = np.zeros(batch.num_rows)
            for a, b in pieces(offsets, PIECE):
                text = _normal(raw[offsets[a] : offsets[b]])
                for n in ORDERS:
                    keys, at = _grams(text, offsets[a : b + 1] - offsets[a], n)
                    mask = model.languages(keys)
                    count = np.diff(at)
                    seen[a:b] += count
                    for i in range(len(model.langs)):
                        total = np.concatenate(([0], np.cumsum(model.has(mask, i), dtype=np.int64)))
                        hits[i, a:b] += total[at[1:]] - total[at[:-1]]
            true = np.maximum(0, (hits - rates[:, None] * seen) / (1 - np.minimum(rates, 0.999))[:, None])
            weight = (true / np.maximum(seen, 1)) ** 4
            best = weight.argmax(0) if len(model.langs) else np.zeros(batch.num_rows, int)
            score = np.where(weight.sum(0) > 0, weight.max(0, initial=0) / np.maximum(weight.sum(0), 1e-300), 1 / max(1, len(model.langs)))
            known = letters & (len(model.langs) > 0)
            names = [model.langs[i] if k else "und" for i, k in zip(best, known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names), pa.array(np.where(known, np.clip(score, 0, 1), 0.0))], ["doc_id", "lang_pred", "score"])

    return predict


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by len(ORDERS) / MIN_SHARE n-grams a language
    return docs.select("doc_id", "text").mapInArrow(predictor(shared), "doc_id long, lang_pred string, score double")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False))
    model = fit(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
