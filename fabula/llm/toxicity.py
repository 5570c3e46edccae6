"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts.

The labelled rows that are learnt from give pairs of neighbouring words (a document's first word follows a start mark) with
their uses in toxic and in ordinary documents. Each class has an interpolated Kneser-Ney model: a pair's discounted uses,
then the word's discounted continuation count in the class (in how many contexts it was seen), then the continuation count
that both classes share, with one added for a word never seen. What was seen once is discounted wholly, so it says nothing
of its own. All counts are tables made by joins and groupings, and grow with the labelled rows.

A text is scored by the difference of its toxic and ordinary log-likelihood, divided by length, taken over the whole text
and over every run of ``RUNS`` words (an insult is a few words of a long text), for the word model and the pair model. A
logistic curve over these, fitted on at most ``CURVE_ROWS`` labelled rows that the counts leave out (a fifth by a hash of
doc_id), gives the score from 0 to 1.

The table of logarithms goes to all tasks if it has at most ``SHARED_KEYS`` rows; beyond that tasks write it by ranges of keys
into files of the shared folder, in which workers look the words of a piece of texts up, with the same scores. The files are
mapped into memory, not read, so that an executor's workers share their pages and hold no table of their own; of a store
that cannot be mapped each worker keeps a copy on its disk. Neither texts nor words are shuffled.

Defined cases: a null text counts as empty; an empty text scores what a text of no evidence scores; A to Z count as lower
case; words are ``[^\\x20\\x09-\\x0D]+`` without ASCII punctuation at their ends; repeated labels of a document are
averaged (toxic from one half); null labels and ids teach nothing; without learnt labels of both kinds every score is the
learnt share of toxic rows (0 without labels); repeated rows are learnt from as often as they
stand, and scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import documents, fresh_path, id_fold, materialize, mix64, pieces, release, span_hashes, table, utf8

DISCOUNT = 0.75
RUNS = (1, 3, 10)
CURVE_ROWS = 20_000
CURVE_FOLDS = 5
THRESHOLD = 0.3
RIDGE = 1e-3
#: Rows of the table of logarithms (20 bytes each) that every worker may hold.
SHARED_KEYS = 8_000_000
#: Rows of one file of a larger table.
FILE_KEYS = 1_000_000
#: Labelled rows (16 bytes each) that may be sent to all tasks to find their texts.
SHARED_LABELS = 4_000_000
PIECE = 1_000_000
#: Words whose pairs a task adds up before it passes them on.
HELD_WORDS = 2_000_000
#: Parts in which the driver gets the table.
SLICES = 8
START = np.uint64(0x5EED)
_PUNCTUATION = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))


def toxic_words(raw: np.ndarray, offsets: np.ndarray):
    """64-bit hashes of the words of each row in order, and the row of each word."""
    low = raw.copy()
    low[(raw >= 65) & (raw <= 90)] += np.uint8(32)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~gap
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    solid = np.flatnonzero(~_PUNCTUATION[raw])  # bytes that a word cannot be trimmed of
    if len(solid):
        first = np.searchsorted(solid, start)
        last = np.searchsorted(solid, end) - 1
        some = first <= last
        start, end, row = solid[first[some]], solid[last[some]] + 1, row[some]
    else:
        start, end, row = start[:0], end[:0], row[:0]
    return span_hashes(low, start, end), row


def contexts(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The word before each word of its row, or the start mark."""
    before = np.empty_like(words)
    if len(words):
        before[0], before[1:] = START, words[:-1]
        before[np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))] = START
    return before


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + mix64(words))


def _pairs(batches):
    """(h, w, n0, n1) of labelled texts, added up within some million words."""
    held, size = [], 0

    def summed():
        before, words, toxic = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((words, before))
        before, words, toxic = before[order], words[order], toxic[order]
        first = np.flatnonzero(np.concatenate(([True], (before[1:] != before[:-1]) | (words[1:] != words[:-1]))))
        n1 = np.add.reduceat(toxic, first)
        n = np.diff(np.concatenate((first, [len(words)])))
        made = [before[first].view(np.int64), words[first].view(np.int64), n - n1, n1]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["h", "w", "n0", "n1"])

    for batch in batches:
        raw, at = utf8(batch.column("text"))
        toxic = batch.column("toxic").to_numpy()
        for a, b in pieces(at, PIECE):
            words, row = toxic_words(raw[at[a] : at[b]], at[a : b + 1] - at[a])
            if len(words):
                held.append((contexts(words, row), words, toxic[a:b][row].astype(np.int64)))
                size += len(words)
            if size >= HELD_WORDS:
                yield summed()
                held, size = [], 0
    if held:
        yield summed()


def _less(n: str) -> Column:
    """A count after the discount, which takes all of a one."""
    return F.when(F.col(n) > 1, F.col(n) - DISCOUNT).otherwise(0.0)


def labelled_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the documents with a label (doc_id, toxic); texts stay in their partitions while labels are few."""
    few = labels.limit(SHARED_LABELS + 1).count() <= SHARED_LABELS
    return docs.select("doc_id", "text").join(F.broadcast(labels) if few else labels, "doc_id")


class KneserNey:
    """Log ratios of the two classes: table ``rows`` (kind 0 word: a, b for the word and for what follows it; kind 1 pair: a)."""

    def __init__(self, rows: DataFrame | None, unknown: float = 0.0):
        self.rows, self.unknown, self.files = rows, unknown, None


def fit_counts(texts: DataFrame) -> KneserNey | None:
    """Both models from (text, toxic 0/1); None if a class has no words."""
    spark = texts.sparkSession
    pairs = texts.select("text", "toxic").mapInArrow(_pairs, "h long, w long, n0 long, n1 long")
    pairs = materialize(pairs.groupBy("h", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-pairs")
    release(spark)
    zero = F.lit(0)
    seen = [(F.col(n) > 0).cast("long") for n in ("n0", "n1")]
    as_word = F.struct(F.col("w").alias("key"), seen[0].alias("k0"), seen[1].alias("k1"), F.lit(1).alias("k"), zero.cast("long").alias("c0"), zero.cast("long").alias("c1"), F.lit(0.0).alias("d0"), F.lit(0.0).alias("d1"))
    as_context = F.struct(F.col("h").alias("key"), zero.cast("long").alias("k0"), zero.cast("long").alias("k1"), zero.alias("k"), F.col("n0").alias("c0"), F.col("n1").alias("c1"), _less("n0").alias("d0"), _less("n1").alias("d1"))
    names = ("k0", "k1", "k", "c0", "c1", "d0", "d1")
    tally = pairs.select(F.inline(F.array(as_word, as_context))).groupBy("key").agg(*[F.sum(c).alias(c) for c in names])
    tally = materialize(tally, "toxic-words")
    total = tally.agg(*[F.sum(c).alias(c) for c in ("k0", "k1", "k")], F.sum(_less("k0")).alias("l0"), F.sum(_less("k1")).alias("l1"), F.count_if(F.col("k") > 0).alias("v")).first()
    if not total.k0 or not total.k1:
        return None
    shared = (F.col("k") + 1) / (total.k + total.v + 1)
    gamma = [1 - total.l0 / total.k0, 1 - total.l1 / total.k1]
    unknown = float(np.log(max(gamma[1], 1e-12) / max(gamma[0], 1e-12)))
    word = [_less(f"k{c}") / total[f"k{c}"] + max(gamma[c], 1e-12) * shared for c in (0, 1)]
    rest = [F.when(F.col(f"c{c}") > 0, F.greatest(1 - F.col(f"d{c}") / F.col(f"c{c}"), F.lit(1e-12))).otherwise(1.0) for c in (0, 1)]
    known = tally.select("key", "c0", "c1", *[word[c].alias(f"p{c}") for c in (0, 1)], *[rest[c].alias(f"g{c}") for c in (0, 1)], ((F.col("k0") > 1) | (F.col("k1") > 1) | (F.col("d0") > 0) | (F.col("d1") > 0)).alias("says"))
    words = known.where("says").select(F.lit(0).alias("kind"), "key", F.log(F.col("p1") / F.col("p0")).alias("a"), F.log(F.col("g1") / F.col("g0")).alias("b"))
    twice = pairs.where("n0 > 1 or n1 > 1")
    joined = twice.join(known.select(F.col("key").alias("h"), "c0", "c1", "g0", "g1"), "h").join(known.select(F.col("key").alias("w"), "p0", "p1"), "w")
    of = [F.when(F.col(f"c{c}") > 0, _less(f"n{c}") / F.col(f"c{c}")).otherwise(0.0) + F.col(f"g{c}") * F.col(f"p{c}") for c in (0, 1)]

    def keyed(batches):
        for batch in batches:
            h, w = (batch.column(c).to_numpy().view(np.uint64) for c in ("h", "w"))
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.array(pair_keys(h, w).view(np.int64)), batch.column("a"), pa.array(np.zeros(n))], ["kind", "key", "a", "b"])

    expressions = joined.select("h", "w", F.log(of[1] / of[0]).alias("a")).mapInArrow(keyed, "kind int, key long, a double, b double")
    return KneserNey(materialize(words.unionByName(expressions), "toxic-model"), unknown)


class Table:
    """Keys and the values of each, in parts (keys in order, values) that follow one another by their keys."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray]], n_values: int):
        self.parts, self.n_values = parts, n_values
        self.firsts = np.array([keys[0] for keys, _ in parts], np.int64)

    def find(self, asked: np.ndarray):
        """Whether each key is in the table, and its values (any if it is not). Keys are looked up once and in order, so memory is read in order too."""
        distinct, place = np.unique(asked, return_inverse=True)
        known, got = np.zeros(len(distinct), bool), np.zeros((self.n_values, len(distinct)), np.float32)
        cuts = np.searchsorted(distinct, self.firsts).tolist() + [len(distinct)]
        for (keys, values), a, b in zip(self.parts, cuts[:-1], cuts[1:], strict=True):
            if a < b:
                at = np.minimum(np.searchsorted(keys, distinct[a:b]), len(keys) - 1)
                known[a:b], got[:, a:b] = keys[at] == distinct[a:b], values[:, at]
        return known[place], got[:, place]


def in_memory(key: np.ndarray, *values: np.ndarray) -> Table:
    order = np.argsort(key)
    return Table([(key[order], np.stack([x[order].astype(np.float32) for x in values]))] if len(key) else [], len(values))


def _mapped(path: str) -> np.ndarray:
    fs, place = pafs.FileSystem.from_uri(path)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(place, np.uint8, "r")
    with tempfile.TemporaryFile() as own, fs.open_input_stream(place, compression=None) as source:  # it has no name, and goes with its map
        shutil.copyfileobj(source, own)
        own.flush()
        return np.memmap(own, np.uint8, "r")


@lru_cache(maxsize=2)
def in_files(files: tuple, n_values: int) -> Table:
    """The table of some files (first key, rows, path), each the keys and then the values of its rows. A worker keeps those of words and of pairs open from task to task."""
    raw = [(_mapped(path), n) for _, n, path in files]
    return Table([(x[: 8 * n].view(np.int64), x[8 * n :].view(np.float32).reshape(n_values, n)) for x, n in raw], n_values)


def write_files(rows: DataFrame, *names: str) -> tuple:
    """(first key, rows, path) of the files of a table (key and the values named) in the shared folder, in order."""
    folder = fresh_path(rows.sparkSession, "toxic-files")

    def written(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        held, size = [], 0

        def flush():
            key, *values = (np.concatenate(x) for x in zip(*held, strict=True))
            path = f"part-{uuid.uuid4().hex}"
            with fs.open_output_stream(f"{base}/{path}", compression=None) as out:
                for x in (key, *values):
                    out.write(x.tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in ((key[0], pa.int64()), (len(key), pa.int64()), (f"{folder}/{path}", pa.string()))], ["first", "n", "path"])

        for batch in batches:
            for a in range(0, batch.num_rows, FILE_KEYS):
                own = batch.slice(a, FILE_KEYS)
                if size + own.num_rows > FILE_KEYS and held:
                    yield flush()
                    held, size = [], 0
                held.append([own.column("key").to_numpy(), *(own.column(c).to_numpy().astype(np.float32) for c in names)])
                size += own.num_rows
        if held:
            yield flush()

    parts = max(1, -(-rows.count() // FILE_KEYS))
    ordered = rows.select("key", *[F.col(c).cast("float").alias(c) for c in names]).repartitionByRange(parts, "key").sortWithinPartitions("key")
    return tuple(sorted((r.first, r.n, r.path) for r in ordered.mapInArrow(written, "first long, n long, path string").collect()))  # a row a file


class Evidence:
    """The table of log ratios: values of each word by the word model and by the pair model."""

    def __init__(self, words: Table, pairs: Table, unknown: float):
        self.words, self.pairs, self.unknown = words, pairs, unknown

    def values(self, words: np.ndarray, row: np.ndarray):
        before = contexts(words, row)
        known, (alone, next_to) = self.words.find(words.view(np.int64))
        by_word = np.where(known, alone, self.unknown)
        after = np.zeros(len(words))
        if len(words):
            follow = np.where(known, next_to, 0.0)
            after[1:] = follow[:-1]
            known, (_, start) = self.words.find(np.array([START]).view(np.int64))
            after[before == START] = start[0] if known[0] else 0.0
        known, (of_pair,) = self.pairs.find(pair_keys(before, words).view(np.int64))
        return by_word, np.where(known, of_pair, by_word + after)


FEATURES = 2 * (1 + len(RUNS)) + 1


def features(by_word: np.ndarray, by_pair: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """For each row: means over the whole text and greatest means over runs of words, by both models, and the log of the length."""
    n = np.bincount(row, minlength=rows)
    last = np.cumsum(n)
    out = []
    for value in (by_word, by_pair):
        total = np.concatenate(([0.0], np.cumsum(value, dtype=float)))  # over a whole piece, so in doubles
        out.append((total[last] - total[last - n]) / np.maximum(n, 1))
        for run in RUNS:
            most = np.zeros(rows)
            if len(value):
                i = np.arange(len(value))
                j = np.minimum(i + run, last[row])
                i = np.where(j - i < run, np.maximum(j - run, (last - n)[row]), i)  # a run at the end reaches back; a short text is one run
                first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                most[row[first]] = np.maximum.reduceat((total[j] - total[i]) / (j - i), first)
            out.append(most)
    return np.column_stack([*out, np.log1p(n)])


def _as_arrays(ids: pa.Array, values: np.ndarray) -> pa.RecordBatch:
    made = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, FEATURES), pa.int32()), pa.array(values.ravel()))
    return pa.RecordBatch.from_arrays([ids, made], ["doc_id", "stats"])


def document_evidence(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, stats) of every whole text."""
    spark, rows, unknown = docs.sparkSession, model.rows, model.unknown
    if rows.limit(SHARED_KEYS + 1).count() > SHARED_KEYS:
        files = model.files = model.files or (write_files(rows.where("kind = 0"), "a", "b"), write_files(rows.where("kind = 1"), "a"))
        made_of = lambda: Evidence(in_files(files[0], 2), in_files(files[1], 1), unknown)
    else:
        slim = rows.select(F.col("kind").cast("tinyint").alias("kind"), "key", F.col("a").cast("float").alias("a"), F.col("b").cast("float").alias("b"))
        got = pa.concat_tables([slim.where(F.pmod("key", F.lit(SLICES)) == i).toArrow() for i in range(SLICES)])  # SHARED_KEYS rows at most
        kind, *columns = (got.column(c).to_numpy() for c in ("kind", "key", "a", "b"))
        shared = spark.sparkContext.broadcast(Evidence(in_memory(*(x[kind == 0] for x in columns)), in_memory(*(x[kind == 1] for x in columns[:2])), unknown))
        made_of = lambda: shared.value
        del got, kind, columns

    def scored(batches):
        evidence = made_of()
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            made = []
            for a, b in pieces(at, PIECE):
                words, row = toxic_words(raw[at[a] : at[b]], at[a : b + 1] - at[a])
                made.append(features(*evidence.values(words, row), row, b - a))
            yield _as_arrays(batch.column("doc_id"), np.concatenate(made) if made else np.zeros((0, FEATURES)))

    return docs.select("doc_id", "text").mapInArrow(scored, "doc_id long, stats array<double>")


class Curve:
    """A logistic curve over standardised statistics, fitted by Newton steps with a ridge."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.mean, sd = x.mean(0), x.std(0)
        self.sd = np.where(sd > 1e-9, sd, 1)
        z = self._inputs(x)
        self.beta = np.zeros(z.shape[1])
        share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
        self.beta[-1] = np.log(share / (1 - share))
        keep = RIDGE * len(y) * np.eye(z.shape[1])
        keep[-1, -1] = 1e-9
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ self.beta, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ self.beta)
            self.beta += step
            if np.abs(step).max() < 1e-9:
                break

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.sd, -8, 8), np.ones(len(x))])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._inputs(x) @ self.beta, -30, 30)))


class ToxicityModel:
    def __init__(self, counts: KneserNey | None, curve: Curve | None, share: float):
        self.counts, self.curve, self.share = counts, curve, share


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns ``labels`` (doc_id, y 0 or 1) on the texts of documents."""
    clean = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    clean = materialize(clean.select("doc_id", (F.col("y") >= 0.5).cast("int").alias("toxic"), (F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(CURVE_FOLDS)) == 0).alias("aside"), F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)).alias("pick")), "toxic-labels")
    n, share, of_aside, toxic_aside = clean.agg(F.count("*"), F.avg("toxic"), F.count_if("aside"), F.count_if(F.col("aside") & (F.col("toxic") == 1))).first()
    share = float(share or 0.0)
    if not n or share in (0.0, 1.0):
        return ToxicityModel(None, None, share)
    split = n >= 50 and 0 < toxic_aside < of_aside  # too few rows to keep some aside: the curve is fitted on the rows that were counted
    counted = clean.where(~F.col("aside")) if split else clean
    counts = fit_counts(labelled_texts(docs, counted.select("doc_id", "toxic")))
    if counts is None:
        return ToxicityModel(None, None, share)
    release(docs.sparkSession)
    shown = clean.where(F.col("aside")) if split else clean
    size = max(1, of_aside if split else n)
    shown = shown.where(F.col("pick") < CURVE_ROWS / size * (1 << 20)).select("doc_id", "toxic")  # some 20,000 rows
    texts = docs.select("doc_id", "text").join(F.broadcast(shown.select("doc_id")), "doc_id", "left_semi")
    got = document_evidence(texts, counts).join(F.broadcast(shown), "doc_id").select("stats", "toxic").toArrow()
    x = got.column("stats").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
    y = got.column("toxic").to_numpy().astype(float)
    if not 0 < y.sum() < len(y):
        return ToxicityModel(None, None, share)
    return ToxicityModel(counts, Curve(x, y), share)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) of every row of documents."""
    if model.curve is None:
        return docs.select("doc_id", F.lit(model.share).alias("score"))
    curve = model.curve

    def scored(batches):
        for batch in batches:
            x = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(curve(x))], ["doc_id", "score"])

    return document_evidence(docs, model.counts).mapInArrow(scored, "doc_id long, score double")


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = F.coalesce(id_fold("doc_id", 4) == 2, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("y"))
    scored = score(docs, fit(docs, labels.where(~held_out)))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
