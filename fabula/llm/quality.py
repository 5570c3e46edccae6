"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

A document becomes a row of statistics of its whole text. Random Fourier features of the standardised statistics
approximate a Gaussian kernel; every partition of the learning rows sums its own normal equations, the sums are added and
solved with a ridge, and a monotone step curve fitted by pooling adjacent violators on rows kept out of the ridge turns
scores into probabilities.

Defined cases: a null text counts as empty; an empty text has a score like any other; repeated labels of a document are
averaged; without labels of both kinds every score is the labelled share (0.5 without labels); at most ``max_rows``
labelled rows are learnt from, chosen by a hash of the doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import documents, id_fold, materialize, pieces, segment_sums, table, utf8, words_of

FEATURES = 256
RIDGE = 1e-4
MAX_ROWS = 1_000_000
ROWS_A_PART = 50_000
#: Tasks that add up the partitions' sums.
SUM_TASKS = 4
BINS = 2000
PIECE = 2_000_000
NAMES = (
    "log_bytes", "log_words", "mean_word", "sd_word", "upper", "digit", "high", "punct", "symbol", "pipe", "bang", "stop", "newline",
    "cap_words", "all_cap_words", "symbol_end_words", "distinct_words", "same_next", "distinct_pairs", "top_word", "short_words", "long_words",
)


def _distinct(row: np.ndarray, h: np.ndarray, rows: int):
    """Distinct values in each row and the count of its most frequent one."""
    key = np.sort((row.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
    owner = (key[first] >> np.uint64(40)).astype(int)
    most = np.zeros(rows)
    np.maximum.at(most, owner, np.diff(np.concatenate((first, [len(key)]))))
    return np.bincount(owner, minlength=rows), most


def statistics(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The columns NAMES for each row of a batch of texts."""
    rows = len(at) - 1
    size = np.diff(at)
    upper = (raw >= 65) & (raw <= 90)
    if len(raw) > 1:  # the capitals of the two-byte Latin letters
        upper[1:] |= (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E)
    lower = (raw >= 97) & (raw <= 122)
    digit = (raw >= 48) & (raw <= 57)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    symbol = np.isin(raw, np.frombuffer(b"#$%&*+<=>@^_`{}~\\/", np.uint8))
    punct = np.isin(raw, np.frombuffer(b".,;:'\"()-?", np.uint8))
    count = lambda m: segment_sums(m.astype(np.int8), at)
    start, end, row, h = words_of(raw, at)
    length = (end - start).astype(float)
    words = np.bincount(row, minlength=rows)
    of = np.maximum(words, 1)
    total = np.bincount(row, length, rows)
    square = np.bincount(row, length**2, rows)
    caps = np.concatenate(([0], np.cumsum(upper)))
    small = np.concatenate(([0], np.cumsum(lower)))
    first_cap = upper[start] if len(start) else np.zeros(0, bool)
    all_caps = (caps[end] - caps[start] >= 2) & (small[end] == small[start]) if len(start) else first_cap
    odd_end = symbol[end - 1] if len(start) else first_cap
    same = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    inside = row[1:] == row[:-1]
    distinct, top = _distinct(row, h, rows)
    pairs, _ = _distinct(row[1:][inside], (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])[inside], rows)
    per = np.maximum(size, 1)
    mean = total / of
    return np.column_stack([
        np.log1p(size), np.log1p(words), mean, np.sqrt(np.maximum(0, square / of - mean**2)), count(upper) / per, count(digit) / per, count(raw >= 128) / per,
        count(punct) / per, count(symbol) / per, count(raw == 124) / of, count(raw == 33) / of, count(raw == 46) / of, count(raw == 10) / of,
        np.bincount(row, first_cap, rows) / of, np.bincount(row, all_caps, rows) / of, np.bincount(row, odd_end, rows) / of, distinct / of,
        np.bincount(row[1:][same], minlength=rows) / of, pairs / np.maximum(words - 1, 1), top / of, np.bincount(row, length <= 2, rows) / of, np.bincount(row, length >= 12, rows) / of,
    ])


def _statistics(batches):
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        out = [statistics(raw[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in pieces(at, PIECE)]
        values = np.concatenate(out) if out else np.zeros((0, len(NAMES)))
        stats = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(NAMES)), pa.int32()), pa.array(values.ravel()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), stats], ["doc_id", "stats"])


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats array) for every whole text."""
    return docs.select("doc_id", "text").mapInArrow(_statistics, "doc_id long, stats array<double>")


class Fourier:
    """cos(W z + b) of the standardised statistics, with a constant term."""

    def __init__(self, mean: np.ndarray, sd: np.ndarray, features: int = FEATURES, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.sd = mean, np.where(sd > 1e-9, sd, 1)
        self.w = rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.sd, -6, 6)
        return np.column_stack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones(len(z))])


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _normal_equations(fourier: Fourier):
    def sums(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                x = fourier(_matrix(batch.column("stats")))
                total += x.T @ np.column_stack([x, batch.column("y").to_numpy()])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])

    return sums


def pool_adjacent_violators(x: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Knots of the weighted monotone least-squares curve through (x, y), x ascending."""
    blocks: list[list[float]] = []
    for xi, yi, wi in zip(x, y, weight, strict=True):
        blocks.append([xi * wi, yi * wi, wi])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


class QualityModel:
    """Statistics to calibrated scores from 0 to 1."""

    def __init__(self, fourier=None, beta=None, knots=None, share: float = 0.5):
        self.fourier, self.beta, self.knots, self.share = fourier, beta, knots, share

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.full(len(stats), self.share)
        raw = self.raw(stats)
        if self.knots is None:
            return np.clip(raw, 0, 1)
        # a hair of the ridge score keeps the order inside the curve's flat parts
        return np.clip(np.interp(raw, *self.knots) * 0.998 + 0.002 / (1 + np.exp(-np.clip(4 * (raw - 0.5), -30, 30))), 0, 1)


def _added(batches):
    """The sum of the parts of a task."""
    total = None
    for batch in batches:
        for part in batch.column("part"):
            own = np.frombuffer(part.as_buffer())
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def fit(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> QualityModel:
    """Learns ``labels`` (doc_id, y) on document statistics (doc_id, stats)."""
    y = labels.where(F.col("y").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(F.col("y").cast("double")).alias("y"))
    known = stats.join(y, "doc_id").groupBy("doc_id").agg(F.min("stats").alias("stats"), F.first("y").alias("y")).withColumn("pick", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 20)))
    known = materialize(known, "quality-rows")
    n, share, low, high = known.agg(F.count("*"), F.avg("y"), F.min("y"), F.max("y")).first()
    if not n or low == high:
        return QualityModel(share=0.5 if share is None else float(share))
    known = known.where(F.col("pick") < max_rows / n * (1 << 20))
    moments = known.select(*[f(F.element_at("stats", i + 1)) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    fourier = Fourier(np.array(moments[::2], float), np.array(moments[1::2], float))
    parts = int(min(n, max_rows) // ROWS_A_PART) + 1
    calibrating = F.col("pick") % 5 == 0
    fitting = known.where(~calibrating) if n >= 50 else known
    sums = fitting.repartition(parts, "doc_id").sortWithinPartitions("doc_id").select("stats", "y").mapInArrow(_normal_equations(fourier), "part binary")
    few = sums.repartition(SUM_TASKS).mapInArrow(_added, "part binary")  # however many partitions there are, the driver gets a few sums
    total = sum(np.frombuffer(r.part).reshape(FEATURES + 1, FEATURES + 2) for r in few.collect())
    gram, moment = total[:, :-1], total[:, -1]
    beta = np.linalg.solve(gram + RIDGE * gram[-1, -1] * np.eye(FEATURES + 1), moment)
    model = QualityModel(fourier, beta)

    def binned(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            bin_ = np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(bin_), pa.array(raw), batch.column("y")], ["bin", "raw", "y"])

    curve = (known.where(calibrating) if n >= 50 else known).select("stats", "y").mapInArrow(binned, "bin long, raw double, y double")
    curve = curve.groupBy("bin").agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("bin").toPandas()  # BINS rows at most
    if len(curve) > 1:
        model.knots = pool_adjacent_violators(curve["raw"].to_numpy(), curve["y"].to_numpy(), curve["n"].to_numpy().astype(float))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) of document statistics; the model is a few thousand numbers."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def scored(batches):
        for batch in batches:
            s = shared.value.score(_matrix(batch.column("stats"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return stats.mapInArrow(scored, "doc_id long, score double")


def good_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.5) -> DataFrame:
    """The documents that score at least ``threshold``; rows stay where they are, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kept(batches):
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            good = [shared.value.score(statistics(raw[at[a] : at[b]], at[a : b + 1] - at[a])) >= threshold for a, b in pieces(at, PIECE)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(kept, docs.schema)


def learning_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"))
    return labels.where(~F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(document_statistics(documents(spark, sf_dir)), "quality-stats")
    model = fit(stats, learning_labels(spark, sf_dir))
    scored = score(stats, model)
    held_out = F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
