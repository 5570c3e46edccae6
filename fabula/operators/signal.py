"""Signal tables: clips as arrays of samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def signal_metrics(arr: Column, rate: int) -> Column:
    """AGG-11: seconds, peak, RMS, share of clipped samples."""
    squares = F.aggregate(arr, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    n = F.size(arr)
    clipped = F.size(F.filter(arr, lambda x: F.abs(x) >= 0.999))
    return F.struct((n / F.lit(float(rate))).alias("seconds"), F.array_max(F.transform(arr, lambda x: F.abs(x).cast("double"))).alias("peak"), F.sqrt(squares / F.nullif(n, F.lit(0))).alias("rms"), (clipped / F.nullif(n, F.lit(0))).alias("clipped"))


def framed_rms(arr: Column, size: int) -> Column:
    """SIG-1: RMS of whole frames of ``size`` samples."""
    frames = F.floor(F.size(arr) / size).cast("int")
    one = lambda i: F.sqrt(F.aggregate(F.slice(arr, i * size + 1, F.lit(size)), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")) / size)
    return F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), one)).otherwise(F.array().cast("array<double>"))


def silence_bounds(rms: Column, floor_db=-48.0, before=2, after=4) -> Column:
    """SIG-2: first and last loud frame with some room, as (from, to); null for silence."""
    level = F.lit(10 ** (floor_db / 20))
    loud = F.filter(F.sequence(F.lit(0), F.size(rms) - 1), lambda i: F.get(rms, i) > level)
    return F.when((F.size(rms) > 0) & (F.size(loud) > 0), F.struct(F.greatest(F.lit(0), F.array_min(loud) - before).alias("from"), F.least(F.size(rms) - 1, F.array_max(loud) + after).alias("to")))


def plausible(seconds: Column, chars: Column, rms: Column) -> Column:
    """SIG-7: what speaks against a sample."""
    rate = chars / F.nullif(seconds, F.lit(0.0))
    return F.array_compact(F.array(F.when(F.coalesce(rms, F.lit(0.0)) < 1e-4, "silence"), F.when(rate > 25, "fast"), F.when(rate < 5, "slow"), F.when(seconds > 10, "long")))


def judge(clicks: Column, tempo: Column, low: Column, high: Column, pauses: Column, swallowed: Column, score: Column, floor: Column) -> Column:
    """SIG-8: the list of a take's problems."""
    return F.array_compact(F.array(F.when(clicks > 0, "click"), F.when(tempo < low, "slow"), F.when(tempo > high, "fast"), F.when(pauses > 0, "pause"), F.when(swallowed, "swallowed"), F.when(score < floor, "voice")))


def semitone_distance(pitch_a: Column, pitch_b: Column, range_a: Column, range_b: Column) -> Column:
    """SIG-9."""
    return F.abs(12 * F.log2(pitch_a / pitch_b)) + F.abs(range_a - range_b) / 2


def _frames(x: np.ndarray, size: int) -> np.ndarray:
    n = len(x) // size
    return np.sqrt((x[: n * size].reshape(n, size) ** 2).mean(1)) if n else np.zeros(0)


# Fixed values of the click rule, in milliseconds, decibels and multiples.
CLICK_RULE = {
    "surround": 81, "shortest": 120, "ratio": 25.0, "energy": 0.004, "quiet_db": -42.0, "quiet_around": 20, "apart": 6, "speech_percentile": 95, "speech_below": 25.0,
    "from_speech": 80, "skip_before": 2, "skip_after": 3, "tail": (10, 40), "floor": (60, 10), "tail_db": 12.0,
}


def _within(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many flags stand in each range [a, b), cut to the array."""
    upto = np.concatenate(([0], np.cumsum(flags)))
    a, b = np.clip(a, 0, len(flags)), np.clip(b, 0, len(flags))
    return upto[np.maximum(a, b)] - upto[a]


def _median(values: np.ndarray, a: int, b: int) -> float:
    own = values[max(0, a) : max(0, b)]
    return float(np.median(own)) if len(own) else float("nan")


def click_times(x: np.ndarray, rate: int, rule: dict | None = None) -> list[tuple[float, float]]:
    """SIG-3 of one clip: (start, end) in seconds of short wide-band bursts that are heard as clicks.

    A burst is where the second difference's energy stands far above the log mean around it. It is a click if it lies in a
    pause, no speech is near on either side (a plosive is near its word), and it is still again at once (a breath fades).
    Too short clips have none.
    """
    rule = CLICK_RULE | (rule or {})
    size = max(1, rate // 1000)
    n = len(x) // size
    if n < rule["shortest"]:
        return []
    sharp = np.pad(np.diff(np.asarray(x, float), 2), 1)
    in_frames = lambda y: np.sqrt((y[: n * size].reshape(n, size) ** 2).mean(1))
    energy = in_frames(sharp) + 1e-7
    upto = np.concatenate(([0.0], np.cumsum(np.log(energy))))
    half = rule["surround"] // 2
    low, high = np.clip(np.arange(n) - half, 0, n), np.clip(np.arange(n) + half + 1, 0, n)
    around = np.exp((upto[high] - upto[low]) / rule["surround"])  # what lies outside the clip counts as silence of level one, like the rule's
    level = 20 * np.log10(in_frames(np.asarray(x, float)) + 1e-9)
    burst = np.flatnonzero((energy > rule["ratio"] * around) & (energy > rule["energy"]))
    burst = np.array([i for i in burst if _median(level, i - rule["quiet_around"], i + rule["quiet_around"] + 1) < rule["quiet_db"]], int)
    if not len(burst):
        return []
    first = np.flatnonzero(np.concatenate(([True], np.diff(burst) > rule["apart"])))
    starts, ends = burst[first], burst[np.append(first[1:], len(burst)) - 1]
    speech = level > np.percentile(level, rule["speech_percentile"]) - rule["speech_below"]
    near = _within(speech, starts - rule["from_speech"], starts - rule["skip_before"]) + _within(speech, ends + rule["skip_after"], ends + rule["skip_after"] + rule["from_speech"])
    found = []
    for a, b in zip(starts[near == 0], ends[near == 0], strict=True):
        tail, floor = _median(level, b + rule["tail"][0], b + rule["tail"][1]), _median(level, a - rule["floor"][0], max(1, a - rule["floor"][1]))
        if not tail > floor + rule["tail_db"]:  # a burst at the very end has no tail
            found.append((a * size / rate, (b + 1) * size / rate))
    return found


def quiet_clicks(clips: DataFrame) -> DataFrame:
    """SIG-3: (clip_id, at_s, end_s); a null clip has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, *t) for c, s, r in zip(pdf["clip_id"], pdf["samples"], pdf["sample_rate"], strict=True) if s is not None and r for t in click_times(np.asarray(s, float), int(r))]
            yield pd.DataFrame(rows, columns=["clip_id", "at_s", "end_s"]).astype({"at_s": float, "end_s": float})

    kind = dict(clips.dtypes)["clip_id"]
    return clips.select("clip_id", "samples", "sample_rate").mapInPandas(run, f"clip_id {kind}, at_s double, end_s double")


def quiet_cuts(x: np.ndarray, weights: np.ndarray, rate: int, reach=0.3) -> list[int]:
    """SIG-5 of one clip: cuts at the quietest 10 ms frame near each proportional boundary, each after the one before."""
    size = max(1, rate // 100)
    r, ends, cuts = _frames(x, size), np.cumsum(weights) / weights.sum() * len(x), []
    for end in ends[:-1]:
        a = max((cuts[-1] if cuts else 0) // size + 1, int((end - reach * rate) / size))
        b = min(len(r), int((end + reach * rate) / size) + 1)
        cuts.append(int((a + int(np.argmin(r[a:b]))) * size + size // 2) if b > a else int(end))
    return cuts


def split_at_quiet(clips: DataFrame) -> DataFrame:
    """SIG-5: (clip_id, piece, start, end) of clips with a list of row weights."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, s, r, w in zip(pdf["clip_id"], pdf["samples"], pdf["sample_rate"], pdf["weights"], strict=True):
                if s is not None and w is not None and len(w):
                    edge = [0, *quiet_cuts(np.asarray(s, float), np.asarray(w, float), int(r)), len(s)]
                    rows += [(c, i, a, b) for i, (a, b) in enumerate(zip(edge, edge[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["clip_id", "piece", "start", "end"])

    kind = dict(clips.dtypes)["clip_id"]
    return clips.select("clip_id", "samples", "sample_rate", "weights").mapInPandas(run, f"clip_id {kind}, piece int, start long, end long")


def pitch_track(x: np.ndarray, rate: int, low=70, high=500) -> np.ndarray:
    """Pitch of 40 ms frames by the largest autocorrelation in range, voiced frames only."""
    size = int(rate * 0.04)
    n = len(x) // size if size else 0
    out = []
    for frame in x[: n * size].reshape(n, size) if n else ():
        f = frame - frame.mean()
        power = float(f @ f)
        if power < 1e-6 * size:
            continue
        c = np.correlate(f, f, "full")[size - 1 :]
        a, b = max(1, int(rate / high)), min(size - 1, int(rate / low))
        if b > a:
            k = a + int(np.argmax(c[a : b + 1]))
            if c[k] > 0.4 * c[0]:
                out.append(rate / k)
    return np.array(out)


def prosody(clips: DataFrame) -> DataFrame:
    """SIG-6: (clip_id, pitch, range_st, rate): median pitch, spread in semitones, letters a second."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for c, s, r, t in zip(pdf["clip_id"], pdf["samples"], pdf["sample_rate"], pdf["text"], strict=True):
                x = np.zeros(0) if s is None else np.asarray(s, float)
                p = pitch_track(x, int(r))
                spread = 12 * np.log2(np.percentile(p, 95, method="lower") / np.percentile(p, 5, method="lower")) if len(p) else None
                said = sum(ch.isalpha() for ch in t or "")
                rows.append((c, float(np.median(p)) if len(p) else None, spread, said / (len(x) / r) if len(x) else None))
            yield pd.DataFrame(rows, columns=["clip_id", "pitch", "range_st", "rate"]).astype({"pitch": float, "range_st": float, "rate": float})

    kind = dict(clips.dtypes)["clip_id"]
    return clips.select("clip_id", "samples", "sample_rate", "text").mapInPandas(run, f"clip_id {kind}, pitch double, range_st double, rate double")


def voiced_frames(clips: DataFrame, size: int, floor: float) -> DataFrame:
    """SIG-4's long form: (clip_id, frame, voiced)."""
    rms = framed_rms(F.col("samples"), size)
    return clips.select("clip_id", F.posexplode(rms).alias("frame", "rms")).select("clip_id", "frame", (F.col("rms") > floor).alias("voiced"))


def speech_shape(frames: DataFrame, least: int) -> DataFrame:
    """SIG-4: voiced frames and long pauses of each clip."""
    from fabula.operators.windows import pause_runs

    voiced = frames.groupBy("clip_id").agg(F.count_if("voiced").alias("voiced_frames"))
    long = pause_runs(frames, least=least).groupBy("clip_id").agg(F.count("*").alias("long_pauses"))
    return voiced.join(long, "clip_id", "left").na.fill(0, ["long_pauses"])
