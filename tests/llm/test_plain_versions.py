"""Whole chains of the quality classifier, the language filter, the media columns and the word encoder against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import jaccard, langid, media, quality, tokens

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
EXTRA = ", stats string, y string, pick int, raw string, score string"
CLASH = ("clash", "clash", 1, "clash", "clash")


def plain_statistics(text):
    """The columns quality.NAMES of a text, by counting."""
    raw = (text or "").encode()
    n, words = max(1, len(raw)), [m for m in WORDS.finditer(raw)]
    own = [m[0] for m in words]
    upper = [65 <= b <= 90 or i > 0 and raw[i - 1] == 0xC3 and 0x80 <= b <= 0x9E for i, b in enumerate(raw)]
    of, sizes = max(1, len(own)), [len(w) for w in own]
    mean = sum(sizes) / of
    low = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in own]
    pairs = set(zip(low, low[1:], strict=False))
    capital = [sum(upper[m.start() : m.end()]) for m in words]
    symbols, marks = b"#$%&*+<=>@^_`{}~\\/", b".,;:'\"()-?"
    return [
        math.log1p(len(raw)), math.log1p(len(own)), mean, math.sqrt(max(0, sum(s * s for s in sizes) / of - mean**2)), sum(upper) / n, sum(48 <= b <= 57 for b in raw) / n, sum(b >= 128 for b in raw) / n,
        sum(b in marks for b in raw) / n, sum(b in symbols for b in raw) / n, raw.count(b"|") / of, raw.count(b"!") / of, raw.count(b".") / of, raw.count(b"\n") / of, sum(upper[m.start()] for m in words) / of,
        sum(c >= 2 and not re.search(rb"[a-z]", w) for c, w in zip(capital, own, strict=True)) / of, sum(w[-1] in symbols for w in own) / of, len(set(low)) / of, sum(a == b for a, b in zip(low, low[1:], strict=False)) / of,
        len(pairs) / max(len(own) - 1, 1), max(collections.Counter(low).values(), default=0) / of, sum(s <= 2 for s in sizes) / of, sum(s >= 12 for s in sizes) / of,
    ]


def monotone(x, y, w):
    """Weighted isotonic regression by its min-max form."""
    fitted = []
    for i in range(len(x)):
        fitted.append(max(min(np.dot(y[a : b + 1], w[a : b + 1]) / w[a : b + 1].sum() for b in range(i, len(x))) for a in range(i + 1)))
    return np.array(fitted)


def quality_rows():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghÉé") for _ in range(rng.randint(1, 14))) for _ in range(200)]
    rows = []
    for i in range(240):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(3, 60)))
        rows.append((i, text.title() + ".\nAnd." if i % 3 else " ".join(w + rng.choice(["$", "|", "!!", "", "#1"]) for w in text.split()), *CLASH))
    labels = [(i, int(i % 3 > 0) if i % 11 else i % 2) for i in range(200)] + [(0, 1), (None, 1), (5, None), (7777, 1)]
    return rows + [(900, None, *CLASH), (901, "", *CLASH), (902, " A|B! ", *CLASH), rows[3], (None, "x", *CLASH)], labels


def test_quality_is_the_plain_chain(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)
    known = spark.createDataFrame(labels, "doc_id long, y int")
    stats = quality.document_statistics(docs)
    got = collections.defaultdict(list)
    for r in stats.collect():
        got[r.doc_id].append(r.stats)
    for r in rows:
        assert any(np.allclose(plain_statistics(r[1]), s, atol=1e-9) for s in got[r[0]])
    model = quality.fit(stats, known)
    # the chain again: learning rows, random features, normal equations, bins, curve
    ids = [r.id for r in spark.range(1000).where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1 << 20)) % 5 == 0).collect()]  # kept out of the ridge
    said = collections.defaultdict(list)
    for d, y in labels:
        if d is not None and y is not None:
            said[d].append(y)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    learnt = [d for d in said if d in text]
    x = np.array([plain_statistics(text[d]) for d in learnt])
    y = np.array([sum(said[d]) / len(said[d]) for d in learnt])
    rng = np.random.default_rng(5)
    w, b = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], quality.FEATURES)), rng.uniform(0, 2 * np.pi, quality.FEATURES)
    sd = np.where(x.std(0) > 1e-9, x.std(0), 1)
    of = lambda s: np.column_stack([np.cos(np.clip((s - x.mean(0)) / sd, -6, 6) @ w + b) * np.sqrt(2 / quality.FEATURES), np.ones(len(s))])
    aside = np.isin(learnt, ids)
    p, q = of(x[~aside]), y[~aside]
    beta = np.linalg.solve(p.T @ p + quality.RIDGE * len(q) * np.eye(p.shape[1]), p.T @ q)
    raw, bins = of(x[aside]) @ beta, collections.defaultdict(list)
    for r, t in zip(raw, y[aside], strict=True):
        bins[int(np.clip((r + 0.5) * quality.BINS / 2, 0, quality.BINS - 1))].append((r, t))
    mean, share, weight = (np.array([f(bins[k]) for k in sorted(bins)]) for f in (lambda v: np.mean([a for a, _ in v]), lambda v: np.mean([a for _, a in v]), len))
    level = monotone(mean, share, weight.astype(float))
    knots = [(np.average(mean[level == v], weights=weight[level == v]), v) for v in sorted(set(level))]
    every = of(np.array([plain_statistics(r[1]) for r in rows])) @ beta
    want = np.interp(every, [k for k, _ in knots], [v for _, v in knots]) * 0.998 + 0.002 / (1 + np.exp(-4 * (every - 0.5)))
    scores = collections.Counter((r.doc_id, round(r.score, 6)) for r in quality.score(stats, model).collect())
    assert scores == collections.Counter((r[0], round(float(s), 6)) for r, s in zip(rows, np.clip(want, 0, 1), strict=True))


def mixed(x):
    """The scrambling of a 64-bit number, in plain integers."""
    x &= (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
    return x ^ x >> 31


def plain_grams(text):
    """(order, packed n-gram) of a text: letters and bytes beyond ASCII, a space around, no two spaces in one."""
    raw = b" " + bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()) + b" "
    for n in langid.ORDERS:
        for i in range(len(raw) - n + 1):
            part = raw[i : i + n]
            if b"  " not in part:
                yield n, n << 8 * n | int.from_bytes(part, "big")


def test_language_is_the_plain_chain(spark):
    rng = random.Random(9)
    parts = {"xx": ["foo", "bar", "quañ"], "yy": ["ñam", "zil", "ött", "foo"], "zz": ["o", "a", "zil"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(1, 30))) + rng.choice(["", "! 12", "\nX."]), lang, *CLASH) for i in range(150) for lang in [("xx", "yy", "zz")[i % 3]]]
    rows += [(500, None, "xx", *CLASH), (501, "", "yy", *CLASH), (502, "12 !", "zz", *CLASH), (503, "ÑAM Foo", None, *CLASH), rows[4], (None, "zil", "zz", *CLASH)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string" + EXTRA).repartition(3)
    model = langid.fit(docs.where("doc_id is null or doc_id < 100 or doc_id >= 500"))
    counts = collections.defaultdict(collections.Counter)
    for r in rows:
        if r[2] and (r[0] is None or r[0] < 100 or r[0] >= 500):
            for n, g in plain_grams(r[1]):
                counts[r[2], n][g] += 1
    share = {(lang, g): c / sum(own.values()) for (lang, _), own in counts.items() for g, c in own.items()}
    most = collections.defaultdict(float)
    for (_, g), s in share.items():
        most[g] = max(most[g], s) if s >= langid.MIN_SHARE else most[g]
    kept = {(lang, g) for (lang, g), s in share.items() if s >= langid.MIN_SHARE and s >= langid.MIN_RATIO * most[g]}
    langs = sorted({lang for lang, _ in kept})
    size = 1 << max(10, math.ceil(math.log2(len({g for _, g in kept}) * 8)))
    probes = lambda g: [mixed(mixed(g) + i) & (size - 1) for i in range(langid.HASHES)]
    slots = {lang: {p for own, g in kept if own == lang for p in probes(g)} for lang in langs}  # a Bloom filter for each language, as a set
    want = collections.Counter()
    for r in rows:
        grams = [g for _, g in plain_grams(r[1])]
        weight = []
        for lang in langs:
            rate = (len(slots[lang]) / size) ** langid.HASHES
            hits = sum(all(p in slots[lang] for p in probes(g)) for g in grams)
            weight.append((max(0.0, (hits - rate * len(grams)) / (1 - rate)) / max(1, len(grams))) ** 4)
        letter = re.search(r"[^\W\d_]", r[1] or "") is not None
        score = max(weight) / sum(weight) if sum(weight) else 1 / len(langs)
        want[(r[0], langs[weight.index(max(weight))] if letter else "und", round(score if letter else 0.0, 9))] += 1
    assert model.langs == langs
    assert collections.Counter((r.doc_id, r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, model).collect()) == want


def test_media_columns_are_those_of_the_bytes(spark):
    texts = [None, "", "a", "a", "é" * 31, "x" * 64, "y " * 40_000, "日本\n", "\x00"]
    docs = spark.createDataFrame([(i if i else None, t, *CLASH) for i, t in enumerate(texts)], "doc_id long, text string" + EXTRA).repartition(2)
    got = {r.doc_id: r for r in media.read_back(media.media_column(docs)).collect()}
    by_text = collections.defaultdict(set)
    for i, t in enumerate(texts):
        r, raw = got[i if i else None], (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        stored = media.write_matroska(payload)
        samples = list(payload)
        crossings = sum((a >= 128) != (b >= 128) for a, b in zip(samples, samples[1:], strict=False))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and len(stored) >= len(payload)
        told = dict(x.split("=") for x in r.feature.split(";"))
        assert int(told["samples"]) == len(samples) and int(told["crossings"]) == crossings and abs(float(told["mean"]) - sum(samples) / len(samples)) < 1e-5
        by_text[t or ""].add((r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in by_text.values())


def test_word_encoder_is_the_tokenizer():
    """Ten thousand random texts, of the characters that the encoder splits itself and of others."""
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    own, whole, rng = tokens.WordEncoder(path, added=True), Tokenizer.from_file(path), random.Random(7)
    plain = [chr(c) for c in range(0x20, 0x2030) if tokens.WordEncoder.PLAIN.fullmatch(chr(c))]
    said = ["the ", "don't", "I'LL", "n't.", "U.S.A.", "'s", "''", "12,5", "e-mail", "<|startoftext|>", "<|endoftext|>", "...", "a'sb", "it've"]
    texts = []
    for i in range(10_000):
        signs = plain if i % 4 else [*plain, "日", "ſ", "İ", "́", "​", "\U0001f600", "ß", " "]
        texts.append("".join(rng.choice(said) if rng.random() < 0.3 else rng.choice(signs) if rng.random() < 0.6 else rng.choice("aeBst \n.',") for _ in range(rng.randint(0, 25))))
    for a in range(0, len(texts), 1000):
        part = texts[a : a + 1000]
        want = whole.encode_batch(part, add_special_tokens=False)
        for t, ids, e in zip(part, own.encode(part), want, strict=True):
            assert ids.tolist() == e.ids, t


@pytest.mark.parametrize(("long_run", "chunk"), [(3, 4096), (1_000_000, 2)])
def test_jaccard_on_the_other_side_of_its_bounds(spark, monkeypatch, long_run, chunk):
    """Streamed runs and runs dealt as cells give the rows of those that are not."""
    rng = random.Random(2)
    base = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(60)]
    texts = [" ".join(base[:40]) + " " + " ".join(rng.choice(base) for _ in range(2)) for _ in range(14)] + [" ".join(rng.sample(base, 30)) for _ in range(6)] + [" ".join(base[:40])] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = lambda: sorted(map(tuple, jaccard.JaccardJoin(docs).result().select("doc_id", "n_shingles", "component_id").collect()))
    usual = rows()
    monkeypatch.setattr(jaccard, "LONG_RUN", long_run)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    assert rows() == usual and len({c for _, _, c in usual}) < len(texts)


def test_decontamination_without_a_broadcast(spark, monkeypatch):
    """Items beyond the bound are joined, with the rows of those that are sent to all tasks."""
    from fabula.llm import decontam

    rng = random.Random(3)
    say = lambda n: " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(n))
    items = [(i, say(rng.randint(3, 30))) for i in range(12)]
    docs = spark.createDataFrame([(i, say(10) + " " + (items[i % 12][1] if i % 2 else say(8)) + " " + say(10)) for i in range(30)], "doc_id long, text string").repartition(3)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: sorted(map(tuple, decontam.contaminated(docs, benchmark).select("doc_id", "item_id", F.round("similarity", 9)).collect()))
    usual = rows()
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert rows() == usual and len(usual) >= 15
