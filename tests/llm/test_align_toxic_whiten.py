"""Alignment, toxicity and whitening against plain versions, and their defined cases."""

import collections
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import alignment, toxicity, whitening

EXTRA = ", lang string, size string, row string, n_a string, pair string, stats string"
CLASH = (None, "clash", "clash", "clash", "clash", "clash")


@pytest.fixture(scope="module")
def paths():
    return alignment.vocabulary_path(alignment.VOCABULARY_A), alignment.vocabulary_path(alignment.VOCABULARY_B)


@pytest.fixture(scope="module")
def own(paths):
    return alignment.Aligner(*paths)


def plain_alignment(both, text):
    """Tokens of the whole text by both libraries, the groups between common ends, and the overlapping pairs, by comparing all."""
    if not text:
        return None
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    pieces = [[both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b]]
    if any(b"".join(p) != (" " + text).encode() for p in pieces):
        return None
    ends = [np.cumsum([len(x) for x in p]).tolist() for p in pieces]
    said, i, j = [], 0, 0
    for cut in sorted(set(ends[0]) & set(ends[1])):
        i2, j2 = ends[0].index(cut) + 1, ends[1].index(cut) + 1
        said.append(",".join(map(str, a[i:i2])) + "|" + ",".join(map(str, b[j:j2])))
        i, j = i2, j2
    links = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if max(ends[0][i] - len(pieces[0][i]), ends[1][j] - len(pieces[1][j])) < min(ends[0][i], ends[1][j])]
    return a, b, said, links


def test_words_apart_are_aligned_as_whole_texts(own):
    rng = random.Random(1)
    signs = list("abcÀé,,.!²  \n\n\t'sté１9 　 é日ß▁Ж") + ["<|endoftext|>", "\U0001f600", " I'll don't 12", "\x00", "\x1c", "​", " ", "the ", "</s>", "<0x0A>"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(1, 40)))
        words = own.split(" " + text)
        assert "".join(words) == " " + text
        own.learn(set(words))
        entries, want = [own[w] for w in words], plain_alignment(own.both, text)
        assert (None in entries) == (want is None)
        if want:
            assert ";".join(e[3] for e in entries) == ";".join(want[2])
            assert collections.Counter(int(x) for e in entries for x in np.frombuffer(e[4], np.int64)) == collections.Counter(x << 32 | y for x, y in want[3])


def test_groups_are_the_common_ends():
    rng = random.Random(2)
    for _ in range(500):
        end = rng.randint(1, 30)
        ends = [sorted({rng.randint(1, end) for _ in range(rng.randint(0, 12))} | {end}) for _ in range(2)]
        found = alignment.groups(*ends)
        assert [ends[0][g[1] - 1] for g in found] == sorted(set(ends[0]) & set(ends[1])) == [ends[1][g[3] - 1] for g in found]
        assert [g[0] for g in found[1:]] == [g[1] for g in found[:-1]] and [g[2] for g in found[1:]] == [g[3] for g in found[:-1]]
    deep = list(range(1, 20001))
    assert len(alignment.groups(deep, deep)) == 20000 and alignment.groups(list(range(1, 40000, 2)) + [40000], list(range(2, 40001, 2))) == [(0, 20001, 0, 20000)]


@pytest.mark.parametrize("most", [alignment.SHARED_PAIRS, 3])
def test_alignment_is_brute_force(spark, own, monkeypatch, most):
    monkeypatch.setattr(alignment, "SHARED_PAIRS", most)
    texts = [None, "", " ", "\n", "a", "Hello world, it's fine.", "Hello world, it's fine.", "tab\tand\nline  two", "has ▁ mark", "naïve Ünïcode 日本語 \U0001f600", "x" * 3000, "the cat sat " * 700, "<|endoftext|></s>", "2024-01-01: 3.50%"]
    rows = [(i, t, *CLASH) for i, t in enumerate(texts)] + [(3, "again", *CLASH), (None, "Hello world", *CLASH), (5, texts[5], *CLASH)]
    docs = spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)
    plain = [(r[0], plain_alignment(own.both, r[1])) for r in rows]
    count = collections.Counter(p for _, x in plain if x for p in x[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(n, best.get(b, 0))
    want = collections.Counter()
    for d, x in plain:
        if x:
            a, b, said, links = x
            want[(d, len(a), len(b), len(said), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links), hashlib.sha256(";".join(said).encode()).hexdigest())] += 1
        else:
            want[(d, 0, 0, 0, 0, 0, 0, "")] += 1
    assert collections.Counter(map(tuple, alignment.align(docs).collect())) == want
    assert alignment.align(docs.limit(0)).count() == 0


def toxic_corpus():
    rng = random.Random(4)
    common = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        words = [rng.choice(common) for _ in range(rng.randint(10, 80))]
        if bad:
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(["dolt", "Oaf", "twit!", "lout"])
        rows.append((i, " ".join(words) + ".", *CLASH))
        labels.append((i, int(bad)))
    labels += [(0, 1), (None, 1), (7, None), (9999, 1)]
    rows += [(1000, None, *CLASH), (1001, "", *CLASH), (1002, " \n ", *CLASH), (1003, "... !!", *CLASH), rows[5], (None, "dolt", *CLASH), (1004, "a oaf " + "lina " * 30000, *CLASH)]
    return rows, labels


def plain_models(rows, labels):
    """The whole chain of both models with dictionaries."""
    said = {}
    for d, y in labels:
        if d is not None and y is not None:
            said.setdefault(d, []).append(y)
    trained = [(r[1], int(sum(said[r[0]]) / len(said[r[0]]) >= 0.5)) for r in rows if r[0] in said]
    uses = [collections.Counter(), collections.Counter()]
    split = lambda t: [w for w in (w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") for w in (t or "").lower().split()) if w]
    for text, y in trained:
        words = split(text)
        uses[y].update(zip(["<s>", *words], words, strict=False))
    less = lambda n: n - 0.75 if n > 1 else 0.0
    follow, every = [], collections.Counter(w for _, w in set(uses[0]) | set(uses[1]))
    for c in uses:
        follow.append(collections.Counter(w for _, w in c))
    vocabulary = len(every)
    word, rest, left = [], [], []
    for c in (0, 1):
        total = sum(follow[c].values())
        left.append(1 - sum(map(less, follow[c].values())) / total)
        word.append(lambda w, c=c, total=total: less(follow[c][w]) / total + left[c] * (every[w] + 1) / (sum(every.values()) + vocabulary + 1))
        sums, kept = collections.Counter(), collections.Counter()
        for (h, _), n in uses[c].items():
            sums[h] += n
            kept[h] += less(n)
        rest.append((sums, kept))

    def pair(h, w, c):
        sums, kept = rest[c]
        return word[c](w) if not sums[h] else less(uses[c][(h, w)]) / sums[h] + (1 - kept[h] / sums[h]) * word[c](w)

    def ratios(t):
        words = split(t)
        return [math.log(word[1](w) / word[0](w)) for w in words], [math.log(pair(h, w, 1) / pair(h, w, 0)) for h, w in zip(["<s>", *words], words, strict=False)]

    return ratios


@pytest.mark.parametrize("most", [toxicity.SHARED_KEYS, 3])
def test_evidence_is_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(toxicity, "SHARED_KEYS", most)
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)
    clean = spark.createDataFrame(labels, "doc_id long, y int").dropna().groupBy("doc_id").agg((F.avg("y") >= 0.5).cast("int").alias("toxic"))
    model = toxicity.fit_counts(toxicity.labelled_texts(docs, clean))
    ratios = plain_models(rows, labels)
    want = collections.defaultdict(list)
    for r in rows:
        values = ratios(r[1])
        out = []
        for v in values:
            out.append(sum(v) / max(1, len(v)))
            for run in toxicity.RUNS:
                out.append(max((sum(v[i : i + run]) / len(v[i : i + run]) for i in range(max(1, len(v) - run + 1))), default=0.0) if v else 0.0)
        want[r[0]].append([*out, math.log1p(len(values[0]))])
    got = collections.defaultdict(list)
    for r in toxicity.document_evidence(docs, model).collect():
        got[r.doc_id].append(list(r.stats))
    assert got.keys() == want.keys()
    for d in want:
        np.testing.assert_allclose(sorted(got[d]), sorted(want[d]), atol=2e-4)


def test_toxicity_learns_and_its_cases(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string" + EXTRA).repartition(3)
    table = spark.createDataFrame(labels, "doc_id long, y int")
    known = table.where("doc_id % 4 <> 1")  # toxic ids are multiples of 8
    got = toxicity.score(docs, toxicity.fit(docs, known)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    caught = [r.score >= toxicity.THRESHOLD for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 8 == 0]
    alarms = [r.score >= toxicity.THRESHOLD for r in got if r.doc_id is not None and r.doc_id < 400 and r.doc_id % 8]
    assert np.mean(caught) >= 0.95 and np.mean(alarms) <= 0.05
    assert len({r.score for r in got if r.doc_id in (1000, 1001, 1002, 1003)}) == 1
    twice = [r.score for r in got if r.doc_id == 5]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, known)).count() == 0
    for only, share in ((table.where("y = 0"), 0.0), (table.where("y = 1"), 1.0), (table.limit(0), 0.0)):
        assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, only)).collect()} == {share}
    assert toxicity.fit(docs.limit(0), known).counts is None


def vectors(n=300, d=12, seed=3):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, d)) @ np.diag(np.linspace(3, 0.5, d))).tolist()


SCHEMA = "vec_id long, embedding array<double>, component string, x string, n int"


def dense(kept, components=16):
    """The same with a dense eigensolver."""
    x = np.floor(64 * np.array([v for _, v in kept])).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    centred = fit - s / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    good = e > 1e-12 * e[0]
    return n, ((n * x - s) ** 2).sum(1), (x - s / n) @ (q[:, good] / np.sqrt(e[good])), e[good] / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize(("d", "rows_a_task", "direct"), [(12, 100_000, 64), (40, 60, 64), (40, 60, 1)])
def test_whitening_is_the_dense_solution(spark, monkeypatch, d, rows_a_task, direct):
    monkeypatch.setattr(whitening, "FIT_ROWS_A_TASK", rows_a_task)
    monkeypatch.setattr(whitening, "DIRECT_SUMS", direct)
    data = vectors(d=d)
    rows = [(i, v, "c", "c", 0) for i, v in enumerate(data)]
    rows += [(500, None, "c", "c", 0), (501, [], "c", "c", 0), (502, [None, *data[0][1:]], "c", "c", 0), (503, [float("nan"), *data[0][1:]], "c", "c", 0), (504, [float("inf"), *data[0][1:]], "c", "c", 0), (505, data[0][:-1], "c", "c", 0), (None, data[1], "c", "c", 0), rows[2], (506, data[2], "c", "c", 0)]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).toPandas()
    kept = [(i, v) for i, v, *_ in rows if v and len(v) == d and None not in v and np.isfinite(v).all()]
    n, deviation, white, explained = dense(kept)
    k = white.shape[1]
    assert len(got) == len(kept) * k and set(got["n"]) == {n} and got["identity_error"].max() <= 1e-9
    sign = {}
    for c in range(k):
        mine = got[(got["component"] == c + 1) & (got["vec_id"] == 0)]["whitened"].iloc[0]
        sign[c] = np.sign(mine * white[0, c])
    for j, (i, _) in enumerate(kept):
        own = got[got["vec_id"] == i] if i is not None else got[got["vec_id"].isna()]
        own = own.sort_values("component")
        assert set(own["deviation"]) == {deviation[j]}
        for c in range(k):
            values = own[own["component"] == c + 1]["whitened"]
            np.testing.assert_allclose(values, sign[c] * white[j, c], atol=1e-8)
        np.testing.assert_allclose(own["explained"].to_numpy()[:: max(1, len(own) // k)], explained, rtol=1e-9)


def test_whitening_cases(spark):
    frame = lambda rows: spark.createDataFrame([(i, v, "c", "c", 0) for i, v in rows], SCHEMA)
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0  # no variance
    flat = whitening.whiten(frame([(i, [float(i), float(i), 0.0]) for i in range(5)])).collect()
    assert {r.component for r in flat} == {1} and len(flat) == 5 and abs(flat[0].explained - 1) < 1e-9
    far = whitening.whiten(frame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.0])])).collect()
    assert {r.deviation for r in far if r.vec_id < 3} == {None}
    single = spark.createDataFrame([(1, [0.5, 1.5]), (2, [2.5, 0.25])], "vec_id int, embedding array<float>")
    assert {r.vec_id for r in whitening.whiten(single).collect()} == {1, 2}


def test_suffixes_of_a_doc_id_with_many_texts(spark):
    """Texts of one doc_id answer each for itself, however their hashes fall: long and short ones that share passages."""
    from fabula.llm import suffixes

    rng = random.Random(8)
    shared = ["".join(rng.choice("abcdef ") for _ in range(90)) for _ in range(5)]
    rows = [(1, "start " + shared[0]), (2, shared[1] * 2)]
    rows += [(77, "".join(rng.choice("ghij ") for _ in range(rng.choice([5, 60, 400]))) + rng.choice(shared)) for _ in range(60)] + [(90, shared[2] + "tail")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    raws, seen, want = [(d, t.encode()) for d, t in rows], {}, collections.Counter()
    for d, raw in raws:
        for i in range(len(raw) - 49):
            seen[raw[i : i + 50]] = min(d, seen.get(raw[i : i + 50], d))
    for d, raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if seen[raw[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        want[(d, bytes(b for b, m in zip(raw, gone, strict=True) if not m))] += 1
    assert collections.Counter((r.doc_id, bytes(r.kept)) for r in suffixes.dedup_substrings(docs).collect()) == want
