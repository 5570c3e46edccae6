"""Running medians and folds that tasks share, against plain loops, on long groups over several partitions."""

import random
import statistics

import pytest

from fabula.operators import folds, windows
from fabula.operators.ordered import RunningMedian, running_medians
from fabula.streaming import incremental as S


def test_running_median_is_the_median():
    rng, state, seen = random.Random(1), RunningMedian(), []
    for i in range(2000):
        seen.append(rng.choice([1.0, 2.5, rng.random() * 10]))
        state.add(seen[-1])
        if i % 97 == 0:
            state = RunningMedian(*state.saved())  # as a stream keeps it
        assert state.median() == statistics.median(seen)


def long_key(n=100_000):
    rng = random.Random(2)
    return [(1, i, 10 + rng.gauss(0, 4)) for i in range(n)] + [(k, i, float(rng.randint(1, 30))) for k in range(2, 40) for i in range(20)]


def plain_gate(rows):
    import bisect

    out, seen = {}, {}
    for k, i, v in sorted(rows):
        s = seen.setdefault(k, [])
        n = len(s)
        m = 0 if not n else s[n // 2] if n % 2 else (s[n // 2 - 1] + s[n // 2]) / 2
        ok = n < 5 or 0.6 * m <= v <= 1.45 * m
        if ok:
            bisect.insort(s, v)
        out[(k, i)] = ok
    return out


def test_gate_of_a_long_key_in_batch_and_stream(spark, tmp_path):
    rows = long_key()
    want = plain_gate(rows)
    df = spark.createDataFrame(rows, "user long, at long, value double").repartition(3)
    got = {(r.user, r.at): r.accepted for r in S.running_gate(df, "user", "at", "value").collect()}
    assert got == want
    for part, (a, b) in enumerate(((0, 30_000), (30_000, 70_000), (70_000, 200_000))):  # micro-batches in order
        df.where(f"at >= {a} and at < {b}").coalesce(1).write.parquet(f"{tmp_path}/in/p={part}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    streamed = S.run_available(spark, S.running_gate_stream(stream, "user", "at", "value"), "append")
    assert {(r.user, r.at): r.accepted for r in streamed.collect()} == want


def test_gate_and_medians_of_nulls(spark):
    rows = [(1, i, v) for i, v in enumerate([10.0, None, float("nan"), 11.0, 9.0, 10.0, 10.0, 30.0, 10.5])] + [(None, 0, 1.0), (None, 1, None)]
    df = spark.createDataFrame(rows, "user long, at long, value double")
    got = {(r.user, r.at): r.accepted for r in S.running_gate(df, "user", "at", "value").collect()}
    assert [got[(1, i)] for i in range(9)] == [True, False, False, True, True, True, True, False, True] and got[(None, 0)] and not got[(None, 1)]
    medians = {(r.user, r.at): (r.n_before, r.median_before) for r in running_medians(df, ["user"], ["at"], "value").collect()}
    assert medians[(1, 0)] == (0, None) and medians[(1, 3)] == (1, 10.0) and medians[(1, 4)] == (2, 10.5) and medians[(1, 8)] == (6, 10.0)
    assert S.running_gate(df.limit(0), "user", "at", "value").count() == 0
    floor = {r.at: r.floor for r in windows.adaptive_floor(df.where("user = 1"), "value", "user", "at").collect()}
    assert floor[0] == 0.5 and floor[8] == pytest.approx(9.9)


def sizes(kind, n):
    rng = random.Random(3)
    return {"equal": [7] * n, "mixed": [rng.choice([0, 1, 5, 30, 90, 300]) for _ in range(n)], "none": [0] * n, "small": [rng.randint(1, 9) for _ in range(n)]}[kind]


@pytest.mark.parametrize("kind", ["equal", "mixed", "none", "small"])
def test_batches_of_a_long_group_run_in_several_tasks(spark, kind):
    n = 5000
    rows = [("hot", i, w, i // 700) for i, w in enumerate(sizes(kind, n))] + [(f"d{k}", i, w, 0) for k in range(50) for i, w in enumerate(sizes("mixed", k))] + [(None, 0, 5, None), (None, 1, None, None)]
    df = spark.createDataFrame(rows, "doc string, at int, size int, chapter int").repartition(4)
    for brk in (None, "chapter"):
        want, last = {}, {}
        for d, i, w, c in sorted(rows, key=lambda r: (str(r[0]), r[1])):
            batch, held, chapter = last.get(d, (-1, 0, c))
            new = batch < 0 or held + (w or 0) > 100 or (brk and chapter != c)
            last[d] = (batch + 1, w or 0, c) if new else (batch, held + (w or 0), c)
            want[(d, i)] = last[d][0]
        got = folds.batch_by_size(df, ["doc"], "at", "size", 100, brk, partitions=9)
        assert {(r.doc, r.at): r.batch for r in got.collect()} == want
    assert folds.batch_by_size(df.limit(0), ["doc"], "at", "size", 100).count() == 0


@pytest.mark.parametrize("kind", ["equal", "mixed", "none", "small"])
def test_balanced_parts_of_a_long_group(spark, kind):
    rows = [("hot", i, w) for i, w in enumerate(sizes(kind, 2000))] + [(f"d{k}", i, w) for k in range(1, 12) for i, w in enumerate(sizes("mixed", k))] + [(None, 0, 5)]
    want = {}
    for d in {r[0] for r in rows}:
        own = sorted((i, w) for x, i, w in rows if x == d)
        total, part, held = sum(w for _, w in own), 0, 0
        for k, (i, w) in enumerate(own):
            want[(d, i)] = part
            held += w
            if held * 4 >= total and part < 3 and len(own) - k - 1 >= 3 - part:
                part, held = part + 1, 0
    df = spark.createDataFrame(rows, "doc string, at int, size int").repartition(4)
    assert {(r.doc, r.at): r.part for r in folds.split_balanced(df, ["doc"], "at", "size", 4, partitions=7).collect()} == want


def test_joins_of_a_long_group(spark):
    rng = random.Random(5)
    rows, order = [], 0
    for block in range(600):
        long = rng.choice([40, 90, 200])
        cut = sorted({0, long, *(rng.randint(1, long - 1) for _ in range(rng.randint(0, 3)))})
        speaker = rng.choice(["a", "a", "a", None])
        for a, b in zip(cut, cut[1:], strict=False):
            rows.append(("hot", 1, order, f"b{block}", speaker, a, b, long, b - a, order % 7, rng.choice([True, False, None]), rng.choice(["", None, f"r{order}"])))
            order += 1
    want = []
    for r in rows:
        _, _, o, block, who, a, b, long, w, pause, review, reason = r
        last = want[-1] if want else None
        touches = last and last["who"] == who and ((last["block"] == block and last["y"] == a) or (last["y"] == last["long"] and a == 0))
        if touches and min(last["w"], w) < 100 and last["w"] + 1 + w <= 260:
            flag = True if last["review"] or review else None if last["review"] is None or review is None else False
            last.update(w=last["w"] + 1 + w, pause=pause, review=flag, reason=last["reason"] or reason, block=block, y=b, long=long)
            last["pieces"].append((o, block, a, b))
        else:
            want.append({"o": o, "who": who, "w": w, "pause": pause, "review": review, "reason": reason, "block": block, "y": b, "long": long, "pieces": [(o, block, a, b)]})
    schema = "doc_id string, chapter_id int, seg_order int, block_id string, speaker string, char_start int, char_end int, block_len int, size int, pause_ms int, needs_review boolean, reason string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    got = [(r.seg_order, r.speaker, r["size"], r.pause_ms, r.needs_review, r.reason, [tuple(p) for p in r.pieces]) for r in folds.merge_short(df).orderBy("seg_order").collect()]
    assert got == [(x["o"], x["who"], x["w"], x["pause"], x["review"], x["reason"], x["pieces"]) for x in want]
    same = {r.seg_order: r.joined for r in folds.join_same_key(df, ["doc_id"], "seg_order", "speaker", "size", 50, 120).collect()}
    n, last = -1, None
    for r in rows:
        o, who, w = r[2], r[4], r[8]
        if last and last[0] is not None and last[0] == who and min(last[1], w) < 50 and last[1] + 1 + w <= 120:
            last = (who, last[1] + 1 + w)
        else:
            n, last = n + 1, (who, w)
        assert same[o] == n


def test_only_the_click_is_found():
    """A plosive before a word, a click in a pause, a breath that fades: the click alone is one."""
    import numpy as np

    from fabula.operators.signal import click_times

    rate, rng = 24_000, np.random.default_rng(1)
    clip = rng.normal(0, 1e-5, 3 * rate)
    word = lambda a, b: clip.__setitem__(slice(int(a * rate), int(b * rate)), 0.3 * np.sin(np.arange(int(b * rate) - int(a * rate)) * 0.05))
    burst = lambda at: clip.__setitem__(slice(int(at * rate), int(at * rate) + 24), np.tile([0.2, -0.2], 12))
    word(0.2, 0.8), word(2.0, 2.6)
    assert click_times(clip, rate) == []
    burst(1.985)  # a plosive: the word begins 15 ms later
    burst(0.83)  # the end of a word
    assert click_times(clip, rate) == []
    burst(1.6)
    fade = np.arange(int(0.06 * rate)) + int(1.603 * rate)
    quiet = clip.copy()
    burst(1.2)
    clip[fade] = 0.004 * np.sin(np.arange(len(fade)) * 0.3)  # a breath after the burst at 1.6
    found = click_times(clip, rate)
    assert len(found) == 1 and abs(found[0][0] - 1.2) < 0.002 and found[0][1] - found[0][0] <= 0.004
    assert len(click_times(quiet, rate)) == 1
    assert click_times(clip[: rate // 10], rate) == [] and click_times(np.zeros(0), rate) == []


def test_windows_and_fragments_by_trying_every_cut():
    """Size windows against a search over all ends of every kind, and fragments that lose nothing."""
    import re

    from fabula.operators import segments

    rng = random.Random(4)
    bits = ["word", "Word ", " ", ". ", "! ", ", ", " — ", "\n", "»", "x" * 30, "« ", "; ", ": ", "…»  ", "(", ") "]
    for _ in range(1500):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))
        target, maximum, minimum = rng.choice([(22, 26, 10), (8, 12, 3), (50, 80, 70)])
        want, at = [], 0
        while len(text) - at > maximum:
            end, kind = at + maximum, "error"
            for name, pattern in segments._ENDS.items():
                ends = [m.end() - at for m in re.finditer(pattern, text) if 0 < m.end() - at <= maximum]
                for least in (minimum, min(60, target), 1):
                    good = [e for e in ends if e >= least]
                    if good and kind == "error":
                        end, kind = at + min(good, key=lambda e: (abs(e - target), e)), name
            want.append((at, end, kind))
            at = end
        if at < len(text):
            want.append((at, len(text), "end"))
        assert list(segments.windows_of(text, target, maximum, minimum)) == want
        spans = list(segments.SpeechFragments().eval(text, 40))
        assert [n for n, _, _ in spans] == list(range(len(spans)))
        assert "".join("".join(text[a:b].split()) for _, a, b in spans) == "".join(text.split()) and all(text[a:b] == text[a:b].strip() for _, a, b in spans)


def test_scanner_takes_any_text():
    """Ten thousand random texts and very long ones: every token is a piece of the text, in order, and reading never fails."""
    import time

    from fabula.operators import normalise as M

    rng = random.Random(5)
    bits = ["5", "12", "2024", "100 200 300", "1234567890123", " ", " ", ".", ",", "/", ":", "-", "–", "мая", " года", " гг.", "IV", "MCMXIVX", "глава ", "Глава I", "кг", "%", "°C", "руб.", "+7", "8 (912) ", "345-67-89", "-я", "-ого", "НАТО", "КТО-ТО", "«", "\n", "и ", "с ", "в ", "Пётр ", "á", "\U0001f600", "₽", "0", "00", "\u00a0", "²", "_"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 30))) for _ in range(10_000)]
    began = time.time()
    texts += ["100 200 300 400 500 600 700 " * 20_000, "Глава 1" + ", 1" * 200_000, "АБ" + "-АБ" * 200_000, "1.2.3.4." * 100_000, " " * 500_000 + "5", "8 9 " * 100_000, "5" * 500_000]
    for text in texts:
        last = 0
        seen = set()
        for start, end, kind in M.scan(text):
            assert last <= start < end <= len(text)
            last = end
            if (text[start:end], kind) not in seen:
                seen.add((text[start:end], kind))
                said = M.read(kind, M.Token(text[start:end], "в", True, "года", True, 2025), True)
                assert said is None or said
    assert time.time() - began < 240
    assert M.read("integer", M.Token("100 200 300 400 500 600 700", "", False, "", False, 2025), False) is None


def test_sentences_add_up(spark):
    """A line feed at a text's end belongs to the last sentence; initials and numbers end none."""
    from fabula.operators import segments

    texts = ["abc\n", "abc\r\n", "One. Two", "One.\n", "J. R. Smith came. So. \n", "3.14 is it... — and more\n\n", ".", "\n", "A... B", "Hm! ?! «No.» Yes"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in segments.sentences(df, ["doc_id"]).orderBy("doc_id", "sentence").collect():
        got.setdefault(r.doc_id, []).append(r)
        assert texts[r.doc_id][r.char_start : r.char_end] == r.sentence_text
    assert ["".join(r.sentence_text for r in got[i]) for i in range(len(texts))] == texts
    assert [r.sentence_text for r in got[4]] == ["J. R. Smith came. ", "So. \n"] and [r.sentence_text for r in got[9]] == ["Hm! ?! ", "«No.» ", "Yes"]
