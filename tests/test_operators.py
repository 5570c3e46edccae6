"""Invariants and small fixtures of the table operators."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.operators import aggregates as A
from fabula.operators import audits, folds, joins, lexicon, segments, signal, topk, windows
from fabula.operators.segments import windows_of
from fabula.sources import blocks as B


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("text,next_block,speaker,wanted", [("Текст.", "b1", "a", 450), ("«Вопрос?» -", "b1", "a", 600), ("Мысль… -", "b1", "a", 700), ("сказал автор,", "b1", "b", 180), ("сказал автор,", "b2", "a", 800), ("ab", "b1", "a", 100)])
def test_boundary_pause(spark, text, next_block, speaker, wanted):
    df = rows(spark, [("d", 0, "b1", "a", text), ("d", 1, next_block, speaker, "x")], "doc_id string, seg_order int, block_id string, speaker string, text string")
    assert windows.boundary_pause(df).orderBy("seg_order").first().pause_ms == wanted


def test_windows_add_up():
    text = "Длинная фраза, с запятыми. " * 40 + "x" * 300
    pieces = list(windows_of(text, 220, 260, 100))
    assert "".join(text[a:b] for a, b, _ in pieces) == text and max(b - a for a, b, _ in pieces) <= 260
    assert pieces[-2][2] == "error" or pieces[-1][2] == "end"


def test_merge_short(spark):
    texts = ["— Да.", "— Нет.", "— Не знаю.", "Рассказ. " * 30]
    data = [("d", "c", i, f"p{i}", "n", 0, len(t), len(t), len(t), 100, False, "") for i, t in enumerate(texts)]
    df = rows(spark, data, "doc_id string, chapter_id string, seg_order int, block_id string, speaker string, char_start int, char_end int, block_len int, size int, pause_ms int, needs_review boolean, reason string")
    got = folds.merge_short(df, 80, 360).orderBy("seg_order").collect()
    assert [p.b for p in got[0].pieces] == ["p0", "p1", "p2", "p3"] and got[0]["size"] <= 360 and len(got) == 1


def test_batches_and_parts(spark):
    df = rows(spark, [("d", i, w) for i, w in enumerate([5, 5, 20, 1, 1, 8])], "k string, o int, w int")
    got = {r.o: r.batch for r in folds.batch_by_size(df, ["k"], "o", "w", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2}
    parts = {r.o: r.part for r in folds.split_balanced(df, ["k"], "o", "w", 2).collect()}
    assert parts == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}


def test_excerpt(spark):
    df = rows(spark, [("d", i, 22, i < 3) for i in range(4)], "doc_id string, block_id int, w int, ok boolean")
    assert topk.excerpt(df, "w", 40).count() == 2
    assert topk.excerpt(df, "w", 1000, measured="ok").count() == 3


def test_sentences(spark):
    text = "И. И. Иванов пришёл. Арина ответила: «Да!» Потом стало тихо."
    got = [r.sentence_text for r in segments.sentences(rows(spark, [("d", text), ("e", "– Вот и спасибо! –")], "doc_id string, text string"), ["doc_id"], ident="doc_id").orderBy("doc_id", "sentence").collect()]
    assert got[0] == "И. И. Иванов пришёл. " and "".join(got[:3]) == text and len(got) == 4


def test_lexicon(spark):
    text = rows(spark, [("d", "Ветер его, замок, дверной замок светло́")], "doc_id string, text string")
    toks = lexicon.tokens(text, ["doc_id"], "text")
    lex = rows(spark, [("exception", "его", "его́", 0), ("correction", "ветер", "ве́тер", 0), ("bulk", "замок", "за́мок", 0)], "layer string, key string, value string, ord int")
    homographs = rows(spark, [("замок",)], "key string")
    hits = lexicon.phrase_match(toks, text, rows(spark, [("замок", "дверной замок", "замо́к")], "key string, phrase string, value string"), ["doc_id"], "text")
    got = {r.idx: (r.value, r.source) for r in lexicon.annotate_tokens(toks, lex, homographs, hits).collect()}
    assert got[0] == ("ве́тер", "correction") and got[1] == ("его́", "exception") and got[2] == ("замок", "homograph") and got[4] == ("замо́к", "phrase") and got[5][1] == "author"
    assert all(text.first().text[r.start : r.start + len(r.token)] == r.token for r in toks.collect())


def test_disputes(spark):
    words = rows(spark, [("d", 0, "была", "бы́ла", "была́"), ("d", 1, "зво́нит", "зво́нит", "звони́т"), ("d", 2, "том", "том", "дом")], "doc_id string, idx int, original string, a string, b string")
    found = lexicon.disputes(words, ["doc_id"])
    assert [r.idx for r in found.collect()] == [0]
    final = lexicon.reconcile(found.withColumn("choice", F.lit("A")), F.lit("была́"))
    assert final.first().final == "B" and final.first().contradiction
    applied = lexicon.apply_decisions(words.withColumn("token", F.col("original")), found, final, ["doc_id"])
    assert applied.where("idx = 0").first().token == "была́" and applied.where("idx = 1").first().token == "зво́нит"
    engines = {r.idx: r.engine for r in lexicon.hybrid_choice(words, rows(spark, [("x",)], "key string")).collect()}
    assert engines == {0: "dictionary", 1: "author", 2: "unchanged"}


def test_registry_and_spans(spark):
    cast = rows(spark, [("d", "narrator", "N", "unknown", "x", 0), ("d", "anna", "Анна", "female", "y", 1), ("d", "anna", "Аня", "alien", "y", 2)], "doc_id string, id string, name string, gender string, voice_description string, ord int")
    assert {r.rule for r in audits.check_registry(cast).collect()} == {"gender", "duplicate", "description"}
    merged = A.merge_registry(cast.where("id = 'anna'"), ["doc_id", "id"]).first()
    assert (merged["name"], merged.aliases, merged.gender) == ("Анна", ["Аня"], "female")
    block = "— Да, — сказала Анна, — пойду."
    blocks = rows(spark, [("d", "b", block)], "doc_id string, block_id string, text string")
    spans = [(0, 0, 5, "anna"), (1, 5, 21, "narrator"), (2, 21, len(block), "anna")]
    table = lambda s: rows(spark, [("d", "b", n, block[a:b], a, b, who, "high", "") for n, a, b, who in s], "doc_id string, block_id string, span_order int, text string, start int, end int, speaker string, confidence string, reason string")
    assert audits.check_spans(blocks, table(spans), cast.limit(2)).count() == 0
    assert {r.rule for r in audits.check_spans(blocks, table(spans[:-1] + [(2, 21, 25, "ghost")]), cast.limit(2)).collect()} == {"tail", "speaker"}


def test_segments_audit(spark):
    blocks = rows(spark, [("d", "b", "abcdef")], "doc_id string, block_id string, text string")
    good = [("d", 0, "b", "abc", 0, 3), ("d", 1, "b", "def", 3, 6)]
    schema = "doc_id string, seg_order int, block_id string, text string, char_start int, char_end int"
    assert audits.check_segments(rows(spark, good, schema), blocks).count() == 0
    assert {r.rule for r in audits.check_segments(rows(spark, good[:1], schema), blocks).collect()} == {"tail"}
    assert {r.rule for r in audits.check_segments(rows(spark, [good[0], ("d", 2, "b", "ef", 4, 6)], schema), blocks).collect()} == {"order", "gap"}


def test_edits_and_drift(spark):
    df = rows(spark, [(1, "Он пришёл. https://a.b", "Он пришё́л. https://a.b"), (2, "Он ушёл.", "Он пришёл"), (3, "a", "<b>a")], "id int, o string, p string")
    got = {(r.id, r.rule) for r in audits.check_edits(df, ["id"], "o", "p").collect()}
    assert (2, "letters") in got and (2, "stops") in got and (3, "markup") in got and not any(i == 1 for i, _ in got)
    drift = audits.repair_drift(rows(spark, [(["a", "b", "c"], ["a", "x", "c"]), (["a", "1"], ["a", "2"])], "o array<string>, p array<string>"), "o", "p").collect()
    assert drift[0].repaired == ["a", "b", "c"] and not drift[1].accepted


def test_joins(spark):
    whole = rows(spark, [("d", i, t) for i, t in enumerate("abc")], "doc_id string, seg_order int, text string")
    parts = rows(spark, [("d", 0, "a"), ("d", 1, "x")], "doc_id string, seg_order int, text string")
    assert [(r.position, r.rule) for r in joins.positional_mismatch(whole, parts, ["text"]).orderBy("position").collect()] == [(1, "text"), (2, "missing")]
    keys = joins.canonical_key(rows(spark, [("Анна",), ("anna",), ("zzz",)], "who string"), rows(spark, [("anna",)], "who string"), "who", F.when(F.col("who") == "Анна", "anna").otherwise(F.col("who")))
    assert sorted(str(r.key) for r in keys.collect()) == ["None", "anna", "anna"]
    over = rows(spark, [("d", 1), ("q", 1)], "doc_id string, v int")
    assert joins.bad_overrides(whole, over.unionByName(over), "doc_id").count() == 3


def test_gains(spark):
    levels = rows(spark, [("x", "a", -28.0, -8.0), ("x", "b", -18.0, -4.0), ("x", "c", float("-inf"), -90.0), ("y", "a", float("-inf"), -90.0)], "book string, role string, lufs double, true_peak_db double")
    got = {(r.book, r.role): r for r in A.gain_plan(levels, ["book"], "role").collect()}
    a, b = got["x", "a"], got["x", "b"]
    assert abs(a.lufs + a.gain_db - b.lufs - b.gain_db) < 1e-9 and a.true_peak_db + a.gain_db <= -1.5 and got["x", "c"].gain_db == 0 and got["y", "a"].gain_db is None


def test_signal(spark):
    rate = 8000
    tone = 0.3 * np.sin(2 * np.pi * 220 * np.arange(rate) / rate)
    clip = np.concatenate((tone, np.zeros(rate // 2), tone))
    df = rows(spark, [("c", rate, clip.tolist(), "abcdef", [1.0, 1.0])], "clip_id string, sample_rate int, samples array<double>, text string, weights array<double>")
    p = signal.prosody(df).first()
    assert abs(p.pitch - 220) < 6 and abs(p.rate - 6 / 2.5) < 1e-6
    cut = signal.split_at_quiet(df).orderBy("piece").collect()
    assert rate < cut[0].end < 1.5 * rate and cut[-1].end == len(clip)
    clicked = clip.copy()
    clicked[int(1.25 * rate) : int(1.25 * rate) + 20] = 0.5
    assert len(signal.click_times(clicked, rate)) == 1 and not signal.click_times(clip, rate)
    shape = signal.speech_shape(signal.voiced_frames(df, 80, 0.01), 40).first()
    assert shape.long_pauses == 1
    bounds = df.select(signal.silence_bounds(signal.framed_rms(F.col("samples"), 160)).alias("b")).first().b
    assert bounds["from"] == 0


def test_epub_and_html(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></container>')
        z.writestr("O/p.opf", '<package><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>')
        z.writestr("O/b.xhtml", "<html><body><h1>Глава</h1><p>Первый  абзац.</p><script>x</script></body></html>")
        z.writestr("O/a.xhtml", '<html><body><p id="a">Про<em>ве</em>рка мы́сли.</p></body></html>')
    (tmp_path / "x.epub").write_bytes(data.getvalue())
    got = B.epub_blocks(spark.read.format("binaryFile").load(str(tmp_path / "x.epub"))).orderBy("block_order").collect()
    assert [r.text for r in got] == ["Глава", "Первый абзац.", "Проверка мы́сли."] and got[-1].source.element_id == "a"
    found, visible = B.blocks_of("<div>skip<p>a<b>b<br>c<p>d<ul><li>e<p>f</ul>")
    assert [t for *_, t in found] == ["ab c", "d", "e", "f"] and "".join(visible.split()) == "abcdef"
    assert B.blocks_of(None) == ([], "")


def test_lexicon_files(spark, tmp_path):
    (tmp_path / "a").write_text("# c\nзамок=за́мок\nветер ве́тер\nx=y\n")
    (tmp_path / "b").write_text("замок=замо́к\n")
    (tmp_path / "p").write_text("темно-*=тёмно-*\n")
    got = {r.key: r.value for r in B.read_lexicon(spark, [str(tmp_path / "a"), str(tmp_path / "b")], "bulk").collect()}
    assert got == {"замок": "замо́к", "ветер": "ве́тер"}
    assert B.read_prefixes(spark, str(tmp_path / "p")).first().asDict() == {"key": "темно", "value": "тёмно"}


def test_replies(spark, one):
    reply = F.lit('```json\n{"b": 1, "a": 2}\n```')
    assert one(A.parse_reply(reply)) == '{"b": 1, "a": 2}' and one(A.exact_fields(A.parse_reply(reply), ["a", "b"])) is True
    assert one(A.parse_reply(F.lit("no answer"))) is None


def test_token_ops(spark):
    df = rows(spark, [(["в", "2024", "году"], ["в", "две", "тысячи", "году"])], "a array<string>, b array<string>")
    got = segments.token_ops(df, "a", "b").first()
    assert (got.op, got.a_start, got.a_end, got.fresh_number) == ("replace", 1, 2, True)
