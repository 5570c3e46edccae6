"""Fixtures for operators that the queries don't reach."""

import json

from pyspark.sql import functions as F

from fabula.functions import text as X
from fabula.operators import aggregates as A
from fabula.operators import audits, folds, joins, lexicon, segments, topk, windows
from fabula.sources import blocks as B


def test_votes_and_reviews(spark):
    issues = spark.createDataFrame([("d", i) for i in range(4)], "doc_id string, idx int")
    votes = spark.createDataFrame([("d", 0, "keep"), ("d", 0, "keep"), ("d", 1, "keep"), ("d", 1, "remove"), ("d", 2, "keep")], "doc_id string, idx int, vote string")
    assert [r.final for r in lexicon.confirm_votes(issues, votes, ["doc_id", "idx"]).orderBy("idx").collect()] == ["keep", "unknown", "incomplete", "incomplete"]
    toks = spark.createDataFrame([("d", 0, "за́мок", False), ("d", 1, "зво́нит", True), ("d", 2, "том", False)], "doc_id string, idx int, token string, is_author boolean")
    found = lexicon.apply_review(toks, issues.withColumn("verdict", F.lit("remove")), ["doc_id"]).orderBy("idx").collect()
    assert [r.action for r in found] == ["removed", "author", "no_mark", "missing"] and found[0].token == "замок"
    rows = spark.createDataFrame([(["за", "дом"], ["за́", "дом"]), (["за"], ["до"]), (["за"], ["за", "x"])], "o array<string>, p array<string>")
    assert [r.fell_back for r in lexicon.transfer_marks(rows, "o", "p").collect()] == [False, True, True]
    pre = lexicon.prefix_match(spark.createDataFrame([("темно", "-"), ("темно", " ")], "token string, next_char string"), spark.createDataFrame([("темно", "тёмно")], "key string, value string"))
    assert sorted(r.value for r in pre.collect()) == ["темно", "тёмно"]


def test_profiles_and_rules(spark):
    profiles = spark.createDataFrame([("d", "a", "high", "x", ["b1"]), ("d", "b", "sure", "", ["zz"])], "doc_id string, id string, certainty string, profile string, evidence array<string>")
    blocks = spark.createDataFrame([("b1",)], "block_id string")
    assert {(r.id, r.rule) for r in audits.check_profiles(profiles, blocks, ["doc_id", "id"]).collect()} == {("b", "certainty"), ("b", "profile"), ("b", "unknown block")}
    said = spark.createDataFrame([(1, "Speak calmly and slowly, please."), (2, "x")], "id int, t string")
    assert {(r.id, r.rule) for r in audits.check_instructions(said, ["id"], "t").collect()} == {(2, "short")}
    values = spark.createDataFrame([("два", 2), ("двух", 2), ("три", 3)], "word string, n int")
    pairs = spark.createDataFrame([("два", "двух"), ("два", "три")], "a string, b string")
    assert sorted(r.same_value for r in audits.numeral_value(pairs, values, "a", "b").collect()) == [False, True]


def test_folds_and_choices(spark):
    groups = spark.createDataFrame([("d", i, k, w) for i, (k, w) in enumerate([("r", 30), ("r", 200), ("r", 50), ("q", 10), ("q", 300)])], "k string, o int, ref string, w int")
    assert [r.joined for r in folds.join_same_key(groups, ["k"], "o", "ref", "w", 100, 260).orderBy("o").collect()] == [0, 0, 1, 2, 3]
    spans = spark.createDataFrame([("d", i, t) for i, t in enumerate(["One two three.", "Four five six seven.", "Eight."])], "k string, o int, t string")
    assert folds.sample_text(spans, ["k"], "o", "t", 14, 30).first()["sample"] == "One two three."
    c = spark.createDataFrame([("k", "a", 1.0), ("k", "b", 3.0), ("k", "c", 3.0)], "k string, v string, d double")
    assert topk.farthest(c, ["k"], "v", "d").first().v == "b"
    t = spark.createDataFrame([("r", 1, 3.0, "x" * 70, "x" * 70), ("r", 2, 6.0, "x" * 70, "y"), ("r", 3, 6.0, "x" * 70, "x" * 70)], "role string, o int, s double, t string, said string")
    assert topk.first_reference(t, ["role"], "s", "t", "said", "o").first().o == 3
    ends = spark.createDataFrame([([100, 210, 230],)], "e array<int>")
    assert ends.select(topk.nearest(F.col("e"), 220).alias("n")).first().n == 210


def test_parts_and_pieces(spark, tmp_path):
    chapters = spark.createDataFrame([("d", 1, 0, "x"), ("d", 1, 1, "y"), ("d", 2, 0, "y"), ("d", 2, 1, "z")], "doc_id string, part int, chapter_order int, href string")
    assert [r.continues for r in windows.merge_seam_chapters(chapters).orderBy("part", "chapter_order").collect()] == [False, False, True, False]
    rows = spark.createDataFrame([(1, "c1"), (2, "c1")], "part int, chapter_id string")
    ids = spark.createDataFrame([(1, "c1", "n1"), (2, "c1", "n2")], "part int, old_id string, new_id string")
    assert sorted(r.chapter_id for r in joins.remap_ids(rows, ids).collect()) == ["n1", "n2"]
    whole = spark.createDataFrame([("d", 0), ("d", 1)], "doc_id string, seg_order int")
    parts = spark.createDataFrame([("d", 2, 0, "b"), ("d", 1, 0, "a")], "doc_id string, part int, seg_order int, tts string")
    assert [r.carried_tts for r in joins.carry_over(whole, parts, ["tts"]).orderBy("seg_order").collect()] == ["a", "b"]
    merged = spark.createDataFrame([("d", 0, "p1", "ab", 0, 2, [("p1", "a", 0, 1), ("p2", "b", 0, 1)]), ("d", 1, "p3", "c", 0, 1, None)], "doc_id string, seg_order int, block_id string, text string, char_start int, char_end int, sources array<struct<block_id:string,text:string,char_start:int,char_end:int>>")
    assert [(r.block_id, r.text) for r in segments.explode_pieces(merged, ["doc_id", "seg_order"]).orderBy("seg_order", "piece").collect()] == [("p1", "a"), ("p2", "b"), ("p3", "c")]
    blocks = spark.createDataFrame([("d", "b", "Первая фраза. Вторая фраза.")], "doc_id string, block_id string, text string")
    spans = spark.createDataFrame([("d", "b", 0, 14), ("d", "b", 14, 27)], "doc_id string, block_id string, start int, end int")
    assert [r.text for r in segments.spans_to_segments(spans, blocks, ["doc_id", "block_id"]).orderBy("char_start").collect()] == ["Первая фраза. ", "Вторая фраза."]
    said = spark.createDataFrame([("d", 0, "b1", "Да,"), ("d", 1, "b2", "— "), ("d", 2, "b2", "нет")], "doc_id string, seg_order int, block_id string, text string")
    assert segments.group_text(said, ["doc_id"]).first().phrase == "Да. нет."
    (tmp_path / "m.json").write_text(json.dumps({"title": "t", "segments": [{"id": "s1", "text": "a", "pause_after_ms": 5}, {"id": "s2", "text": "b"}]}))
    assert [(r.seg_order, r.id) for r in B.read_manifest(spark, str(tmp_path / "m.json")).collect()] == [(0, "s1"), (1, "s2")]
    B.write_segments(said, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_small_columns(spark, one):
    L = F.lit
    assert one(X.needs_review(L(None).cast("string"), L("high"), L("end"))) and not one(X.needs_review(L("a"), L("high"), L("end"))) and one(X.needs_review(L("a"), L("high"), L("word")))
    assert one(X.effective_gender(L("x"))) == "female" and one(X.speech_text(L("a"), L(None).cast("string"))) == "a" and one(X.speech_text(L("a"), L(" "))) is None
    assert one(X.spoken_variants(L("Да"))) == ["Да.", "Да…", "Да!"]
    two = F.array(L("бы́ла"), L("была́"))
    for reason, pick in (("Выбираю B", "была́"), ("A? Нет. Выбираю В.", "была́"), ("норма такова — A.", "бы́ла"), ("B верно", "была́"), ("вариант A, но ответ: B", "была́"), ("нет", None)):
        assert one(X.final_pick(L(reason), two)) == pick
    assert one(X.has_reporting(L("Нет, — сказал он."), ["сказал"])) and not one(X.has_reporting(L("сказал он"), ["сказал"]))
    assert one(X.final_pick(L("A is fine. Выбираю была́"), F.array(L("бы́ла"), L("была́")))) == "была́"
    assert one(X.asks_extra(L("Add laughter."), ["laugh"])) and not one(X.asks_extra(L("Without laughter."), ["laugh"]))
    assert one(X.needs_mark(L("замок"), L(" "))) and one(X.needs_mark(L("какая"), L("-"))) and not one(X.needs_mark(L("нибудь"), L("-"))) and one(X.needs_mark(L("либо"), L(" "))) and not one(X.needs_mark(L("безо"), L(" "))) and not one(X.needs_mark(L("дом"), L(" "))) and one(X.well_marked(L("зам+ок"))) and not one(X.well_marked(L("+замок")))
    assert one(A.alias_set(F.array(L("b"), L("a")), F.array(L("n")), L("n"))) == ["a", "b"]
    assert abs(one(X.est_seconds(L("x" * 28), L(500))) - 2.5) < 1e-9


def test_lossless_gate_sees_text_outside_blocks(spark):
    """SRC-4 against tags cut out by hand."""
    import re

    pages = [(1, "<body><h1>A</h1><p>b <b>c</b></p><ul><li>d<p>e</ul>"), (2, "<body>loose<p>a</p>"), (3, "<div>box<p>a</p></div>"), (4, "<p>a</p><table><tr><td>cell</td></tr></table>"), (5, "<pre>x = 1</pre>"), (6, "<head><title>t</title></head><script>s()</script><p>a &amp; b</p>\n "), (7, None), (8, "<p>a</p>tail")]
    df = spark.createDataFrame(pages, "page_id long, html string")
    lost = {r.page_id for r in audits.lossless_check(B.visible_text(df), B.html_blocks(df), "page_id").collect()}
    bare = lambda h: re.sub(r"\s", "", re.sub(r"(?s)<head>.*?</head>|<script>.*?</script>|<[^>]*>", "", h or "").replace("&amp;", "&"))
    want = {k for k, h in pages if bare(h) != re.sub(r"\s", "", "".join(t for *_, t in B.blocks_of(h)[0]))}
    assert lost == want == {2, 3, 4, 5, 8}


def test_fragments_and_windows():
    """Golden fragments, run on the table functions themselves; windows against a plain search at each step."""
    import re

    from fabula.operators.segments import SpeechFragments, windows_of

    text = "— Ну что же, — сказал он, — пойдём. «Это не речь» и «Да ты что! Правда?» — спросила она."
    assert [text[a:b] for _, a, b in SpeechFragments().eval(text, 160)] == ["— Ну что же,", "— сказал он,", "— пойдём. «Это не речь» и", "«Да ты что! Правда?»", "— спросила она."]
    assert list(SpeechFragments().eval("  ", 160)) == list(SpeechFragments().eval(None, 160)) == []
    long = "A first sentence of more than forty signs stands here. " * 5
    assert [long[a:b] for _, a, b in SpeechFragments().eval(long, 160)] == [long[:54]] * 5
    patterns = {"sentence": r"""[.!?…][»”"')\]]*\s+""", "clause": r"""[,;:][»”"')\]]*\s+|\s+[—–]\s+""", "word": r"\s+"}
    story = ("One, two — three. Four; five six! " * 9 + "x" * 90 + " end ") * 2
    at = 0
    for a, b, name in windows_of(story, 50, 70, 30):
        assert a == at and b - a <= 70
        if name != "end":
            ends = {n: [m.end() for m in re.finditer(p, story[a : a + 71]) if m.end() <= 70] for n, p in patterns.items()}
            best = next((n for n in patterns if ends[n]), "error")
            fit = next((f for least in (30, 50, 0) if (f := [e for e in ends.get(best, [70]) if e >= least])), [70])
            assert (name, b - a) == (best, min(fit, key=lambda e: (abs(e - 50), e)))
        at = b
    assert at == len(story)


def test_escaped_hrefs():
    import io
    import zipfile

    from fabula.sources.blocks import spine_documents

    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><manifest><item id="a" href="a%20b.xhtml#x" media-type="application/xhtml+xml"/><item id="i" href="i.svg" media-type="image/svg+xml"/></manifest><spine><itemref idref="i"/><itemref idref="a"/></spine></package>')
        z.writestr("o/a b.xhtml", "<p>A</p>")
        z.writestr("o/i.svg", "<svg/>")
    assert spine_documents(data.getvalue()) == [("o/a b.xhtml", "<p>A</p>")]
