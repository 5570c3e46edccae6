"""Annotator hook, edit safety, reporting clauses, ranges, derived columns, metadata, packing, names by automaton."""

import pytest
from pyspark.sql import functions as F

from fabula.operators import annotators, audits, joins, projections, segments

ACUTE = "́"


def rules_of(spark, pairs, **more):
    df = spark.createDataFrame([(i, o, p) for i, (o, p) in enumerate(pairs)], "k int, o string, p string")
    got = {i: set() for i in range(len(pairs))}
    for r in audits.check_edits(df, ["k"], "o", "p", **more).collect():
        got[r.k].add(r.rule)
    return [got[i] for i in range(len(pairs))]


def test_edits_that_are_safe_and_those_that_are_not(spark):
    good = [("Он пришёл, и всё.", "Он пришёл; и всё."), ("Да. Нет", "Да... Нет"), ("зам ок", f"за{ACUTE}м о{ACUTE}к"), ("", "x")]
    assert rules_of(spark, good[:3]) == [set(), set(), set()]
    bad = {
        ("Он пришёл.", "Он пришёл сюда."): {"words"}, ("Он пришёл.", "Он ушёл."): {"letters"}, ("ещё раз", "еще раз"): {"yo"}, (f"за{ACUTE}мок", f"замо{ACUTE}к"): {"mark"}, ("замок", f"з{ACUTE}амок"): {"bad mark"},
        ("замок", f"за{ACUTE}мо{ACUTE}к"): {"bad mark"}, ("Да. Нет", "Да, Нет"): {"stops"}, ("Да?! Нет", "Да!? Нет"): {"stops"}, ("«Да»", "Да"): {"skeleton"}, ("кто-то", "кто то"): {"skeleton"}, ("a b", "a <b>"): {"skeleton", "markup"},
        ("см. http://a.b/c тут", "см. http://a.b/d тут"): {"links", "letters"}, ("да", None): {"empty"}, ("да", "  "): {"empty"},
    }
    assert rules_of(spark, list(bad)) == list(bad.values())
    numbers = {"пять": "5", "пяти": "5", "шесть": "6"}
    assert rules_of(spark, [("пять лет", "пяти лет"), ("пять лет", "шесть лет"), ("пять лет", "Пяти лет")], families=numbers) == [set(), {"letters"}, {"letters"}]


def test_a_reporting_clause_is_the_narrators(spark):
    told, own = "– Конечно, – тихо сказала Анна.", "– Он сказал мне правду."
    rows = [("d", b, 0, t, 0, len(t), who, "high", "") for b, (t, who) in enumerate([(told, "anna"), (told, "narrator"), (own, "anna"), ("– тихо сказала Анна.", "narrator"), ("Слова – и ещё.", "anna")])]
    rows += [("d", 5, 0, "– Да, ", 0, 6, "anna", "high", ""), ("d", 5, 1, "– сказала Анна.", 6, 21, "narrator", "high", ""), ("d", 6, 0, "Кто", 0, 3, None, "medium", " ")]
    spans = spark.createDataFrame(rows, "doc_id string, block_id int, span_order int, text string, start int, end int, speaker string, confidence string, reason string")
    blocks = spans.groupBy("doc_id", "block_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_order", "text"))), lambda x: x["text"]), "").alias("text"))
    cast = spark.createDataFrame([("d", "anna"), ("d", "narrator")], "doc_id string, id string")
    assert {(r.block_id, r.rule) for r in audits.check_spans(blocks, spans, cast).collect()} == {(0, "insert"), (1, "swallowed"), (6, "reason")}


def test_the_annotator_is_made_once_and_falls_back_by_block(spark):
    rows = [("d", 1, 0, f"За{ACUTE}мок, ", "x0", "a"), ("d", 1, 1, "на горе ещё", "x1", "b"), ("d", 2, 2, "Слово", "x2", "c"), ("d", 3, 3, "...", "x3", "d"), ("d", 4, 4, None, None, "e"), ("d", 5, 5, "все тут", "x5", "f")]
    df = spark.createDataFrame(rows, "doc string, block int, at int, text string, dictionary string, annotated_by string").repartition(2)

    def make():
        def model(text):
            return "другое" if text == "Слово" else text.replace("Замок", f"Замо{ACUTE}к").replace("все", "всё")

        return model

    got = {r.at: (r.annotated, r.annotator_valid, r.annotated_by) for r in annotators.second_annotator(df, ["doc", "block"], "at", "text", "dictionary", make).collect()}
    assert got == {0: (f"Замо{ACUTE}к, ", True, "a"), 1: ("на горе ещё", True, "b"), 2: ("x2", False, "c"), 3: ("...", True, "d"), 4: ("", True, "e"), 5: ("всё тут", True, "f")}
    assert annotators.second_annotator(df.limit(0), ["doc", "block"], "at", "text", "dictionary", make).count() == 0


def test_ranges_reject_missing_and_reversed_bounds(spark):
    rows = spark.createDataFrame([("d", i, f"p{i // 2}") for i in range(10)] + [("e", 0, "p0")], "doc string, at int, block string")
    of = lambda a, b, **k: sorted((r.doc, r.at) for r in projections.between_keys(rows, ["doc"], "at", "block", a, b, **k).collect())
    assert of("p1", "p2", strict=False) == [("d", i) for i in range(2, 6)]
    for a, b in (("p3", "p1"), ("p1", "p9")):
        with pytest.raises(Exception, match="bound (?:missing|reversed)"):
            of(a, b)
        assert of(a, b, strict=False) == []
    faults = {r.doc: r.fault for r in projections.range_bounds(rows, ["doc"], "at", "block", "p3", "p1").collect()}
    assert faults == {"d": "reversed", "e": "missing"}
    assert sorted((r.doc, r.at) for r in projections.from_first(rows, ["doc"], "at", F.col("block") == "p4").collect()) == [("d", 8), ("d", 9)]


def test_a_new_split_carries_nothing_derived(spark):
    df = spark.createDataFrame([(1, "One two. Three four.", "x", 5)], "doc int, text string, tts_text string, kept int")
    df = projections.with_derived(df, "weight", F.length("text"))
    assert projections.drop_derived(df).columns == ["doc", "text", "kept"]
    assert segments.split_window(df, target=8, maximum=10, minimum=4).columns == ["doc", "text", "kept", "piece", "char_start", "char_end", "boundary"]


def test_metadata_of_a_book_or_its_first_part(spark):
    books = spark.createDataFrame([("a", "  The   Book ", None), ("b", None, " "), (None, None, None)], "book string, title string, author string")
    parts = spark.createDataFrame([("a", 1, "Other — часть 1 из 2", "A. Author"), ("b", 2, "B — часть 2", "Second"), ("b", 1, "B — часть 1", None), (None, 1, "N", None), ("c", 1, None, None)], "book string, part int, title string, author string")
    got = {r.book: (r.title, r.author) for r in projections.book_meta(books, parts, ["book"]).collect()}
    assert got == {"a": ("The Book", "A. Author"), "b": ("B", "Second"), None: ("N", ""), "c": ("", "")}


def test_overlong_sentences_are_cut(spark):
    long = "word " * 30 + "x" * 45 + " end"
    rows = [("d", 0, "Short."), ("d", 1, long), ("d", 2, "After."), ("d", 3, " "), ("d", 4, None), ("d", 5, "Last one."), ("e", 0, "y" * 90)]
    got = {}
    for r in segments.pack_texts(spark.createDataFrame(rows, "doc string, at int, text string"), ["doc"], "at", "text", 40).orderBy("doc", "chunk").collect():
        got.setdefault(r.doc, []).append(r.chunk_text)
    want = {}
    for d in ("d", "e"):  # the rule as a loop
        out, held = [], ""
        for _, _, t in (r for r in rows if r[0] == d):
            t = (t or "").strip()
            while len(t) > 40:
                cut = t.rfind(" ", 0, 40)
                cut = cut + 1 if cut > 0 else 40
                out += [held] if held else []
                held = ""
                out.append(t[:cut].strip())
                t = t[cut:].strip()
            if held and t and len(held) + 1 + len(t) > 40:
                out.append(held)
                held = t
            else:
                held = f"{held} {t}".strip()
        want[d] = out + ([held] if held else [])
    assert got == want and all(len(c) <= 40 for x in got.values() for c in x)


@pytest.mark.parametrize("most", [annotators.SHARED_ENTRIES, 1])
def test_readings_and_names_on_both_sides_of_the_bound(spark, monkeypatch, most):
    monkeypatch.setattr(annotators, "SHARED_ENTRIES", most)
    df = spark.createDataFrame([(1, "ab cd, ab!", "z"), (2, None, "z"), (3, "", "z"), (4, "x " * 2000 + "cd", "z")], "k int, text string, fragment string").repartition(2)
    readings = spark.createDataFrame([("ab", "AB"), ("cd", "CD2"), ("cd", "CD1"), (None, "n")], "fragment string, reading string")
    got = {r.k: r.text for r in annotators.replace_fragments(df, ["k"], "text", readings, "[a-z]+").collect()}
    assert got == {1: "AB CD1, AB!", 2: None, 3: "", 4: "x " * 2000 + "CD1"}
    blocks = spark.createDataFrame([(1, "Anna and Mary Jane."), (2, "joanna; mary"), (3, None), (4, "MARY JANE")], "block_id int, text string")
    names = spark.createDataFrame([("a", "Anna"), ("m", "Mary Jane"), ("x", ""), ("n", None)], "key string, name string")
    own = spark.createDataFrame([("a", 2)], "key string, block_id int")
    assert sorted(map(tuple, joins.mention_context(blocks, names, own, "key").collect())) == [("a", 1), ("a", 2), ("m", 1), ("m", 4)]
