"""Results and plans that an earlier round had wrong, on small tables of the same names."""

import duckdb
import pytest

import fabula.plans.more  # noqa: F401
import fabula.plans.narration  # noqa: F401
import fabula.plans.tables  # noqa: F401
import fabula.plans.texts  # noqa: F401
from fabula.plans.registry import QUERIES, SQL
from fabula.session import fresh_path


@pytest.fixture
def against_sql(spark):
    """Rows of a query on a table of given rows, and those of its SQL."""

    def run(query: str, table: str, rows: list, schema: str) -> tuple[list, list]:
        folder = fresh_path(spark, "small")
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        df = QUERIES[query](spark, folder)
        c = duckdb.connect()
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder.removeprefix('file://')}/{table}.parquet/*.parquet'")
        r = c.execute(SQL[query])
        names = [x[0] for x in r.description]
        want = sorted((tuple(row[names.index(n)] for n in df.columns) for row in r.fetchall()), key=str)
        return sorted(map(tuple, df.collect()), key=str), want

    return run


def test_thousands_behind_a_longer_number(against_sql):
    texts = ["+1 (826) 555-4081 190.137.223.204", "1 234 567 и 100 200 300 400", "a1 000 b 5 0001 6 000x 7 000_ 8 000é 9 000", "", None]
    got, want = against_sql("thousands_joined", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want and "4081190" in got[0][1]


def test_reporting_clause_cut_inside_a_word(against_sql):
    cut = "x" * 106 + " then"  # its first 110 characters end in "the"
    texts = [f"a, {cut}, the end", "the a", f"a, {cut}", "hey", "a, bé the c", "b", "a, and", "b, and", None, f"a, {'y' * 110} the, and"]
    got, want = against_sql("reporting_clauses", "documents", list(enumerate(texts)), "doc_id long, text string")
    assert got == want == [(0, "swallowed"), (4, "swallowed"), (6, "swallowed"), (7, "insert"), (9, "insert")]


def test_tail_of_conversations_that_lack_a_bound(against_sql):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b\nc"), (1, 2, "user", "d"), (2, 1, "user", "a"), (2, 2, "assistant", "b"), (2, 4, "user", "c"), (3, 2, "assistant", "a")]
    got, want = against_sql("tail_in_range", "conversations", rows, "conv_id long, turn int, role string, text string")
    assert got == want == [(1, 1), (1, 2), (1, 3), (2, 1), (3, 0)]


def test_fragments_of_one_text_stay_with_it(spark, against_sql):
    from fabula.operators import segments

    rows = [(1, "— Да, — сказал он. — Иду. «Кто там? Я!» " * 90), (1, 'He said: "Come. Now!" and left.'), (2, " \n\t"), (3, ""), (4, None), (5, "a")]
    got, want = against_sql("fragment_cover", "documents", rows, "doc_id long, text string")
    assert got == want and len(got) == 3
    made = segments.fragment_texts(spark.createDataFrame(rows, "doc_id long, text string"))
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    spans = segments.speech_fragments(spark.createDataFrame(rows[:1], "doc_id long, text string")).collect()
    assert [rows[0][1][r.char_start : r.char_end] for r in spans] == made.first().fragments


def test_contexts_travel_apart_from_fragments(spark, against_sql):
    from fabula.functions import text as X

    rows = [(2, "uno dos, tres"), (1, "tres! uno dos"), (3, "x" * 300 + ", tres"), (4, None), (5, ""), (1, "zwei")]
    got, want = against_sql("foreign_fragments", "documents", rows, "doc_id long, text string")
    assert got == want and (1, "tres! uno dos") in [(r[2], r[3]) for r in got]
    plan = X.fragment_contexts(spark.createDataFrame(rows, "k long, t string"), "k", "t")._jdf.queryExecution().optimizedPlan().toString()
    aggregated = next(line for line in plan.splitlines() if "Aggregate [fragment" in line)
    assert "context" not in aggregated and "substring" not in aggregated


def test_gains_go_to_the_lines(spark):
    from pyspark.sql import functions as F

    from fabula.plans import tables

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for lines too many for Spark's own choice
    try:
        df = tables.applied_gain(spark, "/root/testdata/sf0.001")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert df.agg(F.count("*")).first()[0] == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_words_of_edits_are_found_once(spark):
    from fabula.operators import audits

    df = spark.createDataFrame([(1, "a.b", "a b")], "k long, o string, p string")
    plan = audits.check_edits(df, ["k"], "o", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(_original") + plan.count("regexp_extract_all(_prepared") <= 4  # words and links, of each side
    rows = [(1, "Да. Нет!", "Да, нет"), (2, "a www.x y", "a www.z y"), (3, "a. b", "a, b"), (4, "a. b", "a. b"), (5, "ё", "е"), (6, "a", None), (7, "за́мок", "замо́к"), (8, "a b", "a b b́")]
    got = sorted((r.k, r.rule) for r in audits.check_edits(spark.createDataFrame(rows, df.schema), ["k"], "o", "p").collect())
    assert got == [(1, "stops"), (2, "letters"), (2, "links"), (3, "stops"), (5, "yo"), (6, "empty"), (7, "mark"), (8, "bad mark"), (8, "words")]


def test_pages_are_parsed_a_few_at_a_time(spark):
    from fabula.sources import blocks as B

    n = 3 * B.PAGES_AT_ONCE + 1
    rows = [(i, None if i % 7 == 0 else "<body>x</body>" if i % 7 == 1 else f"<p id='a'>one {i}</p><ul><li>two</ul>") for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    want = [(i, j, *b) for i, h in rows for j, b in enumerate(B.blocks_of(h)[0])]
    assert sorted(map(tuple, B.html_blocks(pages).collect())) == want
    assert dict(map(tuple, B.visible_text(pages).collect())) == {i: B.shown_text(h) for i, h in rows}
    for made in (B.html_blocks(pages), B.visible_text(pages)):
        assert "MapInPandas" not in made._jdf.queryExecution().executedPlan().toString()


def test_atoms_are_cut_where_a_rule_can_begin(monkeypatch):
    from fabula.operators import normalise as NM

    made = []
    own = NM.Atoms._more
    monkeypatch.setattr(NM.Atoms, "_more", lambda self: (made.append(self.end), own(self))[1])
    assert list(NM.scan("lorem ipsum dolor " * 5000 + "12 км, XIV век")) == [(90000, 90005, "measure"), (90007, 90010, "roman")]
    assert len(made) < 100
    assert list(NM.scan("text II\n \t III.\nIV x")) == [(5, 7, "roman"), (8, 15, "heading"), (16, 18, "roman")]
