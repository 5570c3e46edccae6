"""Golden pairs of the text functions."""

import pytest
from pyspark.sql import functions as F

from fabula.functions import numbers as N
from fabula.functions import rules as R
from fabula.functions import text as X

L = F.lit

CASES = [
    (X.speech_punctuation, "Смерть – высокая особа.", "Смерть высокая особа."),
    (X.speech_punctuation, "5–10", "5-10"),
    (X.speech_punctuation, "как-будто", "какбудто"),
    (X.spoken_brackets, "Он вошёл (тихо).", "Он вошёл, скобка открывается, тихо, скобка закрывается."),
    (X.spoken_brackets, "(Примечание автора.) Дальше.", "скобка открывается, Примечание автора, скобка закрывается. Дальше."),
    (X.spoken_brackets, "«(шёпотом) Иди»", "«скобка открывается, шёпотом, скобка закрывается, Иди»"),
    (X.spoken_brackets, "См. [а] и {б}.", "См. скобка открывается, а, скобка закрывается, и, скобка открывается, б, скобка закрывается."),
    (X.spoken_brackets, "Да (…), нет", "Да …, нет"),
    (lambda c: X.unmask(X.mask_opaque(c), X.opaque_spans(c)), "\ue000 a@b.cd \ue000\ue001 https://x.y/\ue000 \ue002", "\ue000 a@b.cd \ue000\ue001 https://x.y/\ue000 \ue002"),
    (X.join_thousands, "1 234 5678 и 100 200 300 400 500", "1234 5678 и 100200300400500"),
    (X.symbol_words, "№ 7, § 3 * “a”", "номер 7, параграф 3 «a»"),
    (X.widen_years, "1813-14 годов", "1813-1814 годов"),
    (X.widen_years, "2024-05", "2024-05"),
    (X.join_thousands, "2 000 кг, 12 345 678 и 1 00", "2000 кг, 12345678 и 1 00"),
    (X.slug_id, "Игорь Петрович", "igor_petrovich"),
    (X.slug_id, "dühring", "duhring"),
    (X.slug_id, "12 стульев", "c_12_stulev"),
    (X.to_acute, "зам+ок", "замо́к"),
    (X.to_plus, "замо́к", "зам+ок"),
    (X.transliterate, "Gillian Škoda", "гиллиан шкода"),
    (X.tidy_reading, "ле́тс гет а́ут ов хи́р", "летс гет а́ут ов хир"),
    (X.foreign_fragments, "Он сказал: ex post facto, а потом — Übermensch и д’Артаньян.", ["ex post facto", "Übermensch"]),
    (X.close_phrase, "Да,", "Да."),
    (X.close_phrase, "«Да»", "«Да»."),
    (X.close_phrase, "Не знаю —", "Не знаю."),
    (X.close_phrase, "— — —", "— — —"),
    (X.close_phrase, "«Да!»", "«Да!»"),
    (X.slug_id, "Хрущёв", "khrushchev"),
    (X.tidy_reading, "ха́-ха́", "ха-ха"),
    (X.spoken_variants, "Конста́нс", ["Конста́нс.", "Констанс.", "Констанс…", "Констанс!"]),
    (X.close_phrase, "Да!", "Да!"),
    (X.phone_groups, "+7 (912) 345-67-89", ["7", "912", "345", "67", "89"]),
    (X.fix_spacing, "$100 а,б", "100 $ а, б"),
    (X.clean_space, "по‑\nшёл", "пошёл"),
    (X.balance_quotes, "«a» b»", "a b"),
    (X.drop_footnotes, "a[12] b", "a b"),
    (N.decimal_words, "3,14", "три целых четырнадцать сотых"),
    (N.fraction_words, "1/3", "одна третья"),
    (N.fraction_words, "1/0", None),
    (N.clock_words, "02:01", "два часа одна минута"),
    (N.clock_words, "25:10", None),
    (N.suffix_ordinal, "21-я", "двадцать первая"),
    (N.span_words, "10–15 км", "от десяти до пятнадцати километров"),
    (N.span_words, "15–10 км", None),
    (N.acronym_reading, "ФСБ", "эф эс бэ"),
    (N.acronym_reading, "НАТО", "нато"),
    (N.ordinal_ending, "главе", "ой"),
]


@pytest.mark.parametrize("f,given,wanted", CASES, ids=lambda x: getattr(x, "__name__", None))
def test_golden(one, f, given, wanted):
    assert one(f(L(given))) == wanted


@pytest.mark.parametrize("word,good", [("Ги́ллиан Флинн", True), ("экс пост фа́кто", True), ("Гиллиан", False), ("фла́йн", False), ("Gillian", False), ("ги́лли́ан", False), ("ха-ха", True), ("ёлка́", False), ("гм", False), ("ѓи", False), (None, False)])
def test_valid_reading(one, word, good):
    assert one(X.valid_reading(L(word))) is good


def test_numbers(one):
    assert one(N.integer_words(L(1101), 0, True)) == "одна тысяча сто одна"
    assert one(N.integer_words(L(25), 1)) == "двадцати пяти"
    assert one(N.integer_words(L(234), 2)) == "двумстам тридцати четырём"
    assert one(N.integer_words(L(2_000_000))) == "два миллиона"
    assert one(N.integer_words(L(10**12))) is None
    assert one(N.ordinal_word(L(2024), "ом")) == "две тысячи двадцать четвёртом"
    assert one(N.ordinal_word(L(1813), "ого")) == "тысяча восемьсот тринадцатого"
    ref = F.to_date(L("2025-01-01"))
    assert one(N.date_words(N.date_of(L("05.05.2024"), ref))) == "пятого мая две тысячи двадцать четвёртого года"
    assert one(N.date_of(L("31.02.2024"), ref)) is None
    assert one(N.unit_words(L(1), L("км"), 1)) == "километра"


def test_roman_table(spark):
    table = {r.roman: r.n for r in N.roman_table(spark).collect()}
    assert len(table) == 3999 and table["MCMXCIV"] == 1994 and "IIII" not in table


def test_abbreviations(one):
    text = X.expand_abbreviations(X.expand_abbreviations(L("т.е. wi-fi г-н"), R.BRANDS), R.ABBREVIATIONS, False)
    assert one(text) == "то есть вай-фай господин"


def test_marks(one):
    assert one(X.restore_case(L("ве́тер"), L("Ветер"))) == "Ве́тер"
    info = one(X.stress_info(L("замо́к")))
    assert (info.stressed, info.vowels, info.has_yo) == (2, 2, False)
    assert one(X.unmask(X.mask_opaque(L("a https://b.c/d x@y.zz e")), X.opaque_spans(L("a https://b.c/d x@y.zz e")))) == "a https://b.c/d x@y.zz e"


def test_idempotent(spark):
    rows = spark.createDataFrame([("Смерть – высокая особа (да), № 7.",), ("— Ну что же, — сказал он.",)], "t string")
    once = rows.select(X.speech_punctuation(X.symbol_words(X.spoken_brackets(F.col("t")))).alias("t"))
    assert once.collect() == once.select(X.speech_punctuation(X.symbol_words(X.spoken_brackets(F.col("t")))).alias("t")).collect()
