import pytest
from pyspark.sql import functions as F

from bibliolake.functions import lists, scalars


@pytest.fixture(scope="module")
def one(spark):
    def run(column_of, *values, type="string"):
        df = spark.createDataFrame([(v,) for v in values], f"x {type}")
        return [r[0] for r in df.select(column_of(F.col("x"))).collect()]

    return run


def test_lenient_int(one):
    values = ["12abc", "3.9", "Jan", "", " 7", "-2x", None]
    assert one(scalars.lenient_int, *values) == [12, 3, 0, 0, 7, -2, None]


def test_numbers(one):
    assert one(scalars.to_number, "n/a", None, "12", " 3.5 ") == [None, None, 12.0, 3.5]
    odd = ["NaN", "Infinity", "-inf", "12d", "3F", "1e999", "", " ", ".", "e3", "1e3", ".5", "5.", "-2", "+7"]
    assert one(scalars.to_number, *odd) == [None] * 10 + [1000.0, 0.5, 5.0, -2.0, 7.0]
    assert one(scalars.to_count, "n/a", None, "12", "NaN", "Infinity", "1e30", "3.9") == [0, 0, 12, 0, 0, 0, 3]


def test_ratios(spark):
    df = spark.createDataFrame([(6, 0), (6, 4)], "n int, d int")
    got = df.select(scalars.ratio_or_null(F.col("n"), F.col("d")), scalars.ratio_or_numerator(F.col("n"), F.col("d")))
    assert [tuple(r) for r in got.collect()] == [(None, 6.0), (1.5, 1.5)]


@pytest.mark.parametrize("length, dots", [(59, False), (60, True), (61, True)])
def test_title_label(one, length, dots):
    assert one(scalars.title_label, "x" * length) == ["x" * min(length, 60) + ("…" if dots else "")]


def test_title_label_of_null(one):
    assert one(scalars.title_label, None) == [""]


def test_whitespace(one):
    text = " \t a  b\n c  "
    assert one(scalars.strip, text) == [text.strip()]
    assert one(scalars.squeeze, text) == [" a b c "]
    assert one(scalars.not_blank, " \t ", "", None, " x") == [False, False, False, True]


def test_dates(one):
    days = one(scalars.parse_date, "05/03/2018", "5/3/2018", "01/00/2018", "x", None)
    assert [str(d) if d else None for d in days] == ["2018-03-05", "2018-03-05", None, None, None]


def test_half_even(one):
    assert one(scalars.round4, 0.00005, 0.00015, type="double") == [0.0, 0.0002]


def test_json_list(one):
    assert one(lists.json_list, '["a","b"]', '{"a":1}', "bad [", None) == [["a", "b"], [], [], []]


def test_json_subjects(one):
    text = '[{"Math":"MATH"}, 5, "x", {"Art":"ARTS","Law":"LAW"}]'
    assert one(lists.json_subjects, text, "{}", None) == [["Math", "Art", "Law"], [], []]


def test_keywords_as_text(one):
    values = ['["a","","b"]', '{"y":"2","x":"1"}', "plain, text", None, ""]
    assert one(lists.keywords_as_text, *values) == ["a b", "2 1", "plain, text", "", ""]


def test_lists(one):
    arrays = ([" b", "a", "b\t", "", "  "], [], None)
    assert one(lists.distinct_terms, *arrays, type="array<string>") == [["a", "b"], [], None]
    assert one(lists.list_length, *arrays, type="array<string>") == [5, 0, 0]
    assert one(lambda c: lists.any_contains(c, "B"), *arrays, type="array<string>") == [True, False, False]


def test_manuscript_text(spark):
    rows = [(" t ", None, "k"), ("", " ", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    texts = df.select(scalars.manuscript_text(F.col("a"), F.col("b"), F.col("c")))
    assert [r[0] for r in texts.collect()] == ["t k", None]
