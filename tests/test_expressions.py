"""Expressions on the edge rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import rules, text


def value(spark, column, **row):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in row.items()) if row else [F.lit(1)]).select(column).first()[0]


@pytest.mark.parametrize(("raw", "want"), [("<b>a</b>&amp;lt;", "a<"), (" a b　\t", "a b"), ("&quot;", "&quot;"), (None, ""), ("a < b &gt; c", "a < b > c"), ("&amp;gt;x", ">x")])
def test_clean_text(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "a string").select(text.clean_text("a")).first()[0] == want


def test_contains_any(spark):
    rows = spark.createDataFrame([("An AD here",), (None,)], "a string")
    got = lambda needles: [r[0] for r in rows.select(text.contains_any("a", needles)).collect()]
    assert got(["ad"]) == [True, False] and got([""]) == [True, True] and got([]) == [False, False]


@pytest.mark.parametrize(("date", "keep"), [("", True), ("20240230", True), ("20240105", True), ("20240131", True), ("20240201", False), (None, True)])
def test_date_window(spark, date, keep):
    rows = spark.createDataFrame([(date,)], "d string")
    assert rows.select(text.in_date_window("d", "2024-01-05", "2024-01-31")).first()[0] is keep
    assert rows.select(text.in_date_window("d", "nonsense", "")).first()[0] is True


def test_score_steps(spark):
    totals = [9, 10, 49, 50, 99, 100, 499, 500, 999, 1000, 4999, 5000, 9999, 10000, None]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(totals)], "i int, t long").orderBy("i").select(rules.score_of_total("t")).collect()
    assert [r[0] for r in got] == [25, 35, 35, 45, 45, 55, 55, 65, 65, 75, 75, 85, 85, 95, 50]


def test_node_size(spark):
    got = spark.createDataFrame([(n,) for n in (99, 100, 1499, 1500, 5000)], "n long").select(rules.node_size("n")).collect()
    assert sorted(r[0] for r in got) == [15, 16, 29, 30, 30]


def test_index_name(spark):
    name = value(spark, rules.index_name(F.lit("S_1" * 20)))
    assert name == ("cx-" + "s-1" * 20)[:45]


@pytest.mark.parametrize(("answer", "state", "n"), [('x [{"a": 1}] y', "ok", 1), ("[1] and [2]", "error", None), ("none", "empty", None), (None, "empty", None), ("[]", "ok", 0), ("[1], [2]", "error", None)])
def test_answers(spark, answer, state, n):
    row = spark.createDataFrame([(answer,)], "t string").select(text.answer_state("t"), F.size(text.parse_array("t", "struct<a:int>"))).first()
    assert row[0] == state and (row[1] == n if n is not None else row[1] in (None, -1))


def test_directives(spark):
    answer = "Sure\nADDED_KEYWORDS: a, ,b \nbye\n```MODIFIED_DATA\n[]\n```"
    rows = spark.createDataFrame([(answer,)], "t string")
    assert rows.select(text.parse_added_keywords("t")).first()[0] == ["a", "b"]
    assert rows.select(text.modified_json("t")).first()[0] is None
    assert rows.select(text.strip_directives("t")).first()[0] == "Sure\n\nbye"


def test_predictions(spark):
    rows = spark.createDataFrame([("1, 0 and 1", 5), ("101010", 2), (None, 2)], "t string, n int")
    assert [r[0] for r in rows.select(text.parse_binary_preds("t", F.col("n"))).collect()] == [[1, 0, 1, 0, 0], [1, 0], [0, 0]]


def test_labels(spark):
    rows = spark.createDataFrame([(x,) for x in ('"relevant"', "1", '"1"', "0", None)], "l string")
    assert [r[0] for r in rows.select(rules.is_relevant_label("l")).collect()] == [1, 1, 0, 0, 0]


def test_small_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(rules.round3(F.lit(0.0625))) == 0.062
    assert one(rules.progress(F.lit(1), F.lit(3))) == 43
    assert one(rules.label_pct(F.lit(3), F.lit(0))) == 0 and one(rules.label_pct(F.lit(1), F.lit(100))) == 50
    assert one(rules.short_name(F.lit("123456789"))) == "12345678..." and one(rules.step_index(F.lit("embed-check"))) == 7
    assert one(rules.next_round(F.lit("r3"), F.lit(159))) == "r3-expand" and one(rules.next_round(F.lit("r3"), F.lit(160))) == "final"
    assert one(rules.target_desc(F.array(F.lit("a"), F.lit("b")), F.array().cast("array<string>"), F.array(F.lit("c")))) == "a, b | c"
    assert one(rules.target_desc(F.array().cast("array<string>"))) == "everyone"
    assert [one(rules.persona_quota(F.lit(n))) for n in (49, 50, 199, 200)] == [1, 2, 2, 3]
    assert [one(rules.score_band(F.lit(n))) for n in (70, 69, 50, 49)] == ["high", "medium", "medium", "low"]
    assert rules.default_window(dt.date(2024, 12, 31)) == ("2024-01-01", "2024-12-31")
    assert rules.run_ts(dt.datetime(2024, 1, 2, 3, 4, 5)) == "20240102_030405"
    assert text.parse_terms(" a, ,b ") == ["a", "b"] and text.parse_terms(["a "]) == ["a "] and text.parse_terms(None) == []
