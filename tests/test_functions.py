import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, strings, vectors


def values(spark, rows, kind, expr):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, c {kind}")
    return [r["v"] for r in df.select("i", expr(F.col("c")).alias("v")).orderBy("i").collect()]


def test_chat_times(spark):
    given = ["2023/05/20 (Sat) 05:03", "2023/5/2 5:03", "2023-05-20 05:03", "2023-05-20", "soon", "", None]
    got = values(spark, given, "string", lambda c: F.date_format(dates.parse_chat_time(c), "yyyy-MM-dd HH:mm"))
    assert got == ["2023-05-20 05:03", "2023-05-02 05:03", "2023-05-20 05:03", None, None, None, None]
    assert values(spark, ["soon"], "string", lambda c: F.year(dates.chat_time_or_last(c))) == [9999]
    assert values(spark, ["2023-05-20", "2023/05/20 (Sat) 05:03", "2023-05-20T01:02:03"], "string", lambda c: dates.parse_date_seconds(c).isNull()) == [False, True, False]
    assert values(spark, ["2023/05/20 (Sat)", "2023-05-20"], "string", lambda c: dates.parse_session_date(c).isNull()) == [False, False]
    assert values(spark, ["at 2021-3-4 it", "no"], "string", lambda c: F.year(dates.date_or_first(c))) == [2021, 2000]
    assert values(spark, ["2023/05/20 (Sat) 05:03", "x"], "string", dates.strip_clock) == ["2023/05/20 (Sat)", "x"]


def test_dates_in_texts(spark):
    given = ["seen 2023/05/20 and in 1999", "on May 3rd, 2021", "in June 2020", "in 2019", "never"]
    assert values(spark, given, "string", dates.date_from_text) == ["2023/05/20", "May 3rd, 2021", "June 2020", "2019", None]


@pytest.mark.parametrize(
    ("said", "yes"),
    [("so ... Final answer: yes", True), ("Answer - no", False), ("reasoning\nYes.", True), ("yes, because", True), ("I think not", False), ("<think>final answer: yes</think> no", False), ("", False), ("<think></think>yes", False), ("no\nanswer: yes", True)],
)
def test_verdicts(spark, said, yes):
    assert values(spark, [said], "string", strings.verdict) == [yes]


def test_thinking(spark):
    given = ["<think> a </think> b", "<THINKING>x</THINKING><redacted_thinking>y</redacted_thinking>z ", "<think> </think> b", " b "]
    assert values(spark, given, "string", strings.thinking) == ["a", "x\n\ny", "", ""]
    assert values(spark, given, "string", strings.after_thinking) == ["b", "z", "<think> </think> b", "b"]


def test_relation_labels(spark):
    given = ['{"relation": "con"}', "```json\n{\"relation\": \"EQV\"}\n```", "it is OSN", 'x {"relation": "NSO"} y', "CONCERT", "nothing"]
    assert values(spark, given, "string", strings.relation_strict) == ["CON", "EQV", "IND", "NSO", "IND", "IND"]
    assert values(spark, given, "string", strings.relation_loose) == ["CON", "EQV", "OSN", "NSO", "CON", "IND"]
    assert values(spark, given, "string", strings.relation_word) == ["CON", "EQV", "OSN", "NSO", "PARSE_FAIL", "PARSE_FAIL"]
    assert values(spark, ["CON", "EQV"], "string", lambda c: strings.active(c, ("EQV",))) == ["IND", "EQV"]


def test_names(spark):
    assert values(spark, [" A  b/C!! ", "--", "x__y"], "string", strings.slug) == ["a-b-c", "x", "x__y"]
    assert values(spark, ["gpt4_ab", "xgpt4_"], "string", strings.question_file) == ["gp_4_ab", "xgpt4_"]
    assert values(spark, ["The user saw the user"], "string", lambda c: strings.aliased(c, F.lit("h"))) == ["User_h saw User_h"]
    assert values(spark, ["a\n\n b ", "  "], "string", strings.lines) == [["a", "b"], ["  "]]


def test_vectors(spark):
    assert values(spark, [[3.0, 4.0], [0.0, 0.0]], "array<double>", vectors.normalized) == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, [[1.0, 2.0]], "array<double>", lambda c: vectors.dot(c, c)) == [5.0]
    assert values(spark, [[0.0]], "array<double>", lambda c: vectors.cosine(c, c)) == [0.0]
