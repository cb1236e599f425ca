import math
import statistics

import pytest
from pyspark.sql import functions as F

from tracewise.functions import scores, text
from tracewise.operators import joins, scoring


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def letters(s):
    return F.array(*map(F.lit, s)) if s else F.array().cast("array<string>")


@pytest.mark.parametrize(("predicted", "truth", "expected"), [("d", "d", 1.0), ("ad", "d", 0.0), ("a", "ab", 0.5), ("aa", "a", 1.0), ("D", "d", 0.0), ("", "ab", 0.0)])
def test_choice_score(spark, predicted, truth, expected):
    assert one(spark, scores.choice_score(letters(predicted), letters(truth))) == expected


def test_empty_truth_is_an_error(spark):
    with pytest.raises(Exception, match="empty truth"):
        one(spark, scores.choice_score(letters("a"), letters("")))


def test_truths_as_lists_and_letters(spark):
    assert one(spark, scores.truth_list(F.lit('["d"]'))) == ["d"]
    assert one(spark, scores.truth_list(F.lit("d"))) == ["d"]


def test_statistics_are_over_trials(spark):
    rows = [("a", 0, 1.0), ("b", 0, 0.0), ("a", 1, 1.0), ("b", 1, 1.0), ("a", 2, 0.0), ("b", 2, 0.5)]
    got = scoring.statistics(spark.createDataFrame(rows, "id string, trial int, score double")).first()
    means = [0.5, 1.0, 0.25]
    assert math.isclose(got["mean"], statistics.mean(means))
    assert math.isclose(got["sem"], statistics.stdev(means) / math.sqrt(3))
    assert not got["ragged"]


def test_one_trial_has_no_error_and_ragged_trials_show(spark):
    schema = "id string, trial int, score double"
    assert scoring.statistics(spark.createDataFrame([("a", 0, 1.0)], schema)).first()["sem"] is None
    assert scoring.statistics(spark.createDataFrame([("a", 0, 1.0), ("b", 0, 1.0), ("a", 1, 1.0)], schema)).first()["ragged"]
    assert scoring.statistics(spark.createDataFrame([], schema)).collect() == []


def test_strict_scores_need_a_truth(spark):
    p = spark.createDataFrame([("a", 0, ["d"]), ("b", 0, ["d"])], "id string, trial int, answer array<string>")
    g = spark.createDataFrame([("a", ["d"]), ("c", ["d"])], "id string, answer array<string>")
    assert [tuple(r) for r in scoring.score_trials(p, g, ["id"]).collect()] == [("a", 0, 1.0)]
    with pytest.raises(Exception, match="prediction without truth"):
        scoring.score_trials(p, g, ["id"], strict=True).collect()
    assert [r["id"] for r in scoring.unmatched(p, g, ["id"]).collect()] == ["b"]


def test_changed_truth_table(spark):
    def error(stage, kind, message=""):
        return F.struct(F.lit(stage).alias("stage"), F.lit(kind).alias("type"), F.lit(message).alias("message"))

    none = F.lit(None).cast(joins.EXCEPTION)
    v, w, null = F.lit("1"), F.lit("2"), F.lit(None).cast("string")
    assert one(spark, scores.changed(v, none, v, none)) is False
    assert one(spark, scores.changed(v, none, w, none)) is True
    assert one(spark, scores.changed(null, error("evaluation", "NameError"), w, none)) is True
    assert one(spark, scores.changed(null, error("evaluation", "TypeError"), w, none)) is False
    assert one(spark, scores.changed(v, none, null, error("evaluation", "AttributeError", "'NoneType' object"))) is True
    assert one(spark, scores.changed(null, none, null, none)) is False


def test_first_explanation_or_default(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", ["x", "y"]), ("b", [])], "id string, explanations array<string>")
    assert {tuple(r) for r in joins.with_explanation(c, e, ["id"]).collect()} == {("a", "x"), ("b", "EMPTY"), ("c", "EMPTY")}


def test_labels_and_numbers(spark):
    assert one(spark, text.labelled_choices(letters("xy"))) == "a) x\nb) y"
    assert one(spark, text.numbered_lines(F.lit("p\n\nq"))) == "1: p\n2: \n3: q"
    assert one(spark, text.dotted_module(F.lit("lib/a/b.py"))) == "a.b"
    assert one(spark, text.dotted_module(F.lit(".py"))) == "<unknown_module>"
    assert one(spark, text.simple_name(F.lit("m:A.b"))) == "b"
    assert one(spark, text.qualified_name(F.lit("m:A.b:c"))) == "A.b:c"
    assert one(spark, text.joined_or(letters(""))) == "none"
    assert one(spark, text.image_name(F.lit("django__django-1"))) == "django_1776_django-1"


def test_ragged_trials_are_an_error_when_strict(spark):
    even = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 0.0)], "id string, trial int, score double")
    assert scoring.statistics(even, strict=True).first()["mean"] == 0.5
    with pytest.raises(Exception, match="trials of different length"):
        scoring.statistics(even.union(spark.createDataFrame([("b", 0, 1.0)], even.schema)), strict=True).collect()


def test_time_limit_gives_zeros(spark):
    def scorer(answers, truth):
        import time

        if "slow" in truth:
            time.sleep(30)
        return [float(a == truth) for a in answers]

    rows = [("a", [["x"], ["y"]], ["x"]), ("b", [["x"], ["y"], []], ["slow"]), ("c", [], ["x"]), ("d", None, ["x"]), ("e", [["z"]], ["z"])]
    df = spark.createDataFrame(rows, "id string, p array<array<string>>, t array<string>")
    got = {r["id"]: r["s"] for r in df.select("id", scoring.time_limited(scorer, F.col("p"), F.col("t"), 0.5).alias("s")).collect()}
    assert got == {"a": [1.0, 0.0], "b": [0.0, 0.0, 0.0], "c": [], "d": [], "e": [1.0]}
