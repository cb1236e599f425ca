"""Outcomes of property-test runs before and after a patch, and the questions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.scores import reproduction
from tracewise.functions.text import last_match, numbered_lines
from tracewise.operators.selection import expanded, sorted_letter
from tracewise.schemas import ERROR_INFO

# How a failing line and an exception show in a run's output, and the two fixed options.
FAILING_LINE = r'File "/testbed/reproducer\.py", line (\d+)'
EXCEPTION_LINE = r"(?m)^(.*(?:Error|Exception|ImproperlyConfigured)(?::?).*)$"
EXCEPTION_NAME = r"^(.*(?:Error|Exception|ImproperlyConfigured))"
UNKNOWN = "The question cannot be answered based on the explanation alone."
PASSED = "The test passed."


def failing_line(output: Column, code: Column) -> Column:
    """The last failing line; NA for a failure without one; null for a run that didn't fail."""
    return F.when(code != 0, F.coalesce(last_match(output, FAILING_LINE), F.lit("NA")))


def exception_name(output: Column, code: Column) -> Column:
    """Name of the last exception; Timeout where no line shows either; Exception where only the line is known."""
    line = last_match(output, EXCEPTION_LINE)
    name = F.regexp_extract(line, EXCEPTION_NAME, 1)
    name = F.trim(F.regexp_replace(F.substring_index(name, ":", 1), r"[+|]", ""))
    known = F.regexp_like(output, F.lit(FAILING_LINE))
    return F.when(code != 0, F.when(F.coalesce(name, F.lit("")) != "", name).when(known, "Exception").otherwise("Timeout"))


def error_infos(text: Column) -> Column:
    """Lines and exceptions of an error report; an error if it isn't one, or lacks a field. Null stays null."""

    def whole(info: Column) -> Column:
        found = info["info_list"]
        lacking = found.isNull() | F.exists(found, lambda x: x.isNull() | x["lineno"].isNull() | x["exception_type"].isNull())
        wrong = F.raise_error(F.lit("error report lacks a field")).cast("array<struct<lineno: int, exception_type: string>>")
        return F.when(F.coalesce(lacking, F.lit(False)), wrong).otherwise(found)

    return F.when(text.isNotNull(), whole(F.from_json(text, ERROR_INFO, {"mode": "FAILFAST"})))


def option(line: Column, name: Column) -> Column:
    return F.when(line.isNull(), F.lit(PASSED)).otherwise(F.concat(F.lit("The test failed at line "), line, F.lit(" with exception: "), name, F.lit(".")))


def seeded(runs: DataFrame) -> DataFrame:
    """before and after texts and the options they give. A run that doesn't fail before the patch gives no question."""
    out = runs.withColumns({
        "before_line": failing_line(F.col("buggy_stdout"), F.col("buggy_returncode")),
        "before_name": exception_name(F.col("buggy_stdout"), F.col("buggy_returncode")),
        "after_line": failing_line(F.col("fixed_stdout"), F.col("fixed_returncode")),
        "after_name": exception_name(F.col("fixed_stdout"), F.col("fixed_returncode")),
    })
    out = out.where(F.col("before_line").isNotNull())
    same = F.coalesce(F.col("before_line") == F.col("after_line"), F.lit(False))
    after = option(F.col("after_line"), F.col("after_name"))
    before = F.when(same, after).otherwise(option(F.col("before_line"), F.col("before_name")))
    return out.withColumn("before", before).withColumn("after", after).withColumn("options", F.array_distinct(F.array(F.lit(PASSED), F.col("after"), F.col("before"))))


def questions(seeds: DataFrame, extra: DataFrame, on: list[str]) -> DataFrame:
    """Numbered test, five sorted choices and the letters of both outcomes. extra: on + extra options from outside."""
    joined = seeds.join(extra, on).withColumn("_c", expanded(F.col("options"), F.col("extra"), UNKNOWN)).where(F.col("_c").isNotNull())
    return joined.select(
        *on,
        numbered_lines(F.col("test_content")).alias("test_content"),
        F.array_sort("_c").alias("choices"),
        sorted_letter(F.col("_c"), F.col("before")).alias("before_answer"),
        sorted_letter(F.col("_c"), F.col("after")).alias("after_answer"),
    )


def statuses(runs: DataFrame) -> DataFrame:
    """Reproduction status and its text."""
    status = reproduction(F.col("buggy_returncode"), F.col("fixed_returncode"))
    text = F.concat_ws("\n", F.concat(F.lit("status: "), status), F.concat(F.lit("before: "), F.col("buggy_returncode").cast("string")), F.concat(F.lit("after: "), F.col("fixed_returncode").cast("string")))
    return runs.withColumn("status", status).withColumn("reproduced", status == "reproduced").withColumn("report", text)
