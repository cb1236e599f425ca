"""Answer scores, answer checks and status expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scores of extension tasks: name -> (prediction, truth) -> score.
SCORES: dict[str, Callable[[Column, Column], Column]] = {}


def score(name: str):
    """Registers a scoring expression under a name."""

    def add(f):
        SCORES[name] = f
        return f

    return add


@score("multiple_choice")
def choice_score(predicted: Column, truth: Column) -> Column:
    """0 if any predicted option is wrong, else the share of the truth that was found. Sets: order and repeats don't count."""
    wrong = F.size(F.array_except(predicted, truth)) > 0
    share = F.size(F.array_intersect(predicted, truth)) / F.size(F.array_distinct(truth)).cast("double")
    checked = F.when(F.size(truth) < 1, F.raise_error(F.lit("empty truth")).cast("double"))
    return checked.when(wrong, 0.0).otherwise(share)


@score("ordered_pair")
def pair_score(predicted: Column, truth: Column) -> Column:
    """Share of positions at which two lists of equal length agree."""
    same = F.size(F.filter(F.arrays_zip(predicted.alias("p"), truth.alias("t")), lambda x: x["p"] == x["t"]))
    return same / F.size(truth).cast("double")


@score("pair_as_shipped")
def pair_key_score(predicted: Column, truth: Column) -> Column:
    """Pair truths taken as the names of their keys, which no letter equals: always 0."""
    return F.lit(0.0)


def truth_list(answer: Column) -> Column:
    """A truth given as a JSON list or as one letter, as a list."""
    return F.when(F.ltrim(answer).startswith("["), F.from_json(answer, "array<string>")).otherwise(F.array(answer))


def valid_choice(answer: Column) -> Column:
    """A non-empty list of single letters."""
    return F.coalesce((F.size(answer) > 0) & F.forall(answer, lambda x: F.coalesce(x.rlike(r"^\p{L}$"), F.lit(False))), F.lit(False))


def enough_options(choices: Column, changed: Column, unchanged: Column, least_changed: int = 1, least_unchanged: int = 3) -> Column:
    """Whether a question can be built: it has choices already, or enough of both kinds."""

    def count(a: Column) -> Column:
        return F.coalesce(F.size(a), F.lit(0))

    return choices.isNotNull() | ((count(changed) >= least_changed) & (count(unchanged) >= least_unchanged))


def missing_name(exception: Column) -> Column:
    """An evaluation that failed because a name isn't defined."""
    return F.coalesce((exception["stage"] == "evaluation") & (exception["type"] == "NameError"), F.lit(False))


def missing_attribute(exception: Column) -> Column:
    """An evaluation that failed because the object was None."""
    return F.coalesce((exception["stage"] == "evaluation") & (exception["type"] == "AttributeError") & exception["message"].contains("NoneType"), F.lit(False))


def changed(before: Column, before_exception: Column, after: Column, after_exception: Column) -> Column:
    """Whether an expression changed, given canonical values of both sides and what went wrong.

    Equal values didn't. If one side has none, it changed only if that side failed for a
    missing name or a None. Everything else changed.
    """

    def telling(e: Column) -> Column:
        return missing_name(e) | missing_attribute(e)

    return (
        F.when(before.eqNullSafe(after), False)
        .when(before.isNull(), telling(before_exception))
        .when(after.isNull(), telling(after_exception))
        .otherwise(True)
    )


def reproduction(before_code: Column, after_code: Column) -> Column:
    """Status of a run pair from its return codes."""
    return (
        F.when(before_code.isNull() | after_code.isNull(), "error")
        .when((before_code != 0) & (after_code == 0), "reproduced")
        .when(before_code == 0, "pass_in_buggy")
        .otherwise("fail_in_fixed")
    )


# Fixed value: where a divergence shows that is a return or an exception.
AT_RETURN = "The return statement in the provided function"


def location(event_type: Column, statement: Column) -> Column:
    """Where a divergence shows: a sentence for returns and exceptions, else the statement."""
    return F.when(event_type.isin("Return", "Exception"), AT_RETURN).otherwise(statement)


def moment(before_type: Column, after_type: Column) -> Column:
    """`after` if either side returned or raised, else `before`."""
    return F.when(before_type.isin("Return", "Exception") | after_type.isin("Return", "Exception"), "after").otherwise("before")
