"""Whole jobs: generating answers through a provider, evaluating them, and building question tables."""

from __future__ import annotations

import ast
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions import scores, text
from tracewise.operators import joins, ordering, scoring, selection
from tracewise.sources.scratch import stored

#: (model, prompt, number of answers) -> (answers, completion tokens, prompt tokens). Runs on executors. An answer is a list, or JSON text that a schema reads.
Provider = Callable[[str, str, int], tuple[list[list[str] | str], int, int]]

#: What an answer's JSON text must be: name -> function from the parsed value to the answer's list; ValueError for any other form.
SCHEMAS: dict[str, Callable[[object], list[str]]] = {}


def schema(name: str):
    def add(f):
        SCHEMAS[name] = f
        return f

    return add


def _texts(value: object, field: str) -> list[str]:
    found = value.get(field) if isinstance(value, dict) else None
    if not isinstance(found, list) or not all(isinstance(x, str) for x in found):
        raise ValueError(f"no list of texts under {field}")
    return found


@schema("choice")
def choice_answer(value: object) -> list[str]:
    """{answer: [letters]}: not empty, each a single letter."""
    found = _texts(value, "answer")
    if not found or not all(len(x) == 1 and x.isalpha() for x in found):
        raise ValueError("answer is not a list of single letters")
    return found


@schema("pair")
def pair_answer(value: object) -> list[str]:
    """{before_answer: letter, after_answer: letter}."""
    found = [value.get(k) if isinstance(value, dict) else None for k in ("before_answer", "after_answer")]
    if not all(isinstance(x, str) and len(x) == 1 and x.isalpha() for x in found):
        raise ValueError("before_answer and after_answer are not single letters")
    return found


@schema("expressions")
def expressions_answer(value: object) -> list[str]:
    """{expressions: [Python expressions]}."""
    found = _texts(value, "expressions")
    for x in found:
        try:
            ast.parse(x.strip(), mode="eval")
        except (SyntaxError, ValueError) as e:
            raise ValueError(f"not an expression: {x}") from e
    return found


def checked(answer: list[str] | str, kind: str) -> list[str]:
    """An answer that has its schema's form. JSON text is parsed; a list counts as the choice form's list."""
    value = json.loads(answer) if isinstance(answer, str) else {"answer": answer}
    return SCHEMAS[kind](value)

ANSWERS = "predictions array<array<string>>, completion_tokens bigint, prompt_tokens bigint, total_tokens bigint, error string"


@dataclass(frozen=True)
class Task:
    """A kind of question: its text, the score of its answers, and whether its context depends on the agent."""

    name: str
    question: str
    score: str = "multiple_choice"
    per_agent: bool = False
    schema: str = "choice"


TASKS: dict[str, Task] = {}


def register(task: Task) -> Task:
    TASKS[task.name] = task
    return task


register(Task("e2e_effect", "What happens when the test runs before and after the change?", "ordered_pair", True, "pair"))
register(Task("e2e_intent", "Which expression does the test mask?"))
register(Task("local_effect", "Which expressions change their value at this line?", per_agent=True))
register(Task("local_intent", "Which expressions should change their value at this line?"))


def prompts(task: Task, contexts: DataFrame, explanations: DataFrame, on: list[str], fields: list[str], choices: str | None = "choices") -> DataFrame:
    """on, prompt: the question with context, explanation and labelled choices."""
    joined = joins.with_explanation(contexts, explanations, on)
    parts: dict[str, Column] = {"explanation": F.col("explanation")} | {f: F.col(f) for f in fields}
    if choices:
        parts["choices"] = text.labelled_choices(F.col(choices))
    return joined.select(*on, text.prompt(task.question, text.context_block(parts)).alias("prompt"))


def answered(asked: DataFrame, provider: Provider, model: str, n: int = 5, tries: int = 5, wait: float = 1.0, schema: str | None = None) -> DataFrame:
    """asked with the provider's answers. A call is tried again with doubled waits; the last error is kept in its row.

    schema: the form that every answer of a call must have. A call with another is tried again
    for the answers it lacks, and its tokens count; if none is right in the end, the row has what was right, and the error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for prompt in frame["prompt"]:
                right, spent, error = [], [0, 0], None
                for k in range(tries):
                    try:
                        answers, *tokens = provider(model, prompt, n - len(right) if schema else n)
                        spent = [a + b for a, b in zip(spent, tokens, strict=True)]
                        error = None
                        for a in answers:
                            try:
                                right.append(checked(a, schema) if schema else a)
                            except ValueError as e:
                                error = f"{type(e).__name__}: {e}"
                    except Exception as e:  # noqa: BLE001  any failure of an outside service
                        error = f"{type(e).__name__}: {e}"
                    if error is None:
                        break
                    time.sleep(wait * 2**k if k + 1 < tries else 0)
                rows.append((right, *spent, sum(spent), error))
            yield frame.assign(**dict(zip(("predictions", "completion_tokens", "prompt_tokens", "total_tokens", "error"), map(list, zip(*rows, strict=True)) if rows else [[]] * 5, strict=True)))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields)
    return asked.mapInPandas(run, f"{kinds}, {ANSWERS}")


def generate(asked: DataFrame, provider: Provider, model: str, on: list[str], n: int = 5, order: list[str] | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """Predictions (on, predictions) and token usage. Answers that aren't valid are left out of the predictions.

    order: predictions also have position, their prompt's place in this order, as a list of
    prompts would keep it. Prompts are asked in parallel all the same. Answers are written once,
    so that predictions and usage are of the same calls.
    """
    rows = ordering.with_position(asked, *order) if order else asked
    done = stored(answered(rows, provider, model, n, **how), "answers")
    valid = F.col("predictions") if how.get("schema") else F.filter("predictions", scores.valid_choice)
    tokens = done.select(F.lit(model).alias("model"), "completion_tokens", "prompt_tokens", "total_tokens")
    return done.select(*(["position"] if order else []), *on, valid.alias("predictions")), tokens


def evaluate(task: Task, predictions: DataFrame, truths: DataFrame, on: list[str], by: list[str] | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Scores of every trial, and their statistics."""
    found = scoring.score_trials(scoring.trials(predictions), truths, on, task.score, strict)
    return found, scoring.statistics(found, by, strict)


def build_questions(validated: DataFrame, agents: str = "agent", instance: str = "instance_id", effect: bool = True, seed: int = 42) -> DataFrame:
    """Choices and answers of the instances that every agent has enough options for."""
    ok = F.col("is_fallback_to_gold") | scores.enough_options(F.lit(None).cast("array<string>"), F.col("valid_changed_expressions"), F.col("valid_unchanged_expressions"))
    common = joins.in_every_group(validated, instance, agents)
    rows = joins.all_pass(validated.join(common, instance, "left_semi"), instance, ok)
    q = selection.assemble(F.col("valid_changed_expressions"), F.col("valid_unchanged_expressions"), F.col("is_fallback_to_gold"), seed, agents, instance, effect=effect)
    return rows.withColumn("_q", q).select(agents, instance, "_q.choices", "_q.answer")


def candidates(divergences: DataFrame, expressions: DataFrame, on: list[str], n_changed: int = 10) -> DataFrame:
    """Divergences with the expressions that a model gave, split into those meant to change and those not."""
    joined = divergences.where(F.col("status") == "ok").join(expressions, on)
    changed, same = joins.split_at(F.col("expressions"), n_changed)
    return joined.withColumn("changed_candidates", changed).withColumn("unchanged_candidates", same).drop("expressions", "status", "diff_kind")


def validated(found: DataFrame, inspections: DataFrame, on: list[str]) -> DataFrame:
    """Candidates with the expressions that did and didn't change when they were evaluated. inspections: both sides, canonical values."""
    changes = joins.change_map(F.col("buggy_expr"), F.col("buggy_value"), F.col("buggy_exception"), F.col("patched_value"), F.col("patched_exception"))
    mapped = inspections.select(*on, changes.alias("_m"))
    changed, same = joins.split_map(F.coalesce("_m", F.create_map().cast("map<string, boolean>")))
    return found.join(mapped, on, "left").withColumn("valid_changed_expressions", changed).withColumn("valid_unchanged_expressions", same).drop("_m")
