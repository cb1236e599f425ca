"""Scoring of answers against truths, and statistics over trials."""

from __future__ import annotations

import signal
from collections.abc import Callable
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tracewise.functions.scores import SCORES, choice_score
from tracewise.functions.text import priced, token_count


# Dollars per million tokens in and out.
PRICES = [
    ("gpt-5.2-2025-12-11", 1.75, 14.00),
    ("gpt-5-mini-2025-08-07", 0.25, 2.00),
    ("gpt-5-nano-2025-08-07", 0.05, 0.40),
]


def price_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRICES, "model string, input_price double, output_price double")


def trials(predictions: DataFrame, answers: str = "predictions") -> DataFrame:
    """A list of answers per instance as one row per trial."""
    keep = [c for c in predictions.columns if c != answers]
    return predictions.select(*keep, F.posexplode(answers).alias("trial", "answer"))


def unmatched(predictions: DataFrame, truths: DataFrame, on: list[str]) -> DataFrame:
    """Predictions without a truth. A strict caller raises if there are any."""
    return predictions.join(truths, on, "left_anti")


def score_trials(predictions: DataFrame, truths: DataFrame, on: list[str], task: str = "multiple_choice", strict: bool = False) -> DataFrame:
    """on, trial, score. Truths without a prediction are ignored; with strict, a prediction without a truth is an error."""
    joined = predictions.join(truths.select(*on, F.col("answer").alias("truth")), on, "left" if strict else "inner")
    if strict:
        joined = joined.withColumn("truth", F.when(F.col("truth").isNull(), F.raise_error(F.lit("prediction without truth")).cast("array<string>")).otherwise(F.col("truth")))
    return joined.select(*on, "trial", SCORES[task](F.col("answer"), F.col("truth")).alias("score"))


def statistics(scores: DataFrame, by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """Mean over trials of the trial means, and their standard error (null for one trial). With strict, trials of different length are an error."""
    by = by or []
    means = scores.groupBy(*by, "trial").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    out = means.groupBy(*by).agg(F.avg("m").alias("mean"), (F.stddev_samp("m") / F.sqrt(F.count("*").cast("double"))).alias("sem"), F.min("n").alias("least"), F.max("n").alias("most"))
    ragged = F.col("least") != F.col("most")
    if strict:
        error = F.raise_error(F.lit("trials of different length")).cast("double")
        out = out.withColumns({c: F.when(ragged, error).otherwise(F.col(c)) for c in ("mean", "sem")})
    return out.where(F.col("least").isNotNull()).select(*by, "mean", "sem", ragged.alias("ragged"))


def usage(tokens: DataFrame, prices: DataFrame) -> DataFrame:
    """Token sums by model, with their cost where the model has a price, and a display text."""
    kinds = ["completion_tokens", "prompt_tokens", "total_tokens"]
    sums = tokens.groupBy("model").agg(*(F.sum(k).alias(k) for k in kinds))
    cost = (F.col("prompt_tokens") * F.col("input_price") + F.col("completion_tokens") * F.col("output_price")) / 1e6
    counters = F.concat_ws(" / ", *(token_count(F.col(k)) for k in kinds))
    return sums.join(prices, "model", "left").select("model", *kinds, cost.alias("cost"), F.coalesce(priced(cost), counters).alias("display"))


@contextmanager
def time_limit(seconds: float):
    """TimeoutError for what takes longer. In the main thread, which a worker's functions run in."""

    def late(signum, frame):
        raise TimeoutError

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def time_limited(scorer: Callable[[list, object], list[float]], predictions: Column, truth: Column, seconds: float = 30.0) -> Column:
    """Scores of a row's predictions by a scorer written in Python; zeros for all of them where it takes longer than the limit.

    For scorers that built-in functions can't express. A worker scores in its main thread, so
    an alarm can stop it there; other errors fail the task.
    """

    @pandas_udf("array<double>")
    def run(predicted: pd.Series, truths: pd.Series) -> pd.Series:
        out = []
        for answers, t in zip(predicted, truths, strict=True):
            answers = [] if answers is None else _plain(answers)
            try:
                with time_limit(seconds):
                    scores = [float(s) for s in scorer(answers, _plain(t))]
            except TimeoutError:
                scores = [0.0] * len(answers)
            out.append(scores)
        return pd.Series(out, dtype=object)

    return run(predictions, truth)


def _plain(value):
    """Lists for the arrays that a batch holds."""
    return [_plain(x) for x in value] if isinstance(value, np.ndarray | list) else value


def set_scores(predicted: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """Scores of two tables that hold one answer list per key."""
    return predicted.join(truth, on).withColumn("score", choice_score(F.col("predicted"), F.col("truth")))
