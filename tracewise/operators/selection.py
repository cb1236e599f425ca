"""Ranking, sampling and selection of answer options."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions.text import LETTERS, best_similarity, letter, mean_similarity, similarity


# The two options that every question may have.
NONE = "The patch has no effect and none of the above expressions change in value"
UNKNOWN = "Cannot be answered by the explanation alone"


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def hash_order(seed: int, *keys: Column | str) -> Column:
    """A digest of seed and keys as text, apart by a separator: an order that other engines can repeat. Null keys are empty."""
    own = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *(F.coalesce(k.cast("string"), F.lit("")) for k in own)))


def hard_anchors(pool: DataFrame, by: list[str], item: str, others: DataFrame, k: int) -> DataFrame:
    """The k items of each key most similar on average to the other pool; ties in input order (column pos)."""
    lists = others.groupBy(*by).agg(F.collect_list(item).alias("_others"))
    scored = pool.join(lists, by, "left").withColumn("relevance", mean_similarity(F.col(item), F.coalesce("_others", F.array().cast("array<string>"))))
    w = Window.partitionBy(*by).orderBy(F.desc("relevance"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_others")


def diverse(pool: Column, anchors: Column, k: int, weight: float = 0.7) -> Column:
    """k items of a pool, one at a time: weight x best similarity to the anchors less the rest x best similarity to those chosen; the first wins ties."""
    empty = F.array().cast("array<string>")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        ranked = F.transform(rest, lambda s, i: F.struct((F.lit(weight) * s["near"] - F.lit(1 - weight) * best_similarity(s["x"], state["chosen"])).alias("w"), (-i).alias("i")))
        taken = bound(-F.array_max(ranked)["i"], lambda at: F.struct(F.concat(state["chosen"], F.array(F.get(rest, at)["x"])).alias("chosen"), F.filter(rest, lambda s, i: i != at).alias("rest")))
        return F.when(F.size(rest) > 0, taken).otherwise(state)

    start = F.struct(empty.alias("chosen"), bound(anchors, lambda a: F.transform(pool, lambda x: F.struct(x.alias("x"), best_similarity(x, a).alias("near")))).alias("rest"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(k)), start, step, lambda s: s["chosen"]) if k else empty


def sampled(pool: Column, k: int, seed: int, *keys: Column | str) -> Column:
    """k items at most without replacement, by a hash of seed, keys and item."""
    order = F.array_sort(F.transform(pool, lambda x, i: F.struct(hash_order(seed, *keys, x, i).alias("h"), i.alias("i"), x.alias("x"))))
    return F.transform(F.slice(order, 1, k), lambda s: s["x"])


def sample_rows(df: DataFrame, by: list[str], item: str, k: int, seed: int = 42) -> DataFrame:
    """k rows at most of each key, by a hash of seed, key and item."""
    w = Window.partitionBy(*by).orderBy(hash_order(seed, *by, item), item)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def minus(pool: Column, taken: Column) -> Column:
    """A list without the items taken; order and repeats of the rest stay."""
    return F.filter(pool, lambda x: ~F.array_contains(taken, x))


def assemble(correct: Column, incorrect: Column, fallback: Column, seed: int, *keys: Column | str, n_correct: int = 1, n_incorrect: int = 3, effect: bool = True, none: str = NONE, unknown: str = UNKNOWN) -> Column:
    """choices and answer letters of a question.

    A fallback row has no correct option: its pools are merged and every slot is incorrect.
    Correct options are those nearest to the incorrect pool, incorrect ones are diverse and
    near to the correct ones; hash samples fill what is left open. The effect form adds an
    option for none, correct if no other is; the last option is never correct.
    """
    empty = F.array().cast("array<string>")

    def build(right: Column, wrong: Column, a: int, b: int) -> Column:
        def nearest(w: Column) -> Column:
            ranked = F.array_sort(F.transform(right, lambda x, i: F.struct((-mean_similarity(x, w)).alias("s"), i.alias("i"), x.alias("x"))))
            return F.transform(F.slice(ranked, 1, a), lambda s: s["x"]) if a else empty

        def filled(w: Column, others: Column) -> Column:
            return F.concat(others, F.slice(sampled(minus(w, others), b, seed, *keys), F.lit(1), F.lit(b) - F.size(others)))

        def tagged(anchors: Column, others: Column) -> Column:
            return F.concat(F.transform(anchors, lambda x: F.struct(x.alias("x"), F.lit(True).alias("ok"))), F.transform(others, lambda x: F.struct(x.alias("x"), F.lit(False).alias("ok"))))

        def ended(mixed: Column) -> Column:
            tail = [F.struct(F.lit(none).alias("x"), (~F.exists(mixed, lambda s: s["ok"])).alias("ok"))] if effect else []
            return F.concat(mixed, F.array(*tail, F.struct(F.lit(unknown).alias("x"), F.lit(False).alias("ok"))))

        both = bound(wrong, lambda w: bound(nearest(w), lambda n: tagged(n, bound(diverse(w, n, b), lambda o: filled(w, o)))))
        mixed = F.array_sort(F.transform(both, lambda s: F.struct(hash_order(seed + 1, *keys, s["x"]).alias("h"), s["x"].alias("x"), s["ok"].alias("ok"))))
        return bound(F.transform(mixed, lambda s: F.struct(s["x"].alias("x"), s["ok"].alias("ok"))), ended)

    right, wrong = F.coalesce(correct, empty), F.coalesce(incorrect, empty)
    options = F.when(fallback, build(empty, F.concat(wrong, right), 0, n_correct + n_incorrect)).otherwise(build(right, wrong, n_correct, n_incorrect))

    def lettered(options: Column) -> Column:
        letters = F.transform(F.filter(F.transform(options, lambda s, i: F.struct(s["ok"].alias("ok"), i.alias("i"))), lambda s: s["ok"]), lambda s: letter(s["i"]))
        return F.struct(F.transform(options, lambda s: s["x"]).alias("choices"), letters.alias("answer"))

    return bound(options, lettered)


def sorted_letter(choices: Column, truth: Column) -> Column:
    """Letter of the truth among the sorted choices; the empty string if it isn't one."""
    at = F.array_position(F.array_sort(choices), truth).cast("int")
    return F.when(at > 0, F.substring(F.lit(LETTERS), at, F.lit(1))).otherwise("")


def expanded(seed: Column, extra: Column, unknown: str, k: int = 4) -> Column:
    """Seed options and new extra ones, the first k of them, and a sentinel; null if there are fewer than k."""
    joined = F.concat(seed, F.array_except(extra, seed))
    return F.when(F.size(F.array_union(seed, extra)) >= k, F.concat(F.slice(joined, 1, k), F.array(F.lit(unknown))))
