"""Op 4. Quality rules as weak supervision [native].

Each rule looks at a document's counts and votes good (2), bad (0) or abstains (1). What the
rules are worth is estimated, not set: votes of all documents are counted by pattern (at most
3^rules rows, whatever the input), and expectation-maximisation over those counts gives, per
rule, how often it votes bad on clean and on poor documents, and the share of poor ones. The
posterior probability that a document is clean is then a sum of log ratios, one per vote: one
bad vote of a rule that often errs doesn't reject, several votes of weak rules together may.

Main path: DataFrame functions only. The estimation itself is arithmetic on the pattern
table in the driver.

Cases: null or empty text has no words and fails the base check. Counts go over whole texts;
texts of more than 2^24 words take an ordering of (hash, position) pairs instead of packed
ones. Repeated rows count as often as they occur; ties don't arise. An empty table gives no
rows and needs no estimate. Extra columns pass through score(), whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.llm.shared import let, quoted, store, unboxed, words

SYMBOLS = "[#*$%&|<>]"
#: A word of letters only, with at most one mark after it.
PLAIN = r"(?<!\S)\p{L}+[.,;:?!]?(?!\S)"
#: Position bits in a packed window key.
BITS = 24


def repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more in the array w, first ones included."""
    n = F.size(w)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(p: Column) -> Column:
        return F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2))).cast("bigint")

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("bigint").alias("i"))))
        return let(pairs, lambda s: covered(F.transform(F.filter(s, lambda x, j: F.coalesce(F.get(s, j - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False))), lambda x: x["i"])))

    def packed(h: Column) -> Column:
        low = F.lit((1 << BITS) - 1).cast("bigint")
        keys = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftrightunsigned(x, BITS), BITS).bitwiseOR(i.cast("bigint"))))

        def high(k: Column) -> Column:
            return F.shiftrightunsigned(k, BITS)

        def full(k: Column) -> Column:
            return F.get(h, k.bitwiseAND(low).cast("int"))

        def use(s: Column) -> Column:
            near = F.filter(s, lambda k, j: F.coalesce(high(F.get(s, j - 1)) == high(k), F.lit(False)) | F.coalesce(high(F.get(s, j + 1)) == high(k), F.lit(False)))
            return let(near, lambda r: F.when(_mixed(r, high, full), by_pairs(h)).otherwise(covered(F.transform(r, lambda k: k.bitwiseAND(low)))))

        return let(keys, use)

    def _mixed(r: Column, high, full) -> Column:
        """Whether two windows share the packed part of the hash and differ in the rest."""
        return F.exists(F.transform(r, lambda k, j: F.coalesce((high(F.get(r, j + 1)) == high(k)) & (full(F.get(r, j + 1)) != full(k)), F.lit(False))), lambda x: x)

    found = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).when(n < (1 << BITS), packed(h)).otherwise(by_pairs(h)))
    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(found)


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and what the rules use besides."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    return (
        docs.withColumn("_w", of_words)
        .withColumn("_l", of_lines)
        .withColumn("_c", F.struct(F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"), F.regexp_count(whole, F.lit("!")).cast("bigint").alias("n_bangs"), F.regexp_count(whole, F.lit(r"\p{Lu}{3}")).cast("bigint").alias("n_shouts"), F.regexp_count(whole, F.lit(PLAIN)).cast("bigint").alias("n_plain"), F.regexp_count(whole, F.lit(r"[^\p{L}\p{N}\s]{2,}")).cast("bigint").alias("n_runs")))
    )


def _share(a: str, b: str = "_w.n_words") -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def votes() -> dict[str, tuple[Column, Column]]:
    """rule -> (votes bad, votes good); neither is an abstention."""
    n = F.col("_w.n_words")
    mean = _share("_w.word_chars")
    return {
        "symbols": (_share("_c.n_symbols") > 0.2, _share("_c.n_symbols") < 0.1),
        "repeats": (_share("_w.n_repeat_words") > 0.5, _share("_w.n_repeat_words") < 0.3),
        "lines": (_share("_l.n_dup_lines", "_l.n_lines") > 0.5, _share("_l.n_dup_lines", "_l.n_lines") < 0.3),
        "word_length": ((mean > 20) | (mean < 2), (mean < 12) & (mean > 3)),
        "length": (n < 50, n >= 100),
        "plain_words": (_share("_c.n_plain") < 0.7, _share("_c.n_plain") > 0.85),
        "mark_runs": (_share("_c.n_runs") > 0.2, _share("_c.n_runs") < 0.05),
        "bangs": (_share("_c.n_bangs") > 0.3, _share("_c.n_bangs") < 0.1),
        "shouting": (_share("_c.n_shouts") > 0.4, _share("_c.n_shouts") < 0.1),
        "any_symbols": (F.col("_c.n_symbols") > 0, F.col("_c.n_symbols") == 0),
        "short_lines": (n < 8 * F.col("_l.n_lines"), n >= 15 * F.col("_l.n_lines")),
    }


def with_pattern(counted: DataFrame) -> DataFrame:
    """Adds pattern: the votes as digits of a number to base 3."""
    pattern = F.lit(0)
    for k, (bad, good) in enumerate(votes().values()):
        pattern = pattern + F.when(bad, 0).when(good, 2).otherwise(1) * 3**k
    return counted.withColumn("_pattern", pattern.cast("int"))


def estimate(patterns: dict[int, int], rules: int, rounds: int = 200, strength: float = 0.002) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of clean, and per rule the log ratios of a good and of a bad vote.

    Starts from each document's share of good votes, so the classes have the names that the
    majority of votes gives them, and goes back and forth between posteriors and rates. Nothing
    is held: the prior (a tenth poor; rules vote bad on 5 % of clean and half of poor documents)
    counts as much as `strength` of the documents do, and data overcome it.
    """
    total = sum(patterns.values())
    if not total:
        return math.log(9), [(math.log(0.95 / 0.5), math.log(0.05 / 0.5))] * rules
    votes = np.array([[p // 3**k % 3 for k in range(rules)] for p in patterns])
    n = np.array(list(patterns.values()), float)
    bad, good = (votes == 0).astype(float), (votes == 2).astype(float)
    weight = max(1.0, strength * total)
    clean = (good.sum(1) + 1) / (good.sum(1) + bad.sum(1) + 2)
    for _ in range(rounds):
        shares = np.stack([n * clean, n * (1 - clean)])
        mass = shares.sum(1) + weight * np.array([0.9, 0.1])
        rates = (shares @ bad + weight * np.array([[0.05], [0.5]])) / (shares @ (bad + good) + weight)
        base, at_good, at_bad = math.log(mass[0] / mass[1]), np.log((1 - rates[0]) / (1 - rates[1])), np.log(rates[0] / rates[1])
        clean = 1 / (1 + np.exp(-np.clip(base + good @ at_good + bad @ at_bad, -60, 60)))
    return base, list(zip(at_good.tolist(), at_bad.tolist(), strict=True))


def verdict(base: float, ratios: list[tuple[float, float]]) -> Column:
    """Posterior probability that a document is clean, from its pattern."""
    odds = F.lit(base)
    for k, (good, bad) in enumerate(ratios):
        digit = F.pmod(F.floor(F.col("_pattern") / 3**k), F.lit(3))
        odds = odds + F.when(digit == 2, good).when(digit == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def failed() -> Column:
    return (F.col("_w.n_words") < 50) | (100 * F.col("_w.n_repeat_words") > 50 * F.col("_w.n_words"))


def score(docs: DataFrame, threshold: float = 0.5, keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns in keep (all of docs by default), the counts, base_failed, clean (a probability) and kept.

    Counts are written once and read twice: for the patterns of all documents, and for the
    verdicts. An input column with the name of one of these is replaced.
    """
    keep = list(docs.columns if keep is None else keep)
    own = docs.select(F.struct(*(F.col(quoted(c)) for c in keep)).alias("row"), "text")
    counted = store(with_pattern(counts(own)).select("row", "_w", "_l", "_c", "_pattern"), "votes")
    patterns = {r["_pattern"]: r["n"] for r in counted.groupBy("_pattern").agg(F.count("*").alias("n")).collect()}
    clean = verdict(*estimate(patterns, len(votes())))
    return unboxed(
        counted,
        keep,
        **{c.split(".")[1]: F.col(c) for c in ("_w.n_words", "_w.word_chars", "_c.n_symbols", "_l.n_dup_lines", "_w.n_repeat_words")},
        base_failed=failed(),
        clean=clean,
        kept=~failed() & (clean >= threshold),
    )
