"""Joins, set operations and comparisons keyed by instance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.scores import changed

EXCEPTION = "struct<stage: string, type: string, message: string>"


def with_explanation(contexts: DataFrame, explanations: DataFrame, on: list[str], default: str = "EMPTY") -> DataFrame:
    """The first explanation of each context, or the default."""
    return contexts.join(explanations, on, "left").withColumn("explanation", F.coalesce(F.get("explanations", F.lit(0)), F.lit(default))).drop("explanations")


def with_fallback(rows: DataFrame, gold: DataFrame, on: list[str], is_empty: Column, columns: list[str]) -> DataFrame:
    """Empty rows take the gold row's columns and are flagged; without a gold row they go."""
    other = gold.select(*on, F.struct(*columns).alias("_gold"))
    joined = rows.withColumn("is_fallback_to_gold", is_empty).join(other, on, "left").where(~F.col("is_fallback_to_gold") | F.col("_gold").isNotNull())
    return joined.withColumns({c: F.when(F.col("is_fallback_to_gold"), F.col(f"_gold.{c}")).otherwise(F.col(c)) for c in columns}).drop("_gold")


def with_patch(tests: DataFrame, patches: DataFrame, on: list[str]) -> DataFrame:
    return tests.join(patches, on, "left").withColumn("model_patch", F.coalesce("model_patch", F.lit("")))


def without_excluded(instances: DataFrame, exclusions: DataFrame, key: str = "instance_id") -> DataFrame:
    return instances.join(exclusions.select(key), key, "left_anti")


def in_every_group(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys that every group has."""
    groups = rows.agg(F.countDistinct(group).alias("all"))
    own = rows.groupBy(key).agg(F.countDistinct(group).alias("n"))
    return own.join(groups, own["n"] == groups["all"]).select(key)


def all_pass(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """Rows whose key passes in every one of its rows."""
    good = rows.groupBy(key).agg(F.bool_and(ok).alias("ok")).where("ok")
    return rows.join(good.select(key), key, "left_semi")


def removal_counts(before: DataFrame, after: DataFrame, group: str) -> DataFrame:
    """How many rows of each group went."""
    a = before.groupBy(group).agg(F.count("*").alias("a"))
    b = after.groupBy(group).agg(F.count("*").alias("b"))
    return a.join(b, group, "left").select(group, (F.col("a") - F.coalesce("b", F.lit(0))).alias("removed"))


def only_new(rows: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose key isn't there yet, for an incremental append."""
    return rows.join(existing.select(*on).distinct(), on, "left_anti")


def as_list(value: Column, n: Column) -> Column:
    """A scalar at every position; null as nulls."""
    return F.when(value.isNotNull(), F.array_repeat(value, n)).otherwise(F.array_repeat(F.lit(None).cast("string"), n))


def zip_longest(**lists: Column) -> Column:
    """Lists side by side, the shorter ones padded with null."""
    return F.arrays_zip(*(c.alias(k) for k, c in lists.items()))


def change_map(expressions: Column, before: Column, before_exception: Column, after: Column, after_exception: Column) -> Column:
    """Expression -> whether it changed, by position; of equal expressions the last counts. Values are canonical texts."""
    rows = zip_longest(e=expressions, bv=before, be=before_exception, av=after, ae=after_exception)
    pairs = F.transform(F.filter(rows, lambda r: r["e"].isNotNull()), lambda r: F.struct(r["e"], changed(r["bv"], r["be"], r["av"], r["ae"])))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["e"] == p["e"]))
    return F.map_from_entries(last)


def split_map(changes: Column) -> tuple[Column, Column]:
    """Keys that changed, and keys that didn't."""
    return F.map_keys(F.map_filter(changes, lambda k, v: v)), F.map_keys(F.map_filter(changes, lambda k, v: ~v))


def split_at(items: Column, n: int) -> tuple[Column, Column]:
    return F.slice(items, 1, n), F.slice(items, F.lit(n + 1), F.greatest(F.size(items) - n, F.lit(0)))


def union_sorted(rows: DataFrame, by: list[str], item: str, name: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.array_sort(F.collect_set(item)).alias(name))


def from_parameters(variables: Column, parameters: Column) -> Column:
    """Variables that are parameters too."""
    return F.array_intersect(variables, parameters)
