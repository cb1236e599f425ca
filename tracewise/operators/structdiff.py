"""Filters over structural differences: rows of DIFFS with the columns of their event."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewise.functions import paths
from tracewise.functions.values import diff_entries
from tracewise.operators.selection import hash_order


def diffs(pairs: DataFrame, old: str, new: str, keep: list[str], digits: int = 3) -> DataFrame:
    """One row per difference of two serialised values."""
    return pairs.select(*keep, F.explode(diff_entries(F.col(old), F.col(new), digits=digits)).alias("d")).select(*keep, "d.*")


def keep_entries(df: DataFrame, keep: Callable[[Column, Column, Column, Column], Column]) -> DataFrame:
    """Entries for which keep(kind, path, old_value, new_value) is true. Entries without a path belong to kinds that hold no entries, and go."""
    return df.where(F.col("path").isNotNull() & F.coalesce(keep(*(F.col(c) for c in ("kind", "path", "old_value", "new_value"))), F.lit(False)))


def _keys() -> Column:
    return paths.keys(F.col("path"))


def shallow(threshold: int) -> Column:
    return paths.depth(F.col("path")) <= threshold


def unseen_additions(seen: str = "seen_variables") -> Column:
    """Added items only of variables that weren't seen before."""
    var = paths.variable(F.col("path"))
    known = F.coalesce(F.json_object_keys(F.col(seen)), F.array().cast("array<string>"))
    return (F.col("kind") != "dictionary_item_added") | ((var != "") & ~F.array_contains(known, var))


def not_cached() -> Column:
    return ~F.exists(_keys(), lambda k: k.contains("cache"))


def first_key_not(*names: str) -> Column:
    return ~F.coalesce(F.get(_keys(), F.lit(0)).isin(*names), F.lit(False))


def no_ignored_key(names: list[str] | None = None) -> Column:
    return ~F.arrays_overlap(_keys(), F.array(*map(F.lit, names or paths.IGNORED_KEYS)))


def on_this_line(used: str = "vars_used", defined: str = "vars_defined") -> Column:
    """Variables used or defined on the line; all of them if the line names none."""
    names = F.array_union(used, defined)
    return (F.size(names) == 0) | F.array_contains(names, paths.variable(F.col("path")))


def used_here(used: str = "vars_used") -> Column:
    """Variables used on the line; none if it uses none."""
    return F.array_contains(used, paths.variable(F.col("path")))


def not_docstring(words: int = 3) -> Column:
    """Changed texts only if both are short; other changes all."""

    def long(v: str) -> Column:
        return F.size(F.split(F.trim(F.regexp_replace(v, '^"|"$', "")), r"\s+")) > words

    texts = (F.col("old_type") == "str") & (F.col("new_type") == "str")
    return ~F.coalesce((F.col("kind") == "values_changed") & texts & (long("old_value") | long("new_value")), F.lit(False))


def not_hash() -> Column:
    return F.coalesce(paths.attribute(F.col("path")) != "_hash", F.lit(True))


def only_type_changes(df: DataFrame, event: list[str]) -> DataFrame:
    """Where an event has several differences and one is of type, only those."""
    w = Window.partitionBy(*event)
    marked = df.withColumn("_n", F.count("*").over(w)).withColumn("_t", F.bool_or(F.col("kind") == "type_changes").over(w))
    return marked.where((F.col("_n") <= 1) | ~F.col("_t") | (F.col("kind") == "type_changes")).drop("_n", "_t")


def cascade(df: DataFrame, event: list[str], stages: list[Callable[[], Column]]) -> DataFrame:
    """Filters one after the other until an event has one difference at most.

    An entry survives to the first filter it fails; an event stops at the first stage that
    leaves it one entry or none. No stage is a pass of its own over the data.
    """
    fails = F.coalesce(*(F.when(~F.coalesce(s(), F.lit(False)), F.lit(k)) for k, s in enumerate(stages)), F.lit(len(stages)))
    w = Window.partitionBy(*event)
    left = [F.sum((F.col("_fails") >= k).cast("int")).over(w) for k in range(len(stages) + 1)]
    stop = reduce(lambda out, k: F.when(left[k] <= 1, k).otherwise(out), reversed(range(len(stages) + 1)), F.lit(len(stages)))
    return df.withColumn("_fails", fails).withColumn("_stop", stop).where(F.col("_fails") >= F.col("_stop")).drop("_fails", "_stop")


def shallowest(df: DataFrame, event: list[str], seed: int = 42) -> DataFrame:
    """One difference per event: of least depth, and among those the first by a hash of seed and path."""
    w = Window.partitionBy(*event).orderBy(paths.depth(F.col("path")), hash_order(seed, "path"), "path")
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def change_count(df: DataFrame, event: list[str]) -> DataFrame:
    return df.groupBy(*event).agg(F.count("*").alias("n_changes"))


def variable_view(seen: Column, name: Column) -> Column:
    """The value of one variable in a serialised object, as JSON; null if it isn't there."""
    return F.get(F.map_values(F.map_filter(F.from_json(seen, "map<string, string>"), lambda k, v: k == name)), F.lit(0))


def view_of(event_type: Column, seen: Column, variables: Column, return_value: Column, exception_type: Column, exception_value: Column) -> Column:
    """What an event shows of a difference, by name: on a line the variables that differ, as far as they were seen; else the exception's type and text, or the value that came back, or both."""
    lines = F.map_filter(F.from_json(seen, "map<string, string>"), lambda k, v: F.array_contains(variables, k))
    raised = F.to_json(F.array(exception_type, exception_value), {"ignoreNullFields": "false"})
    only_raised, only_back = F.create_map(F.lit("__exception__"), raised), F.create_map(F.lit("__return__"), return_value)
    other = F.when(exception_type.isNull(), only_back).when(return_value.isNull(), only_raised).otherwise(F.map_concat(only_raised, only_back))
    return F.when(event_type == "Line", lines).otherwise(other)
