"""Column expressions on strings and choice lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz"


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer string, which counts as 1 at least."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def mean_similarity(item: Column, pool: Column) -> Column:
    """Mean similarity to a pool; 0 for an empty pool."""
    total = F.aggregate(pool, F.lit(0.0), lambda t, x: t + similarity(item, x))
    return F.when(F.size(pool) > 0, total / F.size(pool)).otherwise(0.0)


def best_similarity(item: Column, pool: Column) -> Column:
    """Largest similarity to a pool; 0 for an empty pool."""
    return F.coalesce(F.array_max(F.transform(pool, lambda x: similarity(item, x))), F.lit(0.0))


def letter(index: Column) -> Column:
    """Letter of a 0-based position."""
    return F.substring(F.lit(LETTERS), index + 1, F.lit(1))


def labelled_choices(choices: Column, mark: str = ") ") -> Column:
    """`a) first` and so on, one line each; more than 26 choices are an error."""
    lines = F.array_join(F.transform(choices, lambda c, i: F.concat(letter(i), F.lit(mark), c)), "\n")
    return F.when(F.size(choices) > 26, F.raise_error(F.lit("more choices than letters")).cast("string")).otherwise(lines)


def title_case(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def context_block(parts: dict[str, Column]) -> Column:
    """`Title Case Key:` and its value, entries apart by a blank line; entries without a value are left out."""
    return F.concat_ws("\n\n", *(F.when(v.isNotNull(), F.concat(title_case(F.lit(k)), F.lit(":\n"), v)) for k, v in parts.items()))


def prompt(question: Column | str, context: Column, schema: str = "") -> Column:
    """Question, context and the schema that an answer must have."""
    ask = F.lit(question) if isinstance(question, str) else question
    return F.concat_ws("\n\n", ask, context, *([F.lit(schema)] if schema else []))


def probe_prompt(code: Column, line: Column, diff: Column, before: Column, after: Column, changed: int, unchanged: int) -> Column:
    """Asks for expressions whose values do and don't change at a line."""
    wanted = F.format_string(f"Give {changed} expressions that change at this line and {unchanged} that don't.")
    return context_block({"function": code, "line": line, "difference": diff, "variables_before": before, "variables_after": after, "task": wanted})


def collapsed(before: Column, after: Column, first: str = "# Before Patch:\n", second: str = "# After Patch:\n") -> Column:
    """One text if both are the same, else both under their headings."""
    return F.when(before.eqNullSafe(after), before).otherwise(F.concat(F.lit(first), F.coalesce(before, F.lit("")), F.lit("\n\n"), F.lit(second), F.coalesce(after, F.lit(""))))


def statement_block(before: Column, after: Column, before_type: Column, after_type: Column) -> Column:
    """The statement, or those of both sides with what became of them."""

    def tagged(s: Column, kind: Column) -> Column:
        return F.concat(s, F.when(kind == "Exception", " (crashed here)").otherwise(" (normally executed)"))

    return F.when(before.eqNullSafe(after), before).otherwise(collapsed(tagged(before, before_type), tagged(after, after_type)))


def qualified_name(full: Column) -> Column:
    """What follows the first colon; all of it without one."""
    return F.regexp_replace(full, r"^[^:]*:", "")


def simple_name(full: Column) -> Column:
    """The last part of `module:Class.method`."""
    return F.substring_index(F.substring_index(full, ":", -1), ".", -1)


def dotted_module(path: Column) -> Column:
    """`src/pkg/mod.py` as `pkg.mod`; nothing left gives `<unknown_module>`."""
    bare = F.regexp_replace(F.regexp_replace(path, r"\.py$", ""), r"^/*(?:(?:lib|src)/+)?", "")
    dots = F.array_join(F.array_remove(F.split(bare, "/"), ""), ".")
    return F.when(dots == "", "<unknown_module>").otherwise(dots)


def truncated(text: Column, most: int = 20_000, tail: str = " ...(truncated)") -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(tail))).otherwise(text)


def numbered_lines(text: Column) -> Column:
    """`1: first line` and so on."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda line, i: F.concat((i + 1).cast("string"), F.lit(": "), line)), "\n")


def image_name(instance_id: Column) -> Column:
    return F.replace(instance_id, F.lit("__"), F.lit("_1776_"))


def last_match(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the last match; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def token_count(n: Column) -> Column:
    """`1.23Mt`, `4.56Kt` or `7t`."""
    return F.when(n >= 1e6, F.format_string("%.2fMt", n / 1e6)).when(n >= 1e3, F.format_string("%.2fKt", n / 1e3)).otherwise(F.concat(n.cast("bigint").cast("string"), F.lit("t")))


def priced(cost: Column) -> Column:
    return F.format_string("$%.3f", cost)


def joined_or(names: Column, default: str = "none") -> Column:
    """Comma-joined names; the default for null or none."""
    return F.when(F.size(F.coalesce(names, F.array().cast("array<string>"))) > 0, F.array_join(names, ",")).otherwise(default)


def tracer_flags(names: Column, plugin: Column) -> Column:
    """Flag string that a traced test run takes: the plugin and the functions to follow."""
    return F.concat(F.lit("-p "), plugin, F.lit(" --trace-functions="), joined_or(names))
