"""Unified diffs as rows, and what they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewise.functions.source import def_ranges
from tracewise.operators.traces import innermost

# Files that count as tests, by repository owner; paths are matched from their start.
TEST_FILES = {
    "astropy": r"astropy/.*/tests/.*\.py$",
    "django": r"tests/.*\.py$",
    "matplotlib": r"(lib/matplotlib/tests/.*\.py)|(lib/mpl_toolkits/tests/.*\.py)$",
    "pallets": r"tests/.*\.py$",
    "psf": r"tests/.*\.py$",
    "pydata": r"xarray/tests/.*\.py$",
    "pylint-dev": r"tests/.*\.py$",
    "pytest-dev": r"testing/.*\.py$",
    "scikit-learn": r"sklearn/.*/tests/.*\.py$",
    "sphinx-doc": r"tests/.*\.py$",
    "sympy": r"sympy/.*/tests/.*\.py$",
}

# How the unified format marks the start of a file's part and of a hunk.
FILE_START = "diff --git "
HUNK_START = r"(?m)^(?=@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@)"


def _rest(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a))


def patch_rows(patch: Column) -> Column:
    """Distinct lines removed from old files and added to new ones, sorted, as array<struct<side, path, line>>; none for null.

    A hunk's old text is its lines with a blank or a minus, its new text those with a blank or
    a plus; so a line's place among them, counted from the hunk's start, is its number. Other
    lines belong to neither. Parts without both file names have no rows.
    """

    def path(head: Column, mark: str, prefix: str) -> Column:
        named = F.get(F.filter(head, lambda x: x.startswith(f"{mark * 3} ")), F.lit(0))
        return F.regexp_replace(F.substring(named, 5, 1 << 30), f"^{prefix}/", "")

    def side(name: str, sign: str, hunk: Column, file: Column) -> Column:
        start = F.regexp_extract(hunk, rf"[{sign}](\d+)", 1).cast("int")
        own = F.filter(_rest(F.split(hunk, "\n")), lambda x: x.startswith(" ") | x.startswith(sign))
        numbered = F.transform(own, lambda x, i: F.when(x.startswith(sign), F.struct(F.lit(name).alias("side"), file.alias("path"), (start + i).alias("line"))))
        return F.filter(numbered, lambda x: x.isNotNull())

    def of_file(part: Column) -> Column:
        pieces = F.split(part, HUNK_START)
        head = F.split(F.get(pieces, F.lit(0)), "\n")
        old, new = path(head, "-", "a"), path(head, "+", "b")
        rows = F.flatten(F.transform(_rest(pieces), lambda h: F.concat(side("removed", "-", h, old), side("added", "+", h, new))))
        return F.filter(rows, lambda x: old.isNotNull() & new.isNotNull())

    found = F.flatten(F.transform(_rest(F.split(patch, FILE_START)), of_file))
    return F.array_sort(F.array_distinct(F.coalesce(found, F.array().cast("array<struct<side: string, path: string, line: int>>"))))


def patch_lines(patches: DataFrame, keep: list[str], patch: str = "model_patch") -> DataFrame:
    return patches.select(*keep, F.explode(patch_rows(F.col(patch))).alias("l")).select(*keep, "l.*")


def lines_by_file(lines: DataFrame, keep: list[str]) -> DataFrame:
    """Sorted distinct lines of each file and side."""
    return lines.groupBy(*keep, "side", "path").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def without_tests(lines: DataFrame, instance: str = "instance_id") -> DataFrame:
    """Lines of files that aren't tests by their repository's rule; repositories without a rule pass."""
    rules = F.create_map(*(F.lit(x) for pair in TEST_FILES.items() for x in pair))
    rule = F.try_element_at(rules, F.substring_index(instance, "__", 1))
    return lines.where(rule.isNull() | ~F.call_function("rlike", F.col("path"), F.concat(F.lit("^(?:"), F.coalesce(rule, F.lit("")), F.lit(")"))))


def modified_names(lines: DataFrame, files: DataFrame, keep: list[str], side: str) -> DataFrame:
    """Qualified names of the definitions that own a touched line. files: keep + path, text of that side; only .py files."""
    marks = lines.where((F.col("side") == side) & F.col("path").endswith(".py")).select(*keep, "path", "line").distinct()
    ranges = files.where(F.col("path").endswith(".py")).select(*keep, "path", F.explode(def_ranges(F.col("text"))).alias("d")).select(*keep, "path", "d.*")
    owned = innermost(marks, ranges, [*keep, "path"], "line", "start", "end", ["qualname"])
    return owned.groupBy(*keep).agg(F.array_sort(F.collect_set("qualname")).alias("qualnames"))


def all_names(old: DataFrame, new: DataFrame, keep: list[str]) -> DataFrame:
    """Sorted union of the names of both sides; a side may be missing."""
    both = old.withColumnRenamed("qualnames", "a").join(new.withColumnRenamed("qualnames", "b"), keep, "full")
    empty = F.array().cast("array<string>")
    return both.select(*keep, F.array_sort(F.array_union(F.coalesce("a", empty), F.coalesce("b", empty))).alias("qualnames"))
