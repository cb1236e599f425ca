"""Functions on serialised values (JSON text): canonical form, structural diff, pruning. Arrow-batched."""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# Fields whose sequences count as unordered, for every repository and for some.
UNORDERED = {"": ["vars_used", "vars_defined"], "astropy": ["attr_names", "frame_names", "unit", "_all_units"], "django": ["_property_names"]}
#: Whole numbers wider than this many bits become text when a parser would take them for infinity.
SAFE_BITS = 53


def parse(text: str | None):
    """JSON text as a value. Numbers that are infinite as doubles, and wide whole numbers then, become text."""
    if text is None:
        return None
    value = json.loads(text)
    return _without_wide(value) if _has_infinity(value) else value


def _has_infinity(v) -> bool:
    if isinstance(v, float):
        return v in (float("inf"), float("-inf"))
    if isinstance(v, int):
        return v.bit_length() > 1024
    return any(map(_has_infinity, v.values() if isinstance(v, dict) else v)) if isinstance(v, dict | list) else False


def _without_wide(v):
    if isinstance(v, dict):
        return {k: _without_wide(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_without_wide(x) for x in v]
    wide = isinstance(v, int) and not isinstance(v, bool) and v.bit_length() > SAFE_BITS
    return str(v) if wide or isinstance(v, float) and abs(v) == float("inf") else v


def kind_of(v) -> str:
    return {dict: "dict", list: "list", str: "str", bool: "bool", int: "int", float: "float", type(None): "NoneType"}[type(v)]


def rounded(v, digits: int):
    """v with numbers rounded and keys sorted."""
    if isinstance(v, dict):
        return {k: rounded(v[k], digits) for k in sorted(v)}
    if isinstance(v, list):
        return [rounded(x, digits) for x in v]
    return round(v, digits) + 0.0 if isinstance(v, float) else v


def dump(v) -> str:
    return json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


def flat(v, path: str = "root") -> Iterator[tuple[str, object]]:
    """Leaves of a value with their paths; empty containers are leaves."""
    if isinstance(v, dict) and v:
        for k, x in v.items():
            yield from flat(x, f"{path}['{k}']")
    elif isinstance(v, list) and v:
        for k, x in enumerate(v):
            yield from flat(x, f"{path}[{k}]")
    else:
        yield path, v


def difference(a, b, path: str = "root", unordered: frozenset[str] = frozenset(), field: str = "") -> Iterator[tuple[str, str, object, object]]:
    """(kind, path, old, new) of two canonical values, topmost differences only.

    Types are those of JSON: a whole number and a decimal one differ in type. Lists of plain
    values are aligned by their longest matching blocks, so that an insertion is one added
    item; they are compared place by place where that gives no more differences, and so are
    lists that hold containers. The lists of unordered fields, nested ones included, are sets:
    items without an equal one are removed or added, at their place in their list.
    """
    if type(a) is not type(b):
        yield "type_changes", path, a, b
    elif isinstance(a, dict):
        for k in a:
            if k in b:
                yield from difference(a[k], b[k], f"{path}['{k}']", unordered, k)
            else:
                yield "dictionary_item_removed", f"{path}['{k}']", a[k], None
        for k in b:
            if k not in a:
                yield "dictionary_item_added", f"{path}['{k}']", None, b[k]
    elif isinstance(a, list):
        if field in unordered:
            yield from _as_sets(a, b, path)
            return
        by_place = list(_paired(a, b, path, unordered, field))
        plain = not any(isinstance(x, dict | list) for x in (*a, *b))
        aligned = list(_aligned(a, b, path)) if plain and len(by_place) > 1 else by_place
        yield from aligned if len(aligned) < len(by_place) else by_place
    elif a != b:
        yield "values_changed", path, a, b


def _paired(a: list, b: list, path: str, unordered: frozenset[str] = frozenset(), field: str = "", i: int = 0, j: int = 0) -> Iterator[tuple]:
    """Items with the same place, counted from i and j; then what one list has beyond the other."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        yield from difference(x, y, f"{path}[{i + k}]", unordered, field)
    for k in range(len(b), len(a)):
        yield "iterable_item_removed", f"{path}[{i + k}]", a[k], None
    for k in range(len(a), len(b)):
        yield "iterable_item_added", f"{path}[{j + k}]", None, b[k]


def _aligned(a: list, b: list, path: str) -> Iterator[tuple]:
    """Differences between the matching blocks of two lists of plain values."""
    x, y = ([(kind_of(v), v) for v in items] for items in (a, b))
    for kind, i, i_end, j, j_end in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if kind != "equal":
            yield from _paired(a[i:i_end], b[j:j_end], path, i=i, j=j)


def _as_sets(a: list, b: list, path: str) -> Iterator[tuple]:
    """Items of one list that the other lacks; repetitions don't count."""
    x, y = ({dump(v): (k, v) for k, v in reversed([*enumerate(items)])} for items in (a, b))
    for k, v in sorted((x[d] for d in x.keys() - y.keys()), key=lambda i: i[0]):
        yield "iterable_item_removed", f"{path}[{k}]", v, None
    for k, v in sorted((y[d] for d in y.keys() - x.keys()), key=lambda i: i[0]):
        yield "iterable_item_added", f"{path}[{k}]", None, v


def unordered_fields(repo: str) -> frozenset[str]:
    return frozenset(UNORDERED[""] + UNORDERED.get(repo, []))


def pruned(v, depth: int):
    """v with the containers deeper than depth, its own being 0, replaced by stubs."""
    if not isinstance(v, dict | list):
        return v
    if depth < 0:
        return stub(v)
    return {k: pruned(x, depth - 1) for k, x in v.items()} if isinstance(v, dict) else [pruned(x, depth - 1) for x in v]


# The names in stubs that stand for containers.
def stub(v: dict | list) -> dict:
    """What stands for a container that is cut off: its class, with the names or the number of what it holds."""
    if isinstance(v, list):
        return {"py/object": "builtins.list", "len": len(v)}
    names = [k for k in v if not k.startswith("py/")]
    if names and "py/object" in v:
        return {"py/object": v["py/object"], "__dir__": names}
    return v if names and "py/type" in v else {"py/object": "builtins.dict"}


def _mapped(f, text: pd.Series) -> pd.Series:
    def safe(t):
        try:
            return f(t)
        except ValueError:
            return None

    return pd.Series([None if t is None else safe(t) for t in text], dtype=object)


def canonical(value: Column, digits: int = 5) -> Column:
    """One text for equal values: numbers to so many decimals, keys sorted. Null for what isn't JSON."""

    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return _mapped(lambda t: dump(rounded(parse(t), digits)), text)

    return run(value)


def same_value(a: Column, b: Column, digits: int = 5) -> Column:
    return canonical(a, digits).eqNullSafe(canonical(b, digits))


def diff_entries(old: Column, new: Column, repo: Column | None = None, digits: int = 3) -> Column:
    """Differences of two serialised values as array<struct<kind, path, old_value, new_value, old_type, new_type>>; none if either isn't JSON."""
    kind = "array<struct<kind: string, path: string, old_value: string, new_value: string, old_type: string, new_type: string>>"

    @pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series, r: pd.Series) -> pd.Series:
        def one(x, y, name):
            try:
                fields = unordered_fields(name or "")
                found = difference(rounded(parse(x), digits), rounded(parse(y), digits), unordered=fields)
                return [{"kind": k, "path": p, "old_value": None if "added" in k else dump(o), "new_value": None if "removed" in k else dump(n), "old_type": kind_of(o), "new_type": kind_of(n)} for k, p, o, n in found]
            except ValueError:
                return []

        return pd.Series([one(x, y, name) for x, y, name in zip(a, b, r, strict=True)], dtype=object)

    return run(old, new, F.lit("") if repo is None else repo)


def simplified(value: Column, depth: int) -> Column:
    """Serialised value pruned to a depth."""

    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return _mapped(lambda t: dump(pruned(parse(t), depth)), text)

    return run(value)


def printed(value: Column) -> Column:
    """Serialised value as Python prints it, with the line end. Null for what isn't JSON."""

    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return _mapped(lambda t: f"{parse(t)}\n", text)

    return run(value)


def sanitised(value: Column) -> Column:
    """Serialised value whose infinite numbers and, then, wide whole numbers are text."""

    @pandas_udf("string")
    def run(text: pd.Series) -> pd.Series:
        return _mapped(lambda t: dump(parse(t)), text)

    return run(value)
