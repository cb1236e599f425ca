"""Functions on Python source text, by its syntax tree. Arrow-batched."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

FUNCTIONS = ast.FunctionDef | ast.AsyncFunctionDef


def _tree(text: str) -> ast.Module | None:
    try:
        return ast.parse(text)
    except (SyntaxError, ValueError):
        return None


def _first_line(node: ast.AST) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", []))])


def definitions(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, qualified name) of functions, classes and lambdas, decorators included."""
    out: list[tuple[int, int, str]] = []

    def visit(node: ast.AST, prefix: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, FUNCTIONS | ast.ClassDef):
                name = prefix + child.name
                out.append((_first_line(child), child.end_lineno, name))
                visit(child, name + ("." if isinstance(child, ast.ClassDef) else ".<locals>."))
            elif isinstance(child, ast.Lambda):
                name = prefix + "<lambda>"
                out.append((child.lineno, child.end_lineno, name))
                visit(child, name + ".<locals>.")
            else:
                visit(child, prefix)

    if (tree := _tree(text)) is not None:
        visit(tree, "")
    return sorted(out)


def functions(text: str) -> list[tuple[int, int, str, str]]:
    """(first line, last line, qualified name, code) of functions."""
    lines = text.split("\n")
    tree = _tree(text)
    named = {(_first_line(n), n.end_lineno) for n in ast.walk(tree) if isinstance(n, FUNCTIONS)} if tree else set()
    return [(a, b, q, "\n".join(lines[a - 1 : b])) for a, b, q in definitions(text) if (a, b) in named and not q.endswith("<lambda>")]


def find_function(text: str, name: str, hint: str | None = None) -> str | None:
    """Code of the function with that simple or qualified name: the first that contains the hint, else the first."""
    found = [(q, code) for _, _, q, code in functions(text) if q == name or q.replace(".<locals>", "").endswith("." + name) or q.rpartition(".")[2] == name]
    exact = [f for f in found if f[0] == name] or found
    hinted = [f for f in exact if hint and hint.strip() in f[1]]
    return (hinted or exact or [(None, None)])[0][1]


def without_docstrings(text: str) -> str:
    """Source without the docstrings of its functions; the text as it is if it doesn't parse."""
    tree = _tree(text)
    if tree is None:
        return text
    for node in ast.walk(tree):
        if isinstance(node, FUNCTIONS) and ast.get_docstring(node, clean=False) is not None:
            node.body = node.body[1:] or [ast.Pass()]
    return ast.unparse(ast.fix_missing_locations(tree))


def _is_main_guard(node: ast.stmt) -> bool:
    if not isinstance(node, ast.If) or not isinstance(node.test, ast.Compare) or len(node.test.comparators) != 1:
        return False
    sides = [node.test.left, node.test.comparators[0]]
    return any(isinstance(s, ast.Name) and s.id == "__name__" for s in sides) and any(isinstance(s, ast.Constant) and s.value == "__main__" for s in sides)


def runnable_properties(text: str) -> str:
    """Source without main guards, and with a call of each top-level function decorated with @given at its end."""
    tree = _tree(text)
    if tree is None:
        return text

    def given(node: ast.stmt) -> bool:
        names = [d.func if isinstance(d, ast.Call) else d for d in getattr(node, "decorator_list", [])]
        return isinstance(node, FUNCTIONS) and any(getattr(n, "id", getattr(n, "attr", "")) == "given" for n in names)

    body = [n for n in tree.body if not _is_main_guard(n)]
    calls = [ast.parse(f"{n.name}()").body[0] for n in body if given(n)]
    tree.body = body + calls
    return ast.unparse(ast.fix_missing_locations(tree))


def is_expression(text: str) -> bool:
    """One expression that is more than a constant."""
    try:
        return not isinstance(ast.parse(text.strip(), mode="eval").body, ast.Constant)
    except (SyntaxError, ValueError):
        return False


def column(f, returns: str):
    """f on one text as a column function; null stays null."""

    def of(text: Column, *more: Column) -> Column:
        if more:

            @pandas_udf(returns)
            def two(t: pd.Series, u: pd.Series) -> pd.Series:
                return pd.Series([None if x is None else f(x, y) for x, y in zip(t, u, strict=True)], dtype=object)

            return two(text, *more)

        @pandas_udf(returns)
        def one(t: pd.Series) -> pd.Series:
            return pd.Series([None if x is None else f(x) for x in t], dtype=object)

        return one(text)

    return of


def_ranges = column(lambda t: [{"start": a, "end": b, "qualname": q} for a, b, q in definitions(t)], "array<struct<start: int, end: int, qualname: string>>")
function_table = column(lambda t: [{"start": a, "end": b, "qualname": q, "code": c} for a, b, q, c in functions(t)], "array<struct<start: int, end: int, qualname: string, code: string>>")
function_code = column(find_function, "string")
docstrings_removed = column(without_docstrings, "string")
properties_called = column(runnable_properties, "string")
valid_expression = column(is_expression, "boolean")
