"""A small rule language compiled to column expressions, and ordered routing.

Comparisons, and, or, not, dotted names, and literals. A missing value makes an ordering comparison
an error, which makes the whole rule false, also under not; equality with a missing value is fine.
Null stands for the error while a rule is evaluated.
"""

from __future__ import annotations

import ast
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_ORDER = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}
_WORDS = {"true": True, "false": False, "null": None, "none": None, "True": True, "False": False, "None": None}


def compile_rule(rule: str, columns: dict[str, Column]) -> Column:
    """A boolean column that is never null. Unknown names are null; calls, private names and chained comparisons are refused."""
    try:
        tree = ast.parse(rule.strip(), mode="eval").body
    except SyntaxError as e:
        raise ValueError(f"not a rule: {rule!r}") from e
    return F.coalesce(_truth(tree, columns), F.lit(False))


def _name(node: ast.AST) -> str:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        if node.attr.startswith("_"):
            raise ValueError("private names are refused")
        return f"{_name(node.value)}.{node.attr}"
    raise ValueError(f"not allowed in a rule: {ast.dump(node)[:60]}")


def _value(node: ast.AST, cols: dict[str, Column]) -> Column:
    if isinstance(node, ast.Constant):
        return F.lit(node.value)
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub) and isinstance(node.operand, ast.Constant):
        return F.lit(-node.operand.value)
    n = _name(node)
    return F.lit(_WORDS[n]) if n in _WORDS else cols.get(n, F.lit(None))


def _truth(node: ast.AST, cols: dict[str, Column]) -> Column:
    if isinstance(node, ast.BoolOp):
        parts = [_truth(v, cols) for v in node.values]
        out = parts[-1]
        for p in reversed(parts[:-1]):
            # Left to right with short circuit; null is an error and ends the rule.
            rest = out
            out = F.when(p.isNull(), F.lit(None)).when(p, rest if isinstance(node.op, ast.And) else F.lit(True)).otherwise(F.lit(False) if isinstance(node.op, ast.And) else rest)
        return out
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.Not):
        return ~_truth(node.operand, cols)
    if isinstance(node, ast.Compare):
        if len(node.ops) != 1:
            raise ValueError("chained comparisons are refused; write them with 'and'")
        a, b, op = _value(node.left, cols), _value(node.comparators[0], cols), type(node.ops[0])
        if op is ast.Eq:
            return a.eqNullSafe(b)
        if op is ast.NotEq:
            return ~a.eqNullSafe(b)
        if op in _ORDER:
            return _ORDER[op](a, b)
        raise ValueError("only comparisons of values are allowed")
    v = _value(node, cols)
    return F.coalesce(v.cast("boolean"), F.lit(False))


def first_match(routes: list[tuple[Column, str]], default: str) -> Column:
    """The target of the first condition that holds."""
    out = F.lit(default)
    for c, target in reversed(routes):
        out = F.when(F.coalesce(c, F.lit(False)), F.lit(target)).otherwise(out)
    return out


def interpolate(template: str, columns: dict[str, Column]) -> Column:
    """Text with {names} replaced: unknown single names stay, unknown dotted ones become empty."""
    parts = []
    for lit, name in re.findall(r"([^{]+|\{(?![\w.]+\})|)(?:\{([\w.]+)\})?", template):
        if lit:
            parts.append(F.lit(lit))
        if name in columns:
            parts.append(F.coalesce(columns[name].cast("string"), F.lit("")))
        elif name:
            parts.append(F.lit("" if "." in name else "{" + name + "}"))
    return F.concat(*parts) if parts else F.lit("")


def deep_merge(base: dict, over: dict) -> dict:
    """Settings merged key by key; the override wins."""
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
