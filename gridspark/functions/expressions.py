"""Arithmetic in text compiled to Spark columns; nothing is ever evaluated as Python."""

from __future__ import annotations

import ast
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def divide(a: Column, b: Column) -> Column:
    """IEEE division: x/0 is an infinity of x's sign and 0/0 is NaN, also where ANSI mode would raise."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(a.isNull() | b.isNull(), F.lit(None)).when(b == 0, at_zero).otherwise(a / F.nullif(b, F.lit(0.0)))


BINARY: dict[type, Callable[[Column, Column], Column]] = {
    ast.Add: lambda a, b: a + b,
    ast.Sub: lambda a, b: a - b,
    ast.Mult: lambda a, b: a * b,
    ast.Div: divide,
    ast.Pow: F.pow,
    ast.BitAnd: lambda a, b: (a.cast("long").bitwiseAND(b.cast("long"))),
    ast.BitOr: lambda a, b: (a.cast("long").bitwiseOR(b.cast("long"))),
}
COMPARE: dict[type, Callable[[Column, Column], Column]] = {
    ast.Lt: lambda a, b: a < b,
    ast.LtE: lambda a, b: a <= b,
    ast.Gt: lambda a, b: a > b,
    ast.GtE: lambda a, b: a >= b,
    ast.Eq: lambda a, b: a == b,
    ast.NotEq: lambda a, b: a != b,
}
CALLS: dict[str, Callable[..., Column]] = {"exp": F.exp, "log": F.log, "sqrt": F.sqrt, "abs": F.abs, "floor": F.floor, "ceil": F.ceil, "sin": F.sin, "cos": F.cos, "tan": F.tan, "hypot": F.hypot, "radians": F.radians, "maximum": F.greatest, "minimum": F.least, "where": lambda c, a, b: F.when(c, a).otherwise(b)}
CONSTANTS = {"pi": 3.141592653589793, "e": 2.718281828459045}


def symbols(text: str) -> set[str]:
    """Names that an expression uses, functions left out."""
    tree = ast.parse(text, mode="eval")
    called = {id(n.func) for n in ast.walk(tree) if isinstance(n, ast.Call)}
    return {n.id for n in ast.walk(tree) if isinstance(n, ast.Name) and id(n) not in called}


def logical(node: ast.AST) -> bool:
    """Whether a node is a comparison, or comparisons joined by & and |."""
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.BitAnd, ast.BitOr)):
        return logical(node.left) and logical(node.right)
    return isinstance(node, ast.Compare)


def compile_expression(text: str, names: Mapping[str, Column]) -> Column:
    """The column of an expression over ``names``; ValueError for anything beyond arithmetic."""

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.Expression):
            return walk(node.body)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name):
            if node.id in names:
                return names[node.id]
            if node.id in CONSTANTS:
                return F.lit(CONSTANTS[node.id])
            raise ValueError(f"unknown symbol {node.id!r}")
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -walk(node.operand) if isinstance(node.op, ast.USub) else walk(node.operand)
        if isinstance(node, ast.BinOp) and type(node.op) in BINARY:
            if logical(node):
                a, b = walk(node.left), walk(node.right)
                return a & b if isinstance(node.op, ast.BitAnd) else a | b
            return BINARY[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.Compare) and all(type(op) in COMPARE for op in node.ops):
            out, left = None, walk(node.left)
            for op, right in zip(node.ops, map(walk, node.comparators), strict=True):
                test = COMPARE[type(op)](left, right)
                out, left = test if out is None else out & test, right
            return out
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in CALLS and not node.keywords:
            return CALLS[node.func.id](*map(walk, node.args))
        raise ValueError(f"{ast.unparse(node)!r} isn't allowed in an expression")

    return walk(ast.parse(text, mode="eval"))
