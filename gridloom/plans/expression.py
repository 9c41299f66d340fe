"""Correction expressions: a small language over a signal and its correction surfaces.

Names: S, the signal; BG_o, BG_s, FG_o, FG_f, FG_s, the background's offset and stripe and the
foreground's offset, factor and stripe. Operators: + - * / ^ and parentheses. The text is parsed, never
evaluated; names that have no column are replaced (an offset by 0, a factor or stripe by 1) and the tree
is simplified before it becomes a Spark column.
"""

from __future__ import annotations

import ast
import operator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNAL = "S"
SURFACES = ("BG_o", "BG_s", "FG_o", "FG_f", "FG_s")
_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_SIGNS = {ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.Pow: "^"}


class ExpressionError(ValueError):
    pass


class _LeftPowers(ast.NodeTransformer):
    """Powers that stand side by side are taken from the left, unlike Python's: a ^ b ^ c is (a ^ b) ^ c."""

    def __init__(self, source: str):
        self.source = source.encode()  # columns of nodes count bytes

    def _open(self, node: ast.expr) -> bool:
        """Whether an operand stands without parentheses of its own."""
        return not self.source[: node.col_offset].rstrip().endswith(b"(")

    def visit_BinOp(self, node: ast.BinOp) -> ast.expr:
        if not isinstance(node.op, ast.Pow):
            return self.generic_visit(node)
        operands, right = [node.left], node.right
        while True:
            sign, power = None, right
            if isinstance(right, ast.UnaryOp) and self._open(right):
                sign, power = right.op, right.operand
            if not (isinstance(power, ast.BinOp) and isinstance(power.op, ast.Pow) and self._open(power)):
                operands.append(right)
                break
            operands.append(power.left if sign is None else ast.UnaryOp(sign, power.left))
            right = power.right
        out = self.visit(operands[0])
        for exponent in operands[1:]:
            out = ast.BinOp(out, ast.Pow(), self.visit(exponent))
        return out


def parse(text: str, required: tuple[str, ...] = (SIGNAL,)) -> ast.expr:
    source = " ".join(text.replace(".^", "^").replace(".*", "*").replace("./", "/").replace("^", "**").split())
    try:
        tree = _LeftPowers(source).visit(ast.parse(source, mode="eval").body)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise ExpressionError(f"not an expression: {text}") from e
    used = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Name):
            used.add(node.id)
        elif isinstance(node, ast.Constant):
            if isinstance(node.value, bool) or not isinstance(node.value, (int, float)):
                raise ExpressionError(f"not a number: {node.value!r}")
        elif isinstance(node, ast.BinOp):
            if type(node.op) not in _OPERATORS:
                raise ExpressionError(f"no such operator in {text}")
        elif isinstance(node, ast.UnaryOp):
            if not isinstance(node.op, (ast.UAdd, ast.USub)):
                raise ExpressionError(f"no such operator in {text}")
        elif not isinstance(node, (ast.operator, ast.unaryop, ast.expr_context)):
            raise ExpressionError(f"not allowed in an expression: {type(node).__name__}")
    if unknown := used - {SIGNAL, *SURFACES}:
        raise ExpressionError(f"unknown names: {', '.join(sorted(unknown))}")
    if absent := set(required) - used:
        raise ExpressionError(f"the expression has no {', '.join(sorted(absent))}")
    return tree


def _number(node: ast.expr) -> float | None:
    return float(node.value) if isinstance(node, ast.Constant) else None


def simplify(node: ast.expr) -> ast.expr:
    """Folds numbers and removes what adds nothing: +0, -0, *1, /1, ^1, and products with 0."""
    if isinstance(node, ast.UnaryOp):
        inner = simplify(node.operand)
        if isinstance(node.op, ast.UAdd):
            return inner
        value = _number(inner)
        return ast.UnaryOp(node.op, inner) if value is None else ast.Constant(-value)
    if not isinstance(node, ast.BinOp):
        return node
    left, right, kind = simplify(node.left), simplify(node.right), type(node.op)
    a, b = _number(left), _number(right)
    if a is not None and b is not None and not (kind is ast.Div and b == 0):
        try:
            return ast.Constant(float(_OPERATORS[kind](a, b)))
        except (TypeError, ArithmeticError, ValueError) as e:  # a root of a negative number, 0 to a negative power, too large
            raise ExpressionError(f"{a:g} {_SIGNS[kind]} {b:g} is no number") from e
    if kind in (ast.Add, ast.Sub) and b == 0:
        return left
    if kind is ast.Add and a == 0:
        return right
    if kind is ast.Sub and a == 0:
        return simplify(ast.UnaryOp(ast.USub(), right))
    if kind is ast.Mult and (a == 0 or b == 0):
        return ast.Constant(0.0)
    if kind is ast.Div and a == 0:
        return ast.Constant(0.0)
    if kind in (ast.Mult, ast.Div, ast.Pow) and b == 1:
        return left
    if kind is ast.Mult and a == 1:
        return right
    return ast.BinOp(left, node.op, right)


def without_undefined(node: ast.expr, defined: set[str], remove: bool = True) -> ast.expr:
    """The tree with names that are not defined replaced by what has no effect; an error unless ``remove``."""

    class Replace(ast.NodeTransformer):
        def visit_Name(self, name: ast.Name) -> ast.expr:
            if name.id == SIGNAL or name.id in defined:
                return name
            if not remove:
                raise ExpressionError(f"{name.id} is not defined")
            return ast.Constant(0.0 if name.id.endswith("_o") else 1.0)

    import copy

    return simplify(Replace().visit(copy.deepcopy(node)))


def to_text(node: ast.expr) -> str:
    if isinstance(node, ast.Constant):
        return f"{node.value:g}"
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.UnaryOp):
        return f"-{to_text(node.operand)}"
    return f"({to_text(node.left)} {_SIGNS[type(node.op)]} {to_text(node.right)})"


def to_column(node: ast.expr, columns: dict[str, Column]) -> Column:
    """Division by zero gives null, as what cannot be corrected is missing."""
    if isinstance(node, ast.Constant):
        return F.lit(float(node.value))
    if isinstance(node, ast.Name):
        return columns[node.id].cast("double")
    if isinstance(node, ast.UnaryOp):
        return -to_column(node.operand, columns)
    a, b = to_column(node.left, columns), to_column(node.right, columns)
    if isinstance(node.op, ast.Pow):
        return F.pow(a, b)
    return F.try_divide(a, b) if isinstance(node.op, ast.Div) else _OPERATORS[type(node.op)](a, b)


def to_array(node: ast.expr, arrays: dict[str, np.ndarray | float]) -> np.ndarray | float:
    """As :func:`to_column`, of arrays; division by zero gives NaN, which is what is missing there."""
    if isinstance(node, ast.Constant):
        return float(node.value)
    if isinstance(node, ast.Name):
        return arrays[node.id]
    if isinstance(node, ast.UnaryOp):
        return -to_array(node.operand, arrays)
    a, b = to_array(node.left, arrays), to_array(node.right, arrays)
    with np.errstate(all="ignore"):
        if isinstance(node.op, ast.Div):
            return np.divide(a, np.where(np.equal(b, 0), np.nan, b))
        return np.power(a, b) if isinstance(node.op, ast.Pow) else _OPERATORS[type(node.op)](a, b)


class Correction:
    """An expression with the surfaces that are known so far."""

    def __init__(self, text: str = SIGNAL, surfaces: dict[str, Column] | None = None):
        self.text, self.tree, self.surfaces = text, parse(text), dict(surfaces or {})
        if unknown := set(self.surfaces) - set(SURFACES):
            raise ExpressionError(f"unknown surfaces: {', '.join(sorted(unknown))}")

    def with_surface(self, name: str, column: Column) -> Correction:
        return Correction(self.text, self.surfaces | {name: column})

    def cleared(self) -> Correction:
        return Correction(self.text)

    @property
    def current(self) -> str:
        return to_text(without_undefined(self.tree, set(self.surfaces)))

    def array(self, signal: np.ndarray, surfaces: dict[str, np.ndarray | float]) -> np.ndarray:
        """The corrected signal as an array, with the surfaces that are given; others vanish."""
        return np.broadcast_to(to_array(without_undefined(self.tree, set(surfaces)), surfaces | {SIGNAL: signal}), signal.shape)

    def column(self, signal: Column, remove_undefined: bool = True) -> Column:
        return to_column(without_undefined(self.tree, set(self.surfaces), remove_undefined), self.surfaces | {SIGNAL: signal})
