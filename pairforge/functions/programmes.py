"""Values of calls to arithmetic functions, without running any code of the corpus.

A function that only assigns and returns arithmetic becomes a postfix programme; calls and
sides of asserts become programmes too, run on a stack of exact Python numbers. This is for
what :func:`~pairforge.functions.literals.closed_form` leaves open: several operations, local
names, defaults, arguments by name, integers of more than 38 digits. The column function is a
narrow projection; each distinct source of a batch is read once, rows with NULL cost nothing."""

from __future__ import annotations

import ast
import math
import operator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from pairforge.functions.facts import _parse
from pairforge.functions.text import as_col

#: Bits of an integer, intermediate ones too. Longer ones (about 4,300 digits) are never
#: written as text by Python itself, so no test can hold them; calls that meet one are open.
BITS = 14_284
#: Digits that ``round`` may be asked for.
ROUND_DIGITS = 400

_BINARY = {
    ast.Add: "+", ast.Sub: "-", ast.Mult: "*", ast.Div: "/", ast.FloorDiv: "//", ast.Mod: "%", ast.Pow: "**",
}
_VALUE = pa.struct([("status", pa.string()), ("value", pa.string()), ("exact", pa.string()), ("near", pa.bool_())])
_VALUES = pa.list_(pa.list_(_VALUE))


class Open(Exception):
    """The value cannot be told from arithmetic alone."""


def _power(base, exponent, *modulus):
    if modulus:
        raise Open
    whole = isinstance(base, int) and isinstance(exponent, int)
    if whole and abs(base) > 1 and base.bit_length() * exponent > 2 * BITS:
        raise Open
    return base**exponent


def _round(x, digits=None):
    if digits is not None and not (isinstance(digits, int) and abs(digits) <= ROUND_DIGITS):
        raise Open
    return round(x, digits)


_APPLY = {
    "+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv,
    "//": operator.floordiv, "%": operator.mod, "**": _power,
}
# Built-in functions of numbers that a function or an assert may call.
_KNOWN = {"abs": abs, "round": _round, "int": int, "float": float, "min": min, "max": max, "pow": _power}


def _number(value):
    """The value, if it is a real number of a size that can be written."""
    if type(value) not in (int, float) or (isinstance(value, int) and value.bit_length() > BITS):
        raise Open
    return value


def _postfix(node: ast.AST, target: str | None = None) -> list[tuple]:
    """Steps of an expression; calls of ``target`` and of known functions are steps."""
    match node:
        case ast.Constant(value=value):
            return [("push", _number(value))]
        case ast.Name(id=name):
            return [("load", name)]
        case ast.UnaryOp(op=ast.UAdd(), operand=inner):
            return _postfix(inner, target)
        case ast.UnaryOp(op=ast.USub(), operand=inner):
            return [*_postfix(inner, target), ("negate",)]
        case ast.BinOp(left=left, op=op, right=right) if type(op) in _BINARY:
            return [*_postfix(left, target), *_postfix(right, target), ("apply", _BINARY[type(op)])]
        case ast.Call(func=ast.Name(id=name), args=args, keywords=keywords):
            if name != target and (name not in _KNOWN or keywords or not args):
                raise Open
            steps = [s for a in args for s in _postfix(a, target)]
            steps += [s for k in keywords for s in _postfix(k.value, target)]
            names = [k.arg for k in keywords]
            if None in names:
                raise Open
            return [*steps, ("call" if name == target else "known", name, len(args), names)]
    raise Open


class Programme:
    """One function: parameters, defaults and the steps of its body up to the first return."""

    def __init__(self, source: str):
        tree = _parse(source)
        if tree is None or len(tree.body) != 1 or not isinstance(tree.body[0], ast.FunctionDef):
            raise Open
        function = tree.body[0]
        spec = function.args
        if function.decorator_list or spec.vararg or spec.kwarg:
            raise Open
        self.name = function.name
        self.places = [a.arg for a in spec.posonlyargs + spec.args]
        self.unnamed = {a.arg for a in spec.posonlyargs}
        self.only_named = [a.arg for a in spec.kwonlyargs]
        values = dict(zip(self.places[len(self.places) - len(spec.defaults):], spec.defaults, strict=True))
        values |= {n: d for n, d in zip(self.only_named, spec.kw_defaults, strict=True) if d is not None}
        self.defaults = {n: run(_postfix(d), {}) for n, d in values.items()}
        self.steps = self._body(function.body)

    @staticmethod
    def _body(statements: list[ast.stmt]) -> list[tuple]:
        steps = []
        for i, statement in enumerate(statements):
            match statement:
                case ast.Expr(value=ast.Constant(value=str())) if i == 0:
                    pass
                case ast.Assign(targets=[ast.Name(id=name)], value=value) | ast.AnnAssign(
                    target=ast.Name(id=name), value=ast.expr() as value
                ):
                    steps += [*_postfix(value), ("store", name)]
                case ast.AugAssign(target=ast.Name(id=name), op=op, value=value) if type(op) in _BINARY:
                    steps += [("load", name), *_postfix(value), ("apply", _BINARY[type(op)]), ("store", name)]
                case ast.Return(value=ast.expr() as value):
                    return [*steps, *_postfix(value)]
                case _:
                    raise Open
        raise Open

    def call(self, given: list, named: dict):
        """The value for these arguments; TypeError where they do not fit, as in Python."""
        bound = dict(zip(self.places, given, strict=False))
        allowed = (set(self.places) - self.unnamed) | set(self.only_named)
        if len(given) > len(self.places) or named.keys() & bound.keys() or named.keys() - allowed:
            raise TypeError(self.name)
        bound = {**self.defaults, **bound, **named}
        if len(bound) < len(self.places) + len(self.only_named):
            raise TypeError(self.name)
        return run(self.steps, bound)


def run(steps: list[tuple], names: dict, programme: Programme | None = None):
    """The number on the stack after all steps. Names are values bound so far."""
    names, stack = dict(names), []

    def take(n: int) -> list:
        taken = stack[len(stack) - n:]
        del stack[len(stack) - n:]
        return taken

    for kind, *what in steps:
        if kind == "push":
            stack.append(what[0])
        elif kind == "load":
            if what[0] not in names:
                raise Open
            stack.append(names[what[0]])
        elif kind == "store":
            names[what[0]] = stack.pop()
        elif kind == "negate":
            stack.append(-stack.pop())
        elif kind == "apply":
            stack.append(_number(_APPLY[what[0]](*take(2))))
        else:
            name, n, keywords = what
            by_name = dict(zip(keywords, take(len(keywords)), strict=True))
            given = take(n)
            if kind == "call":
                if programme is None:
                    raise Open
                stack.append(programme.call(given, by_name))
            else:
                if name in names:
                    raise Open
                stack.append(_number(_KNOWN[name](*given)))
    return stack.pop()


def _literal(x) -> str:
    """A number as the audit writes it: ten decimals at most, whole floats as integers."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return f"float('{x}')"
    if x == 0:
        return "0.0"
    text = f"{x:.10f}".rstrip("0").rstrip(".")
    return "0" if text == "-0" else text


def _value(text: str | None, programme: Programme) -> dict | None:
    """Of one expression: ok with its value, ``raises``, or ``open``."""
    if text is None:
        return None
    result = {"status": "open", "value": None, "exact": None, "near": False}
    tree = _parse(f"({text}\n)", "eval")
    if tree is None:
        return result
    node = tree.body
    match node:
        case ast.Constant(value=value) if value is None or isinstance(value, bool) or isinstance(value, str) and "\\" not in repr(value):
            return {**result, "status": "ok", "value": repr(value), "exact": repr(value)}
        # Only the default tolerance is known.
        case ast.Call(func=ast.Attribute(value=ast.Name(id="pytest"), attr="approx") | ast.Name(id="approx"),
                      args=[inner], keywords=[]):
            node, result["near"] = inner, True
    try:
        x = run(_postfix(node, programme.name), {}, programme)
        return {**result, "status": "ok", "value": _literal(x), "exact": repr(x) if math.isfinite(x) else _literal(x)}
    except (Open, RecursionError):
        return result
    except (ArithmeticError, TypeError, ValueError):
        # Also an integer too large for a float, or to be written.
        return {**result, "status": "raises"}


def evaluate(source: str, groups: list[list[str | None]]) -> list[list[dict | None]]:
    """Values of expressions that may call the one function of ``source``."""
    try:
        programme = Programme(source)
    except (Open, RecursionError, ArithmeticError, TypeError, ValueError):
        unknown = {"status": "open", "value": None, "exact": None, "near": False}
        return [[None if t is None else unknown for t in texts] for texts in groups]
    return [[_value(t, programme) for t in texts] for texts in groups]


#: Rows whose values a task keeps for equal rows that follow: so many characters, then it starts anew.
KEPT_CHARS = 1_000_000
_KEPT: dict = {}


@F.arrow_udf(from_arrow_type(_VALUES))
def _evaluate_udf(source: pa.Array, groups: pa.Array) -> pa.Array:
    out = []
    for s, g in zip(source.to_pylist(), groups.to_pylist(), strict=True):
        if s is None or g is None:
            out.append(None)
            continue
        row = (s, *map(tuple, g))
        if row not in _KEPT:
            chars = len(s) + sum(len(t or "") for texts in g for t in texts)
            if _KEPT.get("chars", 0) + chars > KEPT_CHARS:
                _KEPT.clear()
            _KEPT["chars"] = _KEPT.get("chars", 0) + chars
            _KEPT[row] = evaluate(s, g)
        out.append(_KEPT[row])
    return pa.array(out, type=_VALUES)


def values_of(source: Column | str, groups: Column) -> Column:
    """array<array<struct<status, value, exact, near>>> for an array<array<string>> of
    expressions. ``status``: ok, ``raises`` (division by zero, overflow, arguments that do not
    fit) or ``open`` (no arithmetic, a complex result, integers of more than :data:`BITS` bits);
    ``value`` is the literal the audit writes, ``exact`` all digits, ``near`` marks
    ``pytest.approx``. NULL source or groups give NULL; a NULL expression gives NULL."""
    return _evaluate_udf(as_col(source), groups)
