"""Formulas over attributes: tokens, references, linearity, and compilation to Columns. No text is ever evaluated as code."""

from __future__ import annotations

import ast
import io
import math
import re
import tokenize
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExpressionError(ValueError):
    """A formula that can't be read, or whose names can't be resolved."""


def _guard(ok: Column, value: Column, what: str) -> Column:
    """The value, or an error where its arguments are outside the function's domain."""
    return F.when(ok | ok.isNull(), value).otherwise(F.raise_error(F.lit(f"math domain error in {what}")).cast("double"))


def _log(x: Column, *base: Column) -> Column:
    y = _guard(x > 0, F.log(x), "log")
    return y / F.log(base[0]) if base else y


#: What formulas may call. Rounding is half to even, as in Python; arguments outside a function's domain are errors.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "float": lambda x: x.cast("double"), "fabs": F.abs, "abs": F.abs, "ceil": lambda x: F.ceil(x).cast("double"), "floor": lambda x: F.floor(x).cast("double"),
    "round": lambda x, n=None: F.bround(x, 0) if n is None else F.bround(x, n), "exp": F.exp, "expm1": F.expm1, "pow": F.pow, "sqrt": lambda x: _guard(x >= 0, F.sqrt(x), "sqrt"),
    "log": _log, "log1p": lambda x: _guard(x > -1, F.log1p(x), "log1p"), "log10": lambda x: _guard(x > 0, F.log10(x), "log10"), "log2": lambda x: _guard(x > 0, F.log2(x), "log2"),
    "factorial": lambda x: _guard((x >= 0) & (x == F.floor(x)) & (x <= 170), F.aggregate(F.sequence(F.lit(0), x.cast("int")), F.lit(1.0), lambda a, i: F.when(i == 0, a).otherwise(a * i)), "factorial"),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "acos": lambda x: _guard(F.abs(x) <= 1, F.acos(x), "acos"), "asin": lambda x: _guard(F.abs(x) <= 1, F.asin(x), "asin"), "atan": F.atan, "atan2": F.atan2,
    "hypot": F.hypot, "degrees": F.degrees, "radians": F.radians, "min": F.least, "max": F.greatest,
}
_LEGAL = {"+", "-", "*", "/", "//", "%", "**", "(", ")", ",", ".", "==", "!=", "<", ">", "<=", ">=", "[", "]"}
_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Pow: lambda a, b: F.pow(a, b)}
_COMPARE = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


@dataclass
class Parsed:
    """A formula. terms: (model, id) of each reference, in order of first appearance; body: the formula with v0, v1 ... in their place."""

    text: str
    terms: list[tuple[str, str]] = field(default_factory=list)
    body: str = ""
    calls: list[str] = field(default_factory=list)


def parse(text: str, known: dict[str, list[str]], functions: dict | None = None) -> Parsed:
    """Tokens of a formula and what they refer to.

    known: model -> its ids. An id may be made of several tokens without blanks between them, such as `a[c]`; the longest
    that is known wins. `Model.id` says which model is meant; an id that several models have needs it.
    """
    functions = functions or FUNCTIONS
    try:
        tokens = [t for t in tokenize.generate_tokens(io.StringIO(text.strip()).readline) if t.type in (tokenize.NAME, tokenize.NUMBER, tokenize.OP)]
        odd = [t.string for t in tokenize.generate_tokens(io.StringIO(text.strip()).readline) if t.type in (tokenize.STRING, tokenize.ERRORTOKEN, tokenize.COMMENT) and t.string.strip()]
    except (tokenize.TokenError, SyntaxError) as e:
        raise ExpressionError(f"{text!r}: {e}") from None
    odd += [t.string for t in tokens if t.type == tokenize.OP and t.string not in _LEGAL]
    if odd:
        raise ExpressionError(f"{text!r} holds {odd}, which formulas can't")
    owners: dict[str, list[str]] = {}
    for m, ids in known.items():
        for i in ids:
            owners.setdefault(i, []).append(m)
    out, at = Parsed(text), 0
    pieces: list[str] = []
    while at < len(tokens):
        t = tokens[at]
        if t.type != tokenize.NAME or t.string in ("and", "or", "not"):
            pieces.append(t.string)
            at += 1
            continue
        found: list[tuple[int, str, str]] = []
        if t.string in known and at + 2 < len(tokens) and tokens[at + 1].string == ".":
            found += [(n, t.string, i) for n, i in _spans(tokens, at + 2) if i in known[t.string]]
        for n, i in _spans(tokens, at):
            found += [(n, m, i) for m in owners.get(i, [])]
        if found:
            longest = max(n for n, _, _ in found)
            best = [(m, i) for n, m, i in found if n == longest]
            if len(best) > 1:
                raise ExpressionError(f"{text!r}: {best[0][1]!r} may be of {[m for m, _ in best]}")
            if best[0] not in out.terms:
                out.terms.append(best[0])
            pieces.append(f"v{out.terms.index(best[0])}")
            at = longest
        elif t.string in functions and at + 1 < len(tokens) and tokens[at + 1].string == "(":
            out.calls.append(t.string)
            pieces.append(t.string)
            at += 1
        else:
            raise ExpressionError(f"{text!r}: {t.string!r} is neither known nor a function")
    out.body = " ".join(pieces)
    try:
        ast.parse(out.body, mode="eval")
    except SyntaxError as e:
        raise ExpressionError(f"{text!r}: {e.msg}") from None
    return out


def _spans(tokens: list, at: int) -> list[tuple[int, str]]:
    """(end, text) of runs of adjacent tokens from `at`."""
    out, s = [], tokens[at].string
    out.append((at + 1, s))
    for k in range(at + 1, min(at + 8, len(tokens))):
        if tokens[k].start != tokens[k - 1].end or tokens[k].start[0] != tokens[at].start[0]:
            break
        s += tokens[k].string
        out.append((k + 1, s))
    return out


def compile_column(p: Parsed, values: list[Column], functions: dict | None = None) -> Column:
    """The formula as one expression inside the engine, given a column for each term. Division by zero is an error, as in Python."""
    functions = functions or FUNCTIONS

    def walk(n: ast.AST) -> Column:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return F.lit(float(n.value)) if not isinstance(n.value, bool) else F.lit(n.value)
        if isinstance(n, ast.Name) and n.id[0] == "v" and n.id[1:].isdigit():
            return values[int(n.id[1:])]
        if isinstance(n, ast.UnaryOp):
            x = walk(n.operand)
            return -x if isinstance(n.op, ast.USub) else ~x if isinstance(n.op, ast.Not) else x
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            if type(n.op) in _BINARY:
                return _BINARY[type(n.op)](a, b)
            divided = {ast.Div: lambda: a / b, ast.FloorDiv: lambda: F.floor(a / b).cast("double"), ast.Mod: lambda: a - F.floor(a / b) * b}.get(type(n.op))
            if divided:
                return F.when((b != 0) | b.isNull(), divided()).otherwise(F.raise_error(F.lit("division by zero")).cast("double"))
        if isinstance(n, ast.Compare):
            sides = [walk(n.left), *map(walk, n.comparators)]
            return reduce(lambda x, y: x & y, [_COMPARE[type(o)](a, b) for o, a, b in zip(n.ops, sides, sides[1:])])
        if isinstance(n, ast.BoolOp):
            return reduce((lambda x, y: x & y) if isinstance(n.op, ast.And) else (lambda x, y: x | y), map(walk, n.values))
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id in functions:
            return functions[n.func.id](*map(walk, n.args))
        raise ExpressionError(f"{p.text!r}: {ast.dump(n)[:60]} isn't allowed")

    return walk(ast.parse(p.body, mode="eval").body)


def evaluate(p: Parsed, values: dict[tuple[str, str], float]) -> float | bool:
    """The formula's value on the driver, through the same engine's rules but for one row: for checks of a few formulas."""
    own = {k: getattr(math, k) for k in FUNCTIONS if hasattr(math, k)} | {"float": float, "abs": abs, "round": round, "min": min, "max": max}

    def walk(n: ast.AST):
        if isinstance(n, ast.Constant):
            return n.value
        if isinstance(n, ast.Name):
            return values[p.terms[int(n.id[1:])]]
        if isinstance(n, ast.UnaryOp):
            x = walk(n.operand)
            return -x if isinstance(n.op, ast.USub) else (not x) if isinstance(n.op, ast.Not) else x
        if isinstance(n, ast.BinOp):
            a, b = walk(n.left), walk(n.right)
            return {ast.Add: lambda: a + b, ast.Sub: lambda: a - b, ast.Mult: lambda: a * b, ast.Div: lambda: a / b, ast.FloorDiv: lambda: a // b, ast.Mod: lambda: a % b, ast.Pow: lambda: a**b}[type(n.op)]()
        if isinstance(n, ast.Compare):
            sides = [walk(n.left), *map(walk, n.comparators)]
            ops = {ast.Eq: "__eq__", ast.NotEq: "__ne__", ast.Lt: "__lt__", ast.LtE: "__le__", ast.Gt: "__gt__", ast.GtE: "__ge__"}
            return all(getattr(float(a), ops[type(o)])(float(b)) for o, a, b in zip(n.ops, sides, sides[1:]))
        if isinstance(n, ast.BoolOp):
            parts = list(map(walk, n.values))
            return all(parts) if isinstance(n.op, ast.And) else any(parts)
        if isinstance(n, ast.Call) and n.func.id in own:
            return own[n.func.id](*map(walk, n.args))
        raise ExpressionError(f"{p.text!r}: {ast.dump(n)[:60]} isn't allowed")

    return walk(ast.parse(p.body, mode="eval").body)


def coefficients(p: Parsed) -> dict[tuple[str, str], float] | None:
    """Coefficient of each term of a linear formula; None where it isn't linear.

    Linear is a sum of terms, each a variable with constants to the left of it. Division, powers and functions, constants that
    stand alone or to the right of a variable, and products of variables aren't.
    """
    out: dict[tuple[str, str], float] = {}

    def constant(n: ast.AST) -> float | None:
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)):
            return float(n.value)
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            x = constant(n.operand)
            return None if x is None else -x if isinstance(n.op, ast.USub) else x
        if isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Add, ast.Sub, ast.Mult)):
            a, b = constant(n.left), constant(n.right)
            return None if a is None or b is None else _NUMBERS[type(n.op)](a, b)
        return None

    def add(n: ast.AST, by: float) -> bool:
        if isinstance(n, ast.Name):
            term = p.terms[int(n.id[1:])]
            out[term] = out.get(term, 0.0) + by
            return True
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.USub, ast.UAdd)):
            return add(n.operand, -by if isinstance(n.op, ast.USub) else by)
        if isinstance(n, ast.BinOp):
            if isinstance(n.op, (ast.Add, ast.Sub)):
                return add(n.left, by) and add(n.right, by if isinstance(n.op, ast.Add) else -by)
            if isinstance(n.op, ast.Mult):
                k = constant(n.left)
                return k is not None and add(n.right, by * k)
        return False

    return out if add(ast.parse(p.body, mode="eval").body, 1.0) else None


_NUMBERS = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b}


def linear_values(coeffs: DataFrame, values: DataFrame, key: str = "expr") -> DataFrame:
    """(expr, value) of many linear formulas at once: coeffs (expr, term, coefficient) joined with values (term, value). A term without a value makes the sum null."""
    both = coeffs.join(values, "term", "left")
    total = F.when(F.count_if(F.col("value").isNull()) == 0, F.sum(F.col("coefficient") * F.col("value")))
    return both.groupBy(key).agg(total.alias("value"))


def rewrite(p: Parsed, name: Callable[[str, str], str]) -> str:
    """The formula with its references written by `name(model, id)`."""
    return re.sub(r"\bv(\d+)\b", lambda m: name(*p.terms[int(m[1])]), p.body)


def terms(df: DataFrame, key: str, column: str, known: dict[str, list[str]], dynamic: tuple[str, ...] = ()) -> DataFrame:
    """(key, model, id, linear, dynamic, error): a row for each reference of each formula of a column, whether the formula is linear, and whether it refers to a model whose values change with time.
    A formula that can't be read has one row with its error; one without references has one without a model. Equal formulas of a batch are read once."""
    from quillstone.functions.grammar import parse_cells

    def parser(text: str):
        p = parse(text, known)
        linear, moves = coefficients(p) is not None, any(m in dynamic for m, _ in p.terms)
        return [(m, i, linear, moves) for m, i in p.terms] or [(None, None, linear, False)]

    return parse_cells(df, key, column, parser, "model string, id string, linear boolean, dynamic boolean")


def checked(p: Parsed, values: dict[tuple[str, str], float] | None = None, kind: type = float, linear: bool = False, terms: int | None = None) -> list[str]:
    """What is wrong with a formula: its value, with ones for terms that have none, isn't of the kind, it isn't linear or hasn't so many terms."""
    wrong = []
    try:
        value = evaluate(p, {t: (values or {}).get(t, 1.0) for t in p.terms})
        if kind is bool and not isinstance(value, bool) or kind is float and (isinstance(value, bool) or not isinstance(value, (int, float))):
            wrong.append(f"{p.text!r} gives {value!r}, not a {kind.__name__}")
    except (ArithmeticError, ValueError) as e:
        wrong.append(f"{p.text!r} can't be evaluated: {e}")
    if linear and coefficients(p) is None:
        wrong.append(f"{p.text!r} isn't linear")
    if terms is not None and len(p.terms) != terms:
        wrong.append(f"{p.text!r} has {len(p.terms)} terms, not {terms}")
    return wrong


def compile_nested(formulas: dict[tuple[str, str], str], known: dict[str, list[str]], values: dict[tuple[str, str], Column]) -> dict[tuple[str, str], Column]:
    """Columns of formulas that refer to each other by (model, id): each is compiled once, those that others need first. A circle is an error."""
    parsed = {k: parse(t, known) for k, t in formulas.items()}
    done: dict[tuple[str, str], Column] = {}
    state: dict[tuple[str, str], int] = {}

    def visit(k: tuple[str, str]) -> Column:
        if k in done:
            return done[k]
        if k not in parsed:
            if k not in values:
                raise ExpressionError(f"{k[0]}.{k[1]} has no value")
            return values[k]
        if state.get(k):
            raise ExpressionError(f"{k[0]}.{k[1]} depends on itself")
        state[k] = 1
        done[k] = compile_column(parsed[k], [visit(t) for t in parsed[k].terms])
        return done[k]

    return {k: visit(k) for k in formulas}
