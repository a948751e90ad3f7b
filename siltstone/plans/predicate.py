"""The metadata predicate language: Python-like text or keyword filters, compiled to one Catalyst filter.

Truth has two values. A comparison with a missing value is false, so ``not`` of it is true, while ``!=`` and
``not in`` never match a missing value. A numeric column compares by number when every literal is a number;
otherwise, and for text columns always, values compare as text in code-point order.
"""

from __future__ import annotations

import ast
import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class PredicateError(ValueError):
    """The text is not a predicate."""


Literal = str | int | float | bool


@dataclass(frozen=True)
class Compare:
    column: str
    op: str  #: == != < <= > >= in notin
    values: tuple[Literal, ...]


@dataclass(frozen=True)
class Exists:
    column: str


@dataclass(frozen=True)
class Both:
    parts: tuple


@dataclass(frozen=True)
class Either:
    parts: tuple


@dataclass(frozen=True)
class Complement:
    part: object


Node = Compare | Exists | Both | Either | Complement

_OPERATORS = {ast.Eq: "==", ast.NotEq: "!=", ast.Lt: "<", ast.LtE: "<=", ast.Gt: ">", ast.GtE: ">=", ast.In: "in", ast.NotIn: "notin"}
_MIRRORED = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_SUFFIXES = {"eq": "==", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">=", "in": "in"}


def parse(text: str | None = None, **filters: Literal | list) -> Node | None:
    """The tree of an expression and keyword filters, all of which must hold; None selects everything.

    Keywords take a suffix (age__lt=40); any other double underscore stands for a dot.
    """
    parts: list[Node] = []
    if text is not None and text.strip():
        try:
            tree = ast.parse(text.strip(), mode="eval")
        except SyntaxError as e:
            raise PredicateError(f"not an expression: {text!r}") from e
        parts.append(_node(tree.body))
    for name, value in filters.items():
        stem, _, suffix = name.rpartition("__")
        op = _SUFFIXES.get(suffix) if stem else None
        column = (stem if op else name).replace("__", ".")
        values = tuple(value) if isinstance(value, (list, tuple, set, frozenset)) else (value,)
        if isinstance(value, (list, tuple, set, frozenset)) and op is None:
            op = "in"
        parts.append(Compare(column, op or "==", tuple(map(_checked, values))))
    return None if not parts else parts[0] if len(parts) == 1 else Both(tuple(parts))


def _node(tree: ast.expr) -> Node:
    match tree:
        case ast.BoolOp(op=ast.And(), values=values):
            return Both(tuple(map(_node, values)))
        case ast.BoolOp(op=ast.Or(), values=values):
            return Either(tuple(map(_node, values)))
        case ast.UnaryOp(op=ast.Not(), operand=operand):
            return Complement(_node(operand))
        case ast.Call(func=ast.Name(id="exists"), args=[argument], keywords=[]):
            name = argument.value if isinstance(argument, ast.Constant) and isinstance(argument.value, str) else _column(argument)
            if name is None:
                raise PredicateError("exists() takes a column")
            return Exists(name)
        case ast.Compare(left=left, ops=ops, comparators=rights):
            links = [_comparison(a, _OPERATORS.get(type(op)), b) for a, op, b in zip([left, *rights], ops, rights, strict=False)]
            return links[0] if len(links) == 1 else Both(tuple(links))
    raise PredicateError(f"not a predicate: {ast.unparse(tree)}")


def _comparison(left: ast.expr, op: str | None, right: ast.expr) -> Compare:
    if op is None:
        raise PredicateError("this comparison isn't supported")
    column, other = _column(left), _column(right)
    if column is not None and other is not None:
        raise PredicateError("a column can only be compared with a value")
    if column is not None:
        value = _value(right)
        if op in ("in", "notin"):
            if not isinstance(value, tuple):
                raise PredicateError("membership needs a list")
            return Compare(column, op, value)
        if isinstance(value, tuple):
            raise PredicateError("a list needs 'in'")
        return Compare(column, op, (value,))
    if other is None or op not in _MIRRORED:
        raise PredicateError("a comparison needs a column")
    value = _value(left)
    if isinstance(value, tuple):
        raise PredicateError("a list needs 'in'")
    return Compare(other, _MIRRORED[op], (value,))


def _column(tree: ast.expr) -> str | None:
    match tree:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=value, attr=attr):
            stem = _column(value)
            return None if stem is None else f"{stem}.{attr}"
        case ast.Call(func=ast.Name(id="col"), args=[ast.Constant(value=str(name))], keywords=[]):
            return name
    return None


def _value(tree: ast.expr) -> Literal | tuple[Literal, ...]:
    match tree:
        case ast.Constant(value=value):
            return _checked(value)
        case ast.UnaryOp(op=ast.USub(), operand=ast.Constant(value=value)) if isinstance(value, (int, float)) and not isinstance(value, bool):
            return -value
        case ast.List(elts=elements) | ast.Tuple(elts=elements) | ast.Set(elts=elements):
            values = [_value(e) for e in elements]
            if any(isinstance(v, tuple) for v in values):
                raise PredicateError("lists don't nest")
            return tuple(values)
    raise PredicateError(f"not a value: {ast.unparse(tree)}")


def _checked(value: object) -> Literal:
    if isinstance(value, (str, int, float, bool)):
        return value
    raise PredicateError(f"not a value: {value!r}")


def number_of(value: Literal) -> float | None:
    """The value as a number: numbers and texts that read as one, but no booleans."""
    if isinstance(value, bool):
        return None
    try:
        return float(value)
    except ValueError:
        return None


def text_of(value: Literal) -> str:
    return ("true" if value else "false") if isinstance(value, bool) else str(value)


def number_text(x: Column) -> Column:
    """A number as text: whole ones without a fraction, others in their shortest form."""
    shortest = x.cast("double").cast("string")
    # Java goes to exponents at 10^7 and 10^-3, the wanted form at 10^16 and 10^-4.
    plain = F.regexp_replace(F.format_string("%.17f", x.cast("double")), r"0+$", "")
    small = F.concat(F.regexp_replace(F.regexp_extract(shortest, r"^(.*)E", 1), r"\.0$", ""), F.lit("e-"), F.lpad(F.regexp_extract(shortest, r"E-(\d+)$", 1), 2, "0"))
    other = F.when(~shortest.contains("E"), shortest).when(F.abs(x) < 1e-4, small).otherwise(plain)
    whole = F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(other)
    return F.when(x.isNotNull(), whole)  # a format would spell a null out


@dataclass(frozen=True)
class Reference:
    """How a column is read: by number, by text, or by whichever of the two its row has.

    ``scalar`` marks a subject's attribute: numeric if its value and all literals read as numbers.
    """

    number: Column | None = None
    text: Column | None = None
    scalar: bool = False


Resolver = Callable[[str], Reference | None]

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?\s*$"


def _sure(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _applied(op: str, left: Column, values: list) -> Column:
    first = values[0] if values else None
    match op:
        case "in":
            return reduce(lambda a, v: a | (left == v), values, F.lit(False))
        case "notin":
            return left.isNotNull() & reduce(lambda a, v: a & (left != v), values, F.lit(True))
        case "==":
            return left == first
        case "!=":
            return left != first
        case "<":
            return left < first
        case "<=":
            return left <= first
        case ">":
            return left > first
    return left >= first


def _by_number(op: str, x: Column, values: list[float]) -> Column:
    x = F.when(~F.isnan(x), x)
    usual = [F.lit(float(v)) for v in values if not math.isnan(v)]
    if len(usual) == len(values) or op in ("in", "notin"):
        return _sure(_applied(op, x, usual))
    return x.isNotNull() if op == "!=" else F.lit(False)  # nothing compares with a NaN


def compiled(node: Node | None, resolve: Resolver) -> Column:
    """The filter of a tree. A column that ``resolve`` doesn't know is missing in every row."""
    match node:
        case None:
            return F.lit(True)
        case Both(parts=parts):
            return reduce(lambda a, b: a & b, [compiled(p, resolve) for p in parts])
        case Either(parts=parts):
            return reduce(lambda a, b: a | b, [compiled(p, resolve) for p in parts])
        case Complement(part=part):
            return ~compiled(part, resolve)
        case Exists(column=column):
            found = resolve(column)
            if found is None:
                return F.lit(False)
            numeric = F.lit(False) if found.number is None else F.when(~F.isnan(found.number), found.number).isNotNull()
            return numeric if found.text is None else numeric | found.text.isNotNull()
    found = resolve(node.column)
    if found is None:
        return F.lit(False)
    numbers = [number_of(v) for v in node.values]
    texts = [F.lit(text_of(v)) for v in node.values]
    numeric = all(n is not None for n in numbers)
    if found.scalar:
        text = found.text if found.text is not None else number_text(found.number)
        by_text = _sure(_applied(node.op, text, texts))
        if not numeric:
            return by_text
        value = found.number if found.number is not None else F.when(text.rlike(_NUMBER), F.replace(F.trim(text), F.lit("_"), F.lit("")).try_cast("double"))
        return F.when(value.isNotNull(), _by_number(node.op, value, numbers)).otherwise(by_text)
    sides = []
    if found.number is not None:
        sides.append(_by_number(node.op, found.number, numbers) if numeric else _sure(_applied(node.op, F.when(~F.isnan(found.number), number_text(found.number)), texts)))
    if found.text is not None:
        sides.append(_sure(_applied(node.op, found.text, texts)))
    return reduce(lambda a, b: a | b, sides)


def columns_of(node: Node | None) -> set[str]:
    """The columns a tree mentions."""
    match node:
        case None:
            return set()
        case Both(parts=parts) | Either(parts=parts):
            return set().union(*map(columns_of, parts))
        case Complement(part=part):
            return columns_of(part)
    return {node.column}


def paths_of(node: Node | None) -> set[str] | None:
    """The paths an expression can only match, where it says so; None if it says nothing."""
    match node:
        case Compare(column="path", op="==" | "in", values=values):
            return set(map(text_of, values))
        case Both(parts=parts):
            known = [p for p in map(paths_of, parts) if p is not None]
            return set.intersection(*known) if known else None
        case Either(parts=parts):
            known = [paths_of(p) for p in parts]
            return set().union(*known) if all(p is not None for p in known) else None
    return None


def resolver_for(df: DataFrame, dynamic: str = "dyn", subject: str = "participant") -> Resolver:
    """References by the frame's own types: numbers by number, all else by text.

    A dotted name is a column of that very name, a ``subject`` struct's field, or an entry of the
    ``dynamic`` map, whose values are structs (num, txt) of which each row has one.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def of(column: Column, kind: T.DataType, scalar: bool = False) -> Reference:
        if isinstance(kind, T.BooleanType):
            return Reference(text=F.when(column, "true").when(~column, "false"), scalar=scalar)
        if isinstance(kind, T.NumericType):
            return Reference(number=column.cast("double"), scalar=scalar)
        return Reference(text=column.cast("string"), scalar=scalar)

    def resolve(name: str) -> Reference | None:
        if name in types:
            return of(df[f"`{name}`"], types[name])
        head, _, rest = name.partition(".")
        if head == subject and isinstance(types.get(subject), T.StructType) and rest in types[subject].fieldNames():
            return of(df[subject][rest], types[subject][rest].dataType, scalar=True)
        if dynamic in types:
            entry = F.try_element_at(df[dynamic], F.lit(name))
            return Reference(number=entry["num"], text=entry["txt"])
        return None

    return resolve


def where(df: DataFrame, text: str | None = None, /, **filters: Literal | list) -> DataFrame:
    """The rows of ``df`` that match; a filter on whole paths also becomes one on subjects, so that
    partitions and row groups of other subjects aren't read."""
    node = parse(text, **filters)
    out = df.where(compiled(node, resolver_for(df)))
    paths = paths_of(node)
    if paths is not None and "sub" in df.columns:
        out = out.where(F.col("sub").isin(sorted({p.partition("/")[0] for p in paths})))
    return out
