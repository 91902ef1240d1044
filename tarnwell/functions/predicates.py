"""Metadata and payload predicates, compiled to columns with two-valued logic.

Every leaf is true or false, never null: a missing field makes a leaf false and its negation true.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_CHILDREN, MOST_DEPTH, MOST_VALUES = 64, 16, 1024


def _steps(field: str) -> list[str]:
    """A top-level key, or the steps of a JSON pointer where the name starts with a slash."""
    if not field.startswith("/"):
        return [field]
    return [s.replace("~1", "/").replace("~0", "~") for s in field[1:].split("/")]


def variant_path(field: str) -> str:
    out = "$"
    for s in _steps(field):
        out += f"[{s}]" if s.isdigit() and field.startswith("/") else "['" + s.replace("\\", "\\\\").replace("'", "\\'") + "']"
    return out


class JsonField:
    """A value inside a JSON text column, with its type kept: 1, 1.0 and "1" are three values."""

    def __init__(self, column: str, field: str):
        self.value = F.try_variant_get(F.try_parse_json(F.col(column)), variant_path(field), "variant")
        self.tag = F.schema_of_variant(self.value)

    def as_type(self, name: str) -> Column:
        return F.try_variant_get(self.value, "$", name)

    def scalar_equals(self, v: object) -> Column:
        tag = self.tag
        if v is None:
            hit = tag == "VOID"
        elif isinstance(v, bool):
            hit = (tag == "BOOLEAN") & (self.as_type("boolean") == v)
        elif isinstance(v, int):
            hit = (tag == "BIGINT") & (self.as_type("bigint") == v)
        elif isinstance(v, float):
            hit = (tag.startswith("DECIMAL") | (tag == "DOUBLE")) & (self.as_type("double") == v)
        elif isinstance(v, str):
            hit = (tag == "STRING") & (self.as_type("string") == v)
        else:
            raise ValueError("only scalars can be compared")
        return F.coalesce(hit, F.lit(False))

    def number(self) -> Column:
        numeric = self.tag.startswith("DECIMAL") | self.tag.isin("DOUBLE", "BIGINT", "FLOAT")
        return F.when(numeric, self.as_type("double"))

    def elements_overlap(self, values: list) -> Column:
        """True where the value is an array with one of ``values``; elements are compared as JSON texts."""
        parts = F.transform(self.as_type("array<variant>"), lambda x: F.to_json(x))
        wanted = F.array(*[F.lit(json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for v in values])
        return F.coalesce(self.tag.startswith("ARRAY") & F.arrays_overlap(parts, wanted), F.lit(False))


@dataclass(frozen=True)
class Eq:
    field: str
    value: object


@dataclass(frozen=True)
class In:
    field: str
    values: tuple


@dataclass(frozen=True)
class Range:
    field: str
    gte: float | None = None
    lte: float | None = None


@dataclass(frozen=True)
class And:
    filters: tuple


@dataclass(frozen=True)
class Or:
    filters: tuple


@dataclass(frozen=True)
class Not:
    filter: object


Predicate = Eq | In | Range | And | Or | Not


def _scalar(v: object) -> bool:
    return v is None or isinstance(v, (bool, int, str)) or (isinstance(v, float) and math.isfinite(v))


def validate(p: Predicate, depth: int = 1) -> None:
    if depth > MOST_DEPTH:
        raise ValueError("filter nesting is too deep")
    match p:
        case Eq(_, v):
            if not _scalar(v):
                raise ValueError("eq takes a scalar")
        case In(_, vs):
            if not 1 <= len(vs) <= MOST_VALUES or not all(map(_scalar, vs)):
                raise ValueError("in takes 1 to 1024 scalars")
        case Range(_, a, b):
            bounds = [x for x in (a, b) if x is not None]
            if not bounds or not all(map(math.isfinite, bounds)) or (len(bounds) == 2 and a > b):
                raise ValueError("range takes at least one finite bound, in order")
        case And(fs) | Or(fs):
            if not 1 <= len(fs) <= MOST_CHILDREN:
                raise ValueError("and/or take 1 to 64 filters")
            for f in fs:
                validate(f, depth + 1)
        case Not(f):
            validate(f, depth + 1)
        case _:
            raise ValueError(f"unknown filter: {p!r}")


def compile_predicate(p: Predicate, metadata: str = "metadata") -> Column:
    """The predicate as a boolean column over a JSON text column."""
    validate(p)

    def build(p: Predicate) -> Column:
        match p:
            case Eq(f, v):
                return JsonField(metadata, f).scalar_equals(v)
            case In(f, vs):
                field = JsonField(metadata, f)
                return reduce(Column.__or__, [field.scalar_equals(v) for v in vs]) | field.elements_overlap(list(vs))
            case Range(f, a, b):
                x = JsonField(metadata, f).number()
                checks = ([] if a is None else [x >= float(a)]) + ([] if b is None else [x <= float(b)])
                return F.coalesce(reduce(Column.__and__, checks), F.lit(False))
            case And(fs):
                return reduce(Column.__and__, map(build, fs))
            case Or(fs):
                return reduce(Column.__or__, map(build, fs))
            case Not(f):
                return ~build(f)

    return build(p)


def from_json(spec: dict) -> Predicate:
    """A predicate from its JSON form, ``{"op": "eq", "field": ..., "value": ...}`` and so on."""
    op = spec.get("op")
    if op == "eq":
        return Eq(spec["field"], spec["value"])
    if op == "in":
        return In(spec["field"], tuple(spec["values"]))
    if op == "range":
        return Range(spec["field"], spec.get("gte"), spec.get("lte"))
    if op in ("and", "or"):
        return (And if op == "and" else Or)(tuple(from_json(x) for x in spec["filters"]))
    if op == "not":
        return Not(from_json(spec["filter"]))
    raise ValueError(f"unknown filter op: {op!r}")


def searchable(p: Predicate | None) -> bool:
    """Whether an approximate search can apply the predicate itself: equality with a non-null scalar, and, or."""
    match p:
        case None:
            return True
        case Eq(_, v):
            return v is not None
        case And(fs) | Or(fs):
            return all(map(searchable, fs))
    return False


def indexed(p: Predicate) -> bool:
    """Whether every leaf is an equality or a membership, which a value index can answer."""
    match p:
        case Eq() | In():
            return True
        case And(fs) | Or(fs):
            return all(map(indexed, fs))
        case Not(f):
            return indexed(f)
    return False


def flat_scalars(text: str | None) -> list[tuple[str, str, str]]:
    """(pointer, kind, value) of every scalar of a JSON text but nulls; array elements are named by their place."""
    out: list[tuple[str, str, str]] = []
    try:
        todo = [("", json.loads(text))] if text else []
    except ValueError:
        return out
    while todo:
        at, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{at}/{k.replace('~', '~0').replace('/', '~1')}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{at}/{i}", x) for i, x in enumerate(v)]
        elif v is not None:
            kind = "bool" if isinstance(v, bool) else "int" if isinstance(v, int) else "float" if isinstance(v, float) else "string"
            out.append((at, kind, v if kind == "string" else json.dumps(v)))
    return sorted(out)


def flatten(df: DataFrame, id_col: str, metadata: str) -> DataFrame:
    """(id, pointer, kind, value): the scalars of a JSON column, read in Arrow batches."""
    run = F.pandas_udf(lambda s: s.map(flat_scalars), "array<struct<pointer: string, kind: string, value: string>>")
    return df.select(id_col, F.explode(run(metadata)).alias("e")).select(id_col, "e.*")


# Payload predicates over typed columns.

_OPS = {
    "eq": lambda a, b: a == b, "neq": lambda a, b: a != b, "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b, "gt": lambda a, b: a > b, "gte": lambda a, b: a >= b,
}
_KINDS = {"bigint": int, "int": int, "double": float, "float": float, "string": str, "boolean": bool}


def _same_kind(kind: str, v: object) -> bool:
    want = _KINDS.get(kind)
    return want is not None and type(v) is want


def match(column: str, value: object) -> Column:
    """Whole-value equality, lists included; a missing value is false."""
    wanted = F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value)
    return F.coalesce(F.col(column) == wanted, F.lit(False))


def compare(column: str, kind: str, op: str, value: object) -> Column:
    """Comparison of a scalar column of SQL type ``kind``. Missing is false, also for ``neq``; another type is an
    error, and so is an order of booleans. A list of strings equals a string where it contains it."""
    if op not in _OPS:
        raise ValueError(f"unknown comparison: {op}")
    if kind == "array<string>" and isinstance(value, str) and op in ("eq", "neq"):
        has = F.array_contains(column, value)
        return F.coalesce(has if op == "eq" else ~has, F.lit(False))
    if not _same_kind(kind, value) or (isinstance(value, bool) and op not in ("eq", "neq")):
        raise TypeError(f"cannot compare {kind} with {value!r} by {op}")
    return F.coalesce(_OPS[op](F.col(column), F.lit(value)), F.lit(False))


def list_query(column: str, op: str, *args: object) -> Column:
    """``contains v``, ``equals list``, ``length op n`` or ``element i op v`` (from 0) of a list column; an element
    out of bounds fails the query."""
    if op == "contains":
        return F.coalesce(F.array_contains(column, args[0]), F.lit(False))
    if op == "equals":
        return match(column, list(args[0]))
    if op == "length":
        return F.coalesce(_OPS[args[0]](F.size(column), F.lit(args[1])) & F.col(column).isNotNull(), F.lit(False))
    if op == "element":
        i, cmp, v = args
        # Outside the list element_at fails the query, as it should.
        element = F.element_at(F.col(column), i + 1)
        return F.coalesce(_OPS[cmp](element, F.lit(v)), F.lit(False))
    raise ValueError(f"unknown list query: {op}")


def from_conditions(spec: dict, kinds: dict[str, str]) -> Column:
    """Conditions of nested ``and`` / ``or`` / ``not`` and ``{field: {"match": ...} | {"range": {...}}}`` as a column."""
    parts = []
    for key, body in spec.items():
        if key in ("and", "or"):
            parts.append(reduce(Column.__and__ if key == "and" else Column.__or__, [from_conditions(x, kinds) for x in body]))
        elif key == "not":
            parts.append(~from_conditions(body, kinds))
        elif "match" in body:
            parts.append(match(key, body["match"].get("value") if isinstance(body["match"], dict) else body["match"]))
        elif "range" in body:
            parts += [compare(key, kinds[key], op, v) for op, v in body["range"].items() if v is not None]
        else:
            raise ValueError(f"unsupported condition on {key}: {sorted(body)}")
    return reduce(Column.__and__, parts)
