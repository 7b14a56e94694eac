"""Condition documents to boolean columns.

Predicates are two-valued: a comparison with a missing field is false, and its
negation true. Positive comparisons are emitted bare, so that they reach the scan; a
filter takes NULL for false anyway. Only beneath a negation NULL is made false.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument
from docspark.functions import values as V

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte")


def two_valued(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


class TypedField:
    """A field of a typed document; missing is NULL."""

    def __init__(self, path: str, schema: T.StructType):
        found = V.resolve(path, schema)
        self.column, self.kind = found if found else (None, None)

    def exists(self) -> Column:
        return F.lit(False) if self.column is None else self.column.isNotNull()

    def equal(self, v) -> Column:
        return F.lit(False) if self.column is None else V.equals(self.column, self.kind, v)

    def unequal(self, v) -> Column:
        if self.column is None or v is None or V.type_rank(self.kind) != V.value_rank(v):
            return F.lit(True)
        if V.type_rank(self.kind) in (V.DOCUMENT, V.ARRAY):
            return ~two_valued(self.equal(v))
        return ~self.column.eqNullSafe(V.literal(v, self.kind))

    def among(self, vs: list) -> Column:
        if self.column is None:
            return F.lit(False)
        rank = V.type_rank(self.kind)
        fitting = [v for v in vs if V.value_rank(v) == rank]
        if not fitting:
            return F.lit(False)
        if rank in (V.DOCUMENT, V.ARRAY):
            return reduce(lambda a, b: a | b, [two_valued(self.equal(v)) for v in fitting])
        return self.column.isin([V.literal(v, self.kind) for v in fitting])

    def ordered(self, op: str, v) -> Column:
        if self.column is None:
            return F.lit(False)
        a, b = V.type_rank(self.kind), V.value_rank(v)
        if a != b:
            return self.exists() if (a > b) == (op in ("$gt", "$gte")) else F.lit(False)
        if a in (V.DOCUMENT, V.ARRAY):
            return self.exists() if op in ("$gte", "$lte") else F.lit(False)
        return _order(self.column, op, V.literal(v, self.kind))


def _order(c: Column, op: str, v: Column) -> Column:
    return {"$gt": c > v, "$gte": c >= v, "$lt": c < v, "$lte": c <= v, "$eq": c == v}[op]


class VariantField:
    """A field of a document in a VARIANT column; explicit nulls differ from missing fields."""

    casts = {V.NUMBER: "double", V.STRING: "string", V.BOOLEAN: "boolean", V.DATE: "timestamp_ntz", V.BINARY: "binary"}

    def __init__(self, path: str, doc: Column):
        self.value = F.variant_get(doc, V.variant_path(path), "variant")

    def exists(self) -> Column:
        return self.value.isNotNull()

    def _rank(self) -> Column:
        return V.variant_rank(self.value)

    def _as(self, rank: int) -> Column:
        return F.try_variant_get(self.value, "$", self.casts[rank])

    def _compare(self, op: str, rank: int, v) -> Column:
        """Numbers compare as doubles, and exactly where doubles are equal."""
        if rank != V.NUMBER:
            return _order(self._as(rank), op, V.literal(v))
        double, exact = self._as(rank), F.try_variant_get(self.value, "$", V.EXACT)
        given = F.lit(float(v))
        if isinstance(v, float) or abs(v) >= 10**28:
            return _order(double, op, given)
        tie = F.coalesce(_order(exact, op, F.lit(str(v)).cast(V.EXACT)), F.lit(False))
        if op == "$eq":
            return (double == given) & tie
        return _order(double, op[:3], given) & (double != given) | (double == given) & tie

    def equal(self, v) -> Column:
        rank = V.value_rank(v)
        if rank == V.NULL:
            return F.is_variant_null(self.value)
        if rank in (V.DOCUMENT, V.ARRAY):
            import json

            return (self._rank() == rank) & (F.to_json(self.value) == F.to_json(F.parse_json(F.lit(json.dumps(v)))))
        return (self._rank() == rank) & self._compare("$eq", rank, v)

    def unequal(self, v) -> Column:
        return ~two_valued(self.equal(v))

    def among(self, vs: list) -> Column:
        return reduce(lambda a, b: a | b, [two_valued(self.equal(v)) for v in vs], F.lit(False))

    def ordered(self, op: str, v) -> Column:
        rank, up = V.value_rank(v), op in ("$gt", "$gte")
        other = (self._rank() > rank) if up else (self._rank() < rank)
        if rank in self.casts:
            same = self._compare(op, rank, v)
        else:
            same = F.lit(op in ("$gte", "$lte"))
        return other | ((self._rank() == rank) & two_valued(same))


def _is_operators(v) -> bool:
    return isinstance(v, dict) and bool(v) and next(iter(v)).startswith("$")


def _list(op: str, v) -> list:
    if not isinstance(v, (list, tuple)):
        raise InvalidArgument(f"{op} needs an array")
    return list(v)


def _flag(v) -> bool:
    if isinstance(v, (bool, int)):
        return bool(v)
    raise InvalidArgument("$exists needs a boolean or an integer")


def _field(f, spec) -> Column:
    if not _is_operators(spec):
        return f.equal(spec)
    parts = []
    for op, v in spec.items():
        if op == "$eq":
            parts.append(f.equal(v))
        elif op == "$ne":
            parts.append(f.unequal(v))
        elif op in COMPARISONS:
            parts.append(f.ordered(op, v))
        elif op == "$in":
            parts.append(f.among(_list(op, v)))
        elif op == "$nin":
            parts.append(~two_valued(f.among(_list(op, v))))
        elif op == "$exists":
            parts.append(f.exists() if _flag(v) else ~f.exists())
        elif op == "$not":
            if not _is_operators(v):
                raise InvalidArgument("$not needs a document of operators")
            parts.append(~two_valued(_field(f, v)))
        else:
            raise InvalidArgument(f"unknown operator {op}")
    return reduce(lambda a, b: a & b, parts)


def _condition(cond: dict, field) -> Column:
    if not isinstance(cond, dict):
        raise InvalidArgument("a condition is a document")
    parts = []
    for key, v in cond.items():
        if key in ("$and", "$or", "$nor"):
            inner = [_condition(x, field) for x in _list(key, v)]
            if key == "$and":
                parts.append(reduce(lambda a, b: a & b, inner, F.lit(True)) if not inner else reduce(lambda a, b: a & b, inner))
            else:
                some = reduce(lambda a, b: a | b, inner) if inner else F.lit(False)
                parts.append(some if key == "$or" else ~two_valued(some))
        elif key.startswith("$"):
            raise InvalidArgument(f"unknown operator {key}")
        else:
            parts.append(_field(field(key), v))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def compile_condition(cond: dict, schema: T.StructType) -> Column:
    """The boolean column of a condition over documents of that schema."""
    return _condition(cond, lambda path: TypedField(path, schema))


def compile_variant_condition(cond: dict, doc: Column | str = "doc") -> Column:
    """The boolean column of a condition over documents in a VARIANT column."""
    column = F.col(doc) if isinstance(doc, str) else doc
    return _condition(cond, lambda path: VariantField(path, column))
