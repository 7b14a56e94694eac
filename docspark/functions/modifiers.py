"""Modifier documents: $set, $unset and $inc as rewrites of columns.

Rules apply in order, each to the result of those before. Fields that a rule adds are
missing in documents that the update doesn't match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument
from docspark.functions import values as V

RULES = ("$set", "$unset", "$inc")


def checked(modifier: dict) -> list[tuple[str, str, object]]:
    """(rule, path, value) of a modifier, in order."""
    if not isinstance(modifier, dict) or not modifier:
        raise InvalidArgument("a modifier is a document of rules")
    out = []
    for rule, spec in modifier.items():
        if rule not in RULES:
            raise InvalidArgument(f"unknown modifier {rule}")
        if not isinstance(spec, dict):
            raise InvalidArgument(f"{rule} needs a document")
        for path, v in spec.items():
            if rule == "$inc":
                if "." in path:
                    raise InvalidArgument("$inc takes no nested path")
                if isinstance(v, bool) or V.value_rank(v) != V.NUMBER:
                    raise InvalidArgument("$inc needs a number")
            out.append((rule, path, v))
    return out


def document_literal(v, kind: T.DataType | None = None) -> Column:
    """A literal of any value, as a column of type ``kind`` if given."""
    if isinstance(v, dict):
        if not v:
            raise InvalidArgument("an empty document has no column type")
        out = F.struct(*[document_literal(x).alias(k) for k, x in v.items()])
    elif isinstance(v, (list, tuple)):
        out = F.array(*[document_literal(x) for x in v])
    else:
        out = V.literal(v, kind)
    return out.cast(kind) if kind is not None else out


def _wider(kind: T.DataType, v) -> T.DataType:
    """The type for a column of ``kind`` in which some rows become v."""
    if v is None:
        return kind
    if V.type_rank(kind) != V.value_rank(v):
        raise InvalidArgument("the value's type doesn't fit the field's column")
    if isinstance(v, float) and isinstance(kind, T.IntegralType):
        return T.DoubleType()
    if isinstance(v, int) and not isinstance(v, bool) and isinstance(kind, T.IntegralType) and not isinstance(kind, T.LongType):
        return kind if -(1 << 31) <= v < 1 << 31 and isinstance(kind, T.IntegerType) else T.LongType()
    return kind


def _set(df: DataFrame, hit: Column, path: str, v) -> DataFrame:
    name, dot, rest = path.partition(".")
    if not dot:
        if name not in df.columns:
            return df.withColumn(name, F.when(hit, document_literal(v)))
        if V.type_rank(df.schema[name].dataType) == V.NULL:
            return df.withColumn(name, F.when(hit, document_literal(v)))
        kind = _wider(df.schema[name].dataType, v)
        return df.withColumn(name, F.when(hit, document_literal(v, kind)).otherwise(V.top(name).cast(kind)))
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.StructType):
        # What isn't a document is overwritten by one; a column has one type, so in all rows or not at all.
        if name in df.columns and V.type_rank(df.schema[name].dataType) != V.NULL:
            raise InvalidArgument(f"{name} isn't a document")
        nested = v
        for part in reversed(rest.split(".")):
            nested = {part: nested}
        return df.withColumn(name, F.when(hit, document_literal(nested)))
    kind = df.schema[name].dataType
    return df.withColumn(name, F.when(hit, _with(V.top(name), kind, rest, v, hit)).otherwise(_with(V.top(name), kind, rest, v, F.lit(False))))


def _with(doc: Column, kind: T.StructType, path: str, v, hit: Column) -> Column:
    """``doc`` with v at path where hit; made from nothing where doc is missing."""
    name, dot, rest = path.partition(".")
    fields = []
    for f in kind:
        c = doc.getField(f.name)
        if f.name == name:
            if dot:
                if not isinstance(f.dataType, T.StructType):
                    raise InvalidArgument(f"{name} isn't a document")
                c = _with(c, f.dataType, rest, v, hit)
            else:
                wide = _wider(f.dataType, v)
                c = F.when(hit, document_literal(v, wide)).otherwise(c.cast(wide))
        fields.append(c.alias(f.name))
    if name not in kind.fieldNames():
        nested = v
        for part in reversed(rest.split(".") if dot else []):
            nested = {part: nested}
        fields.append(F.when(hit, document_literal(nested)).alias(name))
    return F.when(hit | doc.isNotNull(), F.struct(*fields))


def _without(doc: Column, kind: T.StructType, path: str, hit: Column) -> Column:
    name, dot, rest = path.partition(".")
    fields = []
    for f in kind:
        c = doc.getField(f.name)
        if f.name == name:
            if not dot:
                c = F.when(~hit, c)
            elif isinstance(f.dataType, T.StructType):
                c = _without(c, f.dataType, rest, hit)
        fields.append(c.alias(f.name))
    return F.when(doc.isNotNull(), F.struct(*fields))


def _unset(df: DataFrame, hit: Column, path: str) -> DataFrame:
    name, dot, rest = path.partition(".")
    if name not in df.columns:
        return df
    if not dot:
        return df.withColumn(name, F.when(~hit, V.top(name)))
    kind = df.schema[name].dataType
    return df.withColumn(name, _without(V.top(name), kind, rest, hit)) if isinstance(kind, T.StructType) else df


def _inc(df: DataFrame, hit: Column, name: str, v) -> DataFrame:
    if name not in df.columns or V.type_rank(df.schema[name].dataType) == V.NULL:
        return df.withColumn(name, F.when(hit, V.literal(v)))
    kind = df.schema[name].dataType
    if V.type_rank(kind) != V.NUMBER:
        raise InvalidArgument(f"{name} isn't a number")
    if isinstance(v, float) or isinstance(kind, (T.DoubleType, T.FloatType)):
        wide = T.DoubleType()
    elif isinstance(kind, T.DecimalType):
        wide = kind
    else:
        wide = T.IntegerType() if isinstance(kind, T.IntegerType) and -(1 << 31) <= v < 1 << 31 else T.LongType()
    old = V.top(name).cast(wide)
    return df.withColumn(name, F.when(hit, F.coalesce(old, F.lit(0).cast(wide)) + F.lit(v).cast(wide)).otherwise(old))


def apply_modifier(df: DataFrame, modifier: dict, hit: Column | None = None) -> DataFrame:
    """``df`` with the modifier applied to rows where ``hit`` (all if None).

    The match is computed before any rule, so a rule doesn't change who is matched.
    """
    rules = checked(modifier)
    where = F.lit(True) if hit is None else F.coalesce(hit, F.lit(False))
    out = df.withColumn("__hit", where)
    flag = F.col("__hit")
    for rule, path, v in rules:
        if rule == "$set":
            out = _set(out, flag, path, v)
        elif rule == "$unset":
            out = _unset(out, flag, path)
        else:
            out = _inc(out, flag, path, v)
    return out.drop("__hit")
