"""Value semantics: ranks of types, paths into documents, literals, equality.

Two modes. In typed mode a field is a column with a type, and SQL NULL is a missing
field. In schemaless mode a document is one VARIANT column; a missing field is SQL
NULL there and an explicit null is a variant null.
"""

from __future__ import annotations

import datetime
import decimal
import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument

#: Order across types: a value of a lower rank is less than any of a higher one.
NULL, NUMBER, STRING, DOCUMENT, ARRAY, BINARY, BOOLEAN, DATE, REGEX = 1, 2, 3, 4, 5, 6, 8, 9, 11


def type_rank(t: T.DataType) -> int:
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return STRING
    if isinstance(t, (T.StructType, T.MapType)):
        return DOCUMENT
    if isinstance(t, T.ArrayType):
        return ARRAY
    if isinstance(t, T.BinaryType):
        return BINARY
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATE
    return NULL


def value_rank(v) -> int:
    if v is None:
        return NULL
    if isinstance(v, bool):  # before int, of which bool is a subclass
        return BOOLEAN
    if isinstance(v, (int, float, decimal.Decimal)):
        return NUMBER
    if isinstance(v, str):
        return STRING
    if isinstance(v, dict):
        return DOCUMENT
    if isinstance(v, (list, tuple)):
        return ARRAY
    if isinstance(v, (bytes, bytearray)):
        return BINARY
    if isinstance(v, (datetime.date, datetime.datetime)):
        return DATE
    if isinstance(v, re.Pattern):
        return REGEX
    raise TypeError(f"no rank for {type(v).__name__}")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def top(name: str) -> Column:
    """The column of that literal name, dots included."""
    return F.col(quoted(name))


def resolve(path: str, schema: T.StructType) -> tuple[Column, T.DataType] | None:
    """Column and type at a dotted path; None if no document has it.

    The path goes on into documents only, never into arrays.
    """
    column, kind = None, schema
    rest = path
    while True:
        name, dot, rest = rest.partition(".")
        if not isinstance(kind, T.StructType) or name not in kind.fieldNames():
            return None
        kind = kind[name].dataType
        column = top(name) if column is None else column.getField(name)
        if not dot:
            return column, kind


def literal(v, kind: T.DataType | None = None) -> Column:
    """A literal that compares with a column of type ``kind`` without a cast of that column."""
    if isinstance(v, datetime.datetime):
        if isinstance(kind, T.TimestampType):
            return F.lit(v)
        return F.lit(v.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz")
    if isinstance(v, int) and not isinstance(v, bool) and not -(1 << 63) <= v < 1 << 63:
        return F.lit(decimal.Decimal(v))
    if isinstance(v, bytearray):
        return F.lit(bytes(v))
    return F.lit(v)


def equals(c: Column, kind: T.DataType, v) -> Column:
    """Structural equality; NULL or false where the field is missing."""
    if v is None or type_rank(kind) != value_rank(v):
        return F.lit(False)
    if isinstance(kind, T.StructType):
        names = kind.fieldNames()
        if [n for n in names if n in v] != list(v):
            return F.lit(False)
        out = c.isNotNull()
        for f in kind:
            inner = c.getField(f.name)
            out = out & (F.coalesce(equals(inner, f.dataType, v[f.name]), F.lit(False)) if f.name in v else inner.isNull())
        return out
    if isinstance(kind, T.ArrayType):
        out = F.size(c) == len(v)
        for i, x in enumerate(v):
            out = out & F.coalesce(equals(F.get(c, i), kind.elementType, x), F.lit(False))
        return out
    if isinstance(kind, T.MapType):
        out = F.size(c) == len(v)
        for k, x in v.items():
            out = out & F.coalesce(equals(F.try_element_at(c, F.lit(k)), kind.valueType, x), F.lit(False))
        return out
    return c == literal(v, kind)


# ---- schemaless mode


def variant_step(name: str) -> str:
    """A field of that literal name, as a step of a variant path."""
    for quote in "'\"":
        if name and quote not in name:
            return f"[{quote}{name}{quote}]"
    raise InvalidArgument(f"no path to a field of the name {name!r}")


def variant_path(path: str) -> str:
    return "$" + "".join(map(variant_step, path.split(".")))


def variant_rank(v: Column) -> Column:
    """Rank of a variant value; NULL where it is missing."""
    kind = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None).cast("int"))
        .when(F.is_variant_null(v), NULL)
        .when(kind.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)"), NUMBER)
        .when(kind == "STRING", STRING)
        .when(kind.startswith("OBJECT"), DOCUMENT)
        .when(kind.startswith("ARRAY"), ARRAY)
        .when(kind == "BINARY", BINARY)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind.rlike("^(DATE|TIMESTAMP)"), DATE)
    )


#: Enough for all integers of 64 bits; larger numbers are told apart as doubles.
EXACT = "decimal(38,10)"


def number_key(v: Column) -> Column:
    """Orders numbers of all types: as doubles, and exactly where doubles are equal."""
    return F.struct(F.try_variant_get(v, "$", "double").alias("double"), F.try_variant_get(v, "$", EXACT).alias("exact"))


def sort_key(v: Column) -> Column:
    """A key that puts variant values into the order across types, missing ones first."""
    rank = variant_rank(v)

    def of(kind: int, key: Column) -> Column:
        return F.when(rank == kind, key)

    return F.struct(
        rank.alias("rank"),
        of(NUMBER, number_key(v)).alias("number"),
        of(STRING, F.try_variant_get(v, "$", "string")).alias("string"),
        of(BINARY, F.try_variant_get(v, "$", "binary")).alias("binary"),
        of(BOOLEAN, F.try_variant_get(v, "$", "boolean")).alias("boolean"),
        of(DATE, F.try_variant_get(v, "$", "timestamp")).alias("date"),
    )


def group_key(v: Column) -> Column:
    """A key equal for equal variant values; missing and null are one group."""
    return F.struct(F.coalesce(variant_rank(v), F.lit(NULL)).alias("rank"), F.when(~F.is_variant_null(v), F.to_json(v)).alias("json"))
