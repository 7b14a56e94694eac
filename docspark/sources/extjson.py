"""Extended JSON: values that JSON lacks are objects with a $ key."""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.sources.bson import MaxKey, MinKey, ObjectId, Regex, Stamp

EPOCH = datetime.datetime(1970, 1, 1)


def to_jsonable(v):
    """A value as plain JSON data."""
    if isinstance(v, dict):
        return {k: to_jsonable(x) for k, x in v.items()}
    if isinstance(v, Regex):  # a tuple, too
        return {"$regex": v.pattern, "$options": v.options}
    if isinstance(v, (list, tuple)):
        return [to_jsonable(x) for x in v]
    if isinstance(v, ObjectId):
        return {"$oid": v.hex()}
    if isinstance(v, datetime.datetime):
        return {"$date": (v.replace(tzinfo=None) - EPOCH) // datetime.timedelta(milliseconds=1)}
    if isinstance(v, (bytes, bytearray)):
        return {"$binary": base64.b64encode(v).decode()}
    if isinstance(v, re.Pattern):
        return {"$regex": v.pattern, "$options": ""}
    if isinstance(v, Stamp):
        return {"$timestamp": int(v)}
    if isinstance(v, decimal.Decimal):
        return {"$decimal": str(v).encode().hex()}
    if v is MinKey:
        return {"$minKey": 1}
    if v is MaxKey:
        return {"$maxKey": 1}
    return v


_SPECIAL = {
    "$oid": lambda x: ObjectId.fromhex(x["$oid"]),
    "$date": lambda x: EPOCH + datetime.timedelta(milliseconds=x["$date"]),
    "$binary": lambda x: base64.b64decode(x["$binary"]),
    "$regex": lambda x: Regex(x["$regex"], x.get("$options", "")),
    "$timestamp": lambda x: Stamp(x["$timestamp"]),
    "$decimal": lambda x: decimal.Decimal(bytes.fromhex(x["$decimal"]).decode()),
    "$minKey": lambda x: MinKey,
    "$maxKey": lambda x: MaxKey,
}


def from_jsonable(v):
    """The value of plain JSON data."""
    if isinstance(v, list):
        return [from_jsonable(x) for x in v]
    if not isinstance(v, dict):
        return v
    first = next(iter(v), None)
    if first in _SPECIAL and (len(v) == 1 or first == "$regex"):
        return _SPECIAL[first](v)
    return {k: from_jsonable(x) for k, x in v.items()}


def dumps(doc) -> str:
    return json.dumps(to_jsonable(doc), ensure_ascii=False)


def loads(text: str):
    return from_jsonable(json.loads(text))


def _extended(c: Column, kind: T.DataType) -> Column:
    """A column with dates and binaries as their JSON objects."""
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        millis = F.unix_millis(c.cast("timestamp"))
        return F.when(c.isNotNull(), F.struct(millis.alias("$date")))
    if isinstance(kind, T.BinaryType):
        return F.when(c.isNotNull(), F.struct(F.base64(c).alias("$binary")))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_extended(c.getField(f.name), f.dataType).alias(f.name) for f in kind]))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _extended(x, kind.elementType))
    return c


def to_json_rows(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as extended JSON; missing fields are left out."""
    return df.select(F.to_json(F.struct(*[_extended(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema])).alias(name))


def from_json_rows(df: DataFrame, column: str = "json", name: str = "doc") -> DataFrame:
    """Schemaless documents: JSON text as a VARIANT column."""
    return df.select(F.parse_json(F.col(column)).alias(name))
