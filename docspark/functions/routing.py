"""Routing expressions: hash and range groups of a shard key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument
from docspark.functions import values as V

MASK = (1 << 32) - 1


def hash_value(v) -> int:
    """The 32-bit routing hash of a literal."""
    rank = V.value_rank(v)
    if rank == V.NUMBER:
        return int(v) & MASK
    if rank == V.STRING:
        h = 0
        for b in v.encode():
            h = (h * 31 + b) & MASK
        return h
    return 0


def hash_column(c: Column, kind: T.DataType) -> Column:
    """The same of a column: integers truncated, doubles by their integer part, strings by a polynomial over bytes."""
    if isinstance(kind, T.IntegralType):
        return c.cast("long").bitwiseAND(F.lit(MASK))
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return c.cast("long").bitwiseAND(F.lit(MASK))
    if V.type_rank(kind) == V.STRING:
        at = F.sequence(F.lit(1), F.greatest(F.octet_length(c), F.lit(1)))
        codes = F.transform(at, lambda i: F.conv(F.hex(F.substring(c.cast("binary"), i, 1)), 16, 10).cast("long"))
        total = F.aggregate(F.filter(codes, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(F.lit(MASK)))
        return F.when(F.octet_length(c) == 0, F.lit(0).cast("long")).otherwise(total)
    return F.lit(0).cast("long")


def hash_group(c: Column, kind: T.DataType, groups: int) -> Column:
    """Group 1 to ``groups``; NULL for a document without the key, which has no group."""
    if groups < 1:
        raise InvalidArgument("at least one group")
    return F.when(c.isNotNull(), F.pmod(hash_column(c, kind), F.lit(groups)) + 1).cast("int")


def range_group(c: Column, kind: T.DataType, ranges: list[dict]) -> Column:
    """Group of the first range with low <= value < up (an absent bound is open); group 1 if there is none."""
    out = None
    for r in ranges:
        inside = c.isNotNull()
        for op, bound in ((">=", r.get("low")), ("<", r.get("up"))):
            if bound is not None:
                if V.value_rank(bound) != V.type_rank(kind):
                    inside = inside & F.lit((V.type_rank(kind) > V.value_rank(bound)) == (op == ">="))
                else:
                    v = V.literal(bound, kind)
                    inside = inside & ((c >= v) if op == ">=" else (c < v))
        out = F.when(inside, r["group"]) if out is None else out.when(inside, r["group"])
    fallback = F.when(c.isNotNull(), F.lit(1))
    return (fallback if out is None else out.otherwise(fallback)).cast("int")
