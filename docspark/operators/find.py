"""find and count: condition, selector, order, skip, limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.errors import InvalidArgument
from docspark.functions import values as V
from docspark.functions.predicates import compile_condition


def order_keys(df: DataFrame, spec, doubles_descend: bool) -> list[Column]:
    """Sort columns of a document of directions. Missing fields come first, last if descending; unknown ones don't count."""
    pairs = list(spec.items()) if isinstance(spec, dict) else [tuple(x) for x in spec or ()]
    out = []
    for name, way in pairs:
        if name not in df.columns:
            continue
        descends = isinstance(way, (int, float)) and not isinstance(way, bool) and way < 0 and (doubles_descend or isinstance(way, int))
        out.append(V.top(name).desc_nulls_last() if descends else V.top(name).asc_nulls_first())
    return out


def matched(df: DataFrame, condition: dict | None) -> DataFrame:
    return df.where(compile_condition(condition, df.schema)) if condition else df


def selected(df: DataFrame, selector) -> DataFrame:
    """The columns that the selector names, in its order; the values it gives them don't matter."""
    names = [n for n in dict.fromkeys(selector) if n in df.columns]
    return df.select(*map(V.top, names))


def window(df: DataFrame, skip: int = 0, limit: int = -1) -> DataFrame:
    """Rows behind the first ``skip``, at most ``limit`` of them if that is positive."""
    if skip > 0:
        df = df.offset(skip)
    return df.limit(limit) if limit > 0 else df


def find(df: DataFrame, condition: dict | None = None, selector=None, order_by=None, skip: int = 0, limit: int = -1) -> DataFrame:
    """Rows that match, sorted, then skipped and limited, then reduced to the selector's columns."""
    out = matched(df, condition)
    if order_by and (keys := order_keys(out, order_by, doubles_descend=True)):
        out = out.orderBy(*keys)
    out = window(out, skip, limit)
    return selected(out, selector) if selector else out


def count(df: DataFrame, condition: dict | None = None) -> DataFrame:
    """One row with the number of rows that match, as ``count``."""
    return matched(df, condition).agg(F.count(F.lit(1)).alias("count"))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that several rows have, with the number of rows. Missing fields are equal."""
    if not keys:
        raise InvalidArgument("no key")
    by = [V.top(k) if k in df.columns else F.lit(None).alias(k) for k in keys]
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
