"""Aggregation pipelines: a fold of stages over a lazy DataFrame.

Stages: $match, $project, $sort, $limit, $skip, $count, $group and $unwind. With
``extensions``, $group also takes null or compound ids and $avg, $min, $max, $push,
$addToSet, $first and $last, and $lookup joins another collection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument
from docspark.functions import values as V
from docspark.operators.find import matched, order_keys

HUGE = (1 << 31) - 1


def _document(spec, stage: str) -> dict:
    if not isinstance(spec, dict):
        raise InvalidArgument(f"{stage} needs a document")
    return spec


def _number(spec, stage: str) -> int | None:
    """n of an integer or {n: integer}; None for other documents and strings."""
    if isinstance(spec, dict):
        spec = spec.get("n")
    if isinstance(spec, bool) or isinstance(spec, float):
        raise InvalidArgument(f"{stage} needs an integer")
    return spec if isinstance(spec, int) else None


def _match(df: DataFrame, spec, ext: bool) -> DataFrame:
    return matched(df, _document(spec, "$match"))


def _project(df: DataFrame, spec, ext: bool) -> DataFrame:
    kinds = {k: v for k, v in _document(spec, "$project").items() if isinstance(v, int)}
    include = [k for k, v in kinds.items() if v == 1]
    if include:
        return df.select(*[V.top(k) for k in include if k in df.columns])
    exclude = {k for k, v in kinds.items() if v == 0}
    return df.select(*[V.top(c) for c in df.columns if c not in exclude])


def _sort(df: DataFrame, spec, ext: bool) -> DataFrame:
    keys = order_keys(df, _document(spec, "$sort"), doubles_descend=False)
    return df.orderBy(*keys) if keys else df


def _limit(df: DataFrame, spec, ext: bool) -> DataFrame:
    n = _number(spec, "$limit")
    return df if n is None or n < 0 else df.limit(min(n, HUGE))


def _skip(df: DataFrame, spec, ext: bool) -> DataFrame:
    n = _number(spec, "$skip") or 0
    if n < 0:  # counts as more than any input has
        return df.limit(0)
    return df.offset(min(n, HUGE)) if n else df


def _count(df: DataFrame, spec, ext: bool) -> DataFrame:
    name = spec if isinstance(spec, str) else spec.get("as", "count") if isinstance(spec, dict) else "count"
    if not name or not isinstance(name, str):
        raise InvalidArgument("$count needs a name")
    return df.agg(F.count(F.lit(1)).alias(name))


def _operand(df: DataFrame, arg) -> tuple[Column | None, T.DataType | None]:
    """Column and type of "$field"; (None, None) if there is no such column."""
    name = arg[1:]
    return (V.top(name), df.schema[name].dataType) if name in df.columns else (None, None)


def _sum(df: DataFrame, arg) -> Column:
    if isinstance(arg, str) and arg.startswith("$"):
        column, kind = _operand(df, arg)
        if column is None or V.type_rank(kind) != V.NUMBER:
            return F.sum(F.lit(0).cast("long"))
        return F.coalesce(F.sum(column), F.lit(0))
    if isinstance(arg, bool) or not isinstance(arg, (int, float)):
        return F.sum(F.lit(0).cast("long"))
    return F.count(F.lit(1)) * F.lit(arg)


EXTRA: dict[str, Callable[[Column], Column]] = {
    "$avg": F.avg, "$min": F.min, "$max": F.max, "$push": F.collect_list, "$addToSet": F.collect_set, "$first": F.first, "$last": F.last,
}


def _accumulator(df: DataFrame, name: str, spec, ext: bool) -> Column:
    if not isinstance(spec, dict) or len(spec) != 1:
        raise InvalidArgument(f"{name} needs one accumulator")
    (op, arg), = spec.items()
    if op == "$sum":
        return _sum(df, arg).alias(name)
    if ext and op in EXTRA:
        if not isinstance(arg, str) or not arg.startswith("$"):
            raise InvalidArgument(f"{op} needs a field")
        column, _ = _operand(df, arg)
        return EXTRA[op](F.lit(None) if column is None else column).alias(name)
    raise InvalidArgument(f"unknown accumulator {op}")


def _group(df: DataFrame, spec, ext: bool) -> DataFrame:
    spec = dict(_document(spec, "$group"))
    if "_id" not in spec:
        raise InvalidArgument("$group needs an _id")
    key = spec.pop("_id")
    if isinstance(key, str) and key.startswith("$"):
        column, _ = _operand(df, key)
        by = F.lit(None).cast("string") if column is None else column
    elif ext and key is None:
        by = F.lit(None).cast("string")
    elif ext and isinstance(key, dict) and key:
        by = F.struct(*[_operand(df, v)[0].alias(k) for k, v in key.items()])
    else:
        raise InvalidArgument("the _id of $group is a field")
    aggs = [_accumulator(df, name, s, ext) for name, s in spec.items()]
    grouped = df.groupBy(by.alias("_id"))
    return grouped.agg(*aggs) if aggs else df.select(by.alias("_id")).distinct()


def _unwind(df: DataFrame, spec, ext: bool) -> DataFrame:
    path = spec.get("path") if isinstance(spec, dict) else spec if ext else None
    if not isinstance(path, str) or not path.startswith("$"):
        raise InvalidArgument("$unwind needs {path: field}")
    name = path[1:]
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.ArrayType):
        return df
    c = V.top(name)
    # An empty array drops its document; a missing one passes.
    full = df.where(c.isNull() | (F.size(c) > 0))
    return full.select(*[F.explode_outer(c).alias(name) if x == name else V.top(x) for x in df.columns])


STAGES: dict[str, Callable[[DataFrame, object, bool], DataFrame]] = {
    "$match": _match, "$project": _project, "$sort": _sort, "$limit": _limit, "$skip": _skip, "$count": _count, "$group": _group, "$unwind": _unwind,
}


def _lookup(df: DataFrame, spec, collections: dict[str, DataFrame]) -> DataFrame:
    """Extension: the documents of another collection whose field is equal, as an array."""
    try:
        other, local, foreign, name = (spec[k] for k in ("from", "localField", "foreignField", "as"))
        right = collections[other]
    except (KeyError, TypeError):
        raise InvalidArgument("$lookup needs from, localField, foreignField and as, and a known collection") from None
    lists = right.where(V.top(foreign).isNotNull()).groupBy(V.top(foreign).alias("__k")).agg(F.collect_list(F.struct(*map(V.top, right.columns))).alias("__found"))
    joined = df.join(lists, V.top(local) == F.col("__k"), "left")
    empty = F.array().cast(lists.schema["__found"].dataType)
    kept = [c for c in df.columns if c != name]
    return joined.select(*map(V.top, kept), F.coalesce("__found", empty).alias(name))


def aggregate(df: DataFrame, stages: list[dict], extensions: bool = False, collections: dict[str, DataFrame] | None = None) -> DataFrame:
    """The result of a pipeline. A stage is its document's first key."""
    if not isinstance(stages, (list, tuple)):
        raise InvalidArgument("a pipeline is an array of stages")
    for stage in stages:
        if not isinstance(stage, dict) or not stage:
            raise InvalidArgument("a stage is a document")
        name, spec = next(iter(stage.items()))
        if name == "$lookup" and extensions:
            df = _lookup(df, spec, collections or {})
        elif name in STAGES:
            df = STAGES[name](df, spec, extensions)
        else:
            raise InvalidArgument(f"unknown stage {name}")
    return df
