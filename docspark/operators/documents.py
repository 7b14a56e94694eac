"""find, pipelines and modifiers for schemaless documents: rows with one VARIANT column.

A document's fields are read as a map of VARIANT values, so one table holds documents of
any shape, and a field may have another type in each. All are lazy column expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.errors import InvalidArgument
from docspark.functions import values as V
from docspark.functions.modifiers import checked
from docspark.functions.predicates import compile_variant_condition
from docspark.operators.find import window
from docspark.operators.pipeline import HUGE, _document, _number


def field(name: str, doc: str = "doc"):
    """A top-level field by its literal name; SQL NULL if it is missing."""
    return F.variant_get(F.col(doc), "$" + V.variant_step(name), "variant")


FIELDS = "map<string,variant>"


def fields(value: Column) -> Column:
    """The fields of a document; NULL for what isn't one."""
    return F.try_variant_get(value, "$", FIELDS)


def is_text(name: str, doc: str = "doc") -> Column:
    return F.coalesce(V.variant_rank(field(name, doc)) == V.STRING, F.lit(False))


def literal(v) -> Column:
    """Any value as a VARIANT."""
    if v is None:
        return F.parse_json(F.lit("null"))
    if isinstance(v, dict):
        parts = [x for k, inner in v.items() for x in (F.lit(k), literal(inner))]
        return F.to_variant_object(F.create_map(*parts)) if parts else F.parse_json(F.lit("{}"))
    if isinstance(v, (list, tuple)):
        return F.to_variant_object(F.array(*map(literal, v))) if v else F.parse_json(F.lit("[]"))
    return V.literal(v).cast("variant")


def find_documents(df: DataFrame, condition: dict | None = None, selector=None, order_by=None, skip: int = 0, limit: int = -1, doc: str = "doc") -> DataFrame:
    """Like find; explicit nulls differ from missing fields, and values of all types sort together."""
    out = df.where(compile_variant_condition(condition, doc)) if condition else df
    pairs = list(order_by.items()) if isinstance(order_by, dict) else list(order_by or ())
    if pairs:
        keys = [V.sort_key(field(name, doc)) for name, _ in pairs]
        out = out.orderBy(*[k.desc() if isinstance(way, (int, float)) and way < 0 else k.asc() for k, (_, way) in zip(keys, pairs)])
    out = window(out, skip, limit)
    if selector:
        # JSON leaves out missing fields and keeps explicit nulls.
        picked = F.struct(*[field(name, doc).alias(name) for name in dict.fromkeys(selector)])
        out = out.withColumn(doc, F.parse_json(F.to_json(picked)))
    return out


def group_documents(df: DataFrame, by: str, sums: dict[str, object], doc: str = "doc") -> DataFrame:
    """One row a value of the field ``by`` (missing and null are one): _id (VARIANT) and a sum for each name.

    A sum is of "$field", to which other values than numbers add nothing, or of a number for each document.
    """
    if not by.startswith("$"):
        raise InvalidArgument("the _id of a group is a field")
    value = field(by[1:], doc)
    aggs = []
    for name, arg in sums.items():
        if isinstance(arg, str) and arg.startswith("$"):
            x = field(arg[1:], doc)
            number = F.when(V.variant_rank(x) == V.NUMBER, F.try_variant_get(x, "$", "double"))
            aggs.append(F.coalesce(F.sum(number), F.lit(0.0)).alias(name))
        elif isinstance(arg, (int, float)) and not isinstance(arg, bool):
            aggs.append((F.count(F.lit(1)) * F.lit(arg)).alias(name))
        else:
            raise InvalidArgument(f"{name} sums a field or a number")
    grouped = df.groupBy(V.group_key(value).alias("__key")).agg(*aggs)
    return grouped.select(F.parse_json(F.col("__key.json")).alias("_id"), *sums)


def from_values(spark: SparkSession, docs: list[dict], doc: str = "doc") -> DataFrame:
    """Documents given as values of Python. Those that JSON can say come as JSON, others as literals."""
    texts, others = [], []
    for d in docs:
        try:
            texts.append((json.dumps(d, allow_nan=False),))
        except (TypeError, ValueError):
            others.append(d)
    out = spark.createDataFrame(texts, "j string").select(F.parse_json("j").alias(doc))
    for d in others:
        out = out.unionByName(spark.range(1).select(literal(d).alias(doc)))
    return out


def _with(known: Column, path: list[str], v: Column) -> Column:
    """Fields with v at a path. What is in the way and isn't a document is overwritten by one."""
    name, rest = path[0], path[1:]
    if rest:
        inner = F.coalesce(fields(F.try_element_at(known, F.lit(name))), F.create_map().cast(FIELDS))
        v = F.to_variant_object(_with(inner, rest, v))
    return F.map_concat(F.map_filter(known, lambda k, _: k != name), F.create_map(F.lit(name), v))


def _without(known: Column, path: list[str]) -> Column:
    """Fields without that at a path; nothing changes if there is none."""
    name, rest = path[0], path[1:]
    if not rest:
        return F.map_filter(known, lambda k, _: k != name)
    inner = fields(F.try_element_at(known, F.lit(name)))
    return F.when(inner.isNull(), known).otherwise(_with(known, [name], F.to_variant_object(_without(F.coalesce(inner, F.create_map().cast(FIELDS)), rest))))


def _added(old: Column, v) -> Column:
    """old + v: integers stay integers, a double makes a double, a missing value counts as 0. Anything else is an error."""
    whole = isinstance(v, int) and -(1 << 63) <= v < 1 << 63
    kind = F.schema_of_variant(old)
    double = (F.try_variant_get(old, "$", "double") + F.lit(float(v))).cast("variant")
    exact = (F.try_variant_get(old, "$", "bigint") + F.lit(v)).cast("variant") if whole else double
    wrong = F.raise_error(F.lit("$inc of a value that isn't a number")).cast("variant")
    return F.when(old.isNull(), V.literal(v).cast("variant")).when(kind == "BIGINT", exact).when(V.variant_rank(old) == V.NUMBER, double).otherwise(wrong)


def modify_documents(df: DataFrame, modifier: dict, condition: dict | None = None, doc: str = "doc") -> DataFrame:
    """$set, $unset and $inc of the documents that match; rules apply in order, each to the result of those before."""
    hit = compile_variant_condition(condition, doc) if condition else F.lit(True)
    out = df.withColumn("__hit", F.coalesce(hit, F.lit(False)))
    for rule, path, v in checked(modifier):
        known, steps = fields(F.col(doc)), path.split(".")
        if rule == "$set":
            new = _with(known, steps, literal(v))
        elif rule == "$unset":
            new = _without(known, steps)
        else:
            new = _with(known, steps, _added(F.try_element_at(known, F.lit(path)), v))
        out = out.withColumn(doc, F.when(F.col("__hit"), F.to_variant_object(new)).otherwise(F.col(doc)))
    return out.drop("__hit")


def _match(df: DataFrame, spec, doc: str) -> DataFrame:
    spec = _document(spec, "$match")
    return df.where(compile_variant_condition(spec, doc)) if spec else df


def _project(df: DataFrame, spec, doc: str) -> DataFrame:
    kinds = {k: v for k, v in _document(spec, "$project").items() if isinstance(v, int)}
    include, exclude = [k for k, v in kinds.items() if v == 1], [k for k, v in kinds.items() if v == 0]
    kept = F.map_filter(fields(F.col(doc)), lambda k, _: k.isin(include) if include else ~k.isin(exclude))
    return df.withColumn(doc, F.to_variant_object(kept))


def _sort(df: DataFrame, spec, doc: str) -> DataFrame:
    spec = _document(spec, "$sort")
    keys = [(V.sort_key(field(name, doc)), way) for name, way in spec.items()]
    return df.orderBy(*[k.desc() if isinstance(way, int) and way < 0 else k.asc() for k, way in keys]) if keys else df


def _limit(df: DataFrame, spec, doc: str) -> DataFrame:
    n = _number(spec, "$limit")
    return df if n is None or n < 0 else df.limit(min(n, HUGE))


def _skip(df: DataFrame, spec, doc: str) -> DataFrame:
    n = _number(spec, "$skip") or 0
    return df.limit(0) if n < 0 else df.offset(min(n, HUGE)) if n else df


def _count(df: DataFrame, spec, doc: str) -> DataFrame:
    name = spec if isinstance(spec, str) else spec.get("as", "count") if isinstance(spec, dict) else "count"
    if not name or not isinstance(name, str):
        raise InvalidArgument("$count needs a name")
    return df.agg(F.count(F.lit(1)).alias("n")).select(F.to_variant_object(F.create_map(F.lit(name), F.col("n").cast("variant"))).alias(doc))


def _unwind(df: DataFrame, spec, doc: str) -> DataFrame:
    """An element a document; an empty array drops its document, what isn't an array passes."""
    path = spec.get("path") if isinstance(spec, dict) else None
    if not isinstance(path, str) or not path.startswith("$"):
        raise InvalidArgument("$unwind needs {path: field}")
    name = path[1:]
    value = field(name, doc)
    several = F.coalesce(V.variant_rank(value) == V.ARRAY, F.lit(False))
    elements = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda x: F.to_variant_object(_with(fields(F.col(doc)), [name], F.coalesce(x, F.parse_json(F.lit("null"))))))
    out = F.when(several, elements).otherwise(F.array(F.col(doc)))
    return df.withColumn(doc, F.explode(out))


def _group(df: DataFrame, spec, doc: str) -> DataFrame:
    spec = dict(_document(spec, "$group"))
    key = spec.pop("_id", None)
    if not isinstance(key, str):
        raise InvalidArgument("the _id of $group is a field")
    sums = {}
    for name, acc in spec.items():
        if not isinstance(acc, dict) or list(acc) != ["$sum"]:
            raise InvalidArgument(f"{name} needs one known accumulator")
        sums[name] = acc["$sum"]
    out = group_documents(df, key, sums, doc)
    parts = [x for name in sums for x in (F.lit(name), F.col(V.quoted(name)).cast("variant"))]
    return out.select(F.to_variant_object(F.create_map(F.lit("_id"), F.coalesce("_id", F.parse_json(F.lit("null"))), *parts)).alias(doc))


STAGES: dict[str, Callable[[DataFrame, object, str], DataFrame]] = {
    "$match": _match, "$project": _project, "$sort": _sort, "$limit": _limit, "$skip": _skip, "$count": _count, "$group": _group, "$unwind": _unwind,
}


def aggregate_documents(df: DataFrame, stages: list[dict], doc: str = "doc") -> DataFrame:
    """The documents that a pipeline makes. A stage is its document's first key."""
    if not isinstance(stages, (list, tuple)):
        raise InvalidArgument("a pipeline is an array of stages")
    out = df.select(doc)
    for stage in stages:
        if not isinstance(stage, dict) or not stage or next(iter(stage)) not in STAGES:
            raise InvalidArgument("a stage is a document with a known name")
        name, spec = next(iter(stage.items()))
        out = STAGES[name](out, spec, doc)
    return out
