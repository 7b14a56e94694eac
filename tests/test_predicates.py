"""Compiled conditions against a plain evaluator, and the rules one by one."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument
from docspark.functions.predicates import compile_condition, compile_variant_condition
from docspark.functions.values import value_rank

NESTED = T.StructType().add("k", "integer").add("t", "string")
SCHEMA = T.StructType().add("id", "integer").add("x", "integer").add("y", "long").add("z", "double").add("s", "string").add("b", "boolean").add("d", NESTED).add("l", T.ArrayType(T.IntegerType()))
ABSENT = object()


def at(doc, path):
    for part in path.split("."):
        if not isinstance(doc, dict) or doc.get(part) is None:
            return ABSENT
        doc = doc[part]
    return doc


def same(a, b):
    return value_rank(a) == value_rank(b) and (a == b)


def holds(spec, v):
    if not (isinstance(spec, dict) and spec and next(iter(spec)).startswith("$")):
        spec = {"$eq": spec}
    for op, x in spec.items():
        here = v is not ABSENT
        if op == "$eq":
            ok = here and x is not None and same(v, x)
        elif op == "$ne":
            ok = not (here and x is not None and same(v, x))
        elif op == "$in":
            ok = here and any(i is not None and same(v, i) for i in x)
        elif op == "$nin":
            ok = not (here and any(i is not None and same(v, i) for i in x))
        elif op == "$exists":
            ok = here == bool(x)
        elif op == "$not":
            ok = not holds(x, v)
        else:
            if not here:
                ok = False
            else:
                a, b = value_rank(v), value_rank(x)
                if a != b:
                    order = (a > b) - (a < b)
                elif a in (4, 5):
                    order = 0
                else:
                    order = (v > x) - (v < x)
                ok = {"$gt": order > 0, "$gte": order >= 0, "$lt": order < 0, "$lte": order <= 0}[op]
        if not ok:
            return False
    return True


def evaluate(cond, doc):
    for key, v in cond.items():
        if key == "$and":
            ok = all(evaluate(c, doc) for c in v)
        elif key == "$or":
            ok = any(evaluate(c, doc) for c in v)
        elif key == "$nor":
            ok = not any(evaluate(c, doc) for c in v)
        else:
            ok = holds(v, at(doc, key))
        if not ok:
            return False
    return True


def random_condition(r, depth=2):
    literals = [0, 1, 2, -1, 1.0, 1.5, "a", "b", "", True, False, None, 2**40, [1, 2], {"k": 1, "t": "a"}]
    fields = ["x", "y", "z", "s", "b", "d.k", "d.t", "d", "l", "none", "x.y"]

    def operators(deep):
        out = {}
        for op in r.sample(["$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin", "$exists", "$not"], r.randint(1, 2)):
            if op in ("$in", "$nin"):
                out[op] = r.sample(literals, r.randint(0, 4))
            elif op == "$exists":
                out[op] = r.choice([True, False, 0, 1])
            elif op == "$not":
                out[op] = operators(deep - 1) if deep else {"$gt": 1}
            else:
                out[op] = r.choice(literals)
        return out

    cond = {}
    for _ in range(r.randint(0, 2)):
        cond[r.choice(fields)] = operators(1) if r.random() < 0.7 else r.choice(literals[:-2])
    if depth and r.random() < 0.5:
        cond[r.choice(["$and", "$or", "$nor"])] = [random_condition(r, depth - 1) for _ in range(r.randint(0, 3))]
    return cond


def random_docs(r, n):
    out = []
    for i in range(n):
        pick = lambda *xs: r.choice([None, *xs])
        d = pick({"k": pick(0, 1, 2), "t": pick("a", "b")})
        out.append({"id": i, "x": pick(-1, 0, 1, 2), "y": pick(0, 1, 2**40), "z": pick(0.0, 1.0, 1.5), "s": pick("", "a", "b"), "b": pick(True, False), "d": d, "l": pick([1, 2], [], [3])})
    return out


def test_random_conditions_match_the_evaluator(spark):
    r = random.Random(7)
    docs = random_docs(r, 60)
    df = spark.createDataFrame([tuple(d.values()) for d in docs], SCHEMA).cache()
    conditions = [random_condition(r) for _ in range(150)]
    flags = [F.coalesce(compile_condition(c, SCHEMA), F.lit(False)).alias(f"c{k}") for k, c in enumerate(conditions)]
    got = {row["id"]: row for row in df.select("id", *flags).collect()}
    for k, c in enumerate(conditions):
        for d in docs:
            assert got[d["id"]][f"c{k}"] == evaluate(c, d), (c, d)


@pytest.mark.parametrize(
    "cond, found",
    [
        ({"a": {"$exists": True}}, [1, 2, 3, 4]), ({"a": None}, [2]), ({"a": {"$ne": None}}, [0, 1, 3, 4]), ({"a": {"$gt": 5}}, [1, 3, 4]),
        ({"a": {"$lt": 5}}, [2]), ({"a": {"$in": [7, "x"]}}, [1, 3]), ({"a": {"$nin": [7]}}, [0, 2, 3, 4]), ({"n.k": {"$gte": 2}}, [4]), ({"a": {"$not": {"$gt": 5}}}, [0, 2]),
    ],
)
def test_variant_documents(spark, cond, found):
    docs = [{}, {"a": 7}, {"a": None}, {"a": "x"}, {"a": True, "n": {"k": 2}}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)], "i int, j string").select("i", F.parse_json("j").alias("doc"))
    assert [r.i for r in df.where(compile_variant_condition(cond)).orderBy("i").collect()] == found


@pytest.mark.parametrize(
    "cond", [{"$xor": []}, {"x": {"$regex": "a"}}, {"$and": {}}, {"x": {"$in": 3}}, {"x": {"$not": 3}}, {"x": {"$exists": 1.5}}, {"x": {"$exists": "yes"}}, [1]]
)
def test_bad_conditions_are_refused(cond):
    with pytest.raises(InvalidArgument):
        compile_condition(cond, SCHEMA)


def test_positive_comparisons_reach_the_scan(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    plan = df.where(compile_condition({"value": {"$gte": 50.0}, "event_type": {"$ne": "click"}}, df.schema)).select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(value,50.0)" in plan and "Not(EqualNullSafe(event_type,click))" in plan
    assert "Python" not in plan
