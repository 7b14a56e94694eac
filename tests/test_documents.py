import json

import pytest
from pyspark.sql import functions as F

from docspark.errors import InvalidArgument
from docspark.operators.documents import aggregate_documents, find_documents, group_documents, modify_documents

DOCS = [{"i": 0, "a": 2}, {"i": 1, "a": "x"}, {"i": 2}, {"i": 3, "a": None}, {"i": 4, "a": 1.5}, {"i": 5, "a": {"k": 1}}, {"i": 6, "a": [1]}, {"i": 7, "a": True}, {"i": 8, "a": 2.0}]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(json.dumps(d),) for d in DOCS], "j string").select(F.parse_json("j").alias("doc"))


def shown(df):
    return [json.loads(r.j) for r in df.select(F.to_json("doc").alias("j")).collect()]


def test_values_of_all_types_sort_together(docs):
    up = [d["i"] for d in shown(find_documents(docs, order_by=[("a", 1), ("i", 1)]))]
    assert up == [2, 3, 4, 0, 8, 1, 5, 6, 7]
    down = [d["i"] for d in shown(find_documents(docs, order_by={"a": -1, "i": -1}))]
    assert down == up[::-1]


def test_condition_window_selector(docs):
    out = find_documents(docs, {"a": {"$exists": True}}, ["a", "zz"], {"a": 1, "i": 1}, skip=0, limit=2)
    assert shown(out) == [{"a": None}, {"a": 1.5}]
    assert len(shown(find_documents(docs, {"a": None}))) == 1 and len(shown(find_documents(docs))) == len(DOCS)


def test_group(docs):
    rows = group_documents(docs, "$a", {"n": 1, "total": "$a"}).select(F.to_json("_id").alias("id"), "n", "total").collect()
    got = {r.id: (r.n, r.total) for r in rows}
    assert got[None] == (2, 0.0) and got["2"] == (2, 4.0) and got["1.5"] == (1, 1.5) and got['"x"'] == (1, 0.0)
    with pytest.raises(InvalidArgument):
        group_documents(docs, "a", {})


def made(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "j string").select(F.parse_json("j").alias("doc"))


def test_modifiers(spark):
    docs = made(spark, {"i": 1, "a": {"b": 1, "c": 2}, "n": 5}, {"i": 2, "a": "text", "n": 1.5}, {"i": 3}, {"i": 4, "a": [1]})
    out = modify_documents(docs, {"$set": {"a.b": [1, {"x": None}], "f": "new", "e": {}}, "$unset": {"a.c": 1, "zz": 1, "i.j": 1}, "$inc": {"n": 2}}, {"i": {"$lt": 4}})
    got = {d["i"]: d for d in shown(out)}
    same = {"b": [1, {"x": None}]}
    assert got[1] == {"i": 1, "a": same, "n": 7, "f": "new", "e": {}} and got[2] == {"i": 2, "a": same, "n": 3.5, "f": "new", "e": {}}
    assert got[3] == {"i": 3, "a": same, "n": 2, "f": "new", "e": {}} and got[4] == {"i": 4, "a": [1]}
    assert shown(modify_documents(made(spark, {"n": 2**60}), {"$inc": {"n": 1}})) == [{"n": 2**60 + 1}]
    with pytest.raises(Exception, match="isn't a number"):
        modify_documents(made(spark, {"n": "x"}), {"$inc": {"n": 1}}).collect()
    for bad in ({"$push": {"a": 1}}, {"$inc": {"a.b": 1}}, {"$set": 3}):
        with pytest.raises(InvalidArgument):
            modify_documents(docs, bad)


def test_pipeline_of_documents(spark):
    docs = made(spark, {"i": 1, "t": ["x", "y"]}, {"i": 2, "t": []}, {"i": 3}, {"i": 4, "t": "x"}, {"i": 5, "t": ["x", None]})
    out = aggregate_documents(docs, [{"$unwind": {"path": "$t"}}, {"$sort": {"i": 1, "t": -1}}])
    assert shown(out) == [{"i": 1, "t": "y"}, {"i": 1, "t": "x"}, {"i": 3}, {"i": 4, "t": "x"}, {"i": 5, "t": "x"}, {"i": 5, "t": None}]
    groups = shown(aggregate_documents(docs, [{"$unwind": {"path": "$t"}}, {"$group": {"_id": "$t", "n": {"$sum": 1}, "s": {"$sum": "$i"}}}]))
    assert sorted((str(g["_id"]), g["n"], g["s"]) for g in groups) == [("None", 2, 8.0), ("x", 3, 10.0), ("y", 1, 1.0)]
    assert shown(aggregate_documents(docs, [{"$match": {"i": {"$gt": 2}}}, {"$skip": 1}, {"$count": "n"}])) == [{"n": 2}]
    assert shown(aggregate_documents(docs, [{"$project": {"t": 0}}, {"$sort": {"i": -1}}, {"$limit": 1}])) == [{"i": 5}]
    for bad in ([{"$nope": 1}], [{}], 3, [{"$unwind": "$t"}], [{"$group": {"_id": "$t", "n": {"$max": "$i"}}}], [{"$count": ""}]):
        with pytest.raises(InvalidArgument):
            aggregate_documents(docs, bad)


def test_exact_numbers_dates_binary(spark):
    docs = made(spark, {"n": 2**53}, {"n": 2**53 + 1}, {"n": 2.0**53}, {"n": 1.5}, {"n": -3})
    assert shown(find_documents(docs, {"n": 2**53 + 1})) == [{"n": 2**53 + 1}]
    assert len(shown(find_documents(docs, {"n": {"$gte": 2**53}}))) == 3 and len(shown(find_documents(docs, {"n": {"$gt": 2**53}}))) == 1
    assert [d["n"] for d in shown(find_documents(docs, order_by={"n": -1}))][0] == 2**53 + 1
    rows = spark.sql("SELECT to_variant_object(map('v', v, 'i', i)) AS doc FROM VALUES (timestamp'2024-02-01'::variant, 1::variant), (timestamp'2023-02-01'::variant, 2::variant), (X'02'::variant, 3::variant), (X'01FF'::variant, 4::variant), (true::variant, 5::variant), ('z'::variant, 6::variant) AS t(v, i)")
    assert [d["i"] for d in shown(find_documents(rows, order_by={"v": 1}))] == [6, 4, 3, 5, 2, 1]


def test_names_with_quotes(spark):
    docs = made(spark, {"it's": 1, 'a"b': 2}, {"it's": 3})
    assert len(shown(find_documents(docs, {"it's": {"$gt": 1}}))) == 1 and len(shown(find_documents(docs, {'a"b': 2}))) == 1
    assert shown(modify_documents(docs, {"$set": {"it's": 0}}, {'a"b': 2}))[0]["it's"] == 0
    for bad in ("both ' and \"", ""):
        with pytest.raises(InvalidArgument):
            find_documents(docs, {bad: 1})
