import pytest

from docspark.errors import CursorClosed, InvalidArgument
from docspark.operators.cursor import Cursor
from docspark.operators.find import count, find
from docspark.operators.pipeline import aggregate


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("alice", 30, "eng"), ("bob", 25, "eng"), ("carol", 35, "sales")], "name string, age int, dept string")


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([(i, 19 - i, "e") for i in range(20)], "a int, b int, extra string")


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_match_sort_project(people):
    out = aggregate(people, [{"$match": {"dept": "eng"}}, {"$sort": {"age": 1}}, {"$project": {"age": 0}}])
    assert rows(out) == [("bob", "eng"), ("alice", "eng")]


def test_sort_directions(people):
    assert [r[0] for r in rows(aggregate(people, [{"$sort": {"age": -1}}]))] == ["carol", "alice", "bob"]
    assert [r[0] for r in rows(aggregate(people, [{"$sort": {"age": -1.0}}]))] == ["bob", "alice", "carol"]
    assert [r[0] for r in rows(find(people, order_by={"age": -1.0}))] == ["carol", "alice", "bob"]
    assert aggregate(people, [{"$sort": {"nothing": 1}}]).count() == 3


def test_skip_limit_count(people):
    assert rows(aggregate(people, [{"$sort": {"name": 1}}, {"$skip": 1}, {"$limit": 1}, {"$project": {"name": 1}}])) == [("bob",)]
    assert rows(aggregate(people, [{"$match": {"dept": "eng"}}, {"$count": {"as": "total"}}])) == [(2,)]
    assert aggregate(people, [{"$count": "n"}]).columns == ["n"]
    assert rows(aggregate(people.limit(0), [{"$count": {}}])) == [(0,)]
    assert aggregate(people, [{"$limit": 0}]).count() == 0
    assert aggregate(people, [{"$limit": -1}]).count() == 3
    assert aggregate(people, [{"$skip": -1}]).count() == 0
    with pytest.raises(InvalidArgument):
        aggregate(people, [{"$limit": 1.0}])


def test_group(spark):
    pay = spark.createDataFrame([("eng", 100), ("eng", 200), ("sales", 150), (None, 1)], "dept string, salary int")
    out = aggregate(pay, [{"$group": {"_id": "$dept", "total": {"$sum": "$salary"}, "n": {"$sum": 1}, "zero": {"$sum": "$dept"}}}])
    assert sorted(rows(out), key=str) == [("eng", 300, 2, 0), ("sales", 150, 1, 0), (None, 1, 1, 0)]
    assert dict(out.dtypes)["total"] == "bigint"
    for bad in ({"_id": None}, {"_id": "dept"}, {"total": {"$sum": 1}}, {"_id": "$dept", "x": {"$avg": "$salary"}}, {"_id": "$dept", "x": {"$sum": 1, "$max": 2}}):
        with pytest.raises(InvalidArgument):
            aggregate(pay, [{"$group": bad}])
    assert rows(aggregate(pay, [{"$group": {"_id": None, "m": {"$max": "$salary"}}}], extensions=True)) == [(None, 200)]


def test_unwind(spark):
    df = spark.createDataFrame([("alice", ["a", "b"]), ("bob", []), ("carol", None)], "name string, tags array<string>")
    assert sorted(rows(aggregate(df, [{"$unwind": {"path": "$tags"}}])), key=str) == [("alice", "a"), ("alice", "b"), ("carol", None)]
    assert aggregate(df, [{"$unwind": {"path": "$name"}}]).count() == 3
    with pytest.raises(InvalidArgument):
        aggregate(df, [{"$unwind": "$tags"}])


@pytest.mark.parametrize("stages", [[{"$nothing": 1}], [{}], {"$match": {}}, [{"$match": 3}], [{"$lookup": {}}]])
def test_bad_stages(people, stages):
    with pytest.raises(InvalidArgument):
        aggregate(people, stages)


def test_find_chain(chain):
    out = find(chain, {"a": {"$gte": 5}}, {"a": 1, "b": 1}, {"b": 1}, skip=2, limit=5)
    assert out.columns == ["a", "b"] and [r[1] for r in rows(out)] == [2, 3, 4, 5, 6]


def test_find_edges(people):
    assert find(people, limit=0).count() == 3 and find(people, limit=-5, skip=-2).count() == 3
    assert find(people, selector={"dept": 0, "name": 1, "nothing": 1}).columns == ["dept", "name"]
    assert rows(count(people, {"age": {"$gt": 26}})) == [(2,)]


def test_top_k_is_one_operator(chain):
    plan = find(chain, order_by={"a": 1}, skip=1, limit=3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_cursor_batches(spark):
    c = Cursor(spark.range(250))
    assert [len(c.fetch_more()) for _ in range(3)] == [100, 100, 50] and not c.has_more
    with pytest.raises(CursorClosed):
        c.fetch_more()
    assert len(Cursor(spark.range(30), 7).collect_all()) == 30
    c = Cursor(spark.range(2))
    assert c.next().id == 0 and c.has_more and c.next().id == 1 and c.next() is None
