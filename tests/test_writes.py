"""Modifiers, collections, indexes, transactions, SQL, change log."""

import pytest
from pyspark.sql import functions as F

from docspark.errors import (
    CollectionExists,
    CollectionNotFound,
    DuplicateKey,
    IndexExists,
    IndexNotFound,
    InvalidArgument,
    SpaceExists,
    SpaceNotFound,
    TransactionError,
)
from docspark.functions.modifiers import apply_modifier
from docspark.functions.predicates import compile_condition
from docspark.streaming import changelog


def one(df):
    return df.collect()[0].asDict(recursive=True)


def test_set_unset_inc(spark):
    df = spark.createDataFrame([(1, 10, "n", (1, 2))], "x int, count int, name string, a struct<b: int, c: int>")
    out = one(apply_modifier(df, {"$set": {"x": 5, "new": "v", "a.b": 9}, "$inc": {"count": 5, "fresh": 2}, "$unset": {"name": 1, "a.c": 1, "nothing": 1}}))
    assert out == {"x": 5, "count": 15, "name": None, "a": {"b": 9, "c": None}, "new": "v", "fresh": 2}


def test_inc_promotes(spark):
    df = spark.createDataFrame([(10, None)], "val int, m bigint")
    out = apply_modifier(df, {"$inc": {"val": 1.5, "m": 3}})
    assert dict(out.dtypes) == {"val": "double", "m": "bigint"} and one(out) == {"val": 11.5, "m": 3}
    assert dict(apply_modifier(df, {"$inc": {"val": 2**40}}).dtypes)["val"] == "bigint"


def test_set_makes_documents_and_rules_apply_in_order(spark):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    out = apply_modifier(df, {"$set": {"p.q.r": 3}, "$inc": {"x": 1}}, compile_condition({"x": 1}, df.schema))
    assert [r.asDict(recursive=True) for r in out.collect()] == [{"x": 2, "p": {"q": {"r": 3}}}, {"x": 2, "p": None}]
    deep = apply_modifier(out, {"$set": {"p.q.s": "t"}})
    assert one(deep)["p"]["q"] == {"r": 3, "s": "t"}


@pytest.mark.parametrize("modifier", [{"$push": {"x": 1}}, {"$set": 3}, {"$inc": {"x": "a"}}, {"$inc": {"a.b": 1}}, {"$inc": {"s": 1}}, {}, {"$set": {"x": "text"}}])
def test_bad_modifiers(spark, modifier):
    df = spark.createDataFrame([(1, "s")], "x int, s string")
    with pytest.raises(InvalidArgument):
        apply_modifier(df, modifier)


def test_collections(db):
    c = db.create_collection("cs.herons")
    c.insert_many([{"name": "mira", "wing": 30}, {"name": "tove", "wing": 25}])
    c.insert({"name": "ansel", "shore": "sf"})
    assert c.count() == 3 and c.count({"wing": {"$gte": 26}}) == 1
    before = c.df()
    c.update({"name": "tove"}, {"$inc": {"wing": 1}})
    assert c.find({"name": "tove"}, {"wing": 1}).collect()[0].wing == 26
    assert before.where("name = 'tove'").collect()[0].wing == 25, "a version that was read stays"
    c.delete({"wing": {"$exists": False}})
    assert c.count() == 2 and db.collections() == ["cs.herons"]
    assert [len(x) for x in [list(c.cursor())]] == [2]
    assert c.aggregate([{"$count": {"as": "n"}}]).collect()[0].n == 2


def test_types_widen(db):
    c = db.create_collection("cs.t")
    c.insert({"x": 1})
    c.insert({"x": 2.5})
    assert sorted(r.x for r in c.df().collect()) == [1.0, 2.5]


def test_names(db):
    with pytest.raises(SpaceExists):
        db.create_collection_space("cs")
    with pytest.raises(SpaceNotFound):
        db.create_collection("zz.t")
    with pytest.raises(CollectionNotFound):
        db["cs.none"]
    with pytest.raises(InvalidArgument):
        db["plain"]
    db.create_collection("cs.t")
    with pytest.raises(CollectionExists):
        db.create_collection("cs.t")
    db.drop_collection("cs.t")
    assert db.collections() == []
    db.create_collection("cs.u")
    db.drop_collection_space("cs")
    with pytest.raises(SpaceNotFound):
        db["cs.u"]


def test_indexes(db):
    c = db.create_collection("cs.t")
    c.insert_many([{"x": 1, "y": "a"}, {"x": 1, "y": "b"}])
    with pytest.raises(DuplicateKey):
        c.create_index("by_x", {"x": 1}, unique=True)
    c.create_index("by_y", {"y": 1}, unique=True)
    with pytest.raises(IndexExists):
        c.create_index("by_y", {"y": -1})
    with pytest.raises(DuplicateKey):
        c.insert({"x": 5, "y": "a"})
    with pytest.raises(DuplicateKey):
        c.insert_many([{"x": 5}, {"x": 6}])
    with pytest.raises(DuplicateKey):
        c.update({}, {"$set": {"y": "same"}})
    assert c.count() == 2
    c.drop_index("by_y")
    with pytest.raises(IndexNotFound):
        c.drop_index("by_y")


def test_transactions(db):
    c = db.create_collection("cs.t", "x int")
    with db.transaction() as t:
        t.insert("cs.t", [{"x": 1}, {"x": 2}])
        assert c.count() == 0, "reads don't see the buffer"
        t.update("cs.t", {"x": 1}, {"$set": {"x": 7}})
    assert sorted(r.x for r in c.df().collect()) == [2, 7]
    t = db.transaction()
    t.delete("cs.t")
    t.rollback()
    with pytest.raises(TransactionError):
        t.commit()
    with pytest.raises(InvalidArgument), db.transaction() as t:
        t.delete("cs.t", {"x": 2})
        t.update("cs.t", {}, {"$push": {"x": 1}})
    assert c.count() == 2, "what a failed commit did is undone"
    assert {r.op for r in db.changes().collect()} >= {"txnBegin", "txnCommit", "txnAbort", "insert", "update"}


def test_an_aborted_transaction_leaves_no_entries(db):
    c = db.create_collection("cs.t", "k int, v string")
    c.create_index("k", {"k": 1}, unique=True)
    c.insert_many([{"k": 1, "v": "a"}, {"k": 2, "v": "b"}])
    with pytest.raises(DuplicateKey), db.transaction() as t:
        t.insert("cs.t", {"k": 3, "v": "c"})
        t.insert("cs.t", {"k": 1, "v": "d"})
    with db.transaction() as t:
        t.insert("cs.t", {"k": 4, "v": "e"})
        t.update("cs.t", {"k": 4}, {"$set": {"v": "f"}, "$inc": {"k": 1}})
        t.delete("cs.t", {"k": 2})
    want = [(1, "a"), (5, "f")]
    assert sorted(map(tuple, c.df().collect())) == want
    assert sorted(map(tuple, changelog.replay(db.changes(), c._schema(), "cs.t", ["k"]).collect())) == want
    log = db.changes().orderBy("lsn").collect()
    assert [r.lsn for r in log] == list(range(len(log))) == list(range(db.lsn)) and [r.prevLsn for r in log[1:]] == list(range(len(log) - 1))
    assert [r.op for r in log][-7:] == ["txnBegin", "txnAbort", "txnBegin", "insert", "update", "delete", "txnCommit"]
    assert len({r.txnId for r in log[-5:]}) == 1


def test_keys_may_be_swapped(db):
    c = db.create_collection("cs.t")
    c.insert_many([{"k": 1, "v": "a"}, {"k": -1, "v": "b"}])
    c.update({"v": "a"}, {"$inc": {"k": -2}})
    c.update({"v": "b"}, {"$inc": {"k": 2}})
    assert sorted(map(tuple, changelog.replay(db.changes(), c._schema(), "cs.t", ["k"]).collect())) == [(1, "b")], "k = -1 was taken by a, then left by b"
    c.update({}, {"$inc": {"k": 1}})
    db.drop_collection("cs.t")
    db.create_collection("cs.t").insert({"k": 9, "v": "z"})
    assert list(map(tuple, changelog.replay(db.changes(), db["cs.t"]._schema(), "cs.t", ["k"]).collect())) == [(9, "z")]


def test_an_interrupted_write_is_finished(spark, db, monkeypatch):
    from docspark.sources.catalog import Database

    c = db.create_collection("cs.t", "k int")
    c.insert({"k": 1})
    monkeypatch.setattr(Database, "_finish", lambda self: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        c.insert({"k": 2})
    assert c.count() == 1, "nothing is seen before it is published"
    monkeypatch.undo()
    again = Database(spark, db.root)
    assert again["cs.t"].count() == 2 and again.changes().where("op = 'insert'").count() == 2
    again["cs.t"].insert({"k": 3})
    assert sorted(r.lsn for r in again.changes().collect()) == list(range(again.lsn))


def test_sql(db):
    db.sql("CREATE TABLE cs.herons (name VARCHAR(20) NOT NULL, wing INT)")
    db.sql("INSERT INTO cs.herons (name, wing) VALUES ('mira', 30), ('tove b', 25), ('c''d', -5)")
    assert db.sql("SELECT * FROM cs.herons").count() == 3
    assert [r.name for r in db.sql("SELECT name FROM cs.herons WHERE wing > 0 ORDER BY wing DESC LIMIT 1 OFFSET 1").collect()] == ["tove b"]
    assert db.sql("SELECT name FROM cs.herons WHERE wing >= 25 AND name <> 'mira'", strict=True).count() == 1
    assert db.sql("SELECT name FROM cs.herons LIMIT 0").count() == 0
    db.sql("UPDATE cs.herons SET wing = 26 WHERE name = 'tove b'")
    db.sql("DELETE FROM cs.herons WHERE wing < 0")
    assert sorted(r.wing for r in db.sql("SELECT * FROM cs.herons").collect()) == [26, 30]
    assert db.sql("SELECT max(wing) AS m FROM cs.herons GROUP BY name IS NULL").collect()[0].m == 30
    for bad in ("SELECT FROM cs.herons", "UPDATE cs.herons SET wing = 1 WHERE wing LIKE 3", "DELETE FROM cs.herons WHERE", "EXPLODE", "INSERT INTO cs.herons VALUES (1, 2, 3)"):
        with pytest.raises(InvalidArgument):
            db.sql(bad, strict=True)
    db.sql("DROP TABLE cs.herons")
    assert db.collections() == []
    db.sql("CREATE TABLE other.t (x INT)")
    assert db.collections() == ["other.t"]


def test_change_log(spark, db, tmp_path):
    c = db.create_collection("cs.t", "k int, v string")
    start = db.lsn
    c.insert_many([{"k": i, "v": "a"} for i in range(4)])
    c.update({"k": 1}, {"$set": {"v": "b"}})
    c.delete({"k": 2})
    log = db.changes(start)
    assert log.groupBy("op").count().count() == 3 and log.count() == 6
    lsns = [r.lsn for r in log.orderBy("lsn").collect()]
    assert len(set(lsns)) == 6 and db.changes(db.lsn).count() == 0
    state = changelog.replay(db.changes(), c._schema(), "cs.t", ["k"])
    assert sorted(tuple(r) for r in state.collect()) == sorted(tuple(r) for r in c.df().collect())
    seen = []
    run = changelog.replay_stream(db.watch("cs.t", start), str(tmp_path / "point"), lambda batch, i: seen.extend(r.op for r in batch.collect()))
    run.awaitTermination()
    assert sorted(seen) == ["delete", "insert", "insert", "insert", "insert", "update"]
    c.insert({"k": 9, "v": "z"})
    run = changelog.replay_stream(db.watch("cs.t", start), str(tmp_path / "point"), lambda batch, i: seen.extend(r.op for r in batch.collect()))
    run.awaitTermination()
    assert len(seen) == 7, "a tail goes on where it stopped"


def test_snapshots(db):
    db.create_collection("cs.t", "x int").insert({"x": 1})
    assert db.snapshot("database").collect()[0].inserts == 1
    assert db.snapshot("health").collect()[0].status == "ok"
    assert db.snapshot("collections").where(F.col("Name") == "cs.t").count() == 1
    assert db.snapshot("sessions").count() == 1
    with pytest.raises(InvalidArgument):
        db.snapshot("weather")


def test_schemaless_collections(spark, db):
    import datetime
    import json

    c = db.space("cs").create_collection("t", schemaless=True)
    c.create_index("i", {"i": 1}, unique=True)
    c.insert({"i": 1, "x": 1})
    c.insert([{"i": 2, "x": "s"}, {"i": 3, "x": {"y": [1, None]}}, {"i": 4, "at": datetime.datetime(2024, 1, 2), "raw": b"\x01"}])
    c.insert(spark.createDataFrame([(5, 2.5)], "i int, x double"))
    with pytest.raises(DuplicateKey):
        c.insert({"i": 2})
    with db.transaction() as t:
        t.update("cs.t", {"x": {"$gte": 1}, "i": {"$lt": 5}}, {"$set": {"z.a": "new"}})
        t.delete("cs.t", {"x": "s"})
        t.insert("cs.t", {"i": "text"})
    shown = lambda df: sorted((json.loads(r.j) for r in df.select(F.to_json("doc").alias("j")).collect()), key=lambda d: str(d["i"]))
    want = [{"i": 1, "x": 1, "z": {"a": "new"}}, {"i": 3, "x": {"y": [1, None]}, "z": {"a": "new"}}, {"i": 5, "x": 2.5}, {"i": "text"}]
    got = shown(db["cs.t"].query())
    assert [d for d in got if d["i"] != 4] == want and c.count({"at": {"$gt": datetime.datetime(2024, 1, 1)}}) == 1 and c.count({"raw": b"\x01"}) == 1
    assert shown(c.aggregate([{"$match": {"z": {"$exists": True}}}, {"$project": {"i": 1}}])) == [{"i": 1}, {"i": 3}]
    state = shown(changelog.replay(db.changes(), None, "cs.t", ["i"]))
    assert [d for d in state if d["i"] != 4] == want and len(state) == 5
    assert [d["i"] for d in shown(db["cs.t"].find({"x": 2.5}, ["i"]))] == [5] and db.space("cs").collections() == ["t"]
    with pytest.raises(InvalidArgument):
        db.create_collection("cs.u", "x int", schemaless=True)


def test_sharded_collections_and_listings(db):
    c = db.create_collection("cs.t")
    c.insert([{"k": i, "v": str(i)} for i in range(40)])
    assert c.shard_info().first().Sharded is False and db.listing("shards").count() == 0
    c.enable_sharding("k", 4)
    assert tuple(c.shard_info().first()) == (True, "k", 4, "hash") and c.count() == 40
    t = c.sharded()
    assert [r.doc_count for r in t.chunks().orderBy("group_id").collect()] == [10, 10, 10, 10] and t.df({"k": 5}).first().v == "5"
    r = db.create_collection("cs.r", "w int")
    r.enable_sharding("w", 2, "range")
    r.add_range(2, low=10)
    assert r.shard_spec().group_of(11) == 2 and r.shard_spec().group_of(3) == 1
    assert [tuple(x) for x in db.listing("shards").collect()] == [("cs.r", "w", 2, "range"), ("cs.t", "k", 4, "hash")]
    assert [x.GroupId for x in db.listing("groups").collect()] == [1, 2, 3, 4] and db.listing("collections").count() == 2
    for bad in (lambda: c.add_range(1), lambda: c.enable_sharding("k", 0), lambda: db.listing("nodes"), lambda: db.create_collection("cs.n").sharded()):
        with pytest.raises(InvalidArgument):
            bad()
    with pytest.raises(SpaceNotFound):
        db.space("none")
