"""Shard routing, JSON and binary documents, snapshots, access paths."""

import datetime
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docspark.errors import InvalidArgument
from docspark.functions.routing import hash_value
from docspark.operators import sharding
from docspark.plans import explain
from docspark.sources import bson, extjson
from docspark.sources.snapshot import read_snapshot, write_snapshot


@pytest.mark.parametrize("kind, values", [("bigint", [0, 5, -1, 2**40 + 3, None]), ("string", ["", "a", "héé", "abc" * 50, None]), ("double", [1.9, -2.5, None]), ("boolean", [True, None])])
def test_hash_routing_is_the_same_in_columns_and_values(spark, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"k {kind}")
    spec = sharding.ShardSpec("k", 5)
    for row in sharding.with_group(df, spec).collect():
        assert row.group_id == (None if row.k is None else spec.group_of(row.k))
    assert hash_value("ab") == 97 * 31 + 98


def test_range_routing(spark):
    spec = sharding.ShardSpec("wing", 3, "range")
    spec.add_range(1, up=40)
    spec.add_range(2, low=40, up=90)
    spec.add_range(3, low=90)
    wings = [3, 17, 39, 40, 66, 89, 90, 412, 977]
    df = spark.createDataFrame([(a,) for a in wings], "wing int")
    assert [r.group_id for r in sharding.with_group(df, spec).orderBy("wing").collect()] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert [spec.group_of(a) for a in wings] == [1, 1, 1, 2, 2, 2, 3, 3, 3]
    assert {r.group_id: r.doc_count for r in sharding.chunk_info(df, spec).collect()} == {1: 3, 2: 3, 3: 3}
    with pytest.raises(InvalidArgument):
        sharding.with_group(df, sharding.ShardSpec("none", 3))


def test_pruned_reads(spark, tmp_path):
    spec = sharding.ShardSpec("x", 3)
    df = spark.createDataFrame([(i, 10 * i) for i in range(30)], "x int, v int")
    sharding.write_sharded(df, spec, str(tmp_path / "t"))
    found = sharding.read_sharded(spark, str(tmp_path / "t"), spec, {"x": 0})
    assert found.count() == 1 and all("group_id=1" in f for f in found.inputFiles())
    assert sharding.read_sharded(spark, str(tmp_path / "t"), spec).count() == 30
    assert sharding.read_sharded(spark, str(tmp_path / "t"), spec, {"x": 1000}).count() == 0
    assert sharding.query_groups(spec, {"x": {"$gt": 3}}) is None and sharding.query_groups(spec, {"x": {"$in": [0, 3, 1]}}) == [1, 2]


def test_moves_of_a_sharded_table(spark, tmp_path):
    spec = sharding.ShardSpec("x", 3)
    df = spark.createDataFrame([(i % 7 * 3, f"v{i}") for i in range(200)] + [(1, "one")] * 5, "x int, v string")
    t = sharding.ShardedTable.create(spark, str(tmp_path / "t"), spec, df.schema)
    assert t.df().count() == 0 and t.balance().first()["Moved"] is None
    t.insert(df.where("x < 10"))
    t.insert(df.where("x >= 10"))
    counts = lambda: {r.group_id: r.doc_count for r in t.chunks().collect()}
    assert counts() == {1: 200, 2: 5, 3: 0}
    assert tuple(t.balance().first()) == (True, 1, 3, 100) and counts() == {1: 100, 2: 5, 3: 100}
    assert tuple(t.split().first()) == (True, 1, 2, 50) and counts() == {1: 50, 2: 55, 3: 100}
    assert t.groups_for({"x": 3}) == [1, 2, 3] and t.groups_for({"x": 1}) == [2]
    for x in (0, 3, 18, 1):
        assert t.df({"x": x}).count() == df.where(f"x = {x}").count()
    assert sorted((r.x, r.v) for r in t.df().collect()) == sorted(map(tuple, df.collect()))
    for bad in ((1, 1, 1), (1, 4, 1), (2, 1, 56), (2, 1, 0)):
        with pytest.raises(InvalidArgument):
            t.move(*bad)
    with pytest.raises(Exception, match="lacks the shard key"):
        t.insert(spark.createDataFrame([(None, "v")], "x int, v string"))
    assert sum(counts().values()) == 205, "a failed insert leaves nothing"
    with pytest.raises(InvalidArgument):
        t.add_range(1, up=3)


def test_balance(spark):
    chunks = spark.createDataFrame([(1, 100), (2, 20), (3, 50)], "group_id int, doc_count long")
    assert tuple(sharding.imbalance(chunks).collect()[0]) == (1, 2, 40)
    assert sharding.imbalance(chunks.where("group_id = 3")).count() == 0
    assert tuple(sharding.split_move(chunks).collect()[0]) == (1, 2, 50)
    assert sharding.shard_info(spark, None).collect()[0].Sharded is False


leaf = st.one_of(
    st.none(), st.booleans(), st.integers(-(2**63), 2**63 - 1), st.floats(allow_nan=False), st.text(max_size=8).filter(lambda s: "\ud800" not in s),
    st.binary(max_size=8), st.binary(min_size=12, max_size=12).map(bson.ObjectId), st.integers(0, 2**64 - 1).map(bson.Stamp),
    st.integers(-(10**12), 10**12).map(lambda n: datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=n)),
    st.integers(-(10**9), 10**9).map(decimal.Decimal), st.sampled_from([bson.MinKey, bson.MaxKey, bson.Regex("a.b", "i")]),
)
name = st.text(st.characters(blacklist_characters="\0$", blacklist_categories=("Cs",)), min_size=1, max_size=5)
documents = st.dictionaries(name, st.recursive(leaf, lambda x: st.one_of(st.lists(x, max_size=3), st.dictionaries(name, x, max_size=3)), max_leaves=6), max_size=6)


@settings(max_examples=300, deadline=None)
@given(documents)
def test_binary_documents_round_trip(doc):
    assert bson.decode(bson.encode(doc)) == (doc, len(bson.encode(doc)))


@settings(max_examples=200, deadline=None)
@given(documents)
def test_extended_json_round_trips(doc):
    assert extjson.loads(extjson.dumps(doc)) == doc


@pytest.mark.parametrize("data", [b"", b"\x05\0\0\0", b"\x06\0\0\0\0\0", b"\x0c\0\0\0\x10a\0\x01\0\0\0\x01", b"\x09\0\0\0\x63a\0\0\0", b"\xff\xff\xff\xff\0"])
def test_malformed_documents(data):
    with pytest.raises(bson.Malformed):
        bson.decode(data)


def test_known_bytes():
    assert bson.encode({"a": 1}) == b"\x0c\0\0\0\x10a\0\x01\0\0\0\0" and bson.encode({}) == b"\x05\0\0\0\0"


def test_snapshot_folder(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", datetime.datetime(2024, 1, 2)), (2, None, None)], "i int, s string, t timestamp_ntz")
    write_snapshot(df, str(tmp_path), "cs.t")
    rows = read_snapshot(spark, str(tmp_path))
    out = rows.select("collection", F.variant_get("doc", "$.i", "int").alias("i"), F.variant_get("doc", "$.s", "string").alias("s")).orderBy("i").collect()
    assert [tuple(r) for r in out] == [("cs.t", 1, "a"), ("cs.t", 2, None)]


def test_access_paths():
    index = {"a_b": {"a": 1, "b": 1}}
    best = lambda cond, order=None, n=1000: explain.paths(n, index, cond, order)[0]
    assert best({"a": 5}).name == "a_b" and best({"a": 5}).cost == pytest.approx(13.4)
    assert best({"a": 5}, n=13).name == "table scan" and best({"a": 5}, n=14).name == "a_b"
    assert best({"a": {"$gt": 5}}).name == "table scan", "a range alone doesn't pay"
    assert best({"a": {"$gt": 5}}, {"z": 1}).name == "a_b", "a sort makes it pay"
    assert best({"b": 5}).name == "table scan"
    assert best({"$and": [{"a": 1}, {"b": {"$in": [1, 2, 3]}}]}).matched == 2
    assert best({"a": 1}, {"b": -1}).sorted and best({}, {"a": -1, "b": -1}).sorted and not explain.gives_order({"a": 1, "b": 1}, 0, {"a": 1, "b": -1})
    assert not explain.gives_order({"a": 1, "b": 1}, 0, {"b": 1}), "only an equality frees the next field"
