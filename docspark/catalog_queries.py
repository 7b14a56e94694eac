"""Named queries over the driver's tables, each with its SQL twin.

Each runs over its whole table. Queries that write use a database of their own below
the shared folder (or a temporary one, where a local session has none).
"""

from __future__ import annotations

import datetime
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.errors import DuplicateKey
from docspark.functions import modifiers
from docspark.functions import values as V
from docspark.functions.predicates import compile_variant_condition
from docspark.operators import find as finding
from docspark.operators import documents, pipeline, sharding
from docspark.plans import explain as plans
from docspark.plans import sql as front
from docspark.sources import extjson
from docspark.sources.catalog import Database
from docspark.streaming import changelog

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        root = tempfile.mkdtemp(prefix="docspark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_docspark"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def query(name: str, sql: str | None = None):
    def add(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def finder(name: str, source: str, sql: str, prepare=None, **call) -> None:
    """A query that is one find() on a table."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return finding.find(prepare(df) if prepare else df, **call)

    query(name, sql)(run)


def piped(name: str, source: str, sql: str, stages: list, prepare=None, extensions: bool = False) -> None:
    """A query that is one aggregation pipeline on a table."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, source)
        return pipeline.aggregate(prepare(df) if prepare else df, stages, extensions)

    query(name, sql)(run)


def selecting(name: str, source: str, text: str, sql: str, strict: bool = False) -> None:
    """A query that is one SELECT of the small grammar."""

    def run(spark, sf_dir):
        return front.select(table(spark, sf_dir, source), front.parse_select(text), strict)

    query(name, sql)(run)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline.aggregate(
        table(spark, sf_dir, "lineitem"),
        [
            {"$match": {"l_quantity": {"$gte": 10}, "l_returnflag": {"$ne": "N"}}},
            {"$group": {"_id": "$l_returnflag", "qty": {"$sum": "$l_quantity"}, "n": {"$sum": 1}}},
            {"$sort": {"_id": 1}},
        ],
    )


query("flagship", "SELECT l_returnflag AS _id, sum(l_quantity) AS qty, count(*) AS n FROM lineitem WHERE l_quantity >= 10 AND l_returnflag <> 'N' GROUP BY 1")(flagship)

# ---- predicates

ORDERS = "SELECT o_orderkey, o_totalprice FROM orders WHERE "
PICK = {"o_orderkey": 1, "o_totalprice": 1}
finder("find_eq", "orders", ORDERS + "o_orderstatus = 'F'", condition={"o_orderstatus": "F"}, selector=PICK)
finder("find_eq_operator", "orders", ORDERS + "o_orderstatus = 'O'", condition={"o_orderstatus": {"$eq": "O"}}, selector=PICK)
for op, sign in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
    finder(f"find_{op}", "orders", ORDERS + f"o_totalprice {sign} 250000", condition={"o_totalprice": {f"${op}": 250000}}, selector=PICK)
finder("find_range", "orders", ORDERS + "o_totalprice > 1000 AND o_totalprice < 200000.5", condition={"o_totalprice": {"$gt": 1000, "$lt": 200000.5}}, selector=PICK)
EVENT = "SELECT event_id, event_type FROM events WHERE "
KIND = {"event_id": 1, "event_type": 1}
finder("find_ne", "events", EVENT + "event_type IS DISTINCT FROM 'click'", condition={"event_type": {"$ne": "click"}}, selector=KIND)
finder("find_in", "events", EVENT + "event_type IN ('click', 'view')", condition={"event_type": {"$in": ["click", "view", 5, None]}}, selector=KIND)
finder("find_nin", "events", EVENT + "event_type NOT IN ('click', 'view')", condition={"event_type": {"$nin": ["click", "view"]}}, selector=KIND)
finder("find_in_empty", "events", EVENT + "false", condition={"event_type": {"$in": []}}, selector=KIND)
finder("find_all", "region", "SELECT r_regionkey, r_name FROM region", condition={})


def sparse(df: DataFrame) -> DataFrame:
    """Events whose value is missing from 50 on."""
    return df.select("event_id", F.when(F.col("value") < 50, F.col("value")).alias("v"))


SPARSE = "SELECT event_id, v FROM (SELECT event_id, CASE WHEN value < 50 THEN value END AS v FROM events) WHERE "
for name, cond, where in (
    ("exists", {"v": {"$exists": True}}, "v IS NOT NULL"),
    ("not_exists", {"v": {"$exists": 0}}, "v IS NULL"),
    ("ne_missing", {"v": {"$ne": 10}}, "v IS DISTINCT FROM 10"),
    ("nin_missing", {"v": {"$nin": [1.5, 2.5]}}, "coalesce(v NOT IN (1.5, 2.5), true)"),
    ("not_missing", {"v": {"$not": {"$gt": 20}}}, "coalesce(NOT v > 20, true)"),
    ("nor_missing", {"$nor": [{"v": {"$lt": 10}}, {"v": {"$gt": 40}}]}, "NOT coalesce(v < 10 OR v > 40, false)"),
    ("eq_null", {"v": None}, "false"),
    ("ne_null", {"v": {"$ne": None}}, "true"),
    ("unknown_field", {"w": {"$ne": 1}}, "true"),
    ("gt_missing", {"v": {"$gt": 20}}, "v > 20"),
):
    finder(f"find_{name}", "events", SPARSE + where, prepare=sparse, condition=cond)

CUSTOMER = "SELECT c_custkey FROM customer WHERE "
for name, cond, where in (
    ("and", {"$and": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$gt": 0}}]}, "c_mktsegment = 'BUILDING' AND c_acctbal > 0"),
    ("or", {"$or": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, "c_mktsegment = 'BUILDING' OR c_acctbal < 0"),
    ("nor", {"$nor": [{"c_mktsegment": "BUILDING"}, {"c_acctbal": {"$lt": 0}}]}, "NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0)"),
    ("not", {"c_acctbal": {"$not": {"$gte": 0, "$lt": 5000}}}, "NOT (c_acctbal >= 0 AND c_acctbal < 5000)"),
    ("implicit_and", {"c_mktsegment": "MACHINERY", "c_nationkey": {"$lte": 9}}, "c_mktsegment = 'MACHINERY' AND c_nationkey <= 9"),
    ("or_empty", {"$or": []}, "false"),
    ("and_empty", {"$and": []}, "true"),
    ("cross_type_gt", {"c_name": {"$gt": 5}}, "c_name IS NOT NULL"),
    ("cross_type_lt", {"c_name": {"$lt": 5}}, "false"),
    ("cross_type_eq", {"c_name": 5}, "false"),
    ("cross_type_ne", {"c_name": {"$ne": 5}}, "true"),
    ("cross_type_in", {"c_nationkey": {"$in": ["3", 3, 4.0, True]}}, "c_nationkey IN (3, 4)"),
):
    finder(f"find_{name}", "customer", CUSTOMER + where, condition=cond, selector={"c_custkey": 1})


def with_props(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.from_json("props", "k int").alias("props"))


finder("find_nested_path", "events", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) >= 50", prepare=with_props, condition={"props.k": {"$gte": 50}}, selector={"event_id": 1})
finder("find_document_equality", "events", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) = 7", prepare=with_props, condition={"props": {"k": 7}}, selector={"event_id": 1})
finder("find_date", "events", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'", condition={"ts": {"$gte": datetime.datetime(2024, 1, 15)}}, selector={"event_id": 1})


@query("find_variant", "SELECT event_id FROM events WHERE CAST(props->>'k' AS BIGINT) > 80")
def find_variant(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.parse_json("props").alias("doc"))
    return rows.where(compile_variant_condition({"k": {"$gt": 80}, "z": {"$exists": False}})).select("event_id")


@query("variant_sort_group", "SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def variant_sort_group(spark, sf_dir):
    v = F.variant_get(F.parse_json("props"), "$.k", "variant")
    rows = table(spark, sf_dir, "events").select(v.alias("v"))
    keyed = rows.groupBy(V.group_key(F.col("v")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return keyed.select(F.col("key.json").cast("bigint").alias("k"), "n")


def _events(spark, sf_dir) -> DataFrame:
    """Documents of several shapes: {id, t, k, tags} with k a number, a text or missing, tags an array, a text or empty."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    fields = [
        F.lit("id"), F.col("event_id").cast("variant"), F.lit("t"), F.col("event_type").cast("variant"),
        F.lit("k"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("k"), k.cast("string")).cast("variant")).otherwise(k.cast("variant")),
        F.lit("tags"), F.when(F.col("event_id") % 4 == 0, F.lit("none").cast("variant")).when(F.col("event_id") % 4 == 1, F.to_variant_object(F.array().cast("array<variant>"))).otherwise(
            F.to_variant_object(F.array(F.lit(1).cast("variant"), F.col("event_type").cast("variant")))
        ),
    ]
    doc = F.create_map(*fields)
    return e.select(F.to_variant_object(F.when(F.col("event_id") % 7 == 0, F.map_filter(doc, lambda n, _: n != "k")).otherwise(doc)).alias("doc"))


#: The same documents as columns: k as a number (kn) or a text (ks).
EVENTS = """(SELECT event_id AS id, event_type AS t, CASE WHEN event_id % 7 <> 0 AND event_id % 5 <> 0 THEN CAST(props->>'k' AS BIGINT) END AS kn,
  CASE WHEN event_id % 7 <> 0 AND event_id % 5 = 0 THEN 'k' || (props->>'k') END AS ks, event_id % 4 AS g FROM events)"""


def _got(name: str, kind: str) -> Column:
    return F.try_variant_get("doc", f"$.{name}", kind).alias(name)


@query("variant_match_project", f"SELECT id, t FROM {EVENTS} WHERE ks IS NOT NULL OR kn > 50")
def variant_match_project(spark, sf_dir):
    out = documents.aggregate_documents(_events(spark, sf_dir), [{"$match": {"k": {"$gt": 50}}}, {"$project": {"id": 1, "t": 1}}])
    return out.select(_got("id", "bigint"), _got("t", "string"))


@query("variant_project_out", f"SELECT id, kn AS k, NULL::VARCHAR AS t FROM {EVENTS}")
def variant_project_out(spark, sf_dir):
    out = documents.aggregate_documents(_events(spark, sf_dir), [{"$project": {"t": 0, "tags": 0}}])
    return out.select(_got("id", "bigint"), _got("k", "bigint"), _got("t", "string"))


@query("variant_sort_limit", f"SELECT id FROM {EVENTS} ORDER BY CASE WHEN ks IS NOT NULL THEN 2 WHEN kn IS NOT NULL THEN 1 ELSE 0 END DESC, ks DESC, kn DESC, id LIMIT 30 OFFSET 5")
def variant_sort_limit(spark, sf_dir):
    out = documents.aggregate_documents(_events(spark, sf_dir), [{"$sort": {"k": -1, "id": 1}}, {"$skip": 5}, {"$limit": 30}])
    return out.select(_got("id", "bigint"))


@query("variant_count", f"SELECT count(*) AS total FROM {EVENTS} WHERE kn IS NOT NULL")
def variant_count(spark, sf_dir):
    out = documents.aggregate_documents(_events(spark, sf_dir), [{"$match": {"k": {"$lt": "", "$exists": True}}}, {"$count": "total"}])
    return out.select(_got("total", "bigint"))


@query("variant_unwind_group", f"SELECT tag, count(*) AS n FROM (SELECT 'none' AS tag FROM {EVENTS} WHERE g = 0 UNION ALL SELECT '1' FROM {EVENTS} WHERE g > 1 UNION ALL SELECT t FROM {EVENTS} WHERE g > 1) GROUP BY tag")
def variant_unwind_group(spark, sf_dir):
    out = documents.aggregate_documents(_events(spark, sf_dir), [{"$unwind": {"path": "$tags"}}, {"$group": {"_id": "$tags", "n": {"$sum": 1}}}])
    return out.select(F.variant_get("doc", "$._id", "string").alias("tag"), _got("n", "bigint"))


@query(
    "variant_update",
    f"SELECT id, CASE WHEN id % 2 = 0 THEN 'x' ELSE t END AS t, CASE WHEN id % 2 = 0 THEN coalesce(kn, 0) + 9007199254740993 ELSE kn END AS k, CASE WHEN id % 2 = 0 THEN 3 END AS deep, CASE WHEN g <> 0 OR id % 2 <> 0 THEN g <> 0 END AS tagged "
    f"FROM {EVENTS} WHERE ks IS NULL",
)
def variant_update(spark, sf_dir):
    """$set also through what isn't a document, $unset, and $inc of integers that no double holds."""
    rows = _events(spark, sf_dir).where(~documents.is_text("k"))
    even = rows.withColumn("even", F.variant_get("doc", "$.id", "bigint") % 2 == 0)
    hit = documents.modify_documents(even.where("even").select("doc"), {"$set": {"t": "x", "t2.a.b": 3, "k2": None}, "$unset": {"k2": 1, "zz": 1}, "$inc": {"k": 9007199254740993}})
    hit = documents.modify_documents(hit, {"$set": {"t2.a.b.c": 3}}, {"t2": {"$exists": True}})
    out = hit.unionByName(even.where("NOT even").select("doc"))
    tagged = F.when(F.try_variant_get("doc", "$.tags", "array<variant>").isNotNull(), True).when(F.variant_get("doc", "$.id", "bigint") % 2 != 0, False)
    return out.select(_got("id", "bigint"), _got("t", "string"), _got("k", "bigint"), F.try_variant_get("doc", "$.t2.a.b.c", "bigint").alias("deep"), tagged.alias("tagged"))


@query("variant_big_integers", "SELECT o_orderkey FROM orders WHERE o_orderkey % 10 > 3")
def variant_big_integers(spark, sf_dir):
    """Numbers that are the same double are told apart: 2**60 + key."""
    big = F.lit(1 << 60) + F.col("o_orderkey") % 10
    rows = table(spark, sf_dir, "orders").select(F.to_variant_object(F.create_map(F.lit("key"), F.col("o_orderkey").cast("long").cast("variant"), F.lit("big"), big.cast("variant"))).alias("doc"))
    out = documents.find_documents(rows, {"big": {"$gt": (1 << 60) + 3, "$nin": [(1 << 60) + 3]}})
    return out.select(F.variant_get("doc", "$.key", "bigint").cast(table(spark, sf_dir, "orders").schema["o_orderkey"].dataType).alias("o_orderkey"))


@query("variant_date_binary_order", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20) UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 1 ORDER BY encode(o_orderpriority), o_orderkey LIMIT 20)")
def variant_date_binary_order(spark, sf_dir):
    """Dates and binary values have their own order, dates above binary values."""
    o = table(spark, sf_dir, "orders").withColumn("r", F.col("o_orderkey") % 3)
    value = F.when(F.col("r") == 0, F.col("o_orderdate").cast("timestamp").cast("variant")).otherwise(F.col("o_orderpriority").cast("binary").cast("variant"))
    rows = o.where("r < 2").select(F.to_variant_object(F.create_map(F.lit("key"), F.col("o_orderkey").cast("long").cast("variant"), F.lit("v"), value)).alias("doc"))
    late = documents.find_documents(rows, order_by=[("v", -1), ("key", 1)], limit=20)
    low = documents.find_documents(rows, order_by=[("v", 1), ("key", 1)], limit=20)
    return late.unionByName(low).select(F.variant_get("doc", "$.key", "bigint").cast(o.schema["o_orderkey"].dataType).alias("o_orderkey"))



# ---- selector, order, skip, limit, count

finder("find_selector", "customer", "SELECT c_name, c_custkey FROM customer", selector={"c_name": 0, "c_custkey": 1, "nothing": 1})
BY_BALANCE = [("c_mktsegment", 1), ("c_acctbal", -1), ("c_custkey", 1)]
finder("find_sort_multi", "customer", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer", order_by=BY_BALANCE, selector=["c_custkey", "c_mktsegment", "c_acctbal"])
finder("find_limit", "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 25", order_by={"c_custkey": 1}, limit=25, selector=["c_custkey"])
finder("find_skip", "customer", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100", order_by={"c_custkey": 1}, skip=100, selector=["c_custkey"])
finder("find_sort_skip_limit", "customer", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10",
       condition={"c_acctbal": {"$gt": 0}}, order_by=[("c_acctbal", -1), ("c_custkey", 1)], skip=10, limit=20, selector=["c_custkey", "c_acctbal"])
finder("find_zero_limit", "nation", "SELECT n_nationkey FROM nation", limit=0, selector=["n_nationkey"])
finder("find_sort_nulls_first", "events", SPARSE + "true ORDER BY v ASC NULLS FIRST, event_id LIMIT 50", prepare=sparse, order_by=[("v", 1), ("event_id", 1)], limit=50)
finder("find_sort_nulls_desc", "events", SPARSE + "true ORDER BY v DESC NULLS LAST, event_id LIMIT 50", prepare=sparse, order_by=[("v", -1), ("event_id", 1)], limit=50)


@query("count_all", "SELECT count(*) AS count FROM lineitem")
def count_all(spark, sf_dir):
    return finding.count(table(spark, sf_dir, "lineitem"))


@query("count_filtered", "SELECT count(*) AS count FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")
def count_filtered(spark, sf_dir):
    return finding.count(table(spark, sf_dir, "lineitem"), {"l_quantity": {"$gt": 25}, "l_returnflag": "R"})


# ---- pipelines

piped("agg_match", "orders", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'", [{"$match": {"o_orderstatus": "P"}}, {"$project": {"o_orderkey": 1}}])
piped("agg_project_include", "nation", "SELECT n_name, n_nationkey FROM nation", [{"$project": {"n_name": 1, "n_nationkey": True, "n_regionkey": 0}}])
piped("agg_project_exclude", "nation", "SELECT n_nationkey, n_name FROM nation", [{"$project": {"n_regionkey": 0}}])
piped("agg_project_other", "region", "SELECT * FROM region", [{"$project": {"r_name": 1.0, "x": "$r_name"}}])
piped("agg_sort", "orders", "SELECT o_orderkey, o_totalprice FROM orders", [{"$project": {"o_orderkey": 1, "o_totalprice": 1}}, {"$sort": {"o_totalprice": -1, "o_orderkey": 1}}])
piped("agg_limit", "orders", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10", [{"$sort": {"o_orderkey": 1}}, {"$limit": 10}, {"$project": {"o_orderkey": 1}}])
piped("agg_limit_zero", "orders", "SELECT o_orderkey FROM orders LIMIT 0", [{"$limit": {"n": 0}}, {"$project": {"o_orderkey": 1}}])
piped("agg_skip", "nation", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 5", [{"$sort": {"n_nationkey": 1}}, {"$skip": 5}, {"$project": {"n_nationkey": 1}}])
piped("agg_skip_negative", "nation", "SELECT n_nationkey FROM nation LIMIT 0", [{"$skip": -1}, {"$project": {"n_nationkey": 1}}])
piped("agg_count", "orders", "SELECT count(*) AS total FROM orders WHERE o_totalprice > 100000", [{"$match": {"o_totalprice": {"$gt": 100000}}}, {"$count": {"as": "total"}}])
piped("agg_count_empty", "orders", "SELECT 0::BIGINT AS n", [{"$match": {"o_totalprice": {"$lt": -1}}}, {"$count": "n"}])
piped("agg_group_sum", "lineitem", "SELECT l_returnflag AS _id, round(sum(l_extendedprice), 2) AS total, sum(l_linenumber)::BIGINT AS lines FROM lineitem GROUP BY 1",
      [{"$group": {"_id": "$l_returnflag", "total": {"$sum": "$l_extendedprice"}, "lines": {"$sum": "$l_linenumber"}}}])
_total = _QUERIES["agg_group_sum"]
_QUERIES["agg_group_sum"] = lambda spark, sf_dir: _total(spark, sf_dir).withColumn("total", F.round("total", 2))
piped("agg_group_count", "lineitem", "SELECT l_linestatus AS _id, count(*) AS n FROM lineitem GROUP BY 1", [{"$group": {"_id": "$l_linestatus", "n": {"$sum": 1}}}])
piped("agg_group_null_key", "events", "SELECT CASE WHEN user_id % 2 = 0 THEN user_id::VARCHAR END AS _id, count(*) AS n FROM events GROUP BY 1",
      [{"$group": {"_id": "$u", "n": {"$sum": 1}}}], prepare=lambda df: df.select(F.when(F.col("user_id") % 2 == 0, F.col("user_id").cast("string")).alias("u")))
piped("agg_group_literal", "lineitem", "SELECT l_returnflag AS _id, 2 * count(*) AS n FROM lineitem GROUP BY 1", [{"$group": {"_id": "$l_returnflag", "n": {"$sum": 2}}}])
piped("agg_group_nonnumeric", "lineitem", "SELECT l_returnflag AS _id, 0::BIGINT AS n, 0::BIGINT AS m FROM lineitem GROUP BY 1",
      [{"$group": {"_id": "$l_returnflag", "n": {"$sum": "$l_linestatus"}, "m": {"$sum": "$missing"}}}])
piped("agg_group_all_missing", "events", "SELECT event_type AS _id, 0.0::DOUBLE AS total FROM events GROUP BY 1",
      [{"$group": {"_id": "$event_type", "total": {"$sum": "$v"}}}], prepare=lambda df: df.select("event_type", F.when(F.col("value") < -1, F.col("value")).alias("v")))


def tagged(df: DataFrame) -> DataFrame:
    return df.select("item_id", F.split("text", " ").alias("w"))


def emptied(df: DataFrame) -> DataFrame:
    words = F.split("text", " ")
    return df.select("item_id", F.when(F.col("item_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("item_id") % 3 == 1, words).alias("w"))


piped("agg_unwind", "benchmark", "SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark", [{"$unwind": {"path": "$w"}}], prepare=tagged)
piped("agg_unwind_empty", "benchmark", "SELECT item_id, unnest(string_split(text, ' ')) AS w FROM benchmark WHERE item_id % 3 = 1 UNION ALL SELECT item_id, NULL FROM benchmark WHERE item_id % 3 = 2",
      [{"$unwind": {"path": "$w"}}], prepare=emptied)
piped("agg_unwind_scalar", "region", "SELECT * FROM region", [{"$unwind": {"path": "$r_name"}}])
piped("agg_unwind_group", "benchmark", "SELECT w AS _id, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) GROUP BY 1",
      [{"$unwind": {"path": "$w"}}, {"$group": {"_id": "$w", "n": {"$sum": 1}}}], prepare=tagged)
piped("agg_multi_stage", "lineitem", "SELECT l_suppkey AS _id, sum(l_quantity) AS qty FROM lineitem WHERE l_discount > 0.05 GROUP BY 1 ORDER BY qty DESC, _id LIMIT 10",
      [{"$match": {"l_discount": {"$gt": 0.05}}}, {"$group": {"_id": "$l_suppkey", "qty": {"$sum": "$l_quantity"}}}, {"$sort": {"qty": -1, "_id": 1}}, {"$limit": 10}])
piped("ext_group_accumulators", "orders", "SELECT o_orderpriority AS _id, round(avg(o_totalprice), 4) AS mean, min(o_orderkey) AS low, max(o_orderkey) AS high FROM orders GROUP BY 1",
      [{"$group": {"_id": "$o_orderpriority", "mean": {"$avg": "$o_totalprice"}, "low": {"$min": "$o_orderkey"}, "high": {"$max": "$o_orderkey"}}}], extensions=True)
_mean = _QUERIES["ext_group_accumulators"]
_QUERIES["ext_group_accumulators"] = lambda spark, sf_dir: _mean(spark, sf_dir).withColumn("mean", F.round("mean", 4))


@query("ext_lookup", "SELECT n_nationkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def ext_lookup(spark, sf_dir):
    out = pipeline.aggregate(
        table(spark, sf_dir, "nation"),
        [{"$lookup": {"from": "region", "localField": "n_regionkey", "foreignField": "r_regionkey", "as": "r"}}, {"$unwind": {"path": "$r"}}],
        extensions=True, collections={"region": table(spark, sf_dir, "region")},
    )
    return out.select("n_nationkey", F.col("r.r_name").alias("r_name"))


# ---- SQL

selecting("sql_select_where", "orders", "SELECT o_orderkey FROM tpch.orders WHERE o_orderstatus = 'F' AND o_custkey = 7", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7")
selecting("sql_select_strict", "orders", "SELECT o_orderkey FROM tpch.orders WHERE o_totalprice >= 300000 AND o_orderpriority <> '5-LOW'",
          "SELECT o_orderkey FROM orders WHERE o_totalprice >= 300000 AND o_orderpriority <> '5-LOW'", strict=True)
selecting("sql_select_order", "nation", "SELECT * FROM tpch.nation ORDER BY n_regionkey DESC, n_name", "SELECT * FROM nation")
selecting("sql_select_limit_offset", "nation", "SELECT n_name FROM tpch.nation ORDER BY n_nationkey LIMIT 5 OFFSET 3", "SELECT n_name FROM nation ORDER BY n_nationkey LIMIT 5 OFFSET 3")
selecting("sql_select_limit_zero", "nation", "SELECT n_name FROM tpch.nation LIMIT 0", "SELECT n_name FROM nation LIMIT 0")
selecting("sql_select_projection", "supplier", "SELECT s_name, s_suppkey FROM tpch.supplier", "SELECT s_name, s_suppkey FROM supplier")
selecting("sql_select_superset", "part", "SELECT p_partkey FROM tpch.part WHERE p_size BETWEEN 5 AND 10 OR p_brand LIKE '%3'", "SELECT p_partkey FROM part WHERE p_size BETWEEN 5 AND 10 OR p_brand LIKE '%3'")


@query("sql_statements", "SELECT n_nationkey::BIGINT AS id, CASE WHEN n_nationkey = 3 THEN 'x y' ELSE n_name END AS name FROM nation WHERE n_nationkey <> 4 UNION ALL SELECT 100, 'new'")
def sql_statements(spark, sf_dir):
    db = Database(spark, scratch(spark, "sql"))
    db.sql("CREATE TABLE t.n (id BIGINT, name VARCHAR(20) NOT NULL)")
    db["t.n"].insert(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")))
    db.sql("INSERT INTO t.n (id, name) VALUES (100, 'new')")
    db.sql("UPDATE t.n SET name = 'x y' WHERE id = 3")
    db.sql("DELETE FROM t.n WHERE id = 4")
    return db.sql("SELECT * FROM t.n")


# ---- modifiers and writes


def modifying(name: str, source: str, sql: str, condition: dict, modifier: dict, prepare) -> None:
    def run(spark, sf_dir):
        from docspark.functions.predicates import compile_condition

        df = prepare(table(spark, sf_dir, source))
        return modifiers.apply_modifier(df, modifier, compile_condition(condition, df.schema))

    query(name, sql)(run)


def accounts(df: DataFrame) -> DataFrame:
    return df.select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")


HIT = {"c_mktsegment": "BUILDING"}
modifying("update_set", "customer", "SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 0.0 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer", HIT, {"$set": {"c_acctbal": 0.0}}, accounts)
modifying("update_unset", "customer", "SELECT c_custkey, c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer", HIT, {"$unset": {"c_acctbal": 1}}, accounts)
modifying("update_inc", "customer", "SELECT c_custkey, c_nationkey + CASE WHEN c_mktsegment = 'BUILDING' THEN 5 ELSE 0 END AS c_nationkey, c_acctbal, c_mktsegment FROM customer", HIT, {"$inc": {"c_nationkey": 5}}, accounts)
modifying("update_inc_missing", "customer", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey + 7 ELSE 7 END AS k FROM customer", {}, {"$inc": {"k": 7}},
          lambda df: df.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.col("c_nationkey")).alias("k")))
modifying("update_set_new", "customer", "SELECT c_custkey, CASE WHEN c_custkey < 50 THEN 'vip' END AS tag FROM customer", {"c_custkey": {"$lt": 50}}, {"$set": {"tag": "vip"}}, lambda df: df.select("c_custkey"))
modifying("update_combined", "customer", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 11 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer",
          HIT, {"$set": {"c_nationkey": 10}, "$inc": {"c_nationkey": 1}, "$unset": {"c_acctbal": 1}}, accounts)


@query("update_set_nested", "SELECT event_id, CASE WHEN CAST(props->>'k' AS INT) >= 50 THEN 0 ELSE CAST(props->>'k' AS INT) END AS k FROM events")
def update_set_nested(spark, sf_dir):
    from docspark.functions.predicates import compile_condition

    df = with_props(table(spark, sf_dir, "events"))
    out = modifiers.apply_modifier(df, {"$set": {"props.k": 0}}, compile_condition({"props.k": {"$gte": 50}}, df.schema))
    return out.select("event_id", F.col("props.k").alias("k"))


@query("delete_where", "SELECT c_custkey FROM customer WHERE NOT c_acctbal < 0")
def delete_where(spark, sf_dir):
    from docspark.functions.predicates import compile_condition, two_valued

    df = table(spark, sf_dir, "customer")
    return df.where(~two_valued(compile_condition({"c_acctbal": {"$lt": 0}}, df.schema))).select("c_custkey")


@query("insert_union", "SELECT r_regionkey, r_name, NULL::VARCHAR AS note FROM region UNION ALL SELECT 9, NULL, 'far'")
def insert_union(spark, sf_dir):
    new = spark.createDataFrame([(9, "far")], "r_regionkey int, note string")
    return table(spark, sf_dir, "region").unionByName(new, allowMissingColumns=True)


@query("unique_violations", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def unique_violations(spark, sf_dir):
    return finding.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


def _nations(spark, sf_dir) -> Database:
    db = Database(spark, scratch(spark, "db"))
    db.create_collection_space("t")
    db.create_collection("t.nation")
    db["t.nation"].insert(table(spark, sf_dir, "nation"))
    return db


@query("txn_commit", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'moved' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_nationkey <> 5 UNION ALL SELECT 99, 'new', 2")
def txn_commit(spark, sf_dir):
    db = _nations(spark, sf_dir)
    with db.transaction() as t:
        t.insert("t.nation", {"n_nationkey": 99, "n_name": "new", "n_regionkey": 2})
        t.update("t.nation", {"n_regionkey": 1}, {"$set": {"n_name": "moved"}})
        t.delete("t.nation", {"n_nationkey": 5})
    return db["t.nation"].df()


@query("txn_rollback", "SELECT * FROM nation")
def txn_rollback(spark, sf_dir):
    db = _nations(spark, sf_dir)
    t = db.transaction()
    t.delete("t.nation")
    t.rollback()
    return db["t.nation"].df()


@query("snapshot_collections", "SELECT * FROM (VALUES ('t.nation')) v(\"Name\")")
def snapshot_collections(spark, sf_dir):
    return _nations(spark, sf_dir).snapshot("collections")


@query("txn_abort_replay", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def txn_abort_replay(spark, sf_dir):
    """What an aborted transaction did is in neither the collection nor the log; replay gives the collection."""
    db = _nations(spark, sf_dir)
    c = db["t.nation"]
    c.create_index("key", {"n_nationkey": 1}, unique=True)
    c.delete({"n_regionkey": 1})
    try:
        with db.transaction() as t:
            t.insert("t.nation", {"n_nationkey": 100, "n_name": "new", "n_regionkey": 1})
            t.delete("t.nation", {"n_regionkey": 2})
            t.insert("t.nation", {"n_nationkey": 0, "n_name": "again", "n_regionkey": 1})
    except DuplicateKey:
        pass
    state = changelog.replay(db.changes(), c._schema(), "t.nation", ["n_nationkey"])
    same = state.exceptAll(c.df()).unionByName(c.df().exceptAll(state)).limit(1).count() == 0
    return state if same else state.limit(0)


# ---- change log

LOG = """SELECT event_id AS lsn, CASE event_type WHEN 'error' THEN 'delete' WHEN 'view' THEN 'insert' ELSE 'update' END AS op, user_id AS key, value FROM events"""


def log_of(df: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "insert").otherwise("update")
    return df.select(F.col("event_id").alias("lsn"), op.alias("op"), F.col("user_id").alias("key"), "value")


@query("oplog_replay_latest", f"SELECT lsn, op, key, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY lsn DESC) AS r FROM ({LOG})) WHERE r = 1 AND op <> 'delete'")
def oplog_replay_latest(spark, sf_dir):
    return changelog.latest(log_of(table(spark, sf_dir, "events")))


@query("oplog_scan_from", f"SELECT lsn, op, key, value FROM ({LOG}) WHERE lsn >= 500")
def oplog_scan_from(spark, sf_dir):
    return changelog.scan_from(log_of(table(spark, sf_dir, "events")), 500)


@query("oplog_database", "SELECT op, count(*) AS n FROM (SELECT 'insert' AS op FROM nation UNION ALL SELECT 'delete' FROM nation WHERE n_regionkey = 1) GROUP BY 1")
def oplog_database(spark, sf_dir):
    db = _nations(spark, sf_dir)
    db["t.nation"].delete({"n_regionkey": 1})
    log = db.changes(collection="t.nation").where(F.col("op").isin("insert", "update", "delete"))
    return log.groupBy("op").agg(F.count(F.lit(1)).alias("n"))


@query("oplog_replay", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN 'x' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1")
def oplog_replay(spark, sf_dir):
    db = _nations(spark, sf_dir)
    c = db["t.nation"]
    c.delete({"n_regionkey": 1})
    c.update({"n_regionkey": 2}, {"$set": {"n_name": "x"}})
    return changelog.replay(db.changes(), c._schema(), "t.nation", ["n_nationkey"])


@query("oplog_replay_moved_keys", "SELECT c_custkey::BIGINT + 1 AS c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def oplog_replay_moved_keys(spark, sf_dir):
    """An update that gives every document the key of another, a deletion, and a collection of that name that was dropped before."""
    db = Database(spark, scratch(spark, "db"))
    db.create_collection_space("t")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_acctbal")
    db.create_collection("t.c").insert(rows.withColumn("c_custkey", -F.col("c_custkey")))
    db.drop_collection("t.c")
    c = db.create_collection("t.c")
    c.insert(rows)
    c.update({}, {"$inc": {"c_custkey": 1}})
    c.delete({"c_acctbal": {"$lt": 0}})
    return changelog.replay(db.changes(), c._schema(), "t.c", ["c_custkey"])


@query("oplog_lsns", "SELECT i AS lsn, greatest(i - 1, 0) AS prevLsn FROM range((SELECT count(*) + 2 + count(*) FILTER (WHERE o_custkey % 3 = 0) FROM orders)) t(i)")
def oplog_lsns(spark, sf_dir):
    """LSNs are dense over writes of several partitions."""
    db = Database(spark, scratch(spark, "db"))
    db.create_collection_space("t")
    c = db.create_collection("t.orders")
    c.insert(table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 3).alias("r")).repartition(5))
    c.delete({"r": 0})
    return db.changes().select("lsn", "prevLsn")


@query("oplog_watch_stream", "SELECT op, count(*) AS n FROM (SELECT 'insert' AS op FROM nation) GROUP BY 1")
def oplog_watch_stream(spark, sf_dir):
    db = _nations(spark, sf_dir)
    out, point = scratch(spark, "tail"), scratch(spark, "tail-checkpoint")
    stream = db.watch("t.nation", 0).where(F.col("op").isin("insert", "update", "delete")).select("lsn", "op")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", point).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).groupBy("op").agg(F.count(F.lit(1)).alias("n"))


# ---- sharding

BY_CUSTOMER = sharding.ShardSpec("o_custkey", 7)
BY_TYPE = sharding.ShardSpec("event_type", 4)
BY_PRICE = sharding.ShardSpec("o_totalprice", 3, "range", [{"group": 1, "up": 100000}, {"group": 2, "low": 100000, "up": 250000}, {"group": 3, "low": 250000}])
CHUNKS = "SELECT g.i::INT AS group_id, count(o.o_orderkey) AS doc_count FROM range(1, 8) g(i) LEFT JOIN orders o ON o.o_custkey % 7 + 1 = g.i GROUP BY 1"


@query("shard_hash_int", "SELECT o_orderkey, (o_custkey % 7 + 1)::INT AS group_id FROM orders")
def shard_hash_int(spark, sf_dir):
    return sharding.with_group(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), BY_CUSTOMER).select("o_orderkey", "group_id")


@query("shard_hash_string", "SELECT event_id, (list_reduce(list_prepend(0::BIGINT, list_transform(string_split(event_type, ''), lambda x: ascii(x)::BIGINT)), lambda h, b: (h * 31 + b) & 4294967295) % 4 + 1)::INT AS group_id FROM events")
def shard_hash_string(spark, sf_dir):
    return sharding.with_group(table(spark, sf_dir, "events").select("event_id", "event_type"), BY_TYPE).select("event_id", "group_id")


@query("shard_range", "SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 250000 THEN 2 ELSE 3 END AS group_id FROM orders")
def shard_range(spark, sf_dir):
    return sharding.with_group(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), BY_PRICE).select("o_orderkey", "group_id")


@query("shard_chunk_info", CHUNKS)
def shard_chunk_info(spark, sf_dir):
    return sharding.chunk_info(table(spark, sf_dir, "orders"), BY_CUSTOMER)


@query("shard_imbalance", "WITH c AS (SELECT CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 250000 THEN 2 ELSE 3 END AS g, count(*) AS n FROM orders GROUP BY 1), "
       "x AS (SELECT arg_max(g, n) AS s, max(n) AS a, arg_min(g, n) AS t, min(n) AS b FROM c) SELECT s::INT AS source, t::INT AS target, ((a - b) // 2)::BIGINT AS move FROM x WHERE a - b > a // 5 AND a - b > 10")  # fmt: skip
def shard_imbalance(spark, sf_dir):
    return sharding.imbalance(sharding.chunk_info(table(spark, sf_dir, "orders"), BY_PRICE))


@query("shard_pruned_read", "SELECT o_orderkey FROM orders WHERE o_custkey = 8")
def shard_pruned_read(spark, sf_dir):
    path = scratch(spark, "sharded")
    sharding.write_sharded(table(spark, sf_dir, "orders"), BY_CUSTOMER, path)
    return sharding.read_sharded(spark, path, BY_CUSTOMER, {"o_custkey": 8}).select("o_orderkey")


@query("schemaless_collection", "SELECT o_orderkey, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE o_orderstatus END AS status FROM orders WHERE o_custkey % 3 <> 0")
def schemaless_collection(spark, sf_dir):
    """Documents whose field has a number here and a text there, updated and deleted."""
    db = Database(spark, scratch(spark, "db"))
    db.create_collection_space("t")
    c = db.create_collection("t.orders", schemaless=True)
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    c.insert(o.where("o_custkey % 2 <> 0").select("o_orderkey", F.col("o_orderstatus").alias("status"), (F.col("o_custkey") % 3).alias("r")))
    c.insert(o.where("o_custkey % 2 = 0").select("o_orderkey", F.col("o_custkey").alias("status"), (F.col("o_custkey") % 3).alias("r")))
    with db.transaction() as t:
        t.update("t.orders", {"status": {"$lt": ""}}, {"$set": {"status": "even"}})
        t.delete("t.orders", {"r": 0})
    kind = o.schema["o_orderkey"].dataType
    return c.find().select(F.variant_get("doc", "$.o_orderkey", "bigint").cast(kind).alias("o_orderkey"), F.variant_get("doc", "$.status", "string").alias("status"))


@query("listing_shards", "SELECT * FROM (VALUES ('t.nation', 'n_nationkey', 3, 'hash')) v(\"Collection\", \"ShardKey\", \"NumGroups\", \"ShardType\")")
def listing_shards(spark, sf_dir):
    db = _nations(spark, sf_dir)
    db["t.nation"].enable_sharding("n_nationkey", 3)
    return db.listing("shards")


@query("shard_info", "SELECT true AS \"Sharded\", 'o_custkey' AS \"ShardKey\", 7 AS \"NumGroups\", 'hash' AS \"ShardType\"")
def shard_info(spark, sf_dir):
    return sharding.shard_info(spark, BY_CUSTOMER)


SPLIT = """WITH c AS (SELECT (o_custkey % 7 + 1)::INT AS group_id, count(*) AS n FROM orders GROUP BY 1),
m AS (SELECT (SELECT group_id FROM c ORDER BY n DESC, group_id LIMIT 1) AS s, (SELECT group_id FROM c ORDER BY n, group_id LIMIT 1) AS t, (SELECT max(n) // 2 FROM c) AS k)
SELECT group_id, (n - CASE WHEN group_id = s THEN k ELSE 0 END + CASE WHEN group_id = t THEN k ELSE 0 END)::BIGINT AS doc_count FROM c, m"""


def _sharded(spark, sf_dir, spec) -> sharding.ShardedTable:
    orders = table(spark, sf_dir, "orders")
    out = sharding.ShardedTable.create(spark, scratch(spark, "sharded"), spec, orders.schema)
    out.insert(orders)
    return out


@query("shard_split", SPLIT)
def shard_split(spark, sf_dir):
    t = _sharded(spark, sf_dir, BY_CUSTOMER)
    t.split()
    return t.chunks()


@query("shard_split_read", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (7, 8, 9, 10, 11, 12, 13)")
def shard_split_read(spark, sf_dir):
    """Documents of every group are found by their keys after some of them were moved."""
    t = _sharded(spark, sf_dir, BY_CUSTOMER)
    t.split()
    parts = [t.df({"o_custkey": k}).select("o_orderkey", "o_custkey") for k in range(7, 14)]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


BALANCE = """WITH c AS (SELECT CASE WHEN o_totalprice < 100000 THEN 1 WHEN o_totalprice < 250000 THEN 2 ELSE 3 END AS group_id, count(*) AS n FROM orders GROUP BY 1),
e AS (SELECT i::INT AS group_id, coalesce(n, 0) AS n FROM range(1, 4) t(i) LEFT JOIN c ON c.group_id = i),
m AS (SELECT (SELECT group_id FROM e ORDER BY n DESC, group_id LIMIT 1) AS s, (SELECT group_id FROM e ORDER BY n, group_id LIMIT 1) AS t,
  (SELECT CASE WHEN max(n) - min(n) > max(n) // 5 AND max(n) - min(n) > 10 THEN (max(n) - min(n)) // 2 ELSE 0 END FROM e) AS k)
SELECT group_id, (n - CASE WHEN group_id = s THEN k ELSE 0 END + CASE WHEN group_id = t THEN k ELSE 0 END)::BIGINT AS doc_count FROM e, m"""


@query("shard_balance", BALANCE)
def shard_balance(spark, sf_dir):
    t = _sharded(spark, sf_dir, BY_PRICE)
    t.balance()
    return t.chunks()


@query("shard_add_range", "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 2 WHEN o_totalprice >= 200000 THEN 3 ELSE 1 END AS group_id FROM orders")
def shard_add_range(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    t = sharding.ShardedTable.create(spark, scratch(spark, "sharded"), sharding.ShardSpec("o_totalprice", 3, "range"), orders.schema)
    t.add_range(2, up=50000)
    t.add_range(3, low=200000)
    t.insert(orders)
    return t.df().select("o_orderkey", "group_id")


# ---- plans, JSON, snapshots


#: By the costs: a scan of n rows costs n, sorting 3 more a row; an index a seek of 10 and 0.4 a hit.
EXPLAIN = """WITH n AS (SELECT count(*)::DOUBLE AS n FROM orders),
p AS (SELECT 'table scan' AS path, n * 4.0 AS cost, 0 AS matched, 1.0::DOUBLE AS selectivity, false AS in_order FROM n
UNION ALL SELECT 'by_cust', 10 + n * (1 / n) * 0.4 + n * (1 / n) * 3, 1, 1 / n, false FROM n UNION ALL SELECT 'by_price', 10 + n * RANGE * 0.4, 1, RANGE, true FROM n)
SELECT path, cost::DOUBLE AS cost, matched::INT AS matched, selectivity::DOUBLE AS selectivity, in_order, row_number() OVER (ORDER BY cost) = 1 AS chosen FROM p""".replace("RANGE", str(plans.RANGE))


@query("index_explain", EXPLAIN)
def index_explain(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").count()
    return plans.explain(spark, rows, {"by_cust": {"o_custkey": 1}, "by_price": {"o_totalprice": -1}}, {"o_custkey": 7, "o_totalprice": {"$gt": 5}}, {"o_totalprice": 1})


@query("json_round_trip", "SELECT r_regionkey::BIGINT AS r_regionkey, r_name FROM region")
def json_round_trip(spark, sf_dir):
    docs = extjson.from_json_rows(extjson.to_json_rows(table(spark, sf_dir, "region")))
    return docs.select(F.variant_get("doc", "$.r_regionkey", "bigint").alias("r_regionkey"), F.variant_get("doc", "$.r_name", "string").alias("r_name"))


@query("snapshot_round_trip", "SELECT 't.nation' AS collection, n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def snapshot_round_trip(spark, sf_dir):
    from docspark.sources.snapshot import read_snapshot, write_snapshot

    path = scratch(spark, "snapshot")
    write_snapshot(table(spark, sf_dir, "nation"), path, "t.nation")
    return read_snapshot(spark, path).select("collection", F.variant_get("doc", "$.n_nationkey", "bigint").alias("n_nationkey"), F.variant_get("doc", "$.n_name", "string").alias("n_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
