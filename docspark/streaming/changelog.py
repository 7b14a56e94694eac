"""Change log: an append-only table of what was written.

A row has lsn (ascending), prevLsn, txnId, op, collection and data (JSON). It is
scanned as a batch from an LSN, tailed as a stream, and replayed to the current state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.functions import values as V

SCHEMA = T.StructType(
    [
        T.StructField("lsn", T.LongType()),
        T.StructField("prevLsn", T.LongType()),
        T.StructField("txnId", T.LongType()),
        T.StructField("op", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("data", T.StringType()),
    ]
)

#: Names of operations.
OPS = ("insert", "update", "delete", "txnBegin", "txnCommit", "txnAbort", "createCL", "dropCL", "createIndex", "dropIndex", "createCS", "dropCS", "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def scan_from(log: DataFrame, lsn: int, collection: str | None = None) -> DataFrame:
    """Entries from an LSN on; of one collection, if it is named. Both filters reach the scan."""
    out = log.where(F.col("lsn") >= lsn)
    return out if collection is None else out.where(F.col("collection") == collection)


def watch(spark: SparkSession, path: str, start_lsn: int = 0, collection: str | None = None, batch: int | None = None) -> DataFrame:
    """A stream of entries; its checkpoint stands for the resume LSN. ``batch``: files a micro-batch."""
    reader = spark.readStream.schema(SCHEMA)
    if batch:
        reader = reader.option("maxFilesPerTrigger", batch)
    return scan_from(reader.parquet(path), start_lsn, collection)


def latest(log: DataFrame, key: str = "key") -> DataFrame:
    """The last entry of each key that isn't a deletion: the state after all entries. Tasks keep one entry a key."""
    last = log.groupBy(key).agg(F.max_by(F.struct(*log.columns), "lsn").alias("__last"))
    return last.select("__last.*").where("op <> 'delete'")


def replay(log: DataFrame, schema: T.StructType | None, collection: str, keys: list[str]) -> DataFrame:
    """The documents of a collection, folded by key from what was written since it was created last.

    Without a schema they are VARIANT values in the column ``doc``; their dates and binary values are texts, as in the log.

    An update that changes a key takes away the document with the old one. Within a statement, such removals come
    before what it writes, so keys may be swapped. Writes of aborted transactions never reach the log.
    """
    space, mine = collection.partition(".")[0], F.col("collection") == collection
    born = log.where((mine & F.col("op").isin("createCL", "dropCL")) | ((F.col("collection") == space) & (F.col("op") == "dropCS")))
    born = F.broadcast(born.agg(F.coalesce(F.max("lsn"), F.lit(-1)).alias("__born")))  # one row
    rows = log.where(mine & F.col("op").isin("insert", "update", "delete")).join(born, F.col("lsn") > F.col("__born"))

    def document(name: str) -> Column:
        text = F.get_json_object("data", f"$.{name}")
        return F.parse_json(text) if schema is None else F.from_json(text, schema)

    def part(d: str, k: str) -> Column:
        return F.variant_get(F.col(d), "$" + V.variant_step(k), "string") if schema is None else F.col(f"{d}.{V.quoted(k)}")

    after = F.when(F.col("op") == "update", document("new")).otherwise(document("doc"))
    statement = F.coalesce(F.get_json_object("data", "$.s"), F.lpad(F.col("lsn").cast("string"), 19, "0"))
    rows = rows.select("op", after.alias("doc"), F.when(F.col("op") == "update", document("old")).alias("old"), statement.alias("s"), "lsn")
    key, was = (F.struct(*[part(d, k).alias(f"k{i}") for i, k in enumerate(keys)]) for d in ("doc", "old"))
    end = F.struct(key.alias("key"), F.struct(F.col("s"), (F.col("op") != "delete").alias("there"), F.col("lsn")).alias("at"), F.when(F.col("op") != "delete", F.col("doc")).alias("doc"))
    gone = F.struct(was.alias("key"), F.struct(F.col("s"), F.lit(False).alias("there"), F.col("lsn")).alias("at"), F.lit(None).cast(schema or "variant").alias("doc"))
    events = rows.select(F.inline(F.when((F.col("op") == "update") & ~key.eqNullSafe(was), F.array(gone, end)).otherwise(F.array(end))))
    last = events.groupBy("key").agg(F.max_by("doc", "at").alias("doc"), F.max("at").alias("at"))
    return last.where("at.there").select("doc" if schema is None else "doc.*")


def replay_stream(stream: DataFrame, checkpoint: str, apply) -> object:
    """Runs what is there of a tail in micro-batches; ``apply(batch, id)`` folds one into a target."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
