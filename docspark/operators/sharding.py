"""Sharded tables: routing, pruned reads, chunk counts, splits and balance.

A sharded table is a folder with a manifest, which says for each group in which folders
its files are, and which moves have taken place. A write adds folders and replaces
the manifest; a move rewrites the source group alone. Documents that were moved away
from the group of their key are found, because a read of one group also reads those that got
documents from it.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docspark.errors import InvalidArgument
from docspark.functions import routing
from docspark.functions import values as V
from docspark.sources.storage import Storage


@dataclass
class ShardSpec:
    """How documents are dealt to groups. ranges: {group, low?, up?}, for kind "range"."""

    key: str
    groups: int
    kind: str = "hash"
    ranges: list[dict] = field(default_factory=list)

    def add_range(self, group: int, low=None, up=None) -> None:
        self.ranges.append({"group": group, "low": low, "up": up})

    def group_of(self, v) -> int:
        """The group of one key value."""
        if self.kind == "hash":
            return routing.hash_value(v) % self.groups + 1
        for r in self.ranges:
            inside = all(
                b is None or V.value_rank(b) == V.value_rank(v) and (v >= b if low else v < b) for b, low in ((r.get("low"), True), (r.get("up"), False))
            )
            if inside:
                return r["group"]
        return 1


def with_group(df: DataFrame, spec: ShardSpec, name: str = "group_id") -> DataFrame:
    """``df`` with the group of each row."""
    found = V.resolve(spec.key, df.schema)
    if not found:
        raise InvalidArgument(f"documents lack the shard key {spec.key}")
    column, kind = found
    group = routing.hash_group(column, kind, spec.groups) if spec.kind == "hash" else routing.range_group(column, kind, spec.ranges)
    return df.withColumn(name, group)


def query_groups(spec: ShardSpec, condition: dict | None) -> list[int] | None:
    """Groups that a condition needs: those of the key's values if it says the key's value, else None for all."""
    wanted = (condition or {}).get(spec.key)
    if isinstance(wanted, dict):
        if wanted.keys() == {"$eq"}:
            return [spec.group_of(wanted["$eq"])]
        if wanted.keys() == {"$in"}:
            return sorted({spec.group_of(v) for v in wanted["$in"]})
        return None
    return None if wanted is None else [spec.group_of(wanted)]


#: A group's rows are written by so many tasks, and moved rows are numbered by as many.
SALTS = 16


def _salt(df: DataFrame) -> Column:
    return F.pmod(F.xxhash64(*map(V.top, df.columns)), F.lit(SALTS)).cast("int")


def routed(df: DataFrame, spec: ShardSpec) -> DataFrame:
    """``df`` with group_id, dealt out by group and salt; a document without the shard key is an error when it is met."""
    rows = with_group(df, spec)
    missing = F.raise_error(F.lit(f"a document lacks the shard key {spec.key}")).cast("int")
    rows = rows.withColumn("group_id", F.coalesce("group_id", missing))
    return rows.repartition(spec.groups * SALTS, "group_id", _salt(df))


class ShardedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.storage = spark, path.rstrip("/"), Storage(spark)

    @classmethod
    def create(cls, spark: SparkSession, path: str, spec: ShardSpec, schema: T.StructType) -> ShardedTable:
        if spec.groups < 1 or not V.resolve(spec.key, schema):
            raise InvalidArgument("a sharded table needs groups and a key that its documents have")
        out = cls(spark, path)
        out._put({"spec": asdict(spec), "schema": schema.json(), "groups": {}, "moves": []})
        return out

    def _state(self) -> dict:
        return self.storage.read_json(f"{self.path}/_shards.json")

    def _put(self, state: dict) -> None:
        self.storage.write_json(f"{self.path}/_shards.json", state)

    @property
    def spec(self) -> ShardSpec:
        return ShardSpec(**self._state()["spec"])

    def add_range(self, group: int, low=None, up=None) -> None:
        """One more range, for documents that are inserted from now on."""
        state, spec = self._state(), self.spec
        if spec.kind != "range":
            raise InvalidArgument("only range sharding has ranges")
        spec.add_range(group, low, up)
        self._put(state | {"spec": asdict(spec)})

    def _write(self, rows: DataFrame) -> dict[int, str]:
        """Folders of the groups in ``rows`` (with group_id)."""
        part = f"part-{uuid.uuid4().hex}"
        rows.write.partitionBy("group_id").parquet(f"{self.path}/{part}")
        names = [n for n in self.storage.list(f"{self.path}/{part}") if n.startswith("group_id=")]
        return {int(n.partition("=")[2]): f"{part}/{n}" for n in names}

    def insert(self, df: DataFrame) -> None:
        state = self._state()
        rows = df.select(*[V.top(f.name).cast(f.dataType) for f in T.StructType.fromJson(json.loads(state["schema"]))])
        groups = {k: list(v) for k, v in state["groups"].items()}
        for group, folder in self._write(routed(rows, self.spec)).items():
            groups.setdefault(str(group), []).append(folder)
        self._put(state | {"groups": groups})

    def _group(self, state: dict, group: int) -> DataFrame:
        schema, folders = T.StructType.fromJson(json.loads(state["schema"])), state["groups"].get(str(group), [])
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def groups_for(self, condition: dict | None) -> list[int]:
        """Groups that may hold what a condition asks for."""
        state, spec = self._state(), self.spec
        home = query_groups(spec, condition)
        if home is None:
            return sorted(map(int, state["groups"]))
        found = set(home)
        for source, target, _ in state["moves"]:  # in the order of the moves
            if source in found:
                found.add(target)
        return sorted(g for g in found if str(g) in state["groups"])

    def df(self, condition: dict | None = None) -> DataFrame:
        """Matching rows with group_id; no file of another group is read than the condition needs."""
        from docspark.operators.find import matched

        state = self._state()
        out = None
        for g in self.groups_for(condition):
            one = self._group(state, g).withColumn("group_id", F.lit(g))
            out = one if out is None else out.unionByName(one)
        if out is None:
            out = self._group(state, 0).withColumn("group_id", F.lit(0))
        return matched(out, condition)

    def chunks(self) -> DataFrame:
        """Rows of each group, groups without any included."""
        return counted(self.df().select("group_id"), self.spec.groups)

    def move(self, source: int, target: int, count: int) -> DataFrame:
        """Moves so many documents from a group to another: (Split, Source, Target, Migrated)."""
        state = self._state()
        rows = self._group(state, source)
        if source == target or not 1 <= target <= self.spec.groups or not 0 < count <= rows.count():
            raise InvalidArgument("a move needs two groups, and a source with as many documents")
        # Rows are numbered by salt: the counts of the salts before, and the place among those of the salt.
        placed = rows.withColumn("__salt", _salt(rows))
        before = {}
        at = 0
        for salt, n in sorted((r["__salt"], r["count"]) for r in placed.groupBy("__salt").count().collect()):  # SALTS rows
            before[salt], at = at, at + n
        start = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        order = Window.partitionBy("__salt").orderBy(*[F.xxhash64(*map(V.top, rows.columns))])
        number = F.element_at(start, F.col("__salt")) + F.row_number().over(order)
        dealt = placed.withColumn("group_id", F.when(number <= count, F.lit(target)).otherwise(F.lit(source))).drop("__salt")
        folders = self._write(dealt)
        groups = {k: list(v) for k, v in state["groups"].items() if k != str(source)}
        if source in folders:
            groups[str(source)] = [folders[source]]
        groups.setdefault(str(target), []).append(folders[target])
        self._put(state | {"groups": groups, "moves": [*state["moves"], [source, target, count]]})
        return self.spark.createDataFrame([(True, source, target, count)], "Split boolean, Source int, Target int, Migrated long")

    def split(self) -> DataFrame:
        """Half of the fullest group's documents to the emptiest."""
        r = split_move(self.chunks()).first()
        return self.move(r["source"], r["target"], r["move"])

    def balance(self) -> DataFrame:
        """One move from the fullest to the emptiest group, if they differ enough: (Balanced, Source, Target, Moved)."""
        found = imbalance(self.chunks()).first()
        if found:
            self.move(found["source"], found["target"], found["move"])
        row = (True, *(found or (None, None, None)))
        return self.spark.createDataFrame([row], "Balanced boolean, Source int, Target int, Moved long")


def write_sharded(df: DataFrame, spec: ShardSpec, path: str) -> None:
    """A table laid out by group, so that reads of some groups list no others."""
    ShardedTable.create(df.sparkSession, path, spec, df.schema).insert(df)


def read_sharded(spark: SparkSession, path: str, spec: ShardSpec, condition: dict | None = None) -> DataFrame:
    """Matching rows; files of groups that the condition doesn't need aren't read."""
    return ShardedTable(spark, path).df(condition)


def counted(rows: DataFrame, groups: int) -> DataFrame:
    """doc_count of each group_id from 1 to ``groups``."""
    counts = rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("doc_count"))
    each = rows.sparkSession.range(1, groups + 1).select(F.col("id").cast("int").alias("group_id"))
    return each.join(counts, "group_id", "left").select("group_id", F.coalesce("doc_count", F.lit(0)).cast("long").alias("doc_count"))


def chunk_info(df: DataFrame, spec: ShardSpec) -> DataFrame:
    """Rows of each group, groups without any included."""
    return counted(with_group(df, spec), spec.groups)


def imbalance(chunks: DataFrame) -> DataFrame:
    """From the fullest to the emptiest group: (source, target, move), a row if they differ by more than a fifth and by more than 10."""
    top = chunks.agg(
        F.max(F.struct("doc_count", (-F.col("group_id")).alias("g"))).alias("most"), F.min(F.struct("doc_count", "group_id")).alias("least")
    )
    diff = F.col("most.doc_count") - F.col("least.doc_count")
    moved = top.where((diff > F.expr("most.doc_count div 5")) & (diff > 10))
    return moved.select((-F.col("most.g")).cast("int").alias("source"), F.col("least.group_id").alias("target"), F.floor(diff / 2).cast("long").alias("move"))


def split_move(chunks: DataFrame) -> DataFrame:
    """Half of the fullest group's rows, to be moved to the emptiest: (source, target, move)."""
    top = chunks.agg(F.max(F.struct("doc_count", (-F.col("group_id")).alias("g"))).alias("most"), F.min(F.struct("doc_count", "group_id")).alias("least"))
    return top.select((-F.col("most.g")).cast("int").alias("source"), F.col("least.group_id").alias("target"), F.floor(F.col("most.doc_count") / 2).cast("long").alias("move"))


def shard_info(spark: SparkSession, spec: ShardSpec | None) -> DataFrame:
    row = (False, None, 1, None) if spec is None else (True, spec.key, spec.groups, spec.kind)
    return spark.createDataFrame([row], "Sharded boolean, ShardKey string, NumGroups int, ShardType string")
