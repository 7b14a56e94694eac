"""Databases of collections: spaces, versioned Parquet tables, indexes, writes, transactions.

A collection is a folder with versions; a small file names the current one. Inserts add
a folder of files to the version's list; updates and deletes write the collection anew.
Each write appends rows to the change log.

A write first makes the files of its new versions and of its log entries, which nobody
reads yet. Then one small file with all that is to be published is put in place: from
here on the write has happened. Publishing replaces the files that name the current
versions, moves the log entries to the log and ends with the removal of that file; if it
is interrupted, whoever opens the database next finishes it. So a write, or a transaction
over several collections, and its log entries are there together or not at all.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

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
from docspark.functions import values as V
from docspark.functions.modifiers import apply_modifier
from docspark.functions.predicates import compile_condition, compile_variant_condition
from docspark.operators import documents, monitor
from docspark.operators import find as finding
from docspark.operators import pipeline as pipelines
from docspark.operators.cursor import BATCH, Cursor
from docspark.operators.sharding import ShardedTable, ShardSpec, shard_info
from docspark.sources.storage import Storage
from docspark.streaming import changelog


def split_name(full: str) -> tuple[str, str]:
    """Space and collection; the first dot parts them."""
    space, dot, name = full.partition(".")
    if not dot or not space or not name:
        raise InvalidArgument(f"{full!r} isn't space.collection")
    return space, name


#: The column of a schemaless collection.
DOC = "doc"


class Database:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.storage, self.counters = Storage(spark), monitor.Counters()
        self._finish()

    # -- names

    def _space(self, space: str) -> str:
        path = f"{self.root}/{space}"
        if not self.storage.exists(f"{path}/_space.json"):
            raise SpaceNotFound(space)
        return path

    def _path(self, full: str) -> str:
        space, name = split_name(full)
        path = f"{self._space(space)}/{name}"
        if not self.storage.exists(f"{path}/_current.json"):
            raise CollectionNotFound(full)
        return path

    def create_collection_space(self, space: str) -> None:
        if "." in space or space.startswith("_") or not space:
            raise InvalidArgument(f"{space!r} can't name a space")
        if self.storage.exists(f"{self.root}/{space}/_space.json"):
            raise SpaceExists(space)
        self.storage.write_json(f"{self.root}/{space}/_space.json", {"name": space})
        self._publish({}, [self._entry("createCS", space, {"name": space})])

    def drop_collection_space(self, space: str) -> None:
        self.storage.delete(self._space(space))
        self._publish({}, [self._entry("dropCS", space, {"name": space})])

    def space(self, name: str) -> Space:
        self._space(name)
        return Space(self, name)

    def create_collection(self, full: str, schema: T.StructType | str | None = None, schemaless: bool = False) -> Collection:
        """A collection with a column a field, or, if ``schemaless``, of documents of any shape in a VARIANT column ``doc``."""
        space, name = split_name(full)
        path = f"{self._space(space)}/{name}"
        if self.storage.exists(f"{path}/_current.json"):
            raise CollectionExists(full)
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if schemaless and schema is not None:
            raise InvalidArgument("a schemaless collection has no schema")
        schema = T.StructType([T.StructField(DOC, T.VariantType())]) if schemaless else schema or T.StructType()
        state = {"version": 0, "parts": [], "schema": schema.json(), "indexes": {}, "schemaless": schemaless}
        self._publish({path: state}, [self._entry("createCL", full, {"name": full})])
        return self[full]

    def drop_collection(self, full: str) -> None:
        self.storage.delete(self._path(full))
        self._publish({}, [self._entry("dropCL", full, {"name": full})])

    def collections(self) -> list[str]:
        out = []
        for space in self.storage.list(self.root):
            if self.storage.exists(f"{self.root}/{space}/_space.json"):
                out += [f"{space}.{c}" for c in self.storage.list(f"{self.root}/{space}") if self.storage.exists(f"{self.root}/{space}/{c}/_current.json")]
        return out

    def listing(self, kind: str) -> DataFrame:
        """Kinds: collections, and shards and groups of sharded ones."""
        if kind == "collections":
            return self.spark.createDataFrame([(c,) for c in sorted(self.collections())], "Name string")
        shards = [(c, self[c].shard_spec()) for c in sorted(self.collections())]
        shards = [(c, spec) for c, spec in shards if spec]
        if kind == "shards":
            return self.spark.createDataFrame([(c, x.key, x.groups, x.kind) for c, x in shards], "Collection string, ShardKey string, NumGroups int, ShardType string")
        if kind == "groups":
            most = max((x.groups for _, x in shards), default=0)
            return self.spark.range(1, most + 1).select(F.col("id").cast("int").alias("GroupId"))
        raise InvalidArgument(f"unknown listing {kind}")

    def __getitem__(self, full: str) -> Collection:
        self._path(full)
        return Collection(self, full)

    # -- change log

    @property
    def log_path(self) -> str:
        return f"{self.root}/_changes/entries"

    def _end(self) -> dict:
        path = f"{self.root}/_changes/end.json"
        return self.storage.read_json(path) if self.storage.exists(path) else {"lsn": 0, "txn": 0}

    @property
    def lsn(self) -> int:
        """The LSN that the next entry has."""
        return self._end()["lsn"]

    def _stage(self, rows: DataFrame, folder: str, base: int, txn: int) -> int:
        """Writes log entries (op, collection, data) with dense LSNs from ``base`` on, and returns the next LSN.

        Rows are kept while partitions are counted, so both passes see the same ones.
        """
        kept = rows.persist()
        try:
            placed = kept.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("__i"))
            starts, at = [], base
            for r in sorted(placed.groupBy("__p").count().collect()):  # a row a partition
                starts.append((r["__p"], at))
                at += r["count"]
            offsets = F.broadcast(self.spark.createDataFrame(starts, "__p int, __base long"))
            lsn = F.col("__base") + F.col("__i")
            placed.join(offsets, "__p").select(
                lsn.alias("lsn"), F.greatest(lsn - 1, F.lit(0)).alias("prevLsn"), F.lit(txn).cast("long").alias("txnId"), "op", "collection", "data"
            ).write.parquet(folder)
        finally:
            kept.unpersist()
        return at

    def _publish(self, states: dict[str, dict], entries: list[DataFrame], txn: int = 0) -> None:
        """Makes new states of collections (by path) and log entries visible together."""
        end, folder = self._end(), f"{self.root}/_changes/staged-{uuid.uuid4().hex}"
        rows = entries[0]
        for more in entries[1:]:
            rows = rows.unionByName(more)
        new = {"lsn": self._stage(rows, folder, end["lsn"], txn), "txn": max(end["txn"], txn)}
        self.storage.write_json(self._pending, {"states": states, "staged": folder, "end": new})
        self._finish()

    @property
    def _pending(self) -> str:
        return f"{self.root}/_changes/pending.json"

    def _finish(self) -> None:
        """Publishes what a write has left to be published; any part of it may have been done before."""
        if not self.storage.exists(self._pending):
            return
        todo = self.storage.read_json(self._pending)
        for path, state in todo["states"].items():
            self.storage.write_json(f"{path}/_current.json", state)
        self.storage.mkdirs(self.log_path)
        for name in self.storage.list(todo["staged"]):
            if name.startswith("part-"):
                self.storage.move(f"{todo['staged']}/{name}", f"{self.log_path}/{name}")
        self.storage.write_json(f"{self.root}/_changes/end.json", todo["end"])
        self.storage.delete(todo["staged"])
        self.storage.delete(self._pending)

    def _entry(self, op: str, collection: str, data: dict) -> DataFrame:
        return self.spark.createDataFrame([(op, collection, json.dumps(data))], "op string, collection string, data string").coalesce(1)

    def changes(self, lsn: int = 0, collection: str | None = None) -> DataFrame:
        return changelog.scan_from(changelog.read(self.spark, self.log_path), lsn, collection)

    def watch(self, collection: str | None = None, start_lsn: int | None = None) -> DataFrame:
        """A stream of entries from an LSN, by default from now on."""
        return changelog.watch(self.spark, self.log_path, self.lsn if start_lsn is None else start_lsn, collection)

    # -- queries by text, transactions, counters

    def sql(self, text: str, strict: bool = False) -> DataFrame | None:
        from docspark.plans.sql import execute

        return execute(self, text, strict)

    def transaction(self) -> Transaction:
        return Transaction(self)

    def snapshot(self, kind: str) -> DataFrame:
        self.counters.add("commands")
        return monitor.snapshot(self.spark, kind, self.counters, self.collections())


class Space:
    """A collection space; collections by their own names."""

    def __init__(self, db: Database, name: str):
        self.db, self.name = db, name

    def create_collection(self, name: str, schema: T.StructType | str | None = None, schemaless: bool = False) -> Collection:
        return self.db.create_collection(f"{self.name}.{name}", schema, schemaless)

    def drop_collection(self, name: str) -> None:
        self.db.drop_collection(f"{self.name}.{name}")

    def collections(self) -> list[str]:
        return [c.partition(".")[2] for c in self.db.collections() if c.partition(".")[0] == self.name]

    def __getitem__(self, name: str) -> Collection:
        return self.db[f"{self.name}.{name}"]


class Collection:
    def __init__(self, db: Database, full: str):
        self.db, self.full = db, full
        self.path = db._path(full)
        self.schemaless = bool(self._state().get("schemaless"))

    def _state(self) -> dict:
        return self.db.storage.read_json(f"{self.path}/_current.json")

    def df(self) -> DataFrame:
        """The current version; later writes don't change what was read here."""
        return self._read(self._state())

    def _read(self, state: dict) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        if not state["parts"]:
            return self.db.spark.createDataFrame([], schema)
        return self.db.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in state["parts"]])

    # -- reads

    def find(self, condition=None, selector=None, order_by=None, skip: int = 0, limit: int = -1) -> DataFrame:
        self.db.counters.add("queries")
        if self.schemaless:
            return documents.find_documents(self.df(), condition, selector, order_by, skip, limit, DOC)
        return finding.find(self.df(), condition, selector, order_by, skip, limit)

    query = find

    def aggregate(self, stages: list[dict], extensions: bool = False, collections=None) -> DataFrame:
        self.db.counters.add("aggregates")
        if self.schemaless:
            if extensions:
                raise InvalidArgument("pipelines of schemaless documents have no extensions")
            return documents.aggregate_documents(self.df(), stages, DOC)
        return pipelines.aggregate(self.df(), stages, extensions, collections)

    def count(self, condition=None) -> int:
        self.db.counters.add("queries")
        if self.schemaless:
            return documents.find_documents(self.df(), condition, doc=DOC).count()
        return finding.matched(self.df(), condition).count()

    def cursor(self, condition=None, batch: int = BATCH, **more) -> Cursor:
        return Cursor(self.find(condition, **more), batch)

    # -- writes

    def _frame(self, docs) -> DataFrame:
        if isinstance(docs, DataFrame):
            if self.schemaless and docs.columns != [DOC]:
                return docs.select(F.to_variant_object(F.struct(*map(V.top, docs.columns))).alias(DOC))
            return docs
        if self.schemaless:
            return documents.from_values(self.db.spark, docs, DOC)
        names = dict.fromkeys(k for d in docs for k in d)
        known = {f.name: f.dataType for f in self._schema()}
        if not names or any(n not in known for n in names):
            return self.db.spark.createDataFrame([{n: d.get(n) for n in names} for d in docs])
        for n in names:
            given = [d[n] for d in docs if d.get(n) is not None]
            if any(V.value_rank(v) != V.type_rank(known[n]) for v in given) and V.type_rank(known[n]) != V.NULL:
                raise InvalidArgument(f"{n}: a value's type doesn't fit the field's column")
            if isinstance(known[n], T.IntegralType) and any(isinstance(v, float) for v in given):
                known[n] = T.DoubleType()
            elif isinstance(known[n], T.IntegerType) and any(not -(1 << 31) <= v < 1 << 31 for v in given):
                known[n] = T.LongType()
        doubles = {n for n in names if isinstance(known[n], (T.DoubleType, T.FloatType))}
        rows = [tuple(float(d[n]) if n in doubles and d.get(n) is not None else d.get(n) for n in names) for d in docs]
        return self.db.spark.createDataFrame(rows, T.StructType([T.StructField(n, known[n]) for n in names]))

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._state()["schema"]))

    def _write(self, write: Callable[[_Draft], None]) -> None:
        draft = _Draft(self)
        try:
            write(draft)
            state = draft.state_to_publish()
            self.db._publish({self.path: state}, draft.entries)
        except Exception:
            draft.discard()
            raise
        draft.tidy()

    def insert(self, docs) -> None:
        """A document, a list of them, or a DataFrame."""
        self._write(lambda d: d.insert(docs))

    insert_many = insert_batch = insert

    def update(self, condition, modifier: dict) -> None:
        """Every matching document; there is no upsert."""
        self._write(lambda d: d.update(condition, modifier))

    def delete(self, condition=None) -> None:
        """Every matching document."""
        self._write(lambda d: d.delete(condition))

    def _check_unique(self, name: str, keys: list[str], new: DataFrame, old: DataFrame | None = None) -> None:
        if self.schemaless:
            new, old = (None if x is None else x.select(*[V.group_key(documents.field(k, DOC)).alias(k) for k in keys]) for x in (new, old))
        if finding.unique_violations(new, keys).limit(1).count():
            raise DuplicateKey(name)
        if old is not None and all(k in old.columns for k in keys):
            same = [old[V.quoted(k)].eqNullSafe(new[V.quoted(k)]) for k in keys]
            if new.join(old, same, "left_semi").limit(1).count():
                raise DuplicateKey(name)

    # -- sharding: metadata of the collection, and its documents laid out by group

    def enable_sharding(self, key: str, groups: int, kind: str = "hash") -> None:
        """Says how documents are dealt to groups from now on; ``sharded`` lays them out."""
        if groups < 1 or kind not in ("hash", "range"):
            raise InvalidArgument("sharding needs groups and a kind, hash or range")
        self._set_shard(ShardSpec(key, groups, kind))

    def add_range(self, group: int, low=None, up=None) -> None:
        spec = self.shard_spec()
        if spec is None or spec.kind != "range":
            raise InvalidArgument("only range sharding has ranges")
        spec.add_range(group, low, up)
        self._set_shard(spec)

    def _set_shard(self, spec: ShardSpec) -> None:
        state = self._state()
        self.db._publish({self.path: state | {"shard": asdict(spec), "version": state["version"] + 1}}, [self.db._entry("shard", self.full, asdict(spec))])

    def shard_spec(self) -> ShardSpec | None:
        found = self._state().get("shard")
        return ShardSpec(**found) if found else None

    def shard_info(self) -> DataFrame:
        return shard_info(self.db.spark, self.shard_spec())

    def sharded(self) -> ShardedTable:
        """The documents that the collection has now, laid out by group, to be split and balanced."""
        spec, rows = self.shard_spec(), self.df()
        if spec is None or self.schemaless:
            raise InvalidArgument(f"{self.full} has no shard key")
        out = ShardedTable.create(self.db.spark, f"{self.path}/shards-{uuid.uuid4().hex}", spec, rows.schema)
        out.insert(rows)
        return out

    # -- indexes: metadata, and uniqueness

    def indexes(self) -> dict[str, dict]:
        return self._state()["indexes"]

    def create_index(self, name: str, key: dict[str, int], unique: bool = False) -> None:
        state = self._state()
        if name in state["indexes"]:
            raise IndexExists(name)
        if not key or any(v not in (1, -1) for v in key.values()):
            raise InvalidArgument("an index key has directions 1 or -1")
        if unique:
            self._check_unique(name, list(key), self.df())
        new = state | {"indexes": state["indexes"] | {name: {"key": key, "unique": unique}}, "version": state["version"] + 1}
        self.db._publish({self.path: new}, [self.db._entry("createIndex", self.full, {"c": self.full, "name": name, "key": key})])

    def drop_index(self, name: str) -> None:
        state = self._state()
        if name not in state["indexes"]:
            raise IndexNotFound(name)
        new = state | {"indexes": {k: v for k, v in state["indexes"].items() if k != name}, "version": state["version"] + 1}
        self.db._publish({self.path: new}, [self.db._entry("dropIndex", self.full, {"c": self.full, "name": name})])

    def watch(self, start_lsn: int | None = None) -> DataFrame:
        return self.db.watch(self.full, start_lsn)


class _Draft:
    """The next version of a collection: statements one after the other, rewritten once, with their log entries.

    Inserts write a part at once; what updates and deletes leave stays a plan until it is published.
    """

    def __init__(self, collection: Collection):
        self.of, self.state = collection, collection._state()
        self.df, self.rewritten, self.parts, self.entries = collection._read(self.state), False, [], []

    def _statement(self) -> str:
        """Grows from statement to statement, also across writes."""
        return f"{self.of.db.lsn:019d}-{len(self.entries):06d}"

    def _log(self, op: str, letter: str, rows: DataFrame, **documents) -> None:
        fields = [F.lit(self.of.full).alias("c"), F.lit(letter).alias("op"), F.lit(self._statement()).alias("s"), *[d.alias(n) for n, d in documents.items()]]
        self.entries.append(rows.select(F.lit(op).alias("op"), F.lit(self.of.full).alias("collection"), F.to_json(F.struct(*fields)).alias("data")))

    def _unique(self):
        return ((name, list(index["key"])) for name, index in self.state["indexes"].items() if index["unique"])

    def _part(self, df: DataFrame) -> str:
        part = f"v{self.state['version'] + 1:06d}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.of.path}/{part}")
        self.parts.append(part)
        return part

    def insert(self, docs) -> None:
        new = self.of._frame([docs] if isinstance(docs, dict) else docs)
        both = self.df.limit(0).unionByName(new, allowMissingColumns=True)
        widened = any(f.name in self.df.columns and self.df.schema[f.name].dataType != f.dataType for f in both.schema)
        part = self._part(both)
        written = self.of.db.spark.read.schema(both.schema).parquet(f"{self.of.path}/{part}")
        for name, keys in self._unique():
            self.of._check_unique(name, keys, written, self.df)
        if widened or self.rewritten:  # Parquet files keep their types: all is written with the wider ones
            self.rewritten, self.df = True, self.df.unionByName(written, allowMissingColumns=True)
        else:
            self.state = self.state | {"parts": [*self.state["parts"], part], "schema": both.schema.json()}
            self.df = self.of._read(self.state)
        self._log("insert", "I", written, doc=self._document())
        self.of.db.counters.add("inserts")

    def _document(self, df: DataFrame | None = None) -> Column:
        return F.col(DOC) if self.of.schemaless else F.struct("*") if df is None else F.struct(*map(V.top, df.columns))

    def _hit(self, condition) -> Column:
        if self.of.schemaless:
            return F.coalesce(compile_variant_condition(condition, DOC), F.lit(False)) if condition else F.lit(True)
        return F.coalesce(compile_condition(condition or {}, self.df.schema), F.lit(False))

    def update(self, condition, modifier: dict) -> None:
        hit = self._hit(condition)
        rows = self.df.withColumn("__old", F.when(hit, self._document(self.df)))
        after = documents.modify_documents(rows, modifier, condition, DOC) if self.of.schemaless else apply_modifier(rows, modifier, hit)
        new = after.drop("__old")
        for name, keys in self._unique():
            self.of._check_unique(name, keys, new)
        self._log("update", "U", after.where(F.col("__old").isNotNull()), old=F.col("__old"), new=self._document(new))
        self.df, self.rewritten = new, True
        self.of.db.counters.add("updates")

    def delete(self, condition=None) -> None:
        hit = self._hit(condition)
        self._log("delete", "D", self.df.where(hit), doc=self._document())
        self.df, self.rewritten = self.df.where(~hit), True
        self.of.db.counters.add("deletes")

    def state_to_publish(self) -> dict:
        if self.rewritten:
            self.state = self.state | {"parts": [self._part(self.df)] if self.df.columns else [], "schema": self.df.schema.json()}
        return self.state | {"version": self.state["version"] + 1}

    def _drop(self, parts: list[str]) -> None:
        for part in parts:
            self.of.db.storage.delete(f"{self.of.path}/{part}")

    def discard(self) -> None:
        """After a failure nobody needs what was written, unless it is to be published."""
        if not self.of.db.storage.exists(self.of.db._pending):
            self._drop(self.parts)

    def tidy(self) -> None:
        self._drop([p for p in self.parts if p not in self.state["parts"]])


class Transaction:
    """Writes kept until commit; reads don't see them. Rolls back if its block raises.

    Commit applies them in order, each to what those before have made, writes each
    collection once, and publishes all with one append to the log. If one fails, nothing of
    it is published, and the log says only that the transaction began and was aborted.
    """

    def __init__(self, db: Database):
        self.db, self._writes, self._open = db, [], True

    def _add(self, full: str, write: Callable[[_Draft], None]) -> None:
        if not self._open:
            raise TransactionError("the transaction has ended")
        self._writes.append((full, write))

    def insert(self, full: str, docs) -> None:
        self._add(full, lambda d: d.insert(docs))

    def update(self, full: str, condition, modifier: dict) -> None:
        self._add(full, lambda d: d.update(condition, modifier))

    def delete(self, full: str, condition=None) -> None:
        self._add(full, lambda d: d.delete(condition))

    def commit(self) -> None:
        if not self._open:
            raise TransactionError("the transaction has ended")
        self._open = False
        txn = self.db._end()["txn"] + 1
        began, drafts, entries = self.db._entry("txnBegin", "", {}), {}, []
        try:
            for full, write in self._writes:
                if full not in drafts:
                    drafts[full] = _Draft(self.db[full])
                write(drafts[full])
                entries.append(drafts[full].entries[-1])
            states = {d.of.path: d.state_to_publish() for d in drafts.values()}
            self.db._publish(states, [began, *entries, self.db._entry("txnCommit", "", {})], txn)
        except Exception:
            if self.db.storage.exists(self.db._pending):  # it has happened, and the next who opens the database finishes it
                raise
            for d in drafts.values():
                d.discard()
            self.db._publish({}, [began, self.db._entry("txnAbort", "", {})], txn)
            raise
        for d in drafts.values():
            d.tidy()

    def rollback(self) -> None:
        if not self._open:
            raise TransactionError("the transaction has ended")
        self._open, self._writes = False, []

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if self._open:
            self.commit() if kind is None else self.rollback()
