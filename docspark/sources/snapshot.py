"""Snapshot folders: space/collection.dat, binary documents one behind the other.

Reading is a Spark source, ``docspark_snapshot``, with a partition a file, that yields
the collection's name and a document as extended JSON.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from docspark.session import importable
from docspark.sources import bson, extjson


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[_File]:
        from pyarrow import fs

        system, root = _system(self.path)
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(f.path) for f in sorted(found, key=lambda f: f.path) if f.path.endswith(".dat")]

    def read(self, partition: _File) -> Iterator[tuple]:
        space, _, name = partition.path.rpartition("/")
        full = f"{space.rpartition('/')[2]}.{name[:-4]}"
        system, _ = _system(self.path)
        with system.open_input_stream(partition.path) as f:
            held = b""
            while chunk := f.read(1 << 20):
                held += chunk
                at = 0
                while len(held) - at >= 4 and len(held) - at >= (n := int.from_bytes(held[at : at + 4], "little")):
                    if n < 5:
                        return
                    doc, at = bson.decode(held, at)
                    yield full, extjson.dumps(doc)
                held = held[at:]


def _system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.split(":", 1)[1].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


class SnapshotSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "docspark_snapshot"

    def schema(self) -> str:
        return "collection string, json string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """collection and doc (VARIANT) of every document below the folder."""
    importable(spark).dataSource.register(SnapshotSource)
    rows = spark.read.format("docspark_snapshot").option("path", path).load()
    return rows.select("collection", F.parse_json("json").alias("doc"))


def write_snapshot(df: DataFrame, path: str, full_name: str) -> None:
    """One file for the collection, written by one task; for the format's sake, not for large tables (those are Parquet)."""
    space, _, name = full_name.partition(".")
    importable(df.sparkSession)
    rows = extjson.to_json_rows(df).coalesce(1)

    def write(batches):
        import pyarrow as pa

        system, root = _system(path)
        system.create_dir(f"{root}/{space}", recursive=True)
        n = 0
        with system.open_output_stream(f"{root}/{space}/{name}.dat") as f:
            for b in batches:
                for text in b.column(0).to_pylist():
                    f.write(bson.encode(extjson.loads(text)))
                    n += 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64())})

    rows.mapInArrow(write, "n long").collect()
