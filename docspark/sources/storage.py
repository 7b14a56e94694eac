"""Small files and folders through the file system that Spark uses for a path."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Storage:
    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def list(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def mkdirs(self, path: str) -> None:
        fs, p = self._at(path)
        fs.mkdirs(p)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def move(self, path: str, to: str) -> None:
        """Renames a file; one that has been moved before is left alone."""
        fs, p = self._at(path)
        _, target = self._at(to)
        if fs.exists(p) and not fs.rename(p, target):
            raise OSError(f"{path} can't be moved to {to}")

    def read_json(self, path: str):
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def write_json(self, path: str, value) -> None:
        """Writes beside ``path``, then renames over it, so readers see the old or the new file."""
        fs, p = self._at(path)
        fs.mkdirs(p.getParent())
        _, new = self._at(path + ".new")
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(json.dumps(value).encode()))
        finally:
            stream.close()
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        overwrite[0] = options.OVERWRITE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self._conf).rename(new, p, overwrite)
