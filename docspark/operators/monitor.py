"""Counters of a session, and snapshots of them."""

from __future__ import annotations

import threading
import time
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

from docspark.errors import InvalidArgument


class Counters:
    def __init__(self):
        self._lock, self._counts, self.began = threading.Lock(), Counter(), time.time()

    def add(self, name: str, n: int = 1) -> None:
        with self._lock:
            self._counts[name] += n

    def __getitem__(self, name: str) -> int:
        return self._counts[name]


NAMES = ("queries", "inserts", "updates", "deletes", "aggregates", "commands")


def snapshot(spark: SparkSession, kind: str, counters: Counters, collections: list[str]) -> DataFrame:
    """Kinds: database, sessions, collections, health."""
    if kind == "collections":
        return spark.createDataFrame([(c,) for c in sorted(collections)], "Name string")
    if kind == "database":
        return spark.createDataFrame([tuple(counters[n] for n in NAMES)], ", ".join(f"{n} long" for n in NAMES))
    if kind == "sessions":
        return spark.createDataFrame([(spark.sparkContext.applicationId, spark.sparkContext.sparkUser())], "session string, user string")
    if kind == "health":
        return spark.createDataFrame([("ok", time.time() - counters.began)], "status string, uptime double")
    raise InvalidArgument(f"unknown snapshot {kind}")
