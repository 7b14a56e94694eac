"""Sharding: minimax contiguous partition over ordered atomic groups.

Rows with equal texts form an atomic group. Groups are ordered by the digest of
their text, which spreads any corpus evenly over the order. The smallest feasible
shard capacity is found by binary search; a capacity is feasible if greedy filling
needs no more than the given number of shards. Cuts are digests, so a row finds its
shard by comparing its own digest with n - 1 constants: nothing is joined or
collected by group, however large one group is.

The search doesn't look at single groups. It looks at segments, all groups whose
digest begins with the same hex digits: at first 4096 of them, each a sum. A
segment with one group is exact. Greedy filling that may split other segments gives
a lower bound of the capacity, filling that may not gives an upper bound, and only
the segments in which a cut may fall between the two are divided by two more hex
digits. So the driver holds a few thousand sums at any size of the corpus.

Defined results: a null text counts as an empty one (size 1, checksum 0); repeated
rows stay in one group; ids may repeat or be null; with fewer groups than shards,
or with one that outweighs the rest, some shards are empty; an empty table gives an
empty result. Other columns are carried along; a column whose name an output column
has is replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import settle, text_key, whole_text

SHARDS = 16
#: Hex digits of the first segments, and those added when a segment is divided.
FIRST, MORE = 3, 2
#: Within a shard, rows are numbered in so many parts, each by another task.
SLOT_PARTS = 256


def with_digest(df: DataFrame, text: str = "text") -> DataFrame:
    t = whole_text(text)
    return df.withColumns(
        {"size": F.octet_length(t).cast("long") + 1, "text_crc32": F.crc32(t.cast("binary")), "__key": text_key(t)}
    )


class Segments:
    """Ordered segments with their sizes, and greedy filling over them."""

    def __init__(self, rows: list[tuple[str, int, str, str]]):
        #: rows: common prefix, size, least and greatest digest.
        self.rows = sorted(rows)
        self.ends = [0, *accumulate(r[1] for r in self.rows)]
        self.total = self.ends[-1]
        self.atomic = [r[2] == r[3] for r in self.rows]

    def whole_cuts(self, capacity: int, n: int, start: int = 0) -> list[int] | None:
        """Segment numbers at which shards end if no segment is split; None if n shards don't hold all."""
        cuts, at = [], start
        while at < len(self.rows):
            if len(cuts) == n:
                return None
            to = bisect_right(self.ends, self.ends[at] + capacity) - 1
            if to == at:
                return None
            cuts.append(at := to)
        return cuts

    def split_cuts(self, capacity: int, n: int) -> list[int] | None:
        """The same in sizes before the cut, if all but single groups may be split anywhere."""
        cuts, at = [], 0
        while at < self.total:
            if len(cuts) == n:
                return None
            to = min(at + capacity, self.total)
            k = bisect_right(self.ends, to) - 1
            if k < len(self.rows) and self.ends[k] < to and self.atomic[k]:
                to = self.ends[k]
            if to <= at:
                return None
            cuts.append(at := to)
        return cuts

    def least(self, fill, n: int) -> int:
        low, high = 0, self.total
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if fill(mid, n) is not None else (mid + 1, high)
        return low

    def doubtful(self, low: int, high: int, n: int) -> list[str]:
        """Prefixes of the segments that hold several groups and a possible cut."""
        first = self.whole_cuts_from_below(low, n)
        last = self.split_cuts(high, n)
        found = set()
        for k in range(max(len(first), len(last))):
            a = first[k] if k < len(first) else self.total
            b = last[k] if k < len(last) else self.total
            i = max(0, bisect_right(self.ends, min(a, b)) - 1)
            j = min(len(self.rows), bisect_left(self.ends, max(a, b)) + 1)
            found.update(x for x in range(i, j) if not self.atomic[x])
        return [self.rows[x][0] for x in sorted(found)]

    def whole_cuts_from_below(self, capacity: int, n: int) -> list[int]:
        """Sizes before the first n cuts if no segment is split, or one is alone that's too large."""
        cuts, at = [], 0
        while at < len(self.rows) and len(cuts) < n:
            at = max(at, bisect_right(self.ends, self.ends[at] + capacity) - 1)
            cuts.append(self.ends[at])
            if self.ends[at] + capacity < self.ends[min(at + 1, len(self.rows))]:
                cuts += [self.ends[at]] * (n - len(cuts))
        return cuts

    def evened(self, capacity: int, n: int) -> list[int]:
        """Cuts for that capacity, each as near to an equal part of the rest as the capacity lets it be."""
        cuts, at = [], 0
        for left in range(n - 1, 0, -1):
            if at >= len(self.rows):
                break
            most = bisect_right(self.ends, self.ends[at] + capacity) - 1
            goal = self.ends[at] + (self.total - self.ends[at]) / (left + 1)
            k = bisect_left(self.ends, goal)
            if k > at + 1 and goal - self.ends[k - 1] < self.ends[min(k, len(self.rows))] - goal:
                k -= 1
            low, high = min(max(k, at + 1), most), most
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if self.whole_cuts(capacity, left, mid) is not None else (mid + 1, high)
            cuts.append(at := low)
        return [x for x in cuts if x < len(self.rows)]


def _sums(rows: DataFrame, digits: int) -> list[tuple]:
    got = rows.groupBy(F.substring("__key", 1, digits).alias("p")).agg(
        F.sum("size").alias("s"), F.min("__key").alias("a"), F.max("__key").alias("b")
    )
    return [(r.p, r.s, r.a, r.b) for r in got.collect()]


def minimax_cuts(rows: DataFrame, n: int = SHARDS) -> list[str]:
    """Digests at which shards 1, 2, ... begin. ``rows``: __key and size, a row each document."""
    digits = FIRST
    found = _sums(rows, digits)
    while True:
        s = Segments(found)
        low, high = s.least(s.split_cuts, n), s.least(s.whole_cuts, n)
        doubt = s.doubtful(low, high, n) if low < high else []
        if not doubt:
            return [s.rows[k][2] for k in s.evened(high, n)]
        digits, was = digits + MORE, digits
        again = set(doubt)
        fine = _sums(rows.where(F.substring("__key", 1, was).isin(doubt)), digits)
        found = [r for r in found if r[0] not in again] + fine


def shard_of(cuts: list[str], key: Column) -> Column:
    out = F.lit(0)
    for cut in cuts:
        out = out + (key >= F.lit(cut)).cast("int")
    return out.cast("int")


def numbered(df: DataFrame, counts: DataFrame, doc_id: str) -> DataFrame:
    """Adds slot: gapless from 0 in each shard. ``counts``: __key and doc_id's rows, from which parts are counted."""
    part = F.pmod(F.xxhash64(doc_id), F.lit(SLOT_PARTS)).cast("int")
    parts = counts.groupBy("shard", part.alias("__part")).count()
    # At most n * SLOT_PARTS rows: a constant.
    starts = parts.select(
        F.col("shard").alias("__s"), F.col("__part").alias("__p"),
        (F.sum("count").over(Window.partitionBy("shard").orderBy("__part")) - F.col("count")).alias("__start"),
    )
    order = Window.partitionBy("shard", "__part").orderBy(doc_id, "__key")
    rows = df.withColumn("__part", part).withColumn("__n", F.row_number().over(order))
    return (
        rows.join(F.broadcast(starts), (F.col("shard") == F.col("__s")) & (F.col("__part") == F.col("__p")))
        .withColumn("slot", (F.col("__start") + F.col("__n") - 1).cast("long"))
        .drop("__s", "__p", "__part", "__start", "__n", "__key")
    )


def shard(df: DataFrame, n: int = SHARDS, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """``df`` with size, text_crc32, law, shard, slot and grown_shard."""
    narrow = settle(with_digest(df.select(doc_id, text), text).select(doc_id, "size", "text_crc32", "__key"), "shard-digests")
    cuts = minimax_cuts(narrow, n)
    placed = narrow.withColumn("shard", shard_of(cuts, F.col("__key")))
    full = with_digest(df, text).withColumn("shard", shard_of(cuts, F.col("__key"))) if keep_text else placed
    return numbered(full, placed, doc_id).withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op10_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = shard(docs, SHARDS, keep_text=False)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
