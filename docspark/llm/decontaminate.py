"""Benchmark decontamination: MinHash containment search for short items in long texts.

Items and documents are sets of 5-word shingles. A document contains an item if it
has at least ``CONTAINED`` of the item's shingles. Items are partitioned by size: in
the class of items with at most u shingles, an item's sketch is its
floor((1 - CONTAINED) * u) + 1 shingles with the least hashes. A document that
contains an item lacks fewer of its shingles than the sketch has, so at least one
sketch value is among the document's shingle hashes: no containing document is
missed, however long it is. (Banded signatures of whole documents would need
thousands of hash functions for documents that are hundreds of times as long as an
item, and still miss some.) Candidates are verified on the shingles themselves.

The items' sketches are a table (value, item, class), made in tasks. One pass over the
documents sends on those hashes of theirs that a sieve of ``SIEVE_BITS`` bits lets through,
which is all of the benchmark that every task holds; a join with the table gives candidates.
Only candidates' texts are read again, with the texts of their items. The benchmark is
never at the driver, and documents without a candidate are never shuffled.

Words are runs of letters, digits and underscores in lower case. Defined results:
items of fewer than five words have no shingle and are found only if ``least`` allows for
as few words; then the item is one shingle, so its words in a row are its leak. By
default they aren't, being too general to prove a leak. Null texts have no words; items
with null ids are found and keep the null; repeated rows, of items or documents, are
searched each by itself; empty tables give an empty result; a very long text is held by
one task at a time, as its words and their hashes. Other columns are ignored by the search.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.blocks import semi
from docspark.llm.common import BROADCAST_ROWS, pieces, settle, unsettle
from docspark.llm.shingles import windows, word_hashes

CONTAINED, SHINGLE = 0.8, 5
#: Bits of the sieve, and tasks that make it.
SIEVE_BITS, SIEVE_TASKS = 20, 16

_words = re.compile(r"\w+").findall


def item_words(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def grams(words: list[str], n: int = SHINGLE) -> set:
    return set(zip(*(words[i:] for i in range(n))))


def size_class(n: int) -> int:
    """The most shingles of items in the class of n: a power of two."""
    return 1 << (n - 1).bit_length()


def item_sketch(words: list[str], least: int = SHINGLE) -> tuple[int, np.ndarray]:
    """Class and sketch of an item; nothing for one of fewer than ``least`` words."""
    if len(words) < max(least, 1):
        return 0, np.zeros(0, np.uint64)
    h = np.unique(windows(word_hashes(words), SHINGLE))
    bound = size_class(len(h))
    return bound, h[: int((1 - CONTAINED) * bound + 1e-9) + 1]


def sketch_table(items: DataFrame, least: int) -> DataFrame:
    """(value, r, class, words) of items (r, text): words is 0, or how many an item of fewer than SHINGLE has. Settled."""
    names = ["value", "r", "class", "words"]

    def build(batches):
        for b in pieces(batches):
            rows = []
            for r, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = item_words(t)
                bound, sketch = item_sketch(w, least)
                rows += [(x, r, bound, len(w) if len(w) < SHINGLE else 0) for x in sketch.view(np.int64).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(4)], names)

    return settle(items.select("r", "text").mapInArrow(build, "value long, r long, class long, words long"), "item-sketches")


def sieve_of(table: DataFrame) -> np.ndarray:
    """Which leading bits some sketch value has. Its size is the same for any benchmark."""

    places = 1 << SIEVE_BITS

    def build(batches):
        bits = np.zeros(places, bool)
        for b in batches:
            bits[_slot(b.column(0).to_numpy(), places)] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], ["bits"])

    out = np.zeros(places // 8, np.uint8)
    for row in table.select("value").coalesce(SIEVE_TASKS).mapInArrow(build, "bits binary").collect():
        out |= np.frombuffer(row["bits"], np.uint8)
    return np.unpackbits(out).astype(bool)


def _slot(h: np.ndarray, places: int) -> np.ndarray:
    return h.view(np.uint64) >> np.uint64(64 - places.bit_length())


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
          least: int = SHINGLE) -> DataFrame:
    """(doc_id, item_id, item_shingles, shared_shingles), a row for each item that a document contains."""
    schema = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    items = benchmark.select(F.monotonically_increasing_id().alias("r"), F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    items = settle(items, "benchmark-items")
    table = sketch_table(items, least)
    size = table.count()
    if not size:
        return docs.sparkSession.createDataFrame([], schema)
    sieve = sieve_of(table)
    short = [r["words"] for r in table.where("words > 0").select("words").distinct().collect()]  # SHINGLE - 1 rows at most

    def hits(batches):
        for b in pieces(batches):
            keys, values = [], []
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                w = item_words(t)
                if not w:
                    continue
                h = word_hashes(w)
                found = [windows(h, n) for n in (SHINGLE, *short) if len(w) >= n]
                found = np.concatenate([np.zeros(0, np.uint64), *found])
                found = np.unique(found[sieve[_slot(found, len(sieve))]])
                keys.append(np.full(len(found), key))
                values.append(found.view(np.int64))
            none = np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *keys])), pa.array(np.concatenate([none, *values]))], ["key", "value"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    side = table.select("value", "r")
    candidates = rows.select("key", "text").mapInArrow(hits, "key long, value long").join(F.broadcast(side) if size <= BROADCAST_ROWS else side, "value")
    candidates = settle(candidates.select("key", "r").distinct(), "leak-candidates")
    of_doc = candidates.join(items, "r").groupBy("key").agg(F.collect_list(F.struct("item_id", "text")).alias("items"))
    of_doc = settle(of_doc, "candidate-items")
    unsettle(table, candidates)
    types = pa.schema([(x.split()[0], pa.int64()) for x in schema.split(", ")])

    def verify(batches):
        for b in pieces(batches, 50):
            found = []
            for d, t, several in zip(*(c.to_pylist() for c in b.columns)):
                w = item_words(t)
                own = {}
                for item in several:
                    words = item_words(item["text"])
                    n = min(SHINGLE, len(words))
                    if n not in own:
                        own[n] = grams(w, n)
                    wanted = grams(words, n)
                    both = len(wanted & own[n])
                    if both >= CONTAINED * len(wanted) - 1e-9:
                        found.append((d, item["item_id"], len(wanted), both))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], schema=types)

    texts = semi(rows, of_doc.select("key"), "key").join(of_doc, "key")
    return texts.select("doc_id", "text", "items").mapInArrow(verify, schema)


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose document contains no item of the benchmark."""
    found = settle(leaks(docs, benchmark, doc_id, text).where("doc_id IS NOT NULL").select(F.col("doc_id").alias(doc_id)).distinct(), "leaking-documents")
    return semi(docs, found, doc_id, "left_anti")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("containment", F.col("shared_shingles") / F.col("item_shingles"))


OP5_SQL = r"""
WITH i AS (SELECT item_id, row_number() OVER () AS r, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
ig AS (SELECT DISTINCT item_id, r, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM i)),
n AS (SELECT item_id, r, count(*) AS n FROM ig GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
dg AS (SELECT DISTINCT doc_id, rid, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - 3)) AS k FROM d)),
m AS (SELECT doc_id, rid, item_id, r, count(*) AS s FROM dg JOIN ig USING (g) GROUP BY ALL)
SELECT m.doc_id, m.item_id, n.n::BIGINT AS item_shingles, m.s::BIGINT AS shared_shingles, m.s / n.n AS containment
FROM m JOIN n USING (r) WHERE 10 * m.s >= 8 * n.n
"""
