"""Comparing the members of a list in bounded blocks inside tasks, and what decides a pair.

A list is all members that have a key. Its members go to tasks in blocks of about
``CHUNK``; a task holds one block and compares all its pairs by matrix products. It
returns few rows: members that have some pair, or links that hold together whatever
all links of the block do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import pieces, settle, unsettle
from docspark.llm.shingles import jaccard, shingle_hashes, shingle_set

#: Members that a task compares at once, and values in one matrix product.
CHUNK, COLUMNS = 1024, 2048
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Ids that may be broadcast: 8 MB.
BROADCAST_IDS = 1_000_000


def semi(rows: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join to settled ids, which are broadcast if they are at most BROADCAST_IDS."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, how)


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(a, b, linked) of settled pairs, decided on full shingle sets. docs: doc_id, text (binary). Settled."""
    ids = settle(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "pair-ids")
    texts = settle(semi(docs, ids, "doc_id"), "pair-texts")
    out = settle(decided(pairs, texts, k).groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified")
    unsettle(texts, ids)
    return out


def decided(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """(a, b, linked) of pairs, decided on full shingle sets; more than once if ``texts`` (doc_id, text) have an id more than once."""
    joined = pairs.select("a", "b").join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")

    def exact(batches):
        last, kept = None, set()
        for batch in pieces(batches):
            linked = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if tb != last:
                    last, kept = tb, shingle_set(tb, k)
                both, union = jaccard(shingle_set(ta, k), kept)
                linked.append(100 * both >= PERCENT * union > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return joined.select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long, linked boolean")


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def shared_values(sketches: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many values each of the sketches ``left`` shares with each of ``right``."""
    values = np.concatenate(sketches)
    row = np.repeat(np.arange(len(sketches)), [len(s) for s in sketches])
    _, column, count = np.unique(values, return_inverse=True, return_counts=True)
    common = count > 1
    number = np.cumsum(common) - 1
    row, column = row[common[column]], number[column[common[column]]]
    out = np.zeros((len(left), len(right)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for first in range(0, int(common.sum()), COLUMNS):
        a, b = np.searchsorted(column, (first, first + COLUMNS))
        part = np.zeros((len(sketches), COLUMNS), np.float32)
        part[row[a:b], column[a:b] - first] = 1
        out += part[left] @ part[right].T
    return out


def forest(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Few of the pairs (row, column) of a matrix of links that hold together whatever all of them do."""
    across = np.ascontiguousarray(linked.T)
    left, right = [], []
    rows, columns = np.zeros(len(linked), bool), np.zeros(len(across), bool)
    for first in np.flatnonzero(linked.any(1)):
        if rows[first]:
            continue
        rows[first] = True
        ready = [first]
        while ready:
            i = ready.pop()
            new = np.flatnonzero(linked[i] & ~columns)
            columns[new] = True
            left.append(np.full(len(new), i))
            right.append(new)
            for j in new:
                more = np.flatnonzero(across[j] & ~rows)
                rows[more] = True
                left.append(more)
                right.append(np.full(len(more), j))
                ready.extend(more)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def sides(side: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Left members (side 0) and right ones (side 1); if there is no right, left ones are compared with each other."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, right if len(right) else left


def block_links(v, n, label, side, sets, *_):
    """Links of a block that make the components which all its links between members with different labels make.

    Every pair is counted on full sets. Left and right are as in ``sides``.
    """
    left, right = sides(side)
    if not len(left) or len(v) < 2:
        return v[:0], v[:0], np.zeros(0)
    both = shared_values(sets, left, right)
    union = n[left][:, None] + n[right][None, :] - both
    i, j = forest((100 * both >= PERCENT * union) & (both > 0) & (label[left][:, None] != label[right][None, :]))
    return v[left[i]], v[right[j]], (both[i, j] / union[i, j]).astype(np.float64)


def in_blocks(rows: DataFrame, compare) -> DataFrame:
    """key, block, a, b, like: what ``compare`` returns of each block (key, block) of rows key, block, side, v, n, label, sketch, keys.

    ``compare`` gets v, n, label and side as arrays, lists of sketches and keys as arrays, and (key, block).
    """

    def run(batches):
        ready: list = []

        def block_done(at, held) -> bool:
            """Whether enough is ready to be sent."""
            columns = [np.concatenate([h[k] for h in held]) for k in range(4)]
            pairs = compare(*columns, [s for h in held for s in h[4]], [s for h in held for s in h[5]], at)
            if n := len(pairs[0]):
                ready.append((np.full(n, at[0]), np.full(n, at[1]), *pairs))
            return sum(len(x[0]) for x in ready) > 20_000 or len(ready) > 2000

        def send():
            columns = [pa.array(np.concatenate(x)) for x in zip(*ready)]
            ready.clear()
            return pa.RecordBatch.from_arrays(columns, ["key", "block", "a", "b", "like"])

        held, at = [], None
        for b in batches:
            key, block = b.column(0).to_numpy(), b.column(1).to_numpy()
            v, n, label, side = (b.column(c).to_numpy() for c in (3, 4, 5, 2))
            sets, keys = ([np.frombuffer(s, ">i8") for s in b.column(c).to_pylist()] for c in (6, 7))
            new = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            cuts = [0, *new.tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                here = (key[i], block[i])
                if held and here != at:
                    if block_done(at, held):
                        yield send()
                    held = []
                at = here
                held.append((v[i:j], n[i:j], label[i:j], side[i:j], sets[i:j], keys[i:j]))
        if held:
            block_done(at, held)
        if ready:
            yield send()

    dealt = rows.select("key", "block", F.col("side").cast("int").alias("side"), "v", "n", "label", "sketch", "keys").repartition("key", "block").sortWithinPartitions("key", "block", "side")
    return dealt.mapInArrow(run, "key long, block long, a long, b long, like double")


def chunk_of(v: str, chunks: Column) -> Column:
    return F.pmod(F.xxhash64(v), chunks).cast("long")


def chunks_of(count: str) -> Column:
    return F.ceil(F.col(count) / CHUNK).cast("long")


def each_of(n: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), n - 1))


def labelled(rows: DataFrame, labels: DataFrame | None, v: str, name: str) -> DataFrame:
    if labels is None:
        return rows.withColumn(name, F.col(v))
    return rows.join(labels.select(F.col("v").alias(v), F.col("label").alias("__l")), v, "left").withColumn(name, F.coalesce("__l", v)).drop("__l")


def full_sets(ids: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """v, n and full set (hashes) of settled ids (doc_id). Settled."""

    def build(batches):
        for b in pieces(batches):
            sets = [shingle_hashes(t, k) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype(">i8").tobytes() for s in sets], pa.binary())], ["v", "n", "sketch"]
            )

    return settle(semi(docs, ids, "doc_id").select("doc_id", "text").mapInArrow(build, "v long, n long, sketch binary").distinct(), "full-sets")
