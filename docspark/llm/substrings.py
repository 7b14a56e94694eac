"""Substring dedup: paragraphs that documents share, by MinHash banding.

A paragraph is a run of ``SPAN`` words that begins at a place chosen by content: of
``PLACES`` neighbouring places, that whose five words hash least. Two texts choose
the same places within a passage that they share, wherever it stands and however
lines break around it; any common passage of SPAN + PLACES - 1 = 50 words holds at
least one whole common paragraph. (Lines would not do: a passage copied into the
middle of a line shares no line.)

A paragraph's 5-word shingles are kept as ``TINY``-bit hashes beside it. Their MinHash
values are banded: ``ROWS`` values a band, ``tuned_bands(rows=ROWS)`` bands, the fewest by which
a paragraph with a Jaccard similarity of 0.8 is missed once in a thousand. Keys travel
packed with their class, so that a row of Spark holds those of a bucket; lists of the same
members are compared once. Paragraphs of different documents that share a band collide.
Equal ones are one class.

With its key a class brings 64 bits: for each place, whether an odd number of its distinct
small hashes falls on it. A shingle that only one of two sets has changes at most one bit, and sets
at 0.8 have at most ``DIFFER`` = 4 such shingles between them; so pairs that differ in more
bits are left out where the key's list is met, and no pair at 0.8 is lost. Pairs left are
verified on the words. Lists with over ``MANY`` such pairs a member go on as lists, of the
members that have one (of all, beyond ``LONGEST`` members). Their members are compared on
full sets in bounded blocks inside tasks, all pairs of a block; of those with a Jaccard
similarity of 0.8 as many as hold the block's components together are verified on the
words. Links make components. In lists of several blocks, members outside the largest
component are then compared with all others of the list, in pairs of blocks; so no list
holds linked members of different
components. In each component, paragraphs of the document that has the first one stay,
and those of other documents are removed.

Defined results: a row for each paragraph whose component is in several documents;
texts of under SPAN words, empty and null ones have no paragraph; rows with null ids
are left out, and rows that share an id are one document; an empty table gives an
empty result; a very long text is held by one task at a time, as its words and their
hashes. Words are as in near-duplicates: A-Z in lower case, split at white space.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.blocks import PERCENT, block_links, chunk_of, chunks_of, decided, each_of, in_blocks, labelled, ordered, semi, verified
from docspark.llm.common import BROADCAST_ROWS, HOT_SHARE, pieces, release, settle, unsettle
from docspark.llm.components import components, extended
from docspark.llm.neardup import outsiders
from docspark.llm.shingles import P, mixed, shingle_hashes, windows, word_hashes, words

SPAN, PLACES, SHINGLE = 25, 26, 5
ROWS, LIKE, PARAGRAPHS, MISSED = 3, 0.8, 1, 0.001
#: Band keys go to so many buckets at least, and to more if one would hold more keys than FULL; they leave a task when it has READY.
BUCKETS, FULL, READY = 1024, 1 << 18, 1 << 18
#: Bits of a small hash, small hashes in a number of 64 bits, and numbers a paragraph: its hashes, and behind them how many
#: distinct shingles and how many distinct small hashes it has.
TINY, EACH, NUMBERS = 12, 5, 5
PLACE = np.arange(EACH, dtype=np.int64) * TINY
#: Rounds in which bands are dealt out, so that their keys aren't on disk all at once.
ROUNDS = 3
#: Classes of a list whose pairs are always sent, pairs a member that longer ones may send, classes of a list up to which
#: members are compared in the bucket, and pairs compared at once.
FEW, MANY, LONGEST, AT_ONCE = 32, 16, 1 << 14, 50_000
#: What a band key brings of a paragraph: the key's low half, ``distinct_bits``, and its class.
ENTRY = np.dtype([("k", "<u4"), ("s", "<u8"), ("v", "<i8")])
#: Two sets of a paragraph's shingles at PERCENT: so many are at most in one only.
DIFFER = 2 * (SPAN - SHINGLE + 1) * (100 - PERCENT) // (100 + PERCENT)
#: Odd multipliers that make four and more hash functions of one.
FACTORS = np.arange(1, 33, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1)
#: A hash function a row: the ranks that it gives the small hashes.
RANKS = [np.argsort(np.argsort(mixed(np.arange(1, (1 << TINY) + 1, dtype=np.uint64) * f))).astype(np.uint16) for f in FACTORS[:30]]


def tuned_bands(like: float = LIKE, rows: int = 2, paragraphs: int = PARAGRAPHS, missed: float = MISSED) -> int:
    """The fewest bands by which all of so many alike paragraphs are missed with at most that probability."""
    bands = 1
    while (1 - like**rows) ** (bands * paragraphs) > missed:
        bands += 1
    return bands


def least(h: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    k = 1
    while 2 * k <= n:
        h, k = np.minimum(h[:-k], h[k:]), 2 * k
    return np.minimum(h[: len(h) - n + k], h[n - k :])


def places(h: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
    """Of each PLACES neighbours the (first) one with the least hash. h: hashes of the places of a text, or of texts that begin and end there."""
    if begin is None:
        begin, end = np.array([0]), np.array([len(h)])
    found = [np.array([i + h[i:j].argmin() for i, j in zip(begin.tolist(), end.tolist()) if 0 < j - i <= PLACES], np.int64)]
    long = end - begin > PLACES
    if long.any():
        value = least(h, PLACES)
        # Neighbours have the place of those before them, unless the least hash is another, or its first place is left behind.
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (h[: len(value) - 1] == value[:-1])
        new[begin[long]] = True
        inside = np.zeros(len(h) + 1, np.int8)
        inside[begin[long]] = 1
        inside[end[long] - PLACES + 1] = -1
        at = np.flatnonzero(new & (np.cumsum(inside, dtype=np.int8)[: len(value)] > 0))
        found.append(at + h[at[:, None] + np.arange(PLACES)].argmin(1))
    return np.unique(np.concatenate(found))


def spelled(w: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes (v) of the n words from each place on. w: hashes of words."""
    return mixed(mixed(w[at[:, None] + np.arange(n)] + np.arange(n, dtype=np.uint64) * P).sum(1, dtype=np.uint64) + np.uint64(n)).view(np.int64)


def words_of_all(texts: list) -> tuple[list[bytes], np.ndarray]:
    """Words of the texts, one behind the other, and the number of each text's first, with the number of all behind them."""
    found = [words(t) for t in texts]
    return list(chain.from_iterable(found)), np.cumsum([0, *map(len, found)], dtype=np.int64)


def paragraphs_of(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, first word, hash (v) and small hashes (as NUMBERS numbers) of each paragraph."""
    w, first = words_of_all(texts)
    w = word_hashes(w)
    if len(w) < SPAN:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, NUMBERS), np.int64)
    five = windows(w, SHINGLE)  # those across two texts are in no paragraph
    here = places(five, first[:-1], first[1:] - SPAN + 1)
    owner = np.searchsorted(first, here, "right") - 1
    start = here - first[owner]
    inside = np.sort(five[here[:, None] + np.arange(SPAN - SHINGLE + 1)], axis=1)
    tiny = np.zeros((len(here), NUMBERS * EACH), np.int64)
    n = inside.shape[1]
    tiny[:, :n] = inside >> np.uint64(63 - TINY)  # in order, too
    tiny[:, n] = 1 + (inside[:, 1:] != inside[:, :-1]).sum(1)
    tiny[:, n + 1] = 1 + (tiny[:, 1:n] != tiny[:, : n - 1]).sum(1)
    return owner, start, spelled(w, here, SPAN), joined(tiny)


def joined(tiny: np.ndarray) -> np.ndarray:
    """NUMBERS numbers of 64 bits a row, of EACH small ones each."""
    return (tiny.reshape(len(tiny), NUMBERS, EACH) << PLACE).sum(2)


def parted(numbers: np.ndarray) -> np.ndarray:
    """The small ones again."""
    return ((numbers[:, :, None] >> PLACE) & ((1 << TINY) - 1)).reshape(len(numbers), NUMBERS * EACH)


def distinct_bits(small: np.ndarray) -> np.ndarray:
    """64 bits of each paragraph: which places of 64 an odd number of its distinct small hashes falls on. small: a column a paragraph, in order.

    A hash that only one of two paragraphs has changes one bit, so paragraphs at PERCENT differ in at most DIFFER bits.
    """
    bits = np.uint64(1) << (small & np.uint16(63)).astype(np.uint64)
    bits[1:][small[1:] == small[:-1]] = 0
    return np.bitwise_xor.reduce(bits, axis=0)


def band_keys_of(small: np.ndarray, bands: range) -> np.ndarray:
    """Keys of these bands of paragraphs. small: their small hashes, a column a paragraph."""
    keys = np.empty((small.shape[1], len(bands)), np.uint64)
    small = small.astype(np.intp)  # once, as take would each time
    for at, b in enumerate(bands):
        key = np.full(small.shape[1], b, np.uint64)
        for r in range(ROWS):
            key = mixed(key * FACTORS[31] + RANKS[b * ROWS + r].take(small).min(0))
        keys[:, at] = key
    return keys


def buckets_for(paragraphs: int, bands: int) -> int:
    return max(BUCKETS, 1 << (paragraphs * bands // FULL).bit_length())


def packed(v: list, bits: list, keys: list, buckets: int = BUCKETS) -> pa.RecordBatch:
    """Rows bucket, packed: the distinct (low half of a band key, bits, v) of each bucket as bytes."""
    v, once = np.unique(np.concatenate(v), return_index=True)
    keys, bits = np.concatenate(keys)[once], np.concatenate(bits)[once]
    bucket = ((keys >> np.uint64(32)) % np.uint64(buckets)).ravel()
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")  # that of 16 bits is a radix sort
    bucket = bucket[order].astype(np.int64)
    entries = np.empty(len(order), ENTRY)
    entries["k"] = keys.ravel()[order].astype(np.uint32)
    owner = order // keys.shape[1]
    entries["s"], entries["v"] = bits[owner], v[owner]
    at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    ends = np.append(at, len(order)).astype(np.int32) * ENTRY.itemsize
    data = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(entries.view(np.uint8))])
    return pa.RecordBatch.from_arrays([pa.array(bucket[at]), data], ["bucket", "packed"])


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, start (number of the first word), v and small (NUMBERS numbers as bytes) of each paragraph. docs: doc_id, text (binary). Settled."""

    def build(batches):
        for b in pieces(batches):
            owner, start, v, tiny = paragraphs_of(b.column(1).to_pylist())
            own = np.array(b.column(0).to_pylist(), np.int64)[owner]
            yield pa.RecordBatch.from_arrays([*map(pa.array, (own, start, v)), as_bytes(tiny)], ["doc_id", "start", "v", "small"])

    return settle(docs.mapInArrow(build, "doc_id long, start long, v long, small binary"), "paragraphs")


def as_bytes(tiny: np.ndarray) -> pa.Array:
    """Rows of NUMBERS numbers as bytes."""
    ends = np.arange(len(tiny) + 1, dtype=np.int32) * (8 * NUMBERS)
    return pa.Array.from_buffers(pa.binary(), len(tiny), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(tiny))])


def tiny_of(small: pa.Array) -> np.ndarray:
    """The numbers again."""
    at = 8 * NUMBERS * len(small)
    first = np.frombuffer(small.buffers()[1], np.int32)[small.offset] if at else 0
    return np.frombuffer(small.buffers()[2], np.uint8)[first : first + at].view(np.int64).reshape(-1, NUMBERS) if at else np.zeros((0, NUMBERS), np.int64)


def band_keys(units: DataFrame, bands: range, buckets: int) -> DataFrame:
    """Rows bucket, packed of paragraphs."""

    def build(batches):
        held: list = [[], [], []]
        for b in pieces(batches, 10_000):
            small = np.ascontiguousarray(parted(tiny_of(b.column(1)))[:, : SPAN - SHINGLE + 1].T.astype(np.uint16))
            for part, x in zip(held, (b.column(0).to_numpy(), distinct_bits(small), band_keys_of(small, bands))):
                part.append(x)
            if sum(map(len, held[0])) * len(bands) > READY:
                yield packed(*held, buckets)
                held = [[], [], []]
        if held[0]:
            yield packed(*held, buckets)

    return units.select("v", "small").mapInArrow(build, "bucket long, packed binary")


def all_found(units: DataFrame) -> DataFrame:
    """``found_in`` the keys of all bands, in ROUNDS. Settled."""
    bands, parts = tuned_bands(rows=ROWS), []
    step = -(-bands // ROUNDS)
    buckets = buckets_for(units.count(), step)
    for first in range(0, bands, step):
        parts.append(found_in(band_keys(units, range(first, min(first + step, bands)), buckets)))
        release(units.sparkSession)
    found = settle(reduce(DataFrame.unionByName, parts).distinct(), "found")
    unsettle(*parts)
    return found


def alike(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a list's bits: the pairs (i, j) that they don't exclude, none if these are over MANY a member; and which members have one."""
    n, total = len(s), 0
    some = np.zeros(n, bool)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, 20 * AT_ONCE // n)
    for first in range(0, n, step):
        near = np.bitwise_count(s[first : first + step, None] ^ s[None, first:]) <= DIFFER
        i, j = np.nonzero(np.triu(near, 1))
        some[i + first] = some[j + first] = True
        total += len(i)
        if total > MANY * n:
            left, right = left[:1], right[:1]
        else:
            left.append(i + first)
            right.append(j + first)
    return np.concatenate(left), np.concatenate(right), some


def compared(parts: list[bytes]) -> pa.RecordBatch | None:
    """``found_in`` the entries of one bucket."""
    entries = np.frombuffer(b"".join(parts), ENTRY)
    k = np.sort(entries["k"].astype(np.uint64) << np.uint64(32) | np.arange(len(entries), dtype=np.uint64))  # keys, each with its row
    again = np.zeros(len(k), bool)
    again[1:] = k[1:] >> np.uint64(32) == k[:-1] >> np.uint64(32)
    again[:-1] |= again[1:]
    entries = entries[(k[again] & np.uint64(0xFFFFFFFF)).astype(np.int64)]
    entries = entries[np.lexsort((entries["v"], entries["k"]))]
    k, s, v = (np.ascontiguousarray(entries[c]) for c in "ksv")
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (v[1:] != v[:-1])
    k, s, v = k[new], s[new], v[new]
    if not len(k):
        return None
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    count = np.diff([*at, len(k)])
    left, right, out = [], [], []
    behind = np.repeat(at + count, count) - 1 - np.arange(len(k))
    i, apart = np.flatnonzero((behind > 0) & np.repeat(count <= FEW, count)), 1
    while len(i):
        near = i[np.bitwise_count(s[i] ^ s[i + apart]) <= DIFFER]
        left.append(near)
        right.append(near + apart)
        i = i[behind[i] > apart]
        apart += 1
    for first, n in zip(at[count > FEW].tolist(), count[count > FEW].tolist()):
        members = v[first : first + n]
        if n <= LONGEST:
            i, j, some = alike(s[first : first + n])
            if len(i):
                left.append(i + first)
                right.append(j + first)
                continue
            members = members[some]
        if n := len(members):
            key = mixed(mixed(members.view(np.uint64) * FACTORS[30]).sum(dtype=np.uint64)[None] + np.uint64(n)).view(np.int64)
            out.append((np.repeat(key, n), members, np.full(n, n)))
    if left:
        a, b = v[np.concatenate(left)], v[np.concatenate(right)]
        out.append((np.minimum(a, b), np.maximum(a, b), np.zeros(len(a), np.int64)))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in zip(*out)], ["key", "v", "c"]) if out else None


def found_in(keys: DataFrame) -> DataFrame:
    """Of the classes that have a band key with others, rows key, v, c: pairs that their bits don't exclude as (a, b, 0), and lists
    with too many of these as (key, member, how many members). Settled.

    Members of a list that are in no such pair are left out. Lists of the same members are one.
    """

    def run(batches):
        held, at = [], None
        for batch in batches:
            for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if held and bucket != at:
                    if (out := compared(held)) is not None:
                        yield out
                    held = []
                at = bucket
                held.append(data)
        if held and (out := compared(held)) is not None:
            yield out

    dealt = keys.repartition("bucket").sortWithinPartitions("bucket")
    return settle(dealt.mapInArrow(run, "key long, v long, c long").distinct(), "found-in-bands")


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of paragraphs their small hashes don't exclude. a, b: rows of NUMBERS numbers."""
    n = SPAN - SHINGLE + 1
    out = np.zeros(len(a), bool)
    for first in range(0, len(a), AT_ONCE):
        x, y = (parted(z[first : first + AT_ONCE]).astype(np.int32) for z in (a, b))
        both = np.empty((len(x), 2 * n), np.int32)
        for z, part, other in ((x, both[:, :n], -1), (y, both[:, n:], -1 - n)):
            part[:] = z[:, :n]
            again = np.zeros((len(z), n), bool)
            again[:, 1:] = z[:, 1:n] == z[:, : n - 1]
            part[again] = np.broadcast_to(other - np.arange(n), again.shape)[again]  # unlike anything
        both.sort(axis=1)
        shared = (both[:, 1:] == both[:, :-1]).sum(1)
        na, nb = x[:, n], y[:, n]
        shared = np.minimum(shared + np.maximum(na - x[:, n + 1], nb - y[:, n + 1]), np.minimum(na, nb))
        out[first : first + AT_ONCE] = 100 * shared >= PERCENT * (na + nb - shared)
    return out


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id: v, text) of paragraphs. wanted: v, doc_id, start; settled."""
    by_doc = settle(wanted.groupBy("doc_id").agg(F.collect_list(F.struct("start", "v")).alias("spans")), "wanted-paragraphs")
    rows = semi(docs, by_doc.select("doc_id"), "doc_id").join(by_doc, "doc_id").select("text", "spans.start", "spans.v")

    def cut(batches):
        for b in pieces(batches):
            w, first = words_of_all(b.column(0).to_pylist())
            owner = np.repeat(np.arange(b.num_rows), b.column(1).value_lengths().to_numpy())
            at, v = first[owner] + b.column(1).flatten().to_numpy(), b.column(2).flatten().to_numpy()
            inside = at + SPAN <= first[owner + 1]
            at, v = at[inside], v[inside]
            if not len(v):
                continue
            here = np.zeros(len(w) + 1, np.int64)
            np.add.at(here, at, 1)
            np.add.at(here, at + SPAN, -1)
            here = np.flatnonzero(np.cumsum(here) > 0)
            hashes = np.zeros(len(w), np.uint64)
            hashes[here] = word_hashes([w[k] for k in here.tolist()])
            same = spelled(hashes, at, SPAN) == v  # not of another row with the id
            text = [b" ".join(w[k : k + SPAN]) for k in at[same].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(v[same]), pa.array(text, pa.binary())], ["doc_id", "text"])

    return rows.mapInArrow(cut, "doc_id long, text binary")


def across_blocks(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks (key, block, side, v, label) of each list's members outside its largest component against all its members."""
    placed = settle(labelled(lists, labels, "v", "label"), "placed-paragraphs")
    outside = outsiders(lists, labels)[0].select("key", "v", "label")
    counts = outside.groupBy("key").agg(F.count(F.lit(1)).alias("no"))
    sizes = placed.groupBy("key").agg(F.count(F.lit(1)).alias("nm")).join(counts, "key")
    sizes = settle(sizes.select("key", chunks_of("no").alias("co"), chunks_of("nm").alias("cm")), "list-sizes")
    left = outside.join(sizes, "key").withColumn("own", chunk_of("v", F.col("co"))).withColumn("k", each_of(F.col("cm")))
    left = left.select("key", (F.col("own") * F.col("cm") + F.col("k")).alias("block"), F.lit(0).alias("side"), "v", "label")
    right = placed.join(sizes, "key").withColumn("own", chunk_of("v", F.col("cm"))).withColumn("k", each_of(F.col("co")))
    return left.unionByName(right.select("key", (F.col("k") * F.col("cm") + F.col("own")).alias("block"), F.lit(1).alias("side"), "v", "label"))


def near_labels(found: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(v, label) of classes that are alike, by ``components``. found: of ``found_in``, settled; classes: v, doc_id, start of all in it; docs: doc_id, text (binary)."""
    pairs = found.where("c = 0").select(F.col("key").alias("a"), F.col("v").alias("b"))
    large = settle(found.where("c > 0"), "large-lists")
    texts = settle(_texts(docs, classes), "paragraph-texts")

    def build(batches):
        for b in pieces(batches):
            sets = [shingle_hashes(t, SHINGLE) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.astype(">i8").tobytes() for s in sets], pa.binary())], ["v", "n", "sketch"]
            )

    def with_sets(rows: DataFrame) -> DataFrame:
        own = semi(texts, settle(rows.select(F.col("v").alias("doc_id")).distinct(), "set-ids"), "doc_id")
        return rows.join(own.mapInArrow(build, "v long, n long, sketch binary").withColumn("keys", F.lit(b"")), "v")

    rows = with_sets(large).withColumns({"block": chunk_of("v", chunks_of("c")), "side": F.lit(0), "label": F.col("v")})
    pairs = settle(pairs.unionByName(ordered(in_blocks(rows, block_links), "a", "b")).distinct(), "near-paragraphs")
    labels = components(decided(pairs, texts, SHINGLE).where("linked"), closing=True)
    long = settle(large.where(chunks_of("c") > 1).select("key", "v"), "long-lists")
    if long.limit(1).count():
        blocks = settle(across_blocks(long, labels), "blocks")
        more = settle(ordered(in_blocks(with_sets(blocks), block_links), "a", "b"), "far-paragraphs")
        if more.limit(1).count():
            labels = extended(labels, verified(more, texts, SHINGLE).where("linked"))
        unsettle(blocks, more)
    unsettle(texts, pairs, long, large)
    return labels


def in_clusters(units: DataFrame, named: DataFrame) -> DataFrame:
    """doc_id, start, cluster_id and keeper_doc_id of the distinct ``units`` that the settled ``named`` have the class of, which has a row a class; ``rows``: its units.

    Classes are broadcast if they are at most BROADCAST_ROWS, else those with over 1/HOT_SHARE of all units are: a class that many
    paragraphs are does not meet in one task.
    """
    columns = ["doc_id", "start", "v", "cluster_id", "keeper_doc_id"]
    if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return units.join(F.broadcast(named), "v").select(*columns).distinct()
    total = F.lit(named.agg(F.sum("rows")).first()[0])
    hot = F.broadcast(named.where(F.col("rows") * HOT_SHARE > total))
    cold = units.join(hot.select("v"), "v", "left_anti").join(named.where(F.col("rows") * HOT_SHARE <= total), "v")
    return units.join(hot, "v").select(*columns).distinct().unionByName(cold.select(*columns).distinct())


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, n_words, cluster_id, keeper_doc_id and removed of paragraphs that are in several documents."""
    plain = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    units = paragraphs(plain)
    found = all_found(units)
    wide, units = units, settle(units.select("doc_id", "start", "v"), "places")
    unsettle(wide)
    release(docs.sparkSession)
    listed = settle(found.select("v").unionByName(found.where("c = 0").select(F.col("key").alias("v"))).distinct(), "listed")
    # Starts are some of the first document's; equal paragraphs have equal texts.
    grouped = units.groupBy("v").agg(F.count(F.lit(1)).alias("rows"), F.min("doc_id").alias("first"), F.min_by("start", "doc_id").alias("start"), F.max("doc_id").alias("last"))
    classes = settle(grouped.join(listed.withColumn("listed", F.lit(True)), "v", "left").where("listed OR first <> last"), "paragraph-classes")
    unsettle(listed)
    release(docs.sparkSession)
    labels = near_labels(found, classes.where("listed").select("v", F.col("first").alias("doc_id"), "start"), plain)
    unsettle(found)
    release(docs.sparkSession)
    named = classes.join(labels, "v", "left").withColumn("cluster_id", F.coalesce("label", "v")).drop("label")
    clusters = named.groupBy("cluster_id").agg(F.min("first").alias("keeper"), F.max("last").alias("end")).where("keeper <> end")
    named = settle(named.join(clusters, "cluster_id").select("v", "rows", "cluster_id", F.col("keeper").alias("keeper_doc_id")), "paragraph-clusters")
    out = settle(in_clusters(units, named), "repeated-paragraphs")
    unsettle(units, named, classes, labels)
    return out.select(
        "doc_id", "start", F.lit(SPAN).cast("long").alias("n_words"), "cluster_id", "keeper_doc_id", (F.col("doc_id") != F.col("keeper_doc_id")).alias("removed")
    )


def without_repeats(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed paragraphs cut out of the text. found: of ``repeated``."""
    spans = found.where("removed").groupBy(F.col("doc_id").alias("__id")).agg(F.array_sort(F.collect_set("start")).alias("__starts"))
    rows = docs.join(spans, docs[doc_id] == F.col("__id"), "left").drop("__id")

    @F.pandas_udf("string")
    def cut(texts, starts):
        import re

        import pandas as pd

        def one(t, s):
            if t is None or s is None:
                return t
            gone = np.zeros(len(t.encode()) + 1, bool)
            at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
            for k in s:
                gone[at[k][0] : at[min(k + SPAN, len(at)) - 1][1]] = True
            raw = np.frombuffer(t.encode(), np.uint8)
            return raw[~gone[:-1]].tobytes().decode()

        return pd.Series([one(t, s) for t, s in zip(texts, starts)])

    return rows.withColumn(text, cut(F.col(text), F.col("__starts"))).drop("__starts").select(*docs.columns)


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
