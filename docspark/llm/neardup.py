"""Near-duplicate documents by bottom-k sketches.

One hash function gives every shingle a number; a document's sketch is its ``K``
least. Documents with equal shingle sets are one class from the start. Inverted
lists (retained value -> classes) bring classes together. All classes rank values in
one order, the rarest first, and a class is posted only in the lists of its first few:
two classes that share at least s of m retained values share one of the first
m - s + 1 of either. For sets that a sketch holds whole, with all their possible
partners, s is exact. For larger ones s is half the sketch, which a pair at the
threshold misses by six standard deviations. So the lists of common word pairs,
which grow with the square of the corpus, stay empty of all that have rarer values.
Lists are kept by sizes that fit, and those of the same members are one list.

Lists aren't expanded into pairs. A list of two members is a pair. Longer ones go to
tasks in blocks (see ``blocks``), twice:

1. with sketches: the overlap of two members is the number of retained values that
   they share; overlaps and the union-sketch estimate (the share of common values
   among the K least of both sketches) exclude pairs, and only members with a pair
   left go on. The margin of the estimate is six standard deviations, too;
2. with full shingle sets of these, as hashes of 63 bits: exact Jaccard similarity decides all
   links of a block, and as many are returned as hold the block's components together.

A pair that shares several short lists is left to one of them. Pairs of lists of two go
through the estimate and are verified on the shingles themselves.

A list of up to ``SHORT`` members is one block. Of its longer lists, a member goes with
two, in blocks of ``CHUNK``: the longest, and one that its likes choose, too. Links make
components. Then, in long lists with several components, members outside the largest
("outsiders") are compared with the members of that component once, whatever number
of lists they share, and with the other outsiders of their list; both as above.

So every pair that shares a list is decided on full sets, excluded by sizes or by six
standard deviations, or already within one component. A group of copies costs rows
in proportion to its members; only outsiders beyond ``CHUNK`` of one component multiply
the blocks in which its members are.

Defined results: no words or a null text is an empty set, linked with nothing;
rows that share an id are one vertex with the links of all its texts, and of classes that
it is in; a row without an id is linked with nothing and kept; an empty table gives an
empty result. A very long text is held by one task at a time, as its words and 8 bytes a
shingle. Only id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.blocks import PERCENT, block_links, chunk_of, chunks_of, each_of, full_sets, in_blocks, labelled, ordered, semi, shared_values, sides, verified
from docspark.llm.common import attach_class, let, pieces, settle, unsettle
from docspark.llm.components import components, extended
from docspark.llm.shingles import shingle_hashes

K, SHORT = 64, 128
#: Six standard deviations of the estimate from K values.
MARGIN = 0.3
LEAST = PERCENT / 100 - MARGIN
#: Pairs of sketches merged at once.
MERGED = 20_000
#: The block that a short list is.
WHOLE = -1


def sketches(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (size of the shingle set), fp (of the whole set) and sketch. Settled."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("fp", pa.string()), ("sketch", pa.list_(pa.int64()))])

    def build(batches):
        for b in pieces(batches):
            n, fp, sketch = [], [], []
            for t in b.column(1).to_pylist():
                s = shingle_hashes(t, k)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_hexdigest(s.tobytes()))
                sketch.append(s[:K].copy())
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sketch])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sketch])))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp), lists], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return settle(rows.mapInArrow(build, "doc_id long, n long, fp string, sketch array<long>"), "sketches")


def posted_values(n: Column, m: Column) -> Column:
    """How many of its m retained values, the rarest first, a set of n shingles is posted with.

    Sets of up to PERCENT * K / 100 shingles are whole in their sketches, as are all that they can be linked with.
    """
    exact = F.floor((n * PERCENT + 99) / 100)
    return (m - F.when(n <= PERCENT * K // 100, exact).otherwise(int(LEAST * K)) + 1).cast("int")


def inverted_lists(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists of two members as (a, b), whose sizes fit, and longer ones as (key, v, c); c: how many. Both settled.

    A list is of a value and a size bucket. Buckets grow by 100 / PERCENT, so sets that can be linked are in the same
    bucket or in neighbouring ones: a set is in the list of its own bucket and visits that of the next.
    """
    each = classes.select("q", F.explode("sketch").alias("value"))
    counts = settle(each.groupBy("value").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "value-counts")
    # Values that no other class has come first, and their lists are no use.
    known = each.join(counts, "value").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("c", "value"))).alias("shared"))
    sized = classes.select("q", "v", "n", F.size("sketch").alias("m"))
    few = F.greatest(F.lit(0), posted_values(F.col("n"), F.col("m")) - (F.col("m") - F.size("shared")))
    own = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / PERCENT))).cast("int")
    posted = known.join(sized, "q").select("v", own.alias("own"), F.explode(F.transform(F.slice("shared", F.lit(1), few), lambda x: x["value"])).alias("value"))
    posted = settle(posted, "posted")
    # Rows of the first shuffle are narrow numbers, as most are alone in their list.
    placed = posted.select("v", "value", F.inline(F.array(F.struct(F.col("own").alias("bucket"), F.lit(1).alias("here")), F.struct((F.col("own") + 1).alias("bucket"), F.lit(0).alias("here")))))
    of_list = placed.groupBy("value", "bucket").agg(
        F.count(F.lit(1)).alias("c"), F.max("here").alias("here"), F.bit_xor(F.xxhash64("v")).alias("x"), F.min("v").alias("a"), F.max("v").alias("b")
    )
    lists = settle(of_list.where("c > 1 AND here = 1 AND a <> b").drop("here"), "inverted-lists")
    size = classes.select("v", "n")
    twos = lists.where("c = 2").select("a", "b").distinct().join(size.toDF("a", "na"), "a").join(size.toDF("b", "nb"), "b")
    twos = settle(twos.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT).select("a", "b").distinct(), "list-pairs")
    long = lists.where("c > 2").select("value", "bucket", F.xxhash64("c", "x", "a", "b").alias("key"), "c")
    many = posted.join(long, "value").where((F.col("bucket") == F.col("own")) | (F.col("bucket") == F.col("own") + 1))
    many = settle(many.select("key", "v", "c").distinct(), "lists")
    unsettle(counts, posted, lists)
    return twos, many


def estimate(a: Column, b: Column) -> Column:
    """Jaccard similarity, from the K least values of both sketches together."""

    def share(u: Column) -> Column:
        return F.size(F.filter(F.array_intersect(a, b), lambda x: x <= F.element_at(u, -1))) / F.size(u)

    return let(F.slice(F.array_sort(F.array_union(a, b)), 1, K), share)


def estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) that the estimate doesn't exclude. The leading 31 bits of the values do, and keep their order."""
    side = classes.select("v", F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("sketch"))
    out = pairs.join(side.toDF("a", "sa"), "a").join(side.toDF("b", "sb"), "b")
    return out.where(estimate(F.col("sa"), F.col("sb")) >= LEAST).select("a", "b").distinct()


def union_estimates(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The estimate for pairs of sketches."""
    out = np.zeros(len(a))
    for first in range(0, len(a), MERGED):
        both = np.full((min(MERGED, len(a) - first), 2 * K), np.iinfo(np.int64).max)
        for row, x, y in zip(both, a[first : first + MERGED], b[first : first + MERGED]):
            row[: len(x)] = x
            row[K : K + len(y)] = y
        both.sort(axis=1)
        again = both[:, 1:] == both[:, :-1]
        padded = both[:, 1:] == np.iinfo(np.int64).max
        rank = 1 + np.cumsum(~again & ~padded, axis=1)
        least = np.minimum(rank.max(axis=1), K)
        out[first : first + MERGED] = (again & ~padded & (rank <= K)).sum(axis=1) / least
    return out


def touched(v, n, label, side, sets, keys, at):
    """Members with a pair, between different labels, that sizes, overlaps and the estimate don't exclude: v, label and side.

    A pair is left to the first short list that both members are in (``keys``). ``at``: key and block, which is
    WHOLE for short lists.
    """
    none = v[:0], v[:0], np.zeros(0)
    left, right = sides(side)
    if not len(left) or len(v) < 2:
        return none
    length = np.array([len(s) for s in sets])
    overlap = shared_values(sets, left, right)
    union = length[left][:, None] + length[right][None, :] - overlap
    nl, nr = n[left][:, None], n[right][None, :]
    fits = (label[left][:, None] != label[right][None, :]) & (np.minimum(nl, nr) * 100 >= np.maximum(nl, nr) * PERCENT)
    needed = LEAST * np.minimum(union, K)
    fits &= overlap >= needed
    before = [k[k < at[0]] for k in keys] if at[1] == WHOLE else keys
    fits &= shared_values(before, left, right) == 0
    # As many common values as there are beyond the K least of the union can be beyond them at most.
    sure = fits & (overlap - np.maximum(union - K, 0) >= needed)
    some = np.zeros(len(v), bool)
    some[left[sure.any(1)]] = True
    some[right[sure.any(0)]] = True
    for matrix, shared, rows, columns in ((fits, overlap, left, right), (fits.T, overlap.T, right, left)):
        # The pair with the largest overlap of each member that isn't sure; then all others of those that this leaves.
        open_rows = np.flatnonzero(matrix.any(1) & ~some[rows])
        if not len(open_rows):
            continue
        best = np.where(matrix[open_rows], shared[open_rows], -1).argmax(1)
        first = union_estimates([sets[rows[i]] for i in open_rows], [sets[columns[j]] for j in best]) >= LEAST
        some[rows[open_rows[first]]] = True
        for i in open_rows[~first]:
            others = columns[np.flatnonzero(matrix[i])]
            some[rows[i]] = (union_estimates([sets[rows[i]]] * len(others), [sets[j] for j in others]) >= LEAST).any()
        if left is right:
            break
    kept = np.flatnonzero(some)
    return v[kept], label[kept], side[kept].astype(np.float64)


def links_in_blocks(blocks: DataFrame, thin: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(a, b) of links that make the components of all links in the blocks (key, block, side, v, label). Settled."""
    found = in_blocks(blocks.join(thin, "v"), touched)
    some = settle(found.select("key", "block", F.col("a").alias("v"), F.col("b").alias("label"), F.col("like").cast("int").alias("side")), "touched-members")
    ids = settle(some.select(F.col("v").alias("doc_id")).distinct(), "touched-ids")
    full = full_sets(ids, docs, k).withColumn("keys", F.lit(b""))
    links = settle(ordered(in_blocks(some.join(full, "v"), block_links), "a", "b"), "block-links")
    unsettle(some, ids, full)
    return links


def first_blocks(lists: DataFrame) -> DataFrame:
    """Blocks (key, block, side, v, label) of short lists, and of two long lists of each member."""
    long = lists.where(F.col("c") > SHORT).groupBy("v").agg(F.max(F.struct("c", "key")).alias("x"), F.min(F.struct(F.xxhash64("key"), "key", "c")).alias("y"))
    two = long.select("v", F.inline(F.array_distinct(F.array(F.struct("x.key", "x.c"), F.struct("y.key", "y.c")))))
    rows = lists.where(F.col("c") <= SHORT).select("key", "v", F.lit(WHOLE).cast("long").alias("block"))
    rows = rows.unionByName(two.select("key", "v", chunk_of("v", chunks_of("c")).alias("block")))
    return rows.withColumns({"side": F.lit(0), "label": F.col("v")})


def outsiders(lists: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of lists (key, v) with several components: members (key, v, label, top) outside the largest, top, and those (v, label) in it. Both settled."""
    placed = settle(labelled(lists.select("key", "v"), labels, "v", "label"), "placed-lists")
    sizes = placed.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"))
    of_list = sizes.groupBy("key").agg(F.max(F.struct("m", "label")).alias("top"), F.count(F.lit(1)).alias("parts"))
    several = settle(of_list.where("parts > 1").select("key", F.col("top.label").alias("top")), "open-lists")
    rows = placed.join(several, "key")
    out = settle(rows.where("label <> top"), "outsiders")
    inside = settle(rows.where("label = top").select("v", "label").distinct(), "insiders")
    unsettle(placed, several)
    return out, inside


def last_blocks(out: DataFrame, inside: DataFrame) -> DataFrame:
    """Blocks of outsiders against the largest component of their lists, and against the other outsiders of a list."""
    against = out.select("v", "label", "top").distinct()
    sizes = inside.groupBy(F.col("label").alias("top")).agg(F.count(F.lit(1)).alias("ni")).join(against.groupBy("top").agg(F.count(F.lit(1)).alias("no")), "top")
    sizes = settle(sizes.select("top", chunks_of("no").alias("co"), chunks_of("ni").alias("ci")), "component-sizes")
    key = F.xxhash64(F.lit("component"), "top").alias("key")
    left = against.join(sizes, "top").withColumn("own", chunk_of("v", F.col("co"))).withColumn("k", each_of(F.col("ci")))
    left = left.select(key, (F.col("own") * F.col("ci") + F.col("k")).alias("block"), F.lit(0).alias("side"), "v", "label")
    right = inside.withColumn("top", F.col("label")).join(sizes, "top").withColumn("own", chunk_of("v", F.col("ci"))).withColumn("k", each_of(F.col("co")))
    right = right.select(key, (F.col("k") * F.col("ci") + F.col("own")).alias("block"), F.lit(1).alias("side"), "v", "label")
    counts = settle(out.groupBy("key").agg(F.count(F.lit(1)).alias("no")).where("no > 1").select("key", chunks_of("no").alias("co")), "outsider-counts")
    rows = out.join(counts, "key").withColumn("own", chunk_of("v", F.col("co")))
    few = rows.where("co = 1").select("key", F.col("own").alias("block"), F.lit(0).alias("side"), "v", "label")
    many = rows.where("co > 1").withColumn("k", each_of(F.col("co")))
    first = many.select("key", (F.col("own") * F.col("co") + F.col("k")).alias("block"), F.lit(0).alias("side"), "v", "label")
    second = many.select("key", (F.col("k") * F.col("co") + F.col("own")).alias("block"), F.lit(1).alias("side"), "v", "label")
    return left.unionByName(right).unionByName(few).unionByName(first).unionByName(second)


def linked_classes(classes: DataFrame, docs: DataFrame, k: int, more: DataFrame | None = None) -> DataFrame:
    """(v, label) of the vertices that have links. classes: q (a number of its own), v, n, sketch; docs: doc_id, text (binary); more: links (a, b) besides."""
    twos, lists = inverted_lists(classes)
    def packed(values):
        return F.coalesce(F.unhex(F.array_join(F.transform(values, lambda x: F.lpad(F.hex(x), 16, "0")), "")), F.lit(b""))

    members = lists.groupBy("v").agg(packed(F.collect_list(F.when(F.col("c") <= SHORT, F.col("key")))).alias("keys"))
    thin = settle(classes.select("v", "n", packed("sketch").alias("sketch")).join(members, "v"), "list-sketches")
    found = links_in_blocks(first_blocks(lists), thin, docs, k)
    alike = settle(estimated(twos, classes), "candidate-pairs")
    links = found.unionByName(verified(alike, docs, k).where("linked").select("a", "b"))
    if more is not None:
        links = links.unionByName(more)
    labels = components(links)
    long = lists.where(F.col("c") > SHORT)
    if long.limit(1).count():
        out, inside = outsiders(long, labels)
        blocks = settle(last_blocks(out, inside), "blocks")
        found = links_in_blocks(blocks, thin, docs, k)
        if found.limit(1).count():
            labels = extended(labels, found)
        unsettle(out, inside, blocks, found)
    unsettle(twos, lists, thin, alike)
    return labels


def id_links(each: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): an id with several texts, and the vertices of the classes that they are in. Settled."""
    rows = each.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x <> y")
    several = settle(several.select("doc_id"), "ids-of-several-texts")
    return settle(ordered(semi(rows, several, "doc_id").select("doc_id", "fp").distinct().join(classes.select("fp", "v"), "fp"), "doc_id", "v"), "id-links")


def near_duplicates(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs``. k: words in a shingle."""
    each = sketches(docs, k, doc_id, text)
    grouped = each.where(F.col("doc_id").isNotNull() & (F.col("n") > 0)).groupBy("fp")
    classes = grouped.agg(F.min("doc_id").alias("v"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows"))
    classes = settle(classes.withColumn("q", F.xxhash64("fp")), "classes")
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    labels = linked_classes(classes, plain, k, id_links(each, classes))
    named = labelled(classes.select("fp", "v", "rows"), labels, "v", "component")
    named = settle(named.where("rows > 1 OR component <> v").select("fp", "component", "rows"), "named-classes")
    unsettle(classes, labels)
    out = attach_class(each.select("doc_id", "n", "fp"), named, "fp", "rows", F.xxhash64("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


def deduplicated(docs: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group.

    Rows without an id stay. Of rows that repeat an id and a text one stays; other texts of an id that is kept stay, too.
    """
    found = settle(near_duplicates(docs, k, doc_id, text).where("doc_id IS NOT NULL"), "near-duplicates")
    gone = settle(found.where(~F.col("kept")).select(F.col("doc_id").alias(doc_id)).distinct(), "removed-ids")
    stay = semi(docs, gone, doc_id, "left_anti")
    again = settle(found.where("kept").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(doc_id)), "repeated-ids")
    if not again.limit(1).count():
        return stay
    return semi(stay, again, doc_id, "left_anti").unionByName(semi(stay, again, doc_id).dropDuplicates([doc_id, text]))


def op1_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2)


OP1_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) = 1 THEN w
  ELSE list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) END AS g FROM d),
n AS (SELECT doc_id, len(g)::BIGINT AS n, g FROM s),
e AS (SELECT doc_id, n, hash(unnest(g)) AS h FROM n),
f AS (SELECT h, count(*) AS c FROM e GROUP BY h),
r AS (SELECT e.doc_id, e.n, e.h, row_number() OVER (PARTITION BY e.doc_id ORDER BY f.c, e.h) AS k FROM e JOIN f USING (h) WHERE f.c > 1),
p AS (SELECT DISTINCT a.doc_id AS x, b.doc_id AS y FROM r a JOIN r b ON a.h = b.h AND a.doc_id < b.doc_id
  WHERE a.k <= a.n * 0.2 + 1 AND b.k <= b.n * 0.2 + 1 AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * len(list_intersect(a.g, b.g)) >= 80 * (a.n + b.n - len(list_intersect(a.g, b.g)))),
z AS (SELECT x AS a, y AS b FROM l UNION SELECT y, x FROM l),
c AS (SELECT doc_id AS v, doc_id AS o FROM n UNION SELECT z.b, c.o FROM c JOIN z ON z.a = c.v)
SELECT n.doc_id, n.n AS n_shingles, min(c.o)::BIGINT AS component_id, n.doc_id = min(c.o) AS kept FROM n JOIN c ON c.v = n.doc_id GROUP BY n.doc_id, n.n
"""
