"""Connected components of an edge table, by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import HOT_SHARE, attach_class, settle, unsettle


def components(edges: DataFrame, closing: bool = False) -> DataFrame:
    """(v, label) for each vertex of ``edges`` (a, b: long); label is the component's least vertex. Settled.

    In rounds: a vertex takes the least label among its own and its neighbours', then
    the label of that label, until none changes; so chains shorten by half a round and
    more. Neither a hub nor a large component meets in one task: the labels of
    vertices with over 1/HOT_SHARE of all edges are broadcast (HOT_SHARE of them at
    most), a hub's neighbours are aggregated before the shuffle, and the label of a
    label that many vertices have is attached as ``attach_class`` does.

    closing: components that the first round completes are left out of those behind it.
    """
    one = settle(edges.where("a <> b").select("a", "b").distinct(), "edges")
    ways = one.unionByName(one.select(F.col("b").alias("a"), F.col("a").alias("b")))
    firsts = settle(ways.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("label"), F.count(F.lit(1)).alias("degree")).withColumnRenamed("a", "v"), "degrees")
    total = 2 * one.count()
    hubs = settle(firsts.where(F.col("degree") * HOT_SHARE > total).select("v"), "hubs")
    hub = F.broadcast(hubs.select(F.col("v").alias("b"), F.lit(True).alias("hub")))
    both = settle(ways.distinct().join(hub, "b", "left").select("a", "b", F.coalesce("hub", F.lit(False)).alias("hub")), "both-ways")
    unsettle(one)
    labels, spent = firsts.select("v", "label"), firsts
    if closing:
        whole, labels, both = closed(labels, both, hubs)
        unsettle(firsts)
        spent = labels
    while True:
        least = reached(both, labels, hubs).groupBy("a").agg(F.min("label").alias("near"))
        near = settle(labels.join(least.withColumnRenamed("a", "v"), "v").select("v", "label", F.least("label", "near").alias("near")), "near-labels")
        named = near.groupBy("near").agg(F.count(F.lit(1)).alias("rows")).join(labels.select(F.col("v").alias("near"), F.col("label").alias("far")), "near")
        named = settle(named, "far-labels")
        jumped = attach_class(near, named, "near", "rows", F.xxhash64("v"))
        new = settle(jumped.select("v", F.least("near", "far").alias("new"), (F.least("near", "far") < F.col("label")).alias("changed")), "labels")
        done = not new.where("changed").limit(1).count()
        unsettle(spent, near, named)
        labels, spent = new.select("v", F.col("new").alias("label")), new
        if done:
            unsettle(both, hubs)
            return whole.unionByName(labels) if closing else labels


def reached(both: DataFrame, labels: DataFrame, hubs: DataFrame, how: str = "inner") -> DataFrame:
    """``both`` joined to the labels (v, label) of b; those of hubs are broadcast."""
    of = labels.withColumnRenamed("v", "b")
    cold = both.where(~F.col("hub")).join(of, "b", how)
    return cold.unionByName(both.where("hub").join(F.broadcast(of.join(F.broadcast(hubs.withColumnRenamed("v", "b")), "b", "left_semi")), "b", how))


def closed(labels: DataFrame, both: DataFrame, hubs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels (v, label) of whole components, and labels and edges of the others. All settled; ``both`` is removed.

    A label names a vertex of the component. So if all neighbours of all vertices that have it have it too, they are the component.
    """
    ends = reached(both, labels, hubs).groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).withColumnRenamed("a", "v")
    ends = settle(labels.join(ends, "v").select("v", "label", (F.least("label", "low") < F.greatest("label", "high")).alias("apart")), "label-ends")
    open_ = ends.groupBy("label").agg(F.count(F.lit(1)).alias("rows"), F.max("apart").alias("open")).where("open")
    open_ = settle(open_, "open-labels")
    split = settle(attach_class(ends.select("v", "label"), open_, "label", "rows", F.xxhash64("v")), "split-labels")
    done = settle(split.where("open IS NULL").select("v", "label"), "closed-labels")
    rest = settle(split.where("open").select("v", "label"), "open-vertices")
    left = settle(reached(both, rest.select("v"), hubs, "left_semi"), "open-edges")
    unsettle(ends, open_, split, both)
    return done, rest, left


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (v, label) with more edges (a, b): only the components that these join are worked on. Settled."""
    ends = labels.withColumnRenamed("label", "top")
    named = edges.select("a", "b").join(ends.select(F.col("v").alias("a"), F.col("top").alias("ta")), "a", "left").join(ends.select(F.col("v").alias("b"), F.col("top").alias("tb")), "b", "left")
    tops = components(named.select(F.coalesce("ta", "a").alias("a"), F.coalesce("tb", "b").alias("b")))
    every = labels.select("v", "label").unionByName(tops.select("v", F.col("v").alias("label"))).distinct()
    rows = settle(every.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).join(tops.select(F.col("v").alias("label"), F.col("label").alias("top")), "label"), "joined-labels")
    out = attach_class(every, rows, "label", "rows", F.xxhash64("v"))
    out = settle(out.select("v", F.coalesce("top", "label").alias("label")), "labels")
    unsettle(tops, rows)
    return out
