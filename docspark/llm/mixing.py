"""Mixing sources to target weights by systematic sampling.

Every source has a weight; all sources share ``share`` times all words by weight,
but none gets more than ``cap`` times its own words: the excess is reshared by
weight among the others until none is above. Sources are ordered by their words per
unit of weight, so prefix sums give the level at which all is shared.

Within a source, a document is expected target / source_size times. Documents are
ordered by size class, then by a digest of their id; the prefix sum of expected
copies plus one random offset of the source crosses an integer boundary as often as
the document is taken. The order by size makes what is taken of short and of long
documents near to its share, so the words taken come near the target. Each document
is taken floor or ceil of its expected copies, so ``cap`` holds for it, too.

The prefix sum is counted in parts: (source, size class, two hex digits of the id's
digest). Parts are counted first, their starts are a window over a few thousand
counts a source, and rows are numbered within parts; so a source that holds a third
of all rows is spread over thousands of parts.

Defined results: a null text has size 0; a null source is one source of its own,
ordered last; sources without words have target 0, and documents of size 0 add no
words, but are taken as often as others of their source; an id that repeats has as
many rows as in the input, each taken on its own; an empty table gives an empty
result. The offset and the order depend on ids, source and seed alone, so reruns
agree. A very long text is only counted. Other columns are carried along; ``mix`` replaces
those that an output column has the name of, ``mixed`` returns all as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docspark.llm.common import carried, restored, whole_text, word_count

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix"


def size_class(size: Column) -> Column:
    return F.floor(F.log(size + 1) * 8).cast("int")


def id_part(doc_id: Column) -> Column:
    """Two hex digits."""
    return F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 2)


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target (double). ``sources``: source, source_size (long); a row each source, so windows without keys are small."""
    ranked = sources.withColumn("__rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("__w", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("__rank") - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("__most", F.lit(cap) * F.col("source_size"))
    order = Window.orderBy(F.col("__most") / F.col("__w"), "__rank")
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    # The level if all before this source are at their most and all from here on are not.
    ranked = ranked.withColumn(
        "__level",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__most").over(before), F.lit(0.0)))
        / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0))),
    )
    ranked = ranked.withColumn("__fits", F.when(F.col("__level") * F.col("__w") <= F.col("__most"), F.col("__level")))
    level = F.coalesce(F.min_by("__fits", F.when(F.col("__fits").isNotNull(), F.struct(F.col("__most") / F.col("__w"), "__rank"))).over(every), F.lit(float("inf")))
    return (
        ranked.withColumn("target", F.least(F.col("__most"), level * F.col("__w")))
        .select("source", "source_size", "target")
    )


def offset_of(source: Column, seed: str) -> Column:
    digest = F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", narrow: DataFrame | None = None,
        weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: str = SEED) -> DataFrame:
    """``df`` with size, source_size, target, copies and taken (copies * size).

    ``narrow``: the same rows with only id, source and size, to be counted
    without a second reading of the texts.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    parts = {"__key": key, "__class": size_class(F.col("size")), "__part": id_part(F.col(doc_id))}
    sized = df if "size" in df.columns and narrow is df else df.withColumn("size", word_count(whole_text(text)))
    few = sized.select(doc_id, source, "size") if narrow is None else narrow
    counts = few.withColumns(parts).groupBy("__key", "__class", "__part").agg(
        F.first(source).alias("source"), F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size")
    )
    per_source = targets(counts.groupBy("__key").agg(F.first("source").alias("source"), F.sum("__size").alias("source_size")).select("source", "source_size"), weights, share, cap)
    per_source = per_source.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("__key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("__rate"),
        offset_of(F.col("source"), seed).alias("__offset"),
    )
    starts = counts.select(
        "__key", "__class", "__part",
        (F.sum("__n").over(Window.partitionBy("__key").orderBy("__class", "__part")) - F.col("__n")).alias("__start"),
    ).join(per_source, "__key")
    drop = [c for c in ("source_size", "target", "copies", "taken") if c in sized.columns]
    rows = sized.drop(*drop).withColumns(parts).join(starts, ["__key", "__class", "__part"])
    order = Window.partitionBy("__key", "__class", "__part").orderBy(doc_id, "size", *([F.xxhash64(text)] if text in df.columns else []))
    at = F.col("__start") + F.row_number().over(order)
    rows = rows.withColumn("__at", at.cast("double"))
    copies = F.floor(F.col("__at") * F.col("__rate") + F.col("__offset")) - F.floor((F.col("__at") - 1) * F.col("__rate") + F.col("__offset"))
    return (
        rows.withColumn("copies", copies.cast("int")).withColumn("taken", (F.col("copies") * F.col("size")).cast("long"))
        .drop("__key", "__class", "__part", "__start", "__rate", "__offset", "__at")
    )


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(doc_id, source, word_count(whole_text(text)).alias("size"))


def mixed(df: DataFrame, narrow: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The rows themselves, each as often as it is taken. Columns of any name come out as they are."""
    out = mix(carried(df, doc_id, text, source), doc_id, text, source, narrow, **more)
    return restored(out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))), df)


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    from docspark.llm.common import settle

    few = settle(sized(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    return mix(few, narrow=few).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rk FROM s),
x AS (SELECT *, [3, 1, 2][((rk - 1) % 3 + 1)::BIGINT] AS w, 2.0::DOUBLE * source_size AS most FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
   / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lv FROM x),
lev AS (SELECT lv FROM l WHERE lv * w <= most ORDER BY most / w, rk LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT lv FROM lev), 'inf'::DOUBLE) * w) AS target,
   ('0x' || substr(md5('mix|' || coalesce('s' || source, 'n')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY floor(ln(size + 1) * 8),
   substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2), doc_id NULLS FIRST, size)::DOUBLE AS k FROM d)
SELECT r.doc_id, r.size, t.source_size, t.target,
  (CASE WHEN t.source_size > 0 THEN floor(k * (t.target / t.source_size) + u) - floor((k - 1) * (t.target / t.source_size) + u) ELSE 0 END)::BIGINT * r.size AS taken
FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source
"""
