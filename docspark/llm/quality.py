"""Quality rules: per-document limits, and cross-document line frequency.

Base rules count words, symbols, repeated lines and words in repeated 3-word
windows. The corpus rule hashes each normalised line (lower case, single spaces),
counts the distinct documents of its host that have it, and takes lines over the
limit for boilerplate: more than ``LINE_SHARE`` of the host's distinct documents,
and more than ``LINE_DOCS``. Those lines are removed; a document that keeps less
than ``KEEP_SHARE`` of its words is depleted and rejected. Exact copies count as one
document, so a text isn't taken for boilerplate because it was collected twice. The
host of a document is its source.

All is built from DataFrame functions. Lines are counted with partial sums by
(host, line), first over distinct documents, so a line that is in a third of all
documents doesn't meet in one task. A line over the limit is in more than a tenth
of its host's documents, so a host has at most ten times as many such lines as
its documents have lines on average; their table is broadcast if it has at most
``BROADCAST_LINES`` rows, and else joined by (host, salt).

Defined results: a null text has no words and fails the base rules; a null source is
a host of its own; ids may be null or repeat, each row is judged by itself; an empty
table gives an empty result. A very long text is judged by one task at a time, as arrays of
its words and lines. ``judged`` reads only the named columns and replaces those that an
output column has the name of; ``cleaned`` returns all as they were.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import WORD, carried, let, quoted, restored, settle, whole_text, words_of

LINE_DOCS, LINE_SHARE, KEEP_SHARE = 20, 0.1, 0.5
MIN_WORDS, MAX_REPEAT_SHARE = 50, 0.5
SYMBOLS = "#*$%&|<>"
BROADCAST_LINES, SALTS = 100_000, 64


def repeated_words(words: Column) -> Column:
    """Words within 3-word windows that are found twice or more."""

    def from_starts(starts: Column) -> Column:
        """starts: sorted places of repeated windows; each covers three words, together with its successor fewer."""
        return F.when(F.size(starts) == 0, F.lit(0)).otherwise(
            F.aggregate(
                starts, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("sum")),
                lambda a, p: F.struct(p.alias("last"), (a["sum"] + F.least(F.lit(3), p - a["last"])).alias("sum")),
                lambda a: a["sum"],
            )
        )

    def from_sorted(s: Column) -> Column:
        def same(x, i):
            return ((i > 0) & (F.get(s, i - 1)["w"] == x["w"])) | F.coalesce(F.get(s, i + 1)["w"] == x["w"], F.lit(False))

        return let(F.sort_array(F.transform(F.filter(s, same), lambda x: x["i"])), from_starts)

    def from_windows(windows: Column) -> Column:
        pairs = F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(let(F.sort_array(pairs), from_sorted))

    def from_words(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - 3),
            lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)),
        )
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(windows, from_windows))

    return let(words, from_words)


def base_counts(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, " \t\n\x0b\x0c\r", "")) > 0)
    stats = let(
        words_of(text),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("r")),
    )
    return {
        "__stats": stats,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def normal_line(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def host_of(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def common_lines(docs: DataFrame, text: str = "text", source: str = "source", share: float = LINE_SHARE, least: int = LINE_DOCS) -> DataFrame:
    """Lines over the limit: (host, line), line being the hash of the normalised line."""
    t = whole_text(text)
    lines = F.array_distinct(F.transform(F.split(t, "\n", -1), lambda x: F.xxhash64(normal_line(x))))
    rows = docs.select(host_of(source).alias("host"), F.xxhash64(t).alias("doc"), lines.alias("lines"))
    # 42 is unlike any line: its row counts the host's documents.
    rows = rows.select("host", "doc", F.explode(F.array_union("lines", F.array(F.lit(42).cast("long")))).alias("line"))
    counts = rows.distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    counts = settle(counts.where((F.col("docs") > least) | (F.col("line") == 42)), "line-counts")
    hosts = counts.where("line = 42").select("host", F.col("docs").alias("all"))
    empty = F.xxhash64(normal_line(F.lit("")))
    return counts.where((F.col("line") != 42) & (F.col("line") != empty)).join(hosts, "host").where(F.col("docs") > F.col("all") * share).select("host", "line")


def with_common_lines(docs: DataFrame, common: DataFrame, source: str = "source") -> DataFrame:
    """Adds __common: the hashes of the host's lines over the limit. ``common`` must be settled."""
    by_host = common.groupBy(F.col("host").alias("__host")).agg(F.collect_set("line").alias("__common"))
    rows = docs.withColumn("__host", host_of(source))
    if common.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES:
        out = rows.join(F.broadcast(by_host), "__host", "left")
    else:
        salt = F.pmod(F.xxhash64(*[c for c in docs.columns if c != source]), F.lit(SALTS))
        copies = by_host.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        out = rows.withColumn("__salt", salt).join(copies, ["__host", "__salt"], "left").drop("__salt")
    return out.drop("__host").withColumn("__common", F.coalesce("__common", F.array().cast("array<bigint>")))


def judged(docs: DataFrame, common: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``docs`` with the counts, base_failed, kept_words, kept and kept_text, which lacks the common lines."""
    t = whole_text(text)
    rows = with_common_lines(docs, common, source)
    left = F.filter(F.split(t, "\n", -1), lambda x: ~F.array_contains(F.col("__common"), F.xxhash64(normal_line(x))))
    kept_text = F.when(F.size("__common") == 0, t).otherwise(F.array_join(left, "\n"))
    rows = rows.withColumns(base_counts(t)).withColumn("kept_text", kept_text)
    rows = rows.withColumn("kept_words", F.when(F.size("__common") == 0, F.col("__stats.n")).otherwise(F.regexp_count("kept_text", F.lit(WORD))))
    n, r = F.col("__stats.n"), F.col("__stats.r")
    failed = (n < MIN_WORDS) | (r > n * MAX_REPEAT_SHARE)
    return (
        rows.withColumns({"n_words": n, "n_repeat_words": r})
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (F.col("kept_words") >= n * KEEP_SHARE))
        .drop("__stats", "__common")
    )


def cleaned(docs: DataFrame, common: DataFrame, text: str = "text", source: str = "source", n_chars: str = "n_chars") -> DataFrame:
    """The documents that the rules keep, without the common lines; ``n_chars`` follows. Columns of any other name come out as they are."""
    good = judged(carried(docs, text, source), common, text, source).where("kept")
    changed = F.col("kept_text") != F.col(text)
    new = {text: F.when(changed, F.col("kept_text")).otherwise(F.col(text))}
    if n_chars in docs.columns:
        was = F.col(f"__row.{quoted(n_chars)}")
        new[n_chars] = F.when(changed, F.length("kept_text").cast(docs.schema[n_chars].dataType)).otherwise(was)
    return restored(good, docs, **new)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    common = settle(common_lines(docs), "common-lines")
    return judged(docs, common).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("kept_words").cast("long").alias("kept_words")
    )


OP7_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t, row_number() OVER () AS rid FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT rid, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
dup AS (SELECT rid, k FROM (SELECT rid, k, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT k + o) AS r FROM dup, (SELECT unnest([0, 1, 2]) AS o) GROUP BY rid),
ls AS (SELECT rid, host, t, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm,
   len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS nw FROM (SELECT rid, host, t, unnest(string_split(t, chr(10))) AS line FROM d)),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM d GROUP BY host),
common AS (SELECT l.host, norm FROM ls l JOIN hosts h ON l.host = h.host WHERE norm <> '' GROUP BY l.host, norm, h.n
   HAVING count(DISTINCT t) > 20 AND count(DISTINCT t) > h.n * 0.1),
dl AS (SELECT rid, sum(c - 1) AS n FROM (SELECT rid, line, count(*) AS c FROM ls WHERE nw > 0 GROUP BY rid, line) GROUP BY rid),
cut AS (SELECT l.rid, sum(nw) AS n FROM ls l JOIN common c ON l.host = c.host AND l.norm = c.norm GROUP BY l.rid),
a AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
   len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
   coalesce(rep.r, 0)::BIGINT AS n_repeat_words, (len(ws) - coalesce(cut.n, 0))::BIGINT AS kept_words
   FROM w LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN cut USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND 2 * kept_words >= n_words AS kept, kept_words FROM b
"""
