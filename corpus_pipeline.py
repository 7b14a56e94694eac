"""A corpus pipeline of five stages, each written as Parquet and read by the next.

Part of the corpus operators (docspark/llm): quality rules, near-duplicates, benchmark
decontamination, mixing, sharding. All but the last return the columns of documents.

A stage keeps rows whole, with two exceptions: quality rules take lines that are
common boilerplate of a source out of the text, and n_chars follows; and mixing
returns a row as often as the mix takes its document. Columns of any name come out as
they went in; the last stage replaces those that have the name of one of its own.

Defined results, by stage:

* quality rules: a null, empty or short text fails the base rules and goes; a null source is a
  source of its own; repeated rows are judged each by itself; null ids don't matter.
* near-duplicates: a document without words is linked with nothing and stays, as does a
  row without an id; of equal texts the least id stays; of rows that repeat an id and a
  text one stays; other texts of an id that stays do, too.
* benchmark decontamination: a null text, and a row without an id, stays; the rows of an
  id go together; ties don't arise.
* mixing: documents of no words are taken as others of their source, by the source's
  rate, and a source without words isn't taken; a null source is one; repeated rows are
  taken each on its own, in the order of ids, sizes and texts.
* sharding: equal texts share a shard; a null text is an empty one; null ids come first.

All: an empty table gives an empty result; a very long text must fit into a task's memory
with its words, and nothing else grows with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docspark.llm import decontaminate, mixing, neardup, quality, sharding
from docspark.llm.common import drop_dir, settle, work_dir
from docspark.session import importable


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.cleaned(docs, settle(quality.common_lines(docs), "common-lines"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return neardup.deduplicated(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_leaks(docs, importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few = settle(mixing.sized(docs), "mix-sizes")
    return mixing.mixed(docs, narrow=few)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing", mixing_sources),
    ("sharding", sharding_stage),
]

#: SQL can't express the near-duplicate stage on whole tables in bearable time.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = importable(spark).read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        path = work_dir(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_dir(spark, before)
        before = path
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
