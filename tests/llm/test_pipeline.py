import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from docspark.llm import decontaminate, registry
from tests.conftest import DATA
from tests.llm.test_neardup import brute
from tests.test_queries import TABLES, comparable


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in TABLES:
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    out = registry.queries()[name](spark, DATA)
    sql = duck.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in sql.description]
    assert sorted(out.columns) == sorted(columns)
    assert comparable(out.collect(), out.columns) == comparable(sql.fetchall(), columns)


def test_every_operator_is_registered():
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, DATA).cache()
        after = docs.collect()
        seen.append((name, len(before), len(after)))
        ids, left = {r.doc_id for r in before}, {r.doc_id for r in after}
        assert left <= ids and after
        if name != "sharding":
            assert docs.columns == columns
        if name == "near-duplicates":
            want, _ = brute([(r.doc_id, r.text) for r in before], 5)
            assert left == set(want.values())
        elif name == "benchmark decontamination":
            items = [decontaminate.grams(decontaminate.item_words(r.text)) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            clean = lambda t: (own := decontaminate.grams(decontaminate.item_words(t))) is None or all(len(s & own) < 0.8 * len(s) for s in items)
            assert left == {r.doc_id for r in before if clean(r.text)}
        elif name == "sharding":
            assert len(after) == len(before) and {r["shard"] for r in after} == set(range(16))
    assert len(corpus_pipeline.run(spark, DATA).collect()) == seen[-1][2]


CLASHES = ["host", "kept", "n_words", "size", "taken", "copies", "target", "shard", "__row", "kept_text", "label", "v", "key", "a.b", "source_size", "component_id"]


def odd_documents(spark, empty=False):
    """Nulls, empties, ties, repeated rows, a long text, and columns named like those that stages make."""
    import random

    from tests.llm.conftest import DOCS, sentence

    r = random.Random(8)
    texts = [sentence(r, 80) for _ in range(30)]
    rows = [(i, t, "en", r.choice(["a", "b", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(100 + i, texts[i], "en", "a", len(texts[i])) for i in range(5)] + [rows[7], rows[7]]
    rows += [(None, sentence(r, 70), "en", "a", 3), (200, None, None, None, None), (201, "", "en", "b", 0), (202, "a b", "en", "b", 3), (203, sentence(r, 30000), "en", "b", 9)]
    rows += [(204, texts[3] + " more", None, None, None), (205, "\n".join([*[sentence(r, 9) for _ in range(9)], "", " "]), "en", "a", 1)]
    df = spark.createDataFrame([] if empty else rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.concat(F.lit(f"{c}-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) for c in CLASHES}).repartition(3)


@pytest.mark.parametrize("empty", [False, True])
def test_stages_on_odd_documents(spark, empty):
    docs = odd_documents(spark, empty)
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, DATA).cache()
        after = docs.collect()
        assert empty == (not after)
        if name != "sharding":
            assert docs.columns == columns
            for row in after:  # every column is as it was
                assert all(row[c] == f"{c}-{'null' if row['doc_id'] is None else row['doc_id']}" for c in CLASHES)
        if empty:
            continue
        ids = sorted(r["doc_id"] for r in after if r["doc_id"] is not None)
        if name == "quality rules":
            assert not {200, 201, 202} & set(ids) and {203, 204, 205, 7} <= set(ids) and ids.count(7) == 3 and len(after) == len(before) - 3
        elif name == "near-duplicates":
            assert ids == [*range(30), 203, 205] and len(after) == len(ids) + 1
        elif name == "benchmark decontamination":
            assert len(after) == len(before)
        elif name == "sharding":
            assert set(columns) <= set(docs.columns) and {r["shard"] for r in after} <= set(range(16))
