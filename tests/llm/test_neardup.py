from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import blocks, neardup
from docspark.llm import components as module
from docspark.llm.components import components
from docspark.llm.shingles import shingle_hashes, shingle_set


def brute(rows, k):
    """component_id by doc_id, by comparing all pairs."""
    sets = [(d, shingle_set(t.encode() if t else None, k)) for d, t, *_ in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: root(d) for d, _ in sets}, {d: len(s) for d, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_components_equal_brute_force(docs, wide, rows, k):
    want, sizes = brute(rows, k)
    for df in (docs, wide):
        got = neardup.near_duplicates(df, k).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (r.component_id, r.n_shingles) == (want[r.doc_id], sizes[r.doc_id])
            assert r.kept == (r.component_id == r.doc_id)


def test_a_large_cloud_of_near_copies(spark, monkeypatch):
    """Many blocks a list, and copies that are alike only through others."""
    monkeypatch.setattr(blocks, "CHUNK", 16)
    monkeypatch.setattr(neardup, "SHORT", 8)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for j in rng.choice(120, int(rng.integers(0, 14)), replace=False):
            w[j] = f"x{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join([*base[:40], *(f"y{i}-{j}" for j in range(90))])) for i in range(80)]
    want, _ = brute(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_small_sets(spark):
    """All sizes at which one shingle more or less decides."""
    rows = []
    for n in range(1, 14):
        for drop in range(-1, n):
            rows.append((len(rows), " ".join(f"s{n}w{i}" for i in range(n + 1) if i != drop)))
    want, _ = brute(rows, 2)
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {r.doc_id: r.component_id for r in got} == want


def test_rows_that_share_an_id_are_one_vertex(spark):
    rows = [(5, "a b c d"), (5, "p q r s"), (3, "a b c d"), (4, "p q r s"), (9, "u v w"), (9, "x y z"), (8, "x y z")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in got} == {(3, 3, True), (4, 3, False), (5, 3, False), (8, 8, True), (9, 8, False)}


def test_other_texts_of_a_kept_id_stay(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (1, "p q r s t u v"), (2, "a b c d e f g"), (3, "x")]
    got = neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a b c d e f g"), (1, "p q r s t u v"), (3, "x")]


def test_estimates_of_pairs(spark):
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, n))[: neardup.K] for n in (3, 40, 60, 200, 400, 400)]
    pairs = [(a, b) for a in sets for b in sets]
    got = neardup.union_estimates([a for a, _ in pairs], [b for _, b in pairs])
    for (a, b), e in zip(pairs, got):
        least = np.union1d(a, b)[: neardup.K]
        assert e == pytest.approx(np.isin(least, np.intersect1d(a, b)).sum() / len(least))


def test_nothing_and_null_ids(spark, empty):
    assert neardup.near_duplicates(empty, 2).count() == 0
    got = neardup.near_duplicates(spark.createDataFrame([(None, "a b c"), (None, "a b c"), (1, "a b c")], "doc_id long, text string"), 2).collect()
    assert [(r.component_id, r.kept) for r in sorted(got, key=lambda r: str(r.doc_id))] == [(1, True), (None, True), (None, True)]


def test_deduplicated_keeps_one_of_each(docs, rows):
    want, _ = brute(rows, 5)
    got = neardup.deduplicated(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))


def test_shared_values_and_block_pairs():
    rng = np.random.default_rng(1)
    sketches = [np.unique(rng.integers(0, 400, 64)) for _ in range(40)]
    left, right = np.arange(0, 25), np.arange(25, 40)
    got = blocks.shared_values(sketches, left, right)
    assert all(got[i, j] == len(np.intersect1d(sketches[a], sketches[b])) for i, a in enumerate(left) for j, b in enumerate(right))


def test_estimate(spark):
    a, b = (sorted(int(x) for x in shingle_hashes(t.encode(), 1))[:64] for t in ("a b c d e f g h", "a b c d e f g x"))
    df = spark.createDataFrame([(a, b)], "a array<long>, b array<long>")
    assert df.select(neardup.estimate(F.col("a"), F.col("b"))).first()[0] == pytest.approx(7 / 9)


@pytest.mark.parametrize("share", [1024, 4])
def test_components(spark, monkeypatch, share):
    """With all vertices hubs, and with few."""
    monkeypatch.setattr(module, "HOT_SHARE", share)
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)]
    table = lambda x: spark.createDataFrame(x, "a long, b long")
    got = {r.v: r.label for r in components(table(edges)).collect()}
    parts = module.extended(components(table(edges[::2])), table(edges[1::2]))
    assert {r.v: r.label for r in parts.collect()} == got
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for v in near:
        seen, todo = {v}, [v]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[v] == min(seen)
