import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from docspark.llm import mixing, quality, sharding
from docspark.llm.common import settle

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def count(text):
    return len(WORD.findall(text or ""))


def targets(sizes):
    """Reshares the excess until no target is above twice its source's size."""
    names = sorted([s for s in sizes if s is not None], key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    most, left, free, out = {s: 2 * sizes[s] for s in names}, 1.5 * sum(sizes.values()), set(names), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        over = {s for s in free if unit * weight[s] > most[s]}
        if not over:
            return out | {s: unit * weight[s] for s in free}
        for s in over:
            out[s] = most[s]
            left -= most[s]
        free -= over
    return out


@pytest.mark.parametrize("which", ["docs", "wide"])
def test_mix(which, rows, request):
    df = request.getfixturevalue(which)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += count(r[1])
    want = targets(sizes)
    got = mixing.mix(df).collect()
    assert len(got) == len(rows) and sorted((r.doc_id, r.size) for r in got) == sorted((r[0], count(r[1])) for r in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1 + 2 * max(count(r[1]) for r in rows if r[3] == s)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted((r.doc_id, r.size, r.taken) for r in got) == sorted((r.doc_id, r.size, r.taken) for r in again)


def test_mix_of_many_sources(spark):
    rows = [(i, "w " * (i * i % 97), f"s{i % 23}") for i in range(4000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert all(abs(taken[s] - t) <= 0.01 * t + 100 for s, t in goal.items())


def test_mixed_rows_and_nothing(docs, rows, empty, spark):
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r.doc_id] += r.copies
    got = mixing.mixed(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == +want
    assert mixing.mix(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0.0, 0), (0.0, 0)]


# ---- quality


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    many = {x for x, n in Counter(windows).items() if n > 1}
    covered = {i + o for i, x in enumerate(windows) if x in many for o in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


EXTRA = [
    (900, "a b c a b c a b c " * 20, "en", "a", 0), (901, "x y z x y z", "en", "a", 0), (902, "é#*$ %&|<>" * 9, "en", "a", 0),
    (903, "same\nsame\n\n\n same\nsame", "en", "b", 0), (904, "a\x0bb\x0cc\rd\x1ce\x85f g", "en", "b", 0), (905, "p q p q p q p", "en", "b", 0),
]


def test_base_counts(spark, docs, rows, wide):
    more = spark.createDataFrame(EXTRA, docs.schema)
    for df, all_rows in ((docs.unionByName(more), [*rows, *EXTRA]), (wide, rows)):
        common = settle(quality.common_lines(df), "common")
        got = quality.judged(df, common).collect()
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
        assert sorted((r.doc_id, *(r[n] for n in names)) for r in got) == sorted((r[0], *base(r[1])) for r in all_rows)
        assert all(not r.kept for r in got if r.base_failed)


MENU = [" ".join(f"Nav{k}x{j}" for j in range(10)) for k in range(6)]


def site(boiler_docs, clean_docs):
    rows = []
    for i in range(boiler_docs):
        rows.append((i, "\n".join(f"  {m.replace(' ', '   ')}" for m in MENU) + "\n" + " ".join(f"w{i}x{j}" for j in range(80)), "h"))
    for i in range(clean_docs):
        rows.append((1000 + i, " ".join(f"c{i}x{j}" for j in range(80)), "h"))
    rows.append((5001, "\n".join([*(f"k{j} l{j} m{j} n{j}" for j in range(12)), *(m.upper() for m in MENU)]), "h"))
    rows += [(6000 + i, rows[-1][1], "other") for i in range(50)]
    return rows


@pytest.mark.parametrize("broadcast", [True, False])
def test_common_lines_go_and_depleted_documents_with_them(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(quality, "BROADCAST_LINES", 0)
    df = spark.createDataFrame(site(60, 60), "doc_id long, text string, source string")
    common = settle(quality.common_lines(df), "common")
    assert [r.host for r in common.collect()] == ["sh"] * 6, "copies of one text are one document"
    got = {r.doc_id: r for r in quality.judged(df, common).collect()}
    assert got[0].kept_text == " ".join(f"w0x{j}" for j in range(80)) and got[0].kept and got[0].kept_words == 80
    assert got[1000].kept and got[1000].kept_text == df.where("doc_id = 1000").first().text
    assert not got[5001].kept and got[5001].kept_words == 48 and not got[5001].base_failed
    assert got[6000].kept and got[6000].kept_words == 108
    few = spark.createDataFrame(site(15, 0), "doc_id long, text string, source string")
    assert quality.common_lines(few).count() == 0


def test_no_documents(empty):
    common = settle(quality.common_lines(empty), "common")
    assert quality.judged(empty, common).count() == 0


# ---- sharding


def least_capacity(sizes, n):
    def fits(c):
        used, room = 0, 0
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= n

    return next(c for c in range(sum(sizes) + 1) if fits(c))


@pytest.mark.parametrize("seed, n, hot", [(0, 4, 1), (1, 16, 1), (2, 5, 40), (3, 3, 400), (4, 16, 3)])
def test_capacity_is_the_least(spark, seed, n, hot):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 30, 300)
    sizes[7] *= hot
    rows = [(f"{rng.integers(0, 2**60):015x}{k:017x}", int(s)) for k, s in enumerate(sizes)]
    df = spark.createDataFrame(rows, "__key string, size long")
    cuts = sharding.minimax_cuts(df, n)
    got = Counter()
    for key, s in rows:
        got[sum(key >= c for c in cuts)] += s
    assert len(cuts) < n and max(got.values()) == least_capacity([s for _, s in sorted(rows)], n)


@pytest.mark.parametrize("which, keep", list(product(["docs", "wide"], [True, False])))
def test_shards(which, keep, rows, request):
    df = request.getfixturevalue(which)
    got = sharding.shard(df, 6, keep_text=keep).collect()
    assert len(got) == len(rows)
    size = {r[0]: (len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows}
    by_shard, of_text = defaultdict(list), defaultdict(set)
    text = {r[0]: r[1] or "" for r in rows}
    for r in got:
        assert (r.size, r.text_crc32) == size[r.doc_id] and r.law == "bytes" and r.grown_shard is None
        by_shard[r["shard"]].append(r.slot)
        of_text[text[r.doc_id]].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values()) and set(by_shard) <= set(range(6))
    assert all(len(s) == 1 for s in of_text.values())
    if keep:
        assert set(df.columns) <= set(got[0].asDict()) and all(r.text == text[r.doc_id] or r.text is None for r in got)


def test_one_group_and_nothing(spark, empty):
    same = spark.createDataFrame([(i, "x") for i in range(50)], "doc_id long, text string")
    assert {r["shard"] for r in sharding.shard(same).collect()} == {0}
    assert sharding.shard(empty).count() == 0
    assert sharding.with_digest(empty).select(F.sum("size")).first()[0] is None
