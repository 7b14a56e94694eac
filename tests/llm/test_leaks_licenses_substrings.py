import random
from collections import defaultdict

import numpy as np
import pytest

from docspark.llm import blocks, components, decontaminate, licenses, substrings
from docspark.llm.shingles import words


def items():
    r = random.Random(11)
    out = [(i, " ".join(f"q{r.randint(0, 10**6)}" for _ in range(r.randint(3, 70)))) for i in range(60)]
    return [*out, (98, None), (99, ""), (None, out[7][1]), (7, out[7][1])]


def leaky(bench):
    r = random.Random(12)
    rows = []
    for i in range(80):
        w = [f"f{r.randint(0, 999)}" for _ in range(r.randint(0, 400))]
        for _ in range(r.randint(0, 2)):
            q = (bench[r.randrange(60)][1] or "").upper().split()
            for _ in range(r.randint(0, 3)):
                q[r.randrange(len(q))] = "changed"
            k = r.randint(0, len(w))
            w[k:k] = q if r.random() < 0.7 else q[: len(q) // 2] + w[:30] + q[len(q) // 2 :]
        rows.append((i, ", ".join(w)))
    return [*rows, (200, None), (201, ""), (3, rows[5][1]), (300, "x " * 30000 + bench[9][1])]


@pytest.mark.parametrize("broadcast, bits, least", [(10**6, 20, 5), (0, 6, 1), (0, 20, 3)])
def test_leaks_equal_brute_force(spark, monkeypatch, broadcast, bits, least):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", bits)
    bench = [*items(), (70, "f1"), (71, "F2, f3"), (72, "f999 nowhere"), (73, "f4")]
    docs = leaky(bench)
    want = []
    for d, t in docs:
        for i, text in bench:
            w = decontaminate.item_words(text)
            n = min(5, len(w))
            if len(w) >= max(1, least):
                s, own = decontaminate.grams(w, n), decontaminate.grams(decontaminate.item_words(t), n)
                want += [(d, i, len(s), len(s & own))] if len(s & own) >= 0.8 * len(s) - 1e-9 else []
    df = spark.createDataFrame([(d, t, "clash", 1, "k", 2) for d, t in docs], "doc_id long, text string, item_id string, shared_shingles int, key string, value int")
    b = spark.createDataFrame([(i, t, 1) for i, t in bench], "item_id long, text string, r int").repartition(3)
    key = lambda r: tuple(map(str, r))
    assert len(want) > 20
    assert sorted(map(tuple, decontaminate.leaks(df, b, least=least).collect()), key=key) == sorted(want, key=key)
    if least == 5:
        bad = {w[0] for w in want}
        left = decontaminate.without_leaks(df, b)
        assert left.columns == df.columns and sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in docs if d not in bad)


def test_no_leaks(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(docs, none).count() == 0 and decontaminate.without_leaks(docs, none).count() == docs.count()
    some = spark.createDataFrame(items(), "item_id long, text string")
    assert decontaminate.leaks(empty, some).count() == 0


# ---- licences


def naive(text):
    best, order = (0.0, None, None), None
    for unit in licenses.units(text.lower()) if text else ():
        a = licenses.bigrams(unit)
        for lic, part, body in licenses.TEMPLATES:
            b = licenses.bigrams(body.lower())
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= licenses.LIKE and (order is None or (-len(a & b), -dice, f"{lic}/{part}") < order):
                order = (-len(a & b), -dice, f"{lic}/{part}")
                best = (dice, f"{lic}/{part}", lic)
    return best


def test_licenses_equal_all_comparisons(spark, docs, rows, wide, empty):
    r = random.Random(4)
    more = []
    for k, (_, _, body) in enumerate(licenses.TEMPLATES):
        w = body.split()
        w[r.randrange(len(w))] = "other"
        more += [(1000 + k, f"Some text.\n{body}\nMore text", "en", "a", 0), (2000 + k, "Intro words here. " + body.upper() + " And so on, and on.", "en", "a", 0), (3000 + k, " ".join(w), "en", "a", 0)]
    df = docs.unionByName(spark.createDataFrame(more, docs.schema))
    got = licenses.scan(df).collect()
    want = sorted((str(x[0]), *map(str, naive(x[1]))) for x in [*rows, *more])
    assert sorted((str(x.doc_id), str(x.dice), str(x.template), str(x.license)) for x in got) == want
    assert sum(x.license is not None for x in got) > 40
    assert licenses.scan(wide).count() == len(rows) and licenses.scan(empty).count() == 0


def test_whole_licences_are_told_apart():
    known = licenses.Templates()
    bodies = {lic: body for lic, part, body in licenses.TEMPLATES if part == "text"}
    for lic, body in bodies.items():
        assert known.best(f"Copyright (c) 2020, Some One\n\n{body}")[2] == lic
    two = bodies["BSD-2-Clause"]
    assert known.best(f"{two[:150]}\nand other conditions that nobody has heard of before")[1] == "BSD/grant"
    assert "neither the name" in bodies["BSD-3-Clause"].lower() and "neither the name" not in two.lower()


# ---- substrings


def spread(seed=9):
    """Documents of own words, some with passages that others have, within a line."""
    r = random.Random(seed)
    own = lambda n: [f"o{r.randint(0, 10**7)}" for _ in range(n)]
    passages = [[f"p{k}-{j}" for j in range(r.randint(50, 120))] for k in range(12)]
    rows, has = [], defaultdict(set)
    for i in range(120):
        w = own(r.randint(0, 200))
        for k in r.sample(range(12), r.choice([0, 0, 1, 2])):
            at = r.randint(0, len(w))
            w[at:at] = passages[k]
            has[k].add(i)
        for j in range(7, len(w), 13):
            w[j] += "\n" if r.random() < 0.3 else ""
        rows.append((i, " ".join(w)))
    return rows, has


def test_every_common_passage_is_found(spark):
    rows, has = spread()
    rows += [(500, None), (501, ""), (502, "short text"), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 5, "c") for r in rows], "doc_id long, text string, start int, v string")
    got = substrings.repeated(df).collect()
    flagged = {r.doc_id for r in got}
    want = {d for ds in has.values() if len(ds) > 1 for d in ds}
    assert flagged == want
    groups = defaultdict(set)
    for r in got:
        groups[r.cluster_id].add(r.doc_id)
        assert r.removed == (r.doc_id != r.keeper_doc_id)
    assert all(any(ds <= g for g in groups.values()) for ds in has.values() if len(ds) > 1)


def test_near_paragraphs_are_linked(spark):
    r = random.Random(2)
    base = [f"b{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 30):
        w = list(base)
        for j in range(r.randint(0, 20), 400, 40):
            w[j] = f"n{i}-{j}"
        rows.append((i, " ".join(w)))
    got = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x.doc_id for x in got} == set(range(30))
    text = dict(rows)
    by = defaultdict(list)
    for x in got:
        by[x.cluster_id].append(words(text[x.doc_id].encode())[x.start : x.start + x.n_words])
    assert len({tuple(w) for ws in by.values() for w in ws}) > len(by), "some clusters hold different texts"


def variants(tails, stem=0):
    stem = " ".join(f"s{stem}-{i}" for i in range(23))
    return [(k, f"{stem} {t}") for k, t in enumerate(tails)]


def test_families_of_copies_are_bridged(spark):
    rows = variants([f"{x} {x}{k}" for x in "ab" for k in range(8)])
    got = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(16)) and len({r.cluster_id for r in got}) == 1


def test_blocks_of_a_long_list_are_bridged(spark, monkeypatch):
    monkeypatch.setattr(blocks, "CHUNK", 4)
    got = substrings.repeated(spark.createDataFrame(variants([f"x y{k}" for k in range(28)], 2), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == set(range(28)) and len({r.cluster_id for r in got}) == 1


@pytest.mark.parametrize("chunk", [16, 1024])
def test_groups_equal_all_comparisons(spark, monkeypatch, chunk):
    """Texts of one paragraph with a word changed, each compared with all others."""
    monkeypatch.setattr(blocks, "CHUNK", chunk)
    r = random.Random(6)
    rows = []
    for i in range(300):
        w = [f"w{j}" for j in range(25)]
        w[r.randrange(25)] = f"other{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(21)} for _, t in rows]
    group = list(range(len(rows)))

    def root(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                group[y] = x
    want = defaultdict(set)
    for i in range(len(rows)):
        want[root(i)].add(i)
    got = defaultdict(set)
    for x in substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[x.cluster_id].add(x.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_single_near_paragraphs_are_found(spark):
    """Pairs of texts of one paragraph with a Jaccard similarity of 19/23, alone with each other."""
    rows = [(2 * p + k, " ".join([*(f"t{p}-{j}" for j in range(23)), f"u{p}-{k}", f"w{p}-{k}"])) for p in range(300) for k in (0, 1)]
    got = substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) >= 2 * 298 and all(r.keeper_doc_id == r.doc_id // 2 * 2 for r in got)


def test_removal_cuts_only_what_others_keep(spark):
    rows, has = spread()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substrings.repeated(df)
    new = {r.doc_id: r.text for r in substrings.without_repeats(df, found).collect()}
    gone = defaultdict(set)
    for r in found.where("removed").collect():
        gone[r.doc_id].update(range(r.start, r.start + r.n_words))
    for d, t in rows:
        assert new[d].split() == [w for k, w in enumerate(t.split()) if k not in gone[d]]


def test_small_hashes_exclude_no_alike_pair(monkeypatch):
    """Few bits, so that hashes meet by chance, and words that repeat, so that shingles do."""
    rng = np.random.default_rng(3)
    texts = []
    for k in range(400):
        w = [f"a{x}" for x in rng.integers(0, rng.choice([2, 3, 50]), 25)]
        texts.append(" ".join(w).encode())
        w[int(rng.integers(0, 3)) if k % 2 else 24] = "other"
        texts.append(" ".join(w).encode())
    exact = [set(zip(*(words(t)[i:] for i in range(5)))) for t in texts]
    tiny = substrings.parted(substrings.paragraphs_of(texts)[3])
    assert len(tiny) == len(texts) and [int(x) for x in tiny[:, 21]] == [len(s) for s in exact]
    for bits in (12, 5):
        few = tiny.copy()
        few[:, :21] >>= 12 - bits
        few[:, 22] = 1 + (few[:, 1:21] != few[:, :20]).sum(1)
        i, j = np.triu_indices(len(texts), 1)
        few = substrings.joined(few)
        got = substrings.close(few[i], few[j])
        want = np.array([100 * len(exact[a] & exact[b]) >= 80 * len(exact[a] | exact[b]) for a, b in zip(i, j)])
        assert want.sum() > 100 and got[want].all() and (bits < 12 or (got & ~want).sum() < 0.01 * len(i))


def test_pairs_that_are_not_alike_stay_in_their_bucket(spark, monkeypatch):
    """Pairs at 16/26 share bands mostly; no table of lists is made of them."""
    rows = [(2 * p + k, " ".join(f"t{p}-{j}" if j != 12 else f"u{p}-{k}" for j in range(25))) for p in range(200) for k in (0, 1)]
    made, settle = {}, substrings.settle

    def counted(df, name):
        out = settle(df, name)
        made[name] = max(out.count(), made.get(name, 0))
        return out

    monkeypatch.setattr(substrings, "settle", counted)
    assert substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).count() == 0
    assert made.pop("paragraphs") == made.pop("places") == 400
    assert max(made.values()) < 60, made


@pytest.mark.parametrize("few, many, longest", [(32, 16, 1 << 14), (2, 16, 1 << 14), (2, 1, 1 << 14), (2, 1, 3)])
def test_buckets_lose_no_alike_pair(monkeypatch, few, many, longest):
    """Each pair of a list at 0.8 is sent as a pair, or both are in a list that is sent."""
    for name, value in (("FEW", few), ("MANY", many), ("LONGEST", longest), ("AT_ONCE", 3)):
        monkeypatch.setattr(substrings, name, value)
    rng = np.random.default_rng(4)
    texts = []
    for k in range(40):
        stem = [f"a{k}-{x}" for x in rng.integers(0, rng.choice([3, 50]), 25)]
        for j in range(int(rng.integers(1, 12))):
            w = list(stem)
            w[int(rng.choice([0, 1, 12, 24]))] = f"b{j}"
            texts.append(" ".join(w).encode())
    texts = sorted(set(texts))
    exact = [set(zip(*(words(t)[i:] for i in range(5)))) for t in texts]
    small = np.ascontiguousarray(substrings.parted(substrings.paragraphs_of(texts)[3])[:, :21].T.astype(np.uint16))
    entries = np.zeros(2 * len(texts), substrings.ENTRY)
    entries["k"] = np.tile([int(t.split()[2].split(b"-")[0][1:]) if b"-" in t.split()[2] else 99 for t in texts], 2)
    entries["s"], entries["v"] = np.tile(substrings.distinct_bits(small), 2), np.tile(np.arange(len(texts)), 2)
    got = substrings.compared([entries.tobytes()])
    pairs, lists = set(), defaultdict(set)
    for key, v, c in zip(*(x.to_pylist() for x in got.columns)):
        lists[key, c].add(v) if c else pairs.add((key, v))
    assert all(len(members) == c for (_, c), members in lists.items())
    alike = 0
    for b in range(len(texts)):
        for a in range(b):
            if entries["k"][a] == entries["k"][b] and 100 * len(exact[a] & exact[b]) >= 80 * len(exact[a] | exact[b]):
                alike += 1
                assert (a, b) in pairs or any({a, b} <= members for members in lists.values())
    assert alike > 50 and bool(lists) == (many == 1)


def test_no_paragraphs(spark, empty):
    assert substrings.repeated(empty).count() == 0
    assert substrings.tuned_bands(paragraphs=1, missed=0.001) == 7


def test_places_agree_within_a_passage():
    rng = np.random.default_rng(0)
    for _ in range(50):
        common = rng.integers(0, 2**62, 26)
        a = np.concatenate([rng.integers(0, 2**62, 40), common, rng.integers(0, 2**62, 30)])
        b = np.concatenate([rng.integers(0, 2**62, 7), common, rng.integers(0, 2**62, 90)])
        inside = lambda h, s: {x - s for x in substrings.places(h) if s <= x < s + 26}
        assert inside(a, 40) & inside(b, 7)


def test_pairs_need_no_rounds_and_no_copy_of_their_texts(spark, monkeypatch):
    """Components that are closed after one round aren't worked on again, and the texts listed are those of the pairs."""
    rows = [(2 * p + k, " ".join([*(f"t{p}-{j}" for j in range(23)), f"u{p}-{k}", f"w{p}-{k}"])) for p in range(40) for k in (0, 1)]
    made = {}

    def counted(df, name, settle=substrings.settle):
        out = settle(df, name)
        made[name] = max(out.count(), made.get(name, 0))
        return out

    for module in (substrings, blocks, components):
        monkeypatch.setattr(module, "settle", counted)
    assert len(substrings.repeated(spark.createDataFrame(rows, "doc_id long, text string")).collect()) > 70
    assert made["closed-labels"] > 70 and not made["near-labels"] and "pair-texts" not in made, made


@pytest.mark.parametrize("share", [1024, 4])
def test_closed_components_are_whole(spark, monkeypatch, share):
    monkeypatch.setattr(components, "HOT_SHARE", share)
    r = random.Random(5)
    groups = [[(0, k) for k in range(1, 60)], [(100 + k, 101 + k) for k in range(30)], *([(1000 + 10 * k, 1001 + 10 * k)] for k in range(20))]
    groups.append([(2000 + r.randrange(40), 2000 + r.randrange(40)) for _ in range(60)] + [(2000, 2000 + k) for k in range(0, 40, 3)])
    pairs = [(a, b) for g in groups for a, b in g]
    label = {v: v for p in pairs for v in p if p[0] != p[1]}
    for _ in label:
        for a, b in pairs:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    edges = spark.createDataFrame(r.sample(pairs, len(pairs)), "a long, b long")
    for closing in (False, True):
        got = components.components(edges, closing=closing).collect()
        assert len(got) == len(label) and {x.v: x.label for x in got} == label


def test_places_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(7)
    for most in (2, 5, 2**40):
        sizes = rng.integers(0, 90, 60)
        begin = np.cumsum([0, *sizes + 24])[:-1]  # behind each text's places those that are in no paragraph
        h = rng.integers(0, most, int((sizes + 24).sum())).astype(np.uint64)
        want = []
        for i, n in zip(begin, sizes):
            for k in range(max(n - 25, min(n, 1))):
                want.append(i + k + h[i + k : i + min(k + 26, n)].argmin())
        assert substrings.places(h, begin, begin + sizes).tolist() == sorted(set(want))
