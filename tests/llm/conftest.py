import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like those that operators make.
CLASH = {"size": "x", "shard": "y", "kept": "z", "target": "t", "n": "n", "label": "l", "v": "v", "key": "k", "start": 1}


def sentence(r, n, words=None):
    return " ".join(r.choice(words or ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta.", "theta", "iota", "kappa"]) + str(r.randint(0, 60)) for _ in range(n))


def make_docs(seed=3, n=60):
    """Documents with copies, near copies, empties, nulls, ties and one long text."""
    r = random.Random(seed)
    base = sentence(r, 200)
    out = []
    for i in range(n):
        text = sentence(r, r.randint(0, 120)) if i % 4 else "\n".join(sentence(r, r.randint(1, 30)) for _ in range(6))
        out.append([i * 7 % n, text, "en", r.choice(["a", "b", "ß", None]), len(text)])
    for k in range(8):
        w = base.split()
        for _ in range(k * 2):
            w[r.randrange(len(w))] = f"new{r.randint(0, 999)}"
        out.append([n + k, " ".join(w), "en", "a", 0])
    for k in range(5):
        out.append([n + 10 + k, base, "en", "b", 0])
    out += [[n + 20, None, None, None, None], [n + 21, "", "en", "a", 0], [n + 22, " \n\t ", "en", "a", 3], [n + 23, "one", "en", "a", 3], [n + 24, "One two", "en", "a", 7], [n + 25, "ONE  two", "en", "a", 8]]
    out.append([n + 26, sentence(r, 20000), "en", "b", 0])
    out.append([n + 27, "word " * 500, "en", "b", 0])
    out += [out[1], out[1]]
    return [tuple(x) for x in out]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5).cache()


@pytest.fixture(scope="session")
def wide(docs):
    """The same with extra columns."""
    from pyspark.sql import functions as F

    return docs.withColumns({k: F.lit(v) for k, v in CLASH.items()})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
