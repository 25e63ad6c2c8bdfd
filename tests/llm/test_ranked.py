"""Ranked lexical search against brute force."""

import collections
import math
import random
import re

import pytest

from cadenza.llm import ranked_search as R
from cadenza.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, best=50):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n = len(bags)
    total = sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(x for _, b in bags for x in b)
    out = []
    for item, t in items:
        scored = []
        for i, b in bags:
            m = 50 + 50 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))) * (1000000000 * b[x] // (1000 * b[x] + 20 * m)) for x in set(terms(t)) if b[x])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:best])]
    return sorted(out, key=str)


def got(docs, items, **more):
    return sorted(map(tuple, R.ranked(docs, items, **more).collect()), key=str)


@pytest.mark.parametrize("best", [1, 50])
def test_random_texts(spark, monkeypatch, best):
    """Trees and item blocks far smaller than the tables; many equal documents and equal scores."""
    monkeypatch.setattr(R, "TREE_ROWS", 90)
    monkeypatch.setattr(R, "TREE_ENTRIES", 700)
    monkeypatch.setattr(R, "ITEM_BYTES", 60)
    rng = random.Random(5)
    words = [f"W{i}" for i in range(60)]
    weight = [1 / (i + 1) for i in range(60)]
    text = lambda n: rng.choice([" ", ", ", "-"]).join(rng.choices(words, weight, k=n))
    docs = [(d, text(rng.choice([1, 2, 5, 30]))) for d in range(900)]
    docs += [(1000 + d, docs[7][1]) for d in range(200)] + [(2000 + d, "w1 w2 w50") for d in range(100)]
    rng.shuffle(docs)
    items = [(i, text(rng.choice([1, 3, 12]))) for i in range(12)] + [(12, docs[7][1]), (13, "unknown words"), (13, "w50 w59 w58")]
    docs_, items_ = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    assert got(docs_, items_, best=best) == brute(docs, items, best)


def test_odd_rows(spark, odd_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "w3 w4 W5"), (1, "w3 w4 W5"), (None, "one"), (2, None), (3, ""), (4, "é 日本 ▁ unk"), (5, "x" * 5000), (6, docs[9][1]), (7, " .,;")]
    items_ = spark.createDataFrame([(*r, "d", 3) for r in items], "item_id long, text string, doc_id string, score int")
    assert got(odd_docs, items_) == brute(docs, items)
    assert got(odd_docs.limit(0), items_) == [] and got(odd_docs, items_.limit(0)) == []
    assert got(odd_docs.where("text is null"), items_) == []


def test_bounds_hold():
    """No document scores above the bound of a node over it."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows, ranks, tfs = [], [], []
    for d in range(400):
        own = np.flatnonzero(rng.random(40) < 1 / (1 + np.arange(40) / 4))
        rows.append(len(own))
        ranks.append(own)
        tfs.append(rng.integers(1, 9, len(own)))
    m = rng.integers(50, 400, 400)
    tree = R.Tree(np.arange(400), np.ones(400, dtype=bool), m, np.cumsum([0, *rows]), np.concatenate(ranks), np.concatenate(tfs), 40)
    item = np.array([0, 3, 9, 25, 39])
    weight = np.array([5, 100, 900, 3000, 6000])
    tops = R.score(tree.tops.table(item, len(tree.lo)), tree.least_m, weight)
    exact = R.score(tree.docs.table(item, 400), tree.m, weight)
    for lo, hi, top in zip(tree.lo, tree.hi, tops):
        assert exact[lo:hi].max() <= top
    leaves = sorted((lo, hi) for lo, hi, leaf in zip(tree.lo, tree.hi, tree.leaf) if leaf)
    assert [x for lo, hi in leaves for x in range(lo, hi)] == list(range(400))


def test_equals_sql(spark):
    assert compare(QUERIES["op13_ranked_fp_tree_search"](spark, SF), duck(SF), ORACLES["op13_ranked_fp_tree_search"]) is None
