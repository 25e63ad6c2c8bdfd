"""Periodic runs against brute force."""

import random
import re

import pytest

from cadenza.llm import periodic_runs as R
from cadenza.llm.queries import ORACLES, QUERIES, made_periodic
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def brute(w):
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            e = i
            while e + q < n and w[e] == w[e + q]:
                e += 1
            part = w[i: e + q]
            if e > i and len(part) >= max(6, 4 * q) and not any(part[p:] == part[: len(part) - p] for p in range(1, q)):
                out.append((i, len(part), q))
            i = e + 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(t):
    return [x for x in SPACE.split(t or "") if x]


def check(rows, got):
    got = sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=str)
    want = []
    for i, t in rows:
        runs = brute(words(t))
        want.append((i, len(words(t)), runs, collapsed(words(t), runs)))
    assert got == sorted(want, key=str)


def test_random_texts(spark):
    rng, rows = random.Random(8), []
    for d in range(400):
        k, w = rng.choice([1, 2, 3, 6]), []
        while len(w) < rng.choice([0, 8, 40, 150]):
            root = [f"w{rng.randrange(k)}" for _ in range(rng.randrange(1, rng.choice([2, 4, 12, 30])))]
            w += root * rng.randrange(1, 7) + root[: rng.randrange(len(root) + 1)]
        rows.append((d, rng.choice([" ", "\n", " \t "]).join(w)))
    check(rows, R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())


def test_odd_rows(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect() if len(r["text"] or "") < 100_000]
    got = R.periodic_runs(odd_docs).collect()
    assert len(got) == odd_docs.count()
    check(rows, [r for r in got if r.n_words < 20_000])
    for r in got:
        if r.n_words >= 20_000:  # words that come again and again as a whole
            w = words(next(x["text"] for x in odd_docs.where(f"doc_id = {r.doc_id}").collect()))
            period = next(p for p in range(1, len(w)) if w[p:] == w[:-p])
            assert [tuple(x) for x in r.runs] == [(0, len(w), period)] and r.collapsed == " ".join(w[:period])
    assert R.periodic_runs(odd_docs.limit(0)).count() == 0


def test_long_texts(spark):
    """One word over and over; a period of a fifth of a long text; a run of each end; none in a row of distinct words."""
    n = 100_000
    long = [f"a{i}" for i in range(n // 5)]
    rows = [(1, "x " * n), (2, " ".join(long * 5)), (3, " ".join(f"b{i}" for i in range(n))), (4, " ".join(["y"] * 6 + long + ["p", "q"] * 4))]
    got = {r.doc_id: [tuple(x) for x in r.runs] for r in R.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [(0, n, 1)], 2: [(0, n, n // 5)], 3: [], 4: [(0, 6, 1), (n // 5 + 6, 8, 2)]}


def test_made_periodic(spark):
    import zlib

    rows = [(i, t) for i in range(300) for t in ("", " a  b\tc d e f g h i j ", "one")] + [(None, "a b c d"), (10, None)]
    want = []
    for i, t in rows:
        h, w = zlib.crc32(str(i).encode()), words(t)
        if i is not None and h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        want.append((str(i), " ".join(w)))
    got = made_periodic(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), " ".join(words(r.text))) for r in got) == sorted(want)


@pytest.mark.parametrize("name", ["op12_periodic_runs"])
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None
