"""Embedding near-dedup against brute force."""

import collections
import random

import numpy as np

from cadenza.llm import euclidean_hashing as H
from cadenza.llm.queries import ORACLES, QUERIES
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"


def brute(rows):
    """rows of (vec_id, vector, label): links and components by looking at every pair."""
    def usable(v, label):
        return label is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, dtype=float) / max(abs(x) for x in v) if usable(v, label) else None for _, v, label in rows]
    root = list(range(len(rows)))
    links = collections.Counter()

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = unit[i], unit[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and a @ b >= 0.93 * np.sqrt(a @ a) * np.sqrt(b @ b):
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, r in enumerate(rows):
        low[find(i)].append(r[0])
    out = []
    for i, (v, _, _) in enumerate(rows):
        c = min((x for x in low[find(i)] if x is not None), default=None)
        out.append((v, links[i], c, v == c))
    return sorted(out, key=str)


def odd_rows():
    rng = np.random.default_rng(2)
    near = lambda v, s: (v + rng.standard_normal(len(v)) * s).tolist()
    base, other = rng.standard_normal(16), rng.standard_normal(16)
    rows = [(k, near(base, 0.05), 1) for k in range(120)]  # a bucket of several blocks
    rows += [(200 + k, other.tolist(), 2) for k in range(30)] + [(240, (other * 3).tolist(), 2), (241, (other * 1e200).tolist(), 2), (242, (other * 1e-200).tolist(), 2)]
    rows += [(300, other.tolist(), 1), (301, other.tolist(), None), (302, base.tolist(), None), (303, None, 1), (304, [], 1), (305, [0.0] * 16, 1)]
    rows += [(306, [None] + [1.0] * 15, 1), (307, [float("nan")] + [1.0] * 15, 1), (308, [float("inf")] + [1.0] * 15, 1)]
    rows += [(309, base[:8].tolist(), 1), (310, near(base[:8], 0.01), 1), (None, base.tolist(), 1), (None, near(other, 0.001), 3), (None, other.tolist(), 3), (None, None, 1)]
    rows += [(400, other.tolist(), 2), (400, other.tolist(), 2), (401, near(other, 0.2), 2), (2**40, [-0.0, 1.0], 5), (2**40 + 1, [0.0, 1.0], 5), (12, [1.0], 6), (11, [5.0], 6), (10, [-5.0], 6)]
    return rows


def frame(spark, rows):
    rows = [(*r, "x", k, None) for k, r in enumerate(rows)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, keys int, n_links double").repartition(7)


def test_near_groups_odd_rows(spark):
    rows = odd_rows()
    random.Random(1).shuffle(rows)
    got = H.near_groups(frame(spark, rows), block=16).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    assert H.near_groups(frame(spark, rows).limit(0)).count() == 0
    assert sorted(map(tuple, H.near_groups(frame(spark, [(7, None, 1), (8, [0.0], None)])).collect())) == [(7, 0, 7, True), (8, 0, 8, True)]


def test_recall_at_the_threshold(spark):
    """Pairs from just above the threshold to close ones, among unrelated vectors: at least nine of ten links are found, none below."""
    rng, rows = np.random.default_rng(4), []
    for k in range(1500):
        a, b = rng.standard_normal((2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        c = (0.9301, 0.935, 0.95, 0.98, 0.9295, 0.90)[k % 6]
        rows += [(2 * k, a.tolist(), 1), (2 * k + 1, (c * a + np.sqrt(1 - c * c) * b).tolist(), 1)]
    got = dict(H.near_groups(frame(spark, rows)).select("vec_id", "n_links").collect())
    by = collections.Counter((k % 6) for k in range(1500) if got[2 * k] == 1 and got[2 * k + 1] == 1)
    assert all(by[k] >= 230 for k in range(4)) and not by[4] and not by[5], by  # 250 pairs each


def test_tables_follow_the_labels():
    assert H.shape(0) == H.shape(500) and H.shape(10**7)[0] > H.shape(10**4)[0]
    for rows in (500, 10**5, 10**8):
        folds, tables = H.shape(rows)
        assert 1 - (1 - H.agreement(np.sqrt(2 - 2 * H.COSINE)) ** folds) ** tables >= H.RECALL


def test_equals_sql(spark):
    assert compare(QUERIES["op11_euclidean_near_dedup"](spark, SF), duck(SF), ORACLES["op11_euclidean_near_dedup"]) is None
