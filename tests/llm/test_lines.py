"""Fuzzy line dedup against brute force."""

import collections
import random
import re

import numpy as np

from cadenza.llm import line_dedup
from cadenza.llm.queries import QUERIES

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def normal(line):
    return SPACE.sub(" ", re.sub("[A-Z]", lambda m: m[0].lower(), line)).strip(" ")


def line_set(line):
    return {line} if len(line) < 7 else {line[k: k + 7] for k in range(len(line) - 6)}


def brute(rows):
    """(doc_id, line, n, keep_id, keep_line, kept) of rows (doc_id, text) with unlike ids."""
    lines = [(d, k, normal(x)) for d, t in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    sets = {x: line_set(x) for _, _, x in lines}
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = collections.defaultdict(list)
    for a in sorted(sets):
        shared = collections.Counter(b for g in sets[a] for b in holders[g])
        for b, both in shared.items():
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
        for g in sets[a]:
            holders[g].append(a)
    low = collections.defaultdict(list)
    for d, k, x in lines:
        low[find(x)].append((d is None, d or 0, k))
    best = {r: min(v) for r, v in low.items()}
    out = []
    for d, k, x in lines:
        none, i, n = best[find(x)]
        out.append((d, k, len(sets[x]), None if none else i, n, (d is None, d or 0, k) == best[find(x)]))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "line", "n_shingles", "keep_id", "keep_line", "kept").collect()), key=str)


def fuzzy_rows(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdefg hijkl  éß") for _ in range(rng.choice([3, 9, 40, 120, 400]))) for _ in range(30)]

    def typo(x):
        x = list(x)
        for _ in range(rng.choice([0, 0, 1, 2])):
            x[rng.randrange(len(x))] = rng.choice("XYZ 日")
        return "".join(x)

    return [(d, "\n".join(typo(rng.choice(base)) if rng.random() < 0.9 else "" for _ in range(rng.randrange(0, 9)))) for d in range(n)]


def test_lines_equal_brute_force(spark):
    rows = fuzzy_rows(1, 150) + [(1000, None), (1001, ""), (1002, " \n\t\r\n"), (1003, "Word word\r\nword  WORD \n")]
    assert got(line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))) == brute(rows)


def test_lines_of_a_long_list(spark, monkeypatch):
    """A group above the list and block limits: no link between components is lost."""
    monkeypatch.setattr(line_dedup, "LIST_BLOCK", 16)
    rng = random.Random(2)
    base = [rng.choice("abcdefghij") for _ in range(300)]
    rows = []
    for d in range(120):
        x = list(base)
        for _ in range(rng.choice([0, 1, 3, 5, 7])):
            x[rng.randrange(300)] = "Q"
        rows.append((d, "".join(x)))
    assert got(line_dedup.line_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute(rows)


def test_lines_odd_rows(odd_docs, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    lines = line_dedup.line_groups(odd_docs).collect()
    want = collections.Counter((d, k) for d, t in rows for k, x in enumerate((t or "").split("\n")) if normal(x))
    assert collections.Counter((r.doc_id, r.line) for r in lines) == want
    assert sum(r.kept for r in lines) == len({(r.keep_id, r.keep_line) for r in lines})
    clean = line_dedup.without_repeats(odd_docs)
    assert clean.columns == odd_docs.columns
    texts = collections.Counter(r["text"] for r in clean.collect())
    assert sum(texts.values()) == len(rows) and texts["one two"] == 1 and texts[None] == sum(t is None for _, t in rows)
    assert line_dedup.line_groups(odd_docs.limit(0)).count() == 0


def test_bands_recall():
    """Pairs at the threshold share a band as often as 16 bands of 4 rows promise."""
    rng = np.random.default_rng(5)
    hits = 0
    for _ in range(2000):
        x = np.sort(rng.integers(0, 2**52, 70, dtype=np.uint64))
        both = np.concatenate((x[:60], x[:70][10:]))
        keys = line_dedup.bands(both, np.array([0, 60, 120]))
        hits += bool((keys[0] == keys[1]).any())
    assert hits >= 0.98 * 2000


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    have = got(QUERIES["op2_line_dedup"](spark, "/root/testdata/sf0.001"))
    assert have == want
