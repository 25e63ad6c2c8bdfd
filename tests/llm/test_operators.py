"""Operators against brute force, on odd rows and on empty tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from cadenza.llm import bytesets, chat, decontaminate, exact_dedup, jaccard_join, language, sentencepieces, sharding, toxicity, tree_weighting
from cadenza.llm.queries import ORACLES, QUERIES, pieces_path
from cadenza.llm.shared import components
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def shingles(t):
    w = [x for x in SPACE.split(lower(t)) if x]
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i: i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("name", ["op1_ngram_jaccard_join", "op4_exact_dedup", "op5_chat_prefix_targets"])
def test_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[find(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in low[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def test_jaccard_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert sorted(map(tuple, jaccard_join.jaccard_components(odd_docs).collect()), key=str) == brute_components(rows)
    assert jaccard_join.jaccard_components(odd_docs.limit(0)).count() == 0
    kept = jaccard_join.one_per_group(odd_docs)
    assert kept.columns == odd_docs.columns


def test_jaccard_large_group(spark, monkeypatch):
    """A group above the list and block limits, with strays around the threshold: no link between components is lost."""
    monkeypatch.setattr(jaccard_join, "LIST_BLOCK", 16)
    rng = random.Random(4)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for d in range(150):
        w = list(base)
        for k in rng.sample(range(100), rng.choice([0, 1, 2, 3, 5])):
            w[k] = f"x{d}_{k}"
        rows.append((d, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), frequent=4)
    assert sorted(map(tuple, got.collect()), key=str) == brute_components(rows)


def test_signatures_meet():
    """Any two sets at the threshold share an index key, whatever the frequency classes are."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(3, 300))
        drop = int(rng.integers(0, n // 4 + 1))
        add = max(0, (n - drop) * 4 // 3 - n)
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)))
        cls = lambda x: np.where(x % 5 < rng_cut, 0, 1 + x % 7).astype(np.uint8)
        rng_cut = int(rng.integers(0, 6))
        if 100 * (n - drop) >= 75 * (n + add):
            x, y = (jaccard_join.signatures(s, cls(s)) for s in (np.sort(a), np.sort(b)))
            assert len(np.intersect1d(x, y)), (n, drop, add)


def test_signatures_meet_by_levels():
    """The same with levels of rare shingles, at the lower sizes of a set and in sets of mostly frequent shingles."""
    rng = np.random.default_rng(5)
    for k in range(600):
        n = int(rng.integers(3, 40 if k % 2 else 400))
        drop = int(rng.integers(0, n // 4 + 1))
        add = max(0, (n - drop) * 4 // 3 - n)
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate((a[drop:], rng.integers(0, 2**63, add, dtype=np.uint64)))
        spread = int(rng.integers(1, 200))
        cls = lambda x: (x % np.uint64(spread)).astype(np.uint8)
        if 100 * (n - drop) >= 75 * (n + add):
            x, y = (jaccard_join.signatures(s, cls(s), jaccard_join.LEVELS) for s in (np.sort(a), np.sort(b)))
            assert len(np.intersect1d(x, y)), (n, drop, add, spread)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 360)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    want = {x: find(x) for u, v in edges if u != v for x in (u, v)}
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == want
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_dedup_odd_rows(odd_docs, spark):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    text = [hashlib.sha256(SPACE.sub(" ", t or "").encode()).hexdigest() for _, t in rows]
    got = exact_dedup.exact_groups(odd_docs).collect()
    assert sorted((str(r.doc_id), r.text_sha256) for r in got) == sorted((str(d), h) for (d, _), h in zip(rows, text))
    for r in got:
        ids = [d for (d, _), h in zip(rows, text) if h == r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((d for d in ids if d is not None), default=None)
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter(set(text))
    kept = exact_dedup.one_per_text(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(set(text))
    assert exact_dedup.exact_groups(odd_docs.limit(0)).count() == 0
    # A filter far too small flags every row; the result is the same.
    full = exact_dedup.exact_groups(odd_docs, cells=1 << 16).collect()
    assert sorted(map(str, full)) == sorted(map(str, got))


def test_sharding(odd_docs, spark):
    for docs in (odd_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = docs.select("doc_id", "text").collect()
        order = sorted(((r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()) + 1) for r in rows))
        total, before, want, slots = sum(r[3] for r in order), 0, [], collections.Counter()
        for some, i, crc, size in order:
            shard = min(15, (2 * before + size) * 16 // (2 * total))
            want.append((i if some else None, size, crc, "bytes", shard, slots[shard], None))
            slots[shard] += 1
            before += size
        assert sorted(map(tuple, sharding.byte_shards(docs).collect()), key=str) == sorted(want, key=str)
    assert sharding.byte_shards(odd_docs.limit(0)).count() == 0


def test_chat_round_trip(spark):
    rng = random.Random(5)
    rows = []
    for c in [None, *range(40)]:
        for t in range(rng.randrange(1, 9)):
            body = "".join(rng.choice(["<|im_end|>", "<|im_start|>", "\\", "<", "|", "a", "\n", "é", "assistant\n", "\\n"]) for _ in range(rng.randrange(12)))
            rows.append((c, t, rng.choice(["user", "assistant", "system", None, "a\nb<|"]), rng.choice([body, None])))
    rows.append((99, 0, "assistant", "x" * 300_000))
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, target int")
    got = {r["conv_id"]: r for r in chat.digests(chat.examples(df)).collect()}
    by = collections.defaultdict(list)
    for c, _, r, t in rows:
        by[c].append((r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), hashlib.sha256(said.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    examples = chat.examples(df).where("target is not null").collect()
    assert len(examples) == sum(r == "assistant" for _, _, r, _ in rows)
    for e in examples:
        assert chat.read_turns(e.text) == by[e.conv_id][: e.target + 1]
        assert chat.unescape(e.text[e.loss_start: e.loss_end]) == by[e.conv_id][e.target][1]
    assert chat.digests(chat.examples(df.limit(0))).count() == 0


def edit_distance_within(pattern: bytes, text: bytes) -> int:
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def test_decontamination(spark, odd_docs):
    rng = random.Random(9)
    items = [(k, " ".join(rng.choice(["alpha", "beta", "gam", "delta", "eps", "zeta"]) + str(rng.randrange(99)) for _ in range(rng.choice([1, 3, 12, 30])))) for k in range(12)]
    items += [(50, None), (51, ""), (52, items[0][1]), (None, "short"), (53, "tiny")]
    docs = []
    for d in range(80):
        x = list(rng.choice(items)[1] or "")
        for _ in range(rng.randrange(0, 1 + len(x) // 12)):
            k = rng.randrange(len(x) or 1)
            x[k: k + rng.randrange(2)] = rng.choice(["", "q", "z"])
        docs.append((d, f"Some words before {''.join(x)}  AND after"))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: SPACE.sub(" ", lower(t)).strip(" ").encode()
    want = set()
    for d, t in docs:
        for i, x in items:
            x = norm(x)
            dist = edit_distance_within(x, norm(t)) if x else 1
            if x and dist <= decontaminate.budget(len(x), decontaminate.RATE):
                want.add((d, i, dist))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want and any(x[2] > 0 for x in want)
    assert decontaminate.contaminated(df, bench.limit(0)).count() == 0
    assert decontaminate.contaminated(df.limit(0), bench).count() == 0
    assert decontaminate.clean(odd_docs, bench).columns == odd_docs.columns


def test_language(spark, odd_docs):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(train)
    found = language.languages_of_documents(train, model).join(train.withColumnRenamed("doc_id", "id").withColumnRenamed("lang", "declared"), "id")
    right, n = found.selectExpr("avg(int(lang = declared))", "count(*)").first()
    assert right > 0.96 and n == train.count()
    odd = language.languages_of_documents(odd_docs, model)
    assert odd.count() == odd_docs.count() and {r.id for r in odd.where("not accepted").collect()} >= {5, 6}
    assert language.languages_of_documents(odd_docs.limit(0)).count() == 0
    assert {r.lang for r in language.languages_of_documents(odd_docs.withColumn("lang", odd_docs.lang.substr(9, 1)).where("false or lang is null")).collect()} <= {"und", ""}
    pages = spark.createDataFrame(
        [(1, "https://a.example.de/x", "<html lang='de'><p>12</p></html>"), (2, None, None), (None, "no url", "<script>the of and</script>")] +
        [(9 + k, "http://h.example.de/", "<html lang='de'>der die das und nicht ein einer schon keit lich ung</html>") for k in range(30)], "page_id long, url string, html string")
    out = {r.id: r for r in language.languages_of_pages(pages, model).collect()}
    assert len(out) == 33 and out[9].lang == "de" and out[1].lang == "de"


def test_sentencepieces(spark, odd_docs):
    import sentencepiece

    path = pieces_path()
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    texts = [r["text"] or "" for r in odd_docs.collect()] + ["".join(rng.choice("abcdeé ▁\n 日0<>st\t") for _ in range(rng.randrange(700))) for _ in range(60)] + ["ab" * 900, " "]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)] + [(None, None, "y")], "doc_id long, text string, ids string")
    ids = sentencepieces.encode(df, path)
    got = {r.doc_id: r.ids for r in ids.collect()}
    back = {r.doc_id: r.text for r in sentencepieces.decode(ids, path).collect()}
    digest = {r.doc_id: r for r in sentencepieces.digests(df, path).collect()}
    for k, t in enumerate(texts):
        want = lib.encode(t, add_eos=True)
        assert got[k] == want and back[k] == lib.decode(want)
        assert digest[k].ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert (digest[k].n_tokens, digest[k].decoded_sha256) == (len(want), hashlib.sha256(lib.decode(want).encode()).hexdigest())
    assert got[None] == [2]
    assert sentencepieces.digests(df.limit(0), path).count() == 0


def test_language_outside_the_labels(spark):
    """Text of no labelled language goes; labelled text stays."""
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(train)
    foreign = [
        "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。何でも薄暗いじめじめした所で泣いていた。",
        "Все счастливые семьи похожи друг на друга, каждая несчастливая семья несчастлива по-своему.",
        "48151623 42108 99120 37461 00192 83746 55501 29384 77120 46352 19283 74650",
    ]
    df = spark.createDataFrame(list(enumerate(foreign)), "doc_id long, text string").selectExpr("*", "'x' as source")
    out = {r.id: r.accepted for r in language.languages_of_documents(df, model).collect()}
    assert out == {0: False, 1: False, 2: False}
    told = language.languages_of_documents(train, model).where("n_grams > 0")
    kept, n = told.selectExpr("sum(int(accepted))", "count(*)").first()
    print("kept", kept, "of", n)
    assert kept > 0.99 * n


def brute_tree(train: list[bytes], scored: list[bytes], depth: int):
    """Context-tree weighting by recursion over dictionaries."""
    from math import lgamma, log, log10

    counts = collections.defaultdict(lambda: [0, 0])

    def decisions(x):
        padded = b"\n" * depth + x
        for t in range(depth, len(padded)):
            for k in range(8):
                yield padded[t - depth: t], 1 << k | padded[t] >> (8 - k), padded[t] >> (7 - k) & 1

    for x in train:
        for c, u, b in decisions(x):
            for d in range(depth + 1):
                counts[c[depth - d:], u][b] += 1
    kids = collections.defaultdict(list)
    for c, u in counts:
        if c:
            kids[c[1:], u].append((c, u))
    kt = lambda z, o: lgamma(z + 0.5) + lgamma(o + 0.5) - lgamma(z + o + 1) - 2 * lgamma(0.5)
    whole, stop = {}, {}
    for key in sorted(counts, key=lambda k: -len(k[0])):
        own = kt(*counts[key])
        if len(key[0]) == depth:
            whole[key], stop[key] = own, 1.0
        else:
            under = sum(whole[k] for k in kids[key])
            whole[key] = np.logaddexp(own, under) - log(2)
            stop[key] = float(np.exp(own - log(2) - whole[key]))
    out = []
    for x in scored:
        total = 0.0
        for c, u, b in decisions(x):
            p = None
            for d in range(depth, -1, -1):
                key = (c[depth - d:], u)
                if key in counts:
                    z, o = counts[key]
                    own = (o + 0.5) / (z + o + 1)
                    p = own if p is None else stop[key] * own + (1 - stop[key]) * p
            p = 0.5 if p is None else p
            total += log10(p if b else 1 - p)
        out.append(total)
    return out


def test_context_tree(spark, odd_docs):
    rows = [(k, t) for k, t in enumerate(["the cat sat", "The  cat\tran off", None, "", "a", "dog dog dog", "é 日本", "the cat sat on it", "off the map", "zzz"] * 2)] + [(None, "the end")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, chunk double").repartition(3)
    got = {r.doc_id: r for r in tree_weighting.scores(df).collect()}
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1 for d, _ in rows}
    words = {d: [w for w in SPACE.split(lower(t)) if w] for d, t in rows}
    packed = {d: " ".join(w).encode() + b"\n" for d, w in words.items()}
    want = dict(zip(packed, brute_tree([packed[d] for d in packed if not held[d]], list(packed.values()), tree_weighting.DEPTH)))
    train = collections.Counter(w for d in words if not held[d] for w in [*words[d], None])
    n, v = sum(train.values()), len(train)
    for d in words:
        r, tokens = got[d], [*words[d], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(tokens), sum(train[w] > 0 for w in tokens), n)
        assert abs(r.base_score - sum(np.log10((train[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)) < 1e-9
        assert abs(r.score - want[d]) < 1e-6
    assert tree_weighting.scores(df.limit(0)).count() == 0
    assert tree_weighting.scores(odd_docs).count() == odd_docs.count()


def test_context_tree_reaches_six_bytes(spark):
    """A byte that only the sixth byte before it decides is scored by that byte, in training and held out."""
    ids = range(60)
    held = [k for k in ids if zlib.crc32(str(k).encode()) % 5 == 1]
    rows = [(k, "pqqqqqp" if k % 2 else "rqqqqqr") for k in ids if k not in held]
    texts = ["pqqqqqp", "pqqqqqr", "rqqqqqr", "rqqqqqp"]
    df = spark.createDataFrame(rows + list(zip(held, texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in tree_weighting.scores(df).collect()}
    same, other, same_too, other_too = (got[k] for k in held[:4])
    assert same > other + 0.5 and same_too > other_too + 0.5


def test_code_is_a_distribution():
    """The probabilities of all next bytes after any context sum to one."""
    rng = np.random.default_rng(0)
    codes = np.unique(rng.integers(97, 101, (300, 5)) @ (1 << np.array([32, 24, 16, 8, 0])))
    after = np.unique(codes >> 8)[:5]
    every = np.unique(np.concatenate([codes, (after[:, None] << 8 | np.arange(256)).ravel()]))
    counts = np.where(np.isin(every, codes), 3, 0)
    level = tree_weighting._levels(every, counts, 2)[2]
    shallow = tree_weighting.Shallow(level.keys & 0xFFFF, level.zeros, level.ones, level.whole)
    p = 10 ** tree_weighting.log10_probabilities(every, counts, shallow)
    for c in after:
        assert abs(p[every >> 8 == c].sum() - 1) < 1e-9


def test_toxicity(spark, odd_docs):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(docs, labels)
    rows = out.where("held_out").join(labels, "doc_id").select("score", "toxic").collect()
    pos, neg = ([r.score for r in rows if r.toxic == c] for c in (1, 0))
    assert np.mean([a > b for a in pos for b in neg]) > 0.9
    few = labels.where("toxic = 0")
    assert {r.score for r in toxicity.toxicity(odd_docs, few).collect()} == {0.5}
    assert toxicity.toxicity(odd_docs, labels).count() == odd_docs.count()
    assert toxicity.toxicity(odd_docs.limit(0), labels.limit(0)).count() == 0


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: x.astype(np.float64) for k, x in toxicity.fresh_parameters(rng).items()}
    (_, _, data, off), = bytesets.slices(pa.array(["hello bad word and again\n", "another text\n"], pa.large_string()), 1 << 40)
    words = toxicity.Words(data, off)
    index, _ = words.windows()
    number, y = np.where(index >= 0, words.number[np.maximum(index, 0)], -1), np.array([1.0, 0.0])
    _, g = toxicity.gradients(p, words, words.vectors(p), number, y)
    for k in ("wf", "ub", "wa", "va", "wo", "cf", "words", "chars"):
        at = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        loss = []
        for step in (1e-3, -2e-3):
            p[k][at] += step
            loss.append(toxicity.gradients(p, words, words.vectors(p), number, y)[0])
        p[k][at] += 1e-3
        assert abs((loss[0] - loss[1]) / 2e-3 - g[k][at]) < 1e-3


def test_stages_act_by_row(spark):
    """Rows without an id meet each decision, and a clean row that shares its id with a rejected one stays."""
    word = lambda k, n: " ".join(f"{chr(97 + (k * 7 + i) % 26)}w{(k * 31 + i * i) % 997}" for i in range(n))
    item, other = word(1, 30), word(2, 60)
    kinds = "doc_id long, text string, source string, lang string"
    of = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.collect())

    rows = [(None, f"x {item} y"), (None, other), (7, f"a {item} b"), (7, other), (8, other)]
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    df = spark.createDataFrame([(*r, "s", "en") for r in rows], kinds)
    assert of(decontaminate.clean(df, bench)) == sorted([(0, other), (7, other), (8, other)])

    near = other + " end"
    rows = [(None, item), (None, item + " end"), (4, other), (5, near), (5, word(3, 50)), (None, None), (6, "")]
    df = spark.createDataFrame([(*r, "s", "en") for r in rows], kinds)
    left = of(jaccard_join.one_per_group(df))
    assert len(left) == 5 and (4, other) in left and (5, word(3, 50)) in left and (0, "") in left and (6, "") in left
    assert sum(d == 0 and t.startswith(item) for d, t in left) == 1

    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "source", "lang")
    good = train.where("lang = 'en' and length(text) between 300 and 3000").orderBy("doc_id").first()["text"]
    bad = "吾輩は猫である。名前はまだ無い。どこで生れたかとんと見当がつかぬ。"
    rows = [(None, bad, "s", None), (-1, bad, "s", None), (-1, good, "s", None), (None, good, "s", None), (None, None, "s", None)]
    kept = language.accepted(train.unionByName(spark.createDataFrame(rows, kinds))).where("doc_id is null or doc_id < 0")
    assert of(kept) == sorted([(-1, good), (0, good)])


def test_pipeline(spark):
    """Each stage keeps what brute force over its own input keeps."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        if k == 4:
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        assert sorted(docs.columns) == sorted(columns)
        after = {r["doc_id"] for r in docs.collect()}
        if k == 0:
            assert all(len(before[i] or "") < 3 for i in set(before) - after) or len(after) > 0.99 * len(before)
        elif k == 1:
            first = {}
            for i in sorted(before):
                first.setdefault(SPACE.sub(" ", before[i] or ""), i)
            assert after == set(first.values())
        elif k == 2:
            rows = list(before.items())
            assert after == {d for d, _, c in brute_components(rows) if d == c}
        else:
            items = [SPACE.sub(" ", lower(r["text"])).strip(" ") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(x in SPACE.sub(" ", lower(before[i])) for i in after for x in items)
