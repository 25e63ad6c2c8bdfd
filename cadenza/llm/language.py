"""Language ID by Bayesian evidence fusion.

Four kinds of evidence meet in one log posterior: the text (byte trigrams, naive Bayes, tempered because trigrams
overlap), the language that the markup declares, the suffix of the address, and the host. What a suffix, domain or host
says is a prior learned without labels: the text posteriors of its rows are summed by grouped aggregation, and each
level is smoothed towards its parent (all rows, suffix, domain, host). How far a declaration is to be believed is
learned the same way, from how often it agrees with the text.

The trigram table is fitted on a bounded sample of labelled rows (`SAMPLE`); everything else reads all rows. Texts do
not shuffle: the evidence of a row, a few numbers, does. Sums are partial before they shuffle, and a hot host only makes
its side of a join longer, which Spark may split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm import bytesets as B
from cadenza.llm.cells import CUT, cut, merged
from cadenza.llm.shared import ROW, numbered, staged

#: Labelled rows, at most, that the trigram table is fitted on, and languages at most.
SAMPLE = 6000
LANGUAGES = 64
GRAMS = 1 << 16
TEMPER = 0.2
#: Rows that a parent level counts for when it smooths a child.
STRENGTH = 20.0
#: Largest posterior that still counts as undecided.
UNDECIDED = 0.5
#: Standard errors that a text's likelihood may fall short of the floor; overlapping trigrams count as a third.
SLACK = 3.0


def _grams(data: np.ndarray) -> np.ndarray:
    low = B._LOWER[data].astype(np.uint32)
    code = low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(16)).astype(np.int64)


def _gram_bounds(offsets: np.ndarray) -> np.ndarray:
    """End of the trigrams of each text; its separator is no part of one."""
    return np.maximum(offsets[1:] - 3, offsets[:-1])


def _count(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(languages) * GRAMS, dtype=np.int32)
        for batch in batches:
            which = [languages.index(x) for x in batch["lang"].to_pylist()]
            for i, j, data, offsets in B.slices(batch["t"]):
                if len(data) < 3:
                    continue
                grams, ends = _grams(data), _gram_bounds(offsets)
                for d in range(j - i):
                    own = grams[offsets[d]: ends[d]]
                    table[which[i + d] * GRAMS: (which[i + d] + 1) * GRAMS] += np.bincount(own, minlength=GRAMS).astype(np.int32)
        yield from cut(table)
    return run


def fit(docs: DataFrame, lang: str = "lang", sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Languages and log probability of each trigram in each, from at most `sample` labelled rows."""
    labelled = docs.where(F.col(lang).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(lang).alias("lang"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", F.col(lang).alias("lang"), B.closed_text("text").alias("t")).join(
        F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").where("lang is not null")
    common = chosen.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    languages = sorted(r["lang"] for r in common)
    if not languages:
        return ["und"], np.zeros((GRAMS, 1), dtype=np.float32)
    rows = rows.where(F.col("lang").isin(languages))
    counts = merged(rows.mapInArrow(_count(languages), CUT), len(languages) * GRAMS).reshape(len(languages), GRAMS).astype(np.float64)
    prob = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * GRAMS)
    return languages, np.ascontiguousarray(np.log(prob).T.astype(np.float32))


def floors(logp: np.ndarray) -> tuple[list[float], list[float]]:
    """For each language, the least log likelihood a trigram of its text, and the standard error of one trigram.

    Both come from the fitted table. The floor is halfway between what a language's own labelled text has under its table
    and what the nearest other text has: that of another labelled language, or trigrams drawn evenly.
    """
    prob = np.exp(logp.astype(np.float64))
    seen = np.maximum(prob - prob.min(axis=0) * (1 + 1e-5), 0.0)
    if not (seen.sum(axis=0) > 0).all():
        return [-1e9] * logp.shape[1], [0.0] * logp.shape[1]
    seen = np.concatenate([seen / seen.sum(axis=0), np.full((len(seen), 1), 1 / len(seen))], axis=1)
    cross = seen.T @ logp.astype(np.float64)
    n = logp.shape[1]
    own = np.diag(cross[:n])
    other = np.where(np.eye(n + 1, n, dtype=bool), -np.inf, cross).max(axis=0)
    spread = np.sqrt(3 * np.maximum([seen[:, k] @ (logp[:, k].astype(np.float64) - own[k]) ** 2 for k in range(n)], 0.0))
    return ((own + other) / 2).tolist(), spread.tolist()


def _likelihood(table):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logp = table.value
        for batch in batches:
            for i, j, data, offsets in B.slices(batch["t"], 1 << 20):
                ends = _gram_bounds(offsets)
                sums = np.zeros((max(len(data) - 1, 1), logp.shape[1]))
                if len(data) >= 3:
                    np.cumsum(logp[_grams(data)], axis=0, dtype=np.float64, out=sums[1:])
                last = len(sums) - 1
                ll = sums[np.minimum(ends, last)] - sums[np.minimum(offsets[:-1], last)]
                flat = pa.FixedSizeListArray.from_arrays(pa.array(ll.ravel()), logp.shape[1]).cast(pa.list_(pa.float64()))
                rest = [batch[k].slice(i, j - i) for k in KEYS]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(ends - offsets[:-1]), flat], names=[*KEYS, "n_grams", "ll"])
    return run


KEYS = ["id", "declared", "suffix", "domain", "host"]


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    exps = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(exps, lambda x: x / F.aggregate(exps, F.lit(0.0), lambda a, b: a + b))


def _sums(n: int, of: str) -> list[Column]:
    return [F.sum(F.element_at(of, k + 1)).alias(f"c{k}") for k in range(n)]


def _smoothed(counts: DataFrame, parent: DataFrame, n: int, key: list[str]) -> DataFrame:
    """Counts c0.. by key, pulled towards the parent's shares p0.. by STRENGTH rows."""
    whole = sum((F.col(f"c{k}") for k in range(n)), F.lit(0.0))
    shares = [((F.col(f"c{k}") + STRENGTH * F.col(f"p{k}")) / (whole + STRENGTH)).alias(f"p{k}") for k in range(n)]
    return counts.join(parent, key[:-1]).select(*key, *shares)


def fuse(evidence: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """(id, lang, confidence, n_grams, accepted, text_lang) from the staged evidence of all rows."""
    languages = model[0]
    n = len(languages)
    rows = evidence.withColumn("alone", _softmax(F.transform("ll", lambda x: x * TEMPER)))
    told = rows.where("n_grams > 0")
    hosts = told.groupBy("suffix", "domain", "host").agg(*_sums(n, "alone"))
    again = [F.sum(f"c{k}").alias(f"c{k}") for k in range(n)]
    domains = hosts.groupBy("suffix", "domain").agg(*again)
    suffixes = domains.groupBy("suffix").agg(*again)
    # One row: the shares of all rows, each language with one row to begin with.
    first = suffixes.agg(*again).first()
    total = [float(x or 0) + 1.0 for x in first]
    whole = {k: x / sum(total) for k, x in enumerate(total)}
    mass = sum((F.col(f"c{k}") for k in range(n)), F.lit(0.0))
    at_suffix = suffixes.select("suffix", *[((F.col(f"c{k}") + STRENGTH * whole[k]) / (mass + STRENGTH)).alias(f"p{k}") for k in range(n)])
    at_domain = _smoothed(domains, at_suffix, n, ["suffix", "domain"])
    at_host = _smoothed(hosts, at_domain, n, ["suffix", "domain", "host"])
    prior = at_host.select("suffix", "domain", "host", F.array(*[F.log(F.col(f"p{k}")) for k in range(n)]).alias("prior"))
    # How often each language is declared as each: at most LANGUAGES + 1 kinds of declaration.
    known = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull() & (F.col("declared") != ""), F.lit("other"))
    rows = rows.withColumn("said", known)
    agree = {r["said"]: [r[f"c{k}"] or 0.0 for k in range(n)] for r in rows.where("said is not null and n_grams > 0").groupBy("said").agg(*_sums(n, "alone")).collect()}
    spoken = [sum(x[k] for x in agree.values()) for k in range(n)]
    kinds = len(agree) + 1
    belief = {s: [float(np.log((x[k] + 1.0) / (spoken[k] + kinds))) for k in range(n)] for s, x in agree.items()}
    markup = F.array(*[F.lit(0.0)] * n)
    for s, x in belief.items():
        markup = F.when(F.col("said") == s, F.array(*map(F.lit, x))).otherwise(markup)
    flat = F.array(*[F.lit(float(np.log(whole[k]))) for k in range(n)])
    met = rows.join(prior, ["suffix", "domain", "host"], "left").withColumn("prior", F.coalesce("prior", flat)).withColumn("markup", markup)
    logs = F.transform(F.arrays_zip("ll", "prior", "markup"), lambda x: x["ll"] * TEMPER + x["prior"] + x["markup"])
    post = met.withColumn("posterior", _softmax(logs))
    names = F.array(*map(F.lit, languages))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    floor, spread = (F.array(*map(F.lit, x)) for x in floors(model[1]))
    place = F.array_position("posterior", F.array_max("posterior")).cast("int")
    at = lambda c: F.element_at(c, place)
    like = at(F.col("ll")) >= F.col("n_grams") * at(floor) - SLACK * F.sqrt("n_grams") * at(spread)
    return post.select(
        "id", best(F.col("posterior")).alias("lang"), F.array_max("posterior").alias("confidence"), "n_grams",
        ((F.col("n_grams") > 0) & (F.array_max("posterior") > UNDECIDED) & like).alias("accepted"), F.when(F.col("n_grams") > 0, best(F.col("alone"))).alias("text_lang"))


def evidence_of(rows: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Likelihoods of `rows` (id, text, declared, suffix, domain, host), written to the shared folder."""
    table = rows.sparkSession.sparkContext.broadcast(model[1])
    keyed = rows.select(F.col("id").cast("long").alias("id"), *[F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in KEYS[1:]], B.closed_text("text").alias("t"))
    kinds = ", ".join(["id long", *[f"{k} string" for k in KEYS[1:]], "n_grams long", "ll array<double>"])
    return staged(keyed.mapInArrow(_likelihood(table), kinds), "evidence")


def languages_of_documents(docs: DataFrame, model: tuple[list[str], np.ndarray] | None = None) -> DataFrame:
    """(id, lang, confidence, n_grams, accepted, text_lang), one row per row of `docs`; the source is the host.

    A text without trigrams (null, empty, under three bytes) has no evidence of its own: it gets the language of its
    source and is not accepted; nor is one whose best posterior is at most a half, or whose text is less like its language
    than `floors` asks, as text of a language outside the labels is. Repeated rows, null ids and null
    sources are rows like any other. An empty table gives an empty result; without labelled rows every text is `und`.
    Other columns are ignored, whatever their names.
    """
    model = model or fit(docs)
    rows = docs.select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("declared"), F.lit("").alias("suffix"), F.lit("").alias("domain"), F.col("source").alias("host"))
    return fuse(evidence_of(rows, model), model)


def languages_of_pages(pages: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """The same for (page_id, url, html): text is what stands outside tags, scripts and styles."""
    html = F.coalesce(F.col("html"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"<[^>]*>", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rows = pages.select(
        F.col("page_id").alias("id"), F.regexp_replace(bare, r"&[A-Za-z#0-9]+;", " ").alias("text"),
        F.lower(F.regexp_extract(html, r"(?i)<html[^>]*\blang\s*=\s*[\"']?([A-Za-z]+)", 1)).alias("declared"),
        F.substring_index(host, ".", -1).alias("suffix"), F.substring_index(host, ".", -2).alias("domain"), host.alias("host"))
    return fuse(evidence_of(rows, model), model)


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of `docs` whose language is accepted, each by its own text, whatever its id; columns as before."""
    rows = numbered(docs)
    found = languages_of_documents(rows.select(F.col(ROW).alias("doc_id"), "text", "source"), fit(rows))
    gone = found.where("not accepted").select(F.col("id").alias(ROW))
    return rows.join(gone, ROW, "left_anti").select(*docs.columns)
