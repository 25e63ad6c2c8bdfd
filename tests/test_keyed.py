"""The search by keys against plain loops, and against the search of classes."""

from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cadenza.functions import vocab
from cadenza.operators import folds, keyed
from cadenza.operators.nearest import MultiFactor
from cadenza.plans import scoring, sequences
from tests.compare import compare, duck
from tests.test_bounded import brute, side
from tests.test_findings_r03 import tables_with

SMALL = "/root/testdata/sf0.001"
MULTI = MultiFactor(vocab.SCORE_WEIGHTS), ["tempo_lo", "tempo_hi", "energy_rank", "difficulty_rank"]
READ = ["tempo", "energy_rank", "difficulty_rank"]


def shared_sides(rng, n_left, n_right, n_keys):
    """Rows that share a few vectors, some of them equal; attributes of the right side repeat."""
    left, right = side(rng, n_left, "req"), side(rng, n_right, "item")
    base = np.stack(right.vec)[n_right // 3 - 3: n_right // 3 - 3 + n_keys]
    left["key"], right["key"] = np.where(np.arange(n_left) < n_left // 2, 2, rng.integers(0, n_keys, n_left)), rng.integers(0, n_keys, n_right)
    for d in (left, right):
        d["vec"] = [base[i] for i in d.key]
    return left, right, base


@pytest.mark.parametrize("group", [None, "kind"])
@pytest.mark.parametrize("banning", [False, True])
@pytest.mark.parametrize("small", [False, True])
def test_tiles_equal_loops(monkeypatch, group, banning, small):
    """One key looked at first, steps of few scores, no table of classes: the rows of all pairs."""
    if small:
        for name, value in (("FIRST", 0.01), ("SCORES", 50), ("KEYS", 3), ("TABLE", 1)):
            monkeypatch.setattr(keyed, name, value)
    rng = np.random.default_rng(5)
    left, right, base = shared_sides(rng, 70, 300, 25)
    used = [(i, j) for i in range(70) for j in range(300) if (i * j + i) % 3 == 0 or i == 7] if banning else []
    like = keyed.Cosine()
    m = like.ready(base)
    cols = [{c: d[c].to_numpy() for c in names} for d, names in ((left, READ), (right, ["item", "kind", *MULTI[1]]))]
    found = keyed.best_of_keys(m, left.key.to_numpy(), cols[0], m, right.key.to_numpy(), cols[1], "item", 6, like, *MULTI, group=group,
                               used=tuple(np.array(used).T) if banning else None)
    got, at = set(), {}
    for rows in found:
        for i, j in zip(rows[0].tolist(), rows[1].tolist()):
            place = (i, right.kind[j] if group else 0)
            at[place] = at.get(place, 0) + 1
            got.add((i, j, at[place]))
    assert got == brute(left, right, MULTI[0], 6, group, frozenset(used))


@pytest.mark.parametrize("group", [None, "kind"])
@pytest.mark.parametrize("excluding", [False, True])
def test_blocks_equal_loops(spark, group, excluding):
    """Blocks of a few keys and rows: a key with many requests is split, rows of unknown keys are left out."""
    rng = np.random.default_rng(8)
    left, right, base = shared_sides(rng, 80, 200, 9)
    used = [(i, j) for i in range(80) for j in range(200) if (i * j + i) % 3 == 0] + [(999, 1), (1, 999), (2, 2), (2, 2)] if excluding else []
    keys = spark.createDataFrame([(i, [float(x) for x in base[i]]) for i in range(9)], "key long, feat array<double>")
    asked = spark.createDataFrame(left[["req", "key", *READ]])
    asked = asked.unionByName(asked.limit(1).selectExpr("500L as req", "99L as key", *READ)).withColumn("told", F.col("req") * 3)
    rows = spark.createDataFrame(right[["item", "key", "kind", *MULTI[1]]]).withColumn("more", F.col("item") + 0.5)
    exclude = spark.createDataFrame(used, "req long, item long") if excluding else None
    best = keyed.keyed_best(asked, rows, keys, keys, "req", "item", 6, keyed.Cosine(), *MULTI, (81, 200, 9), group=group, exclude=exclude,
                            carry=("more",), keep=("told",), rows_left=16, keys_right=4)
    flat = best.select("*", F.posexplode("best").alias("at", "x")).collect()
    assert {(r.req, r.x.item, r.at + 1) for r in flat} == brute(left, right, MULTI[0], 6, group, frozenset(used))
    assert all(r.told == 3 * r.req and r.x.more == r.x.item + 0.5 for r in flat)
    assert len(flat) == len({(r.req, r.x.item) for r in flat})


#: Items of 400 vectors, twenty of each, and 2,000 requests.
MANY = dict(
    part="select p.* replace (p_partkey + i * 200 as p_partkey, (1 + (p_partkey * 7 + i) % 50)::int as p_size) from part p, range(0, 40) r(i)",
    customer="select c.* replace (c_custkey + i * 150 as c_custkey) from customer c, range(0, 14) r(i)",
    embeddings="select i::bigint as vec_id, [(random() - 0.5)::float for j in range(64)] as embedding, 0::int as label from (select setseed(0.5)), range(0, 400) r(i)")


@pytest.fixture(scope="module")
def many(tmp_path_factory):
    return tables_with(tmp_path_factory.mktemp("many"), **MANY)


def shuffled(spark, df):
    """MB that a query writes for shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def written():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6

    before = written()
    rows = df().count()
    return written() - before, rows


@pytest.mark.parametrize("name, per", [("top1_best_items", 5), ("jon1_batch_scores", 10)])
def test_vectors_travel_once(spark, many, name, per):
    """a vector goes to a block once, not with each class of its items."""
    mb, rows = shuffled(spark, lambda: entry.queries()[name](spark, many))
    assert rows == per * 2100 and mb < 2


def test_lists_equal_the_search_of_classes(spark, many):
    got = keyed.as_rows(scoring.best_lists(spark, many, 7), "item_id").select("req_id", "item_id", "score", "rank")
    want = scoring.best_items(spark, many, 7)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lists_stay_in_their_rows(spark, many):
    """Candidates carry the attributes of their items, so nothing is joined or gathered after the search."""
    for name in ("top7_category_capped", "top7_category_capped_sampled", "seq1_transition_greedy", "seq2_section_greedy", "seq3_per_step_lists"):
        plan = entry.queries()[name](spark, many)._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "collect_list" not in plan, name
    items = {r.item_id: r for r in sequences.b.items(spark, many).collect()}
    for r in sequences.lists(spark, many, 4).where("req_id % 100 = 0").collect():
        for c in r.cands:
            i = items[c.item_id]
            assert (c.label, c.energy, c.difficulty, c.duration) == (i.label, i.energy, i.difficulty, i.duration)


def test_balanced_picks_on_arrays(spark, many):
    """the picks of the column form, also of short lists."""
    base = sequences.lists(spark, many, 15).where("req_id % 3 = 0").withColumn("cands", F.slice("cands", 1, F.when(F.col("req_id") % 5 == 0, 2).otherwise(15)))
    steps = (8 + F.col("req_id") % 9).cast("int")
    got = folds.with_picks(base, partial(folds.usage_balanced_places, seed=7), ["item_id", "rank", "score"], ["kind"], {"key": F.col("req_id"), "steps": steps})
    rows = got.withColumn("want", folds.usage_balanced(F.col("cands"), F.col("req_id"), steps, 7)).collect()
    assert len(rows) == 700 and all(r.picked == r.want for r in rows)
    assert "aggregate" not in entry.queries()["top15_usage_balanced_pick"](spark, many)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["agg19_transition_summary", "jon3_best_transitions", "flt2_filtered_knn"])
def test_blocks_equal_sql(spark, many, monkeypatch, name):
    """several blocks of vectors and of rows."""
    monkeypatch.setattr(keyed, "KEYS_RIGHT", 150)
    monkeypatch.setattr(keyed, "ROWS_LEFT", 1000)
    sql = entry.oracle_sql()[name]
    if name != "agg19_transition_summary":  # the rest would be hundreds of millions of scores
        sql = sql.replace("from motion a", "from (select * from motion where item_id % 40 = 0) a").replace("from request_vectors r,", "from (select * from request_vectors where req_id % 40 = 0) r,")
        key = "item_id" if name.startswith("jon3") else "req_id"
        got = entry.queries()[name](spark, many).where(F.col(key) % 40 == 0)
    else:
        got = entry.queries()[name](spark, many)
    assert compare(got, duck(many), sql) is None


@pytest.fixture(scope="module")
def wide(tmp_path_factory):
    """Items that hardly share a vector."""
    return tables_with(tmp_path_factory.mktemp("wide"), **MANY | {"embeddings": MANY["embeddings"].replace("range(0, 400)", "range(0, 4000)")})


def test_pairs_of_vectors_travel_once(spark, many, wide):
    """the features of a vector go to a block once, not with each class of its items, and blocks are few."""
    mb, rows = shuffled(spark, lambda: entry.queries()["flt2_filtered_knn"](spark, many))
    assert rows == 10500 and mb < 1.5
    mb, rows = shuffled(spark, lambda: entry.queries()["agg19_transition_summary"](spark, wide))
    assert rows == 1 and mb < 3
