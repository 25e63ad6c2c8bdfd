"""One small test for each settled finding of FINDINGS_r03.md."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import TABLES, compare, duck

SMALL = "/root/testdata/sf0.001"


def tables_with(folder, **changed: str) -> str:
    """The small tables, some of them replaced by the rows of a DuckDB query."""
    con = duck(SMALL)
    for t in TABLES:
        if t in changed:
            con.execute(f"copy ({changed[t]}) to '{folder}/{t}.parquet' (format parquet)")
        else:
            os.symlink(f"{SMALL}/{t}.parquet", f"{folder}/{t}.parquet")
    return str(folder)


def same(spark, sf, name):
    assert compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name]) is None


def test_prj40_halves(spark, tmp_path):
    """a duration halfway between two whole numbers goes to the even one, as in the SQL."""
    same(spark, tables_with(tmp_path, customer="select * replace (case when c_custkey % 2 = 0 then 9604 else 236 end::double as c_acctbal) from customer"), "prj40_request_validation")


def test_src5_nothing_new(spark, tmp_path):
    """without an appended row there is no sum of places."""
    same(spark, tables_with(tmp_path, part="select * replace (i as p_partkey) from (from part limit 1), range(0, 20000) r(i)"), "src5_append_with_guard")


def test_win26_natural_slots_are_not_capped(spark, tmp_path):
    """as many slots as the target holds, here 120 of half a second; longer sequences span several units."""
    lines = "select * replace (i % 3 as l_orderkey, 1.0::double as l_quantity, i::int as l_linenumber) from (from lineitem limit 1), range(0, 6000) r(i)"
    sf = tables_with(tmp_path, lineitem=lines)
    same(spark, sf, "win26_natural_slots")
    assert entry.queries()["win26_natural_slots"](spark, sf).count() == 3 * 120


#: Items of 20 copies of 40, with the keys shifted, and requests of three copies of ten.
COPIES = dict(
    part="select p.* replace (p_partkey + i * 1000 as p_partkey) from (from part order by p_partkey limit 40) p, range(0, 20) r(i)",
    customer="select c.* replace (c_custkey + i * 1000 as c_custkey) from (from customer order by c_custkey limit 10) c, range(0, 3) r(i)")
COPIED = ["flt2_filtered_knn", "top6_most_similar_items", "top1_best_items", "jon3_best_transitions", "agg19_transition_summary", "jon1_batch_scores",
          "top10_oversampled_recommend", "flt8_categorical_blend", "top4_semantic_search", "top5_tempo_rerank", "prj11_unified_vector", "seq5_end_to_end"]


@pytest.fixture(scope="module")
def copies(tmp_path_factory):
    return tables_with(tmp_path_factory.mktemp("copies"), **COPIES)


@pytest.mark.parametrize("name", COPIED)
def test_copies_equal_sql(spark, copies, name):
    """Classes of many items and requests, with ties that the id decides, against the SQL."""
    same(spark, copies, name)


def test_single_neighbour_positions(spark, tmp_path):
    """a position that one item alone sets does not count for that item itself."""
    same(spark, tables_with(tmp_path, part="from part order by p_partkey limit 7"), "prj11_unified_vector")


@pytest.mark.parametrize("name", ["jon3_best_transitions", "agg19_transition_summary"])
def test_pairs_of_motions(spark, copies, monkeypatch, name):
    """800 items have at most 360 motions, and no more of them reach a cell."""
    from cadenza.operators import bounded, nearest

    seen = []
    for at, fn, place in ((bounded, "_candidates", 7), (nearest, "_cells", 4)):
        def spy(*a, _real=getattr(at, fn), _place=place, **k):
            seen.extend(a[_place])
            return _real(*a, **k)
        monkeypatch.setattr(at, fn, spy)
    entry.queries()[name](spark, copies)
    assert seen and max(seen) <= 360


def test_windows_over_frames_carry_ids_and_not_landmarks(spark):
    """33 landmarks of each frame and of the one before went through the shuffles."""
    plan = entry.queries()["win9_regional_displacement"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and not any("lag(landmarks" in line for line in windows)


def test_frames_of_a_song_lie_in_one_file(spark):
    """so that sums over a song shrink before the shuffle."""
    from cadenza.operators.clip_features import clip_frames
    from cadenza.plans import binding as b

    frames = clip_frames(b.pose_keys(spark, SMALL), b.poses_of_vectors(spark, SMALL), ["user_id"])
    named = frames.select("user_id", F.input_file_name().alias("file")).distinct()
    files = named.groupBy("user_id").count().agg(F.max("count")).first()[0]
    assert files == 1 and "landmarks" not in frames.columns


def test_nearest_vectors_among_copies(spark, tmp_path):
    """top2, agg27 and agg28 search in large cells by tiles; a vector with many copies may stand behind them."""
    sf = tables_with(tmp_path, embeddings="select vec_id + i * 1000 as vec_id, embedding, label from embeddings, range(7) r(i) where vec_id < 60")
    same(spark, sf, "top2_exact_knn")
    same(spark, sf, "agg27_label_purity")


def test_cells_of_a_table_with_itself_go_by_tiles(spark):
    """scores of a whole cell were held at once."""
    from cadenza.operators import nearest

    def few(cos, left, right):
        assert cos.shape[0] <= 256, cos.shape
        return cos

    df = spark.range(3000).select("id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.sin(F.col("id") * (i + 1.0))).alias("vec"))
    whole = nearest.block_stats(df, "id", scorer=few, sizes=(3000, 3000)).first()
    assert whole["n"] == 3000 * 2999 // 2
    assert nearest.block_pairs(df, "id", 0.99, scorer=few, size=3000).where("a >= b").count() == 0


def test_cosines_of_pairs_in_cells(spark):
    """pairs go to cells of two blocks of vectors and carry none themselves."""
    import numpy as np

    from cadenza.operators.paired import with_cosines

    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 8))
    m[5] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(40, None)]
    vecs = spark.createDataFrame(rows, "vec_id long, vec array<double>")
    ids = rng.integers(0, 43, size=(500, 2))
    given = [(n, int(i), int(j)) for n, (i, j) in enumerate(ids)] + [(500, 3, None)]
    pairs = spark.createDataFrame(given, "n long, a long, b long")
    got = {r["n"]: r for r in with_cosines(pairs, 501, vecs, 41, "a", "b", {"whole": (0, 8), "rest": (3, 5)}, block=11, cell_pairs=10).collect()}
    assert set(got) == {n for n, i, j in given if j is not None and max(i, j) <= 40}
    for n, r in got.items():
        if {r["a"], r["b"]} & {5, 40}:
            assert r["whole"] is None and r["rest"] is None
            continue
        for name, x, y in (("whole", m[r["a"]], m[r["b"]]), ("rest", m[r["a"]][3:], m[r["b"]][3:])):
            assert r[name] == pytest.approx(x @ y / np.linalg.norm(x) / np.linalg.norm(y), abs=1e-12)
    plan = entry.queries()["prj15_rescaled_similarity"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan


def test_query_vectors_of_equal_requests(spark):
    """F32: prj12 built the vector of every request; requests are now brought to classes first."""
    plan = entry.queries()["prj12_query_vector"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "min(req_id" in plan
    same(spark, SMALL, "prj12_query_vector")
