"""Readers and writers on small fixtures."""

import json

from cadenza.session import scratch_path
from cadenza.sources import catalogue as cat
from cadenza.sources import tables as tb

HEADER = ",".join(cat.COLUMNS)


def test_csv_cleansing(spark, tmp_path):
    (tmp_path / "a.csv").write_text(
        HEADER + "\n"
        'c1,v1,dip,high,135.0,advanced,both,some notes,9.5,,nan,YES,none,150,"dip, basic_step ,",ann,2024-01-01\n'
        "c2,v2,dip,high,fast,advanced,both,x,abc,good,good,0,,,,,\n"
        "c3,v3,dip,NaN,120,advanced,both,,7,good,good,true,90,130,,,\n")
    good, bad = cat.read_csv(spark, str(tmp_path))
    r = good.collect()
    assert [x.clip_id for x in r] == ["c1"]
    assert (r[0].estimated_tempo, r[0].tempo_range_min, r[0].tempo_range_max) == (135, None, 150)
    assert r[0].compatible_moves == ["dip", "basic_step"] and r[0].full_body_visible and r[0].lighting_quality == "good"
    assert {x.clip_id: x.missing for x in bad.collect()} == {"c2": ["estimated_tempo"], "c3": ["energy_level"]}


def test_missing_catalogue_is_empty(spark, tmp_path):
    assert cat.read_documents_or_empty(spark, str(tmp_path / "nothing")).count() == 0


def test_one_document(spark, tmp_path):
    doc = {"instructions": "x", "move_categories": ["dip"], "clips": [
        {"clip_id": f"c{i}", "move_label": "dip", "estimated_tempo": 120 + i, "difficulty": "advanced"} for i in range(3)]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=2))
    assert sorted(r.estimated_tempo for r in cat.read_documents(spark, str(tmp_path)).collect()) == [120, 121, 122]


def test_corrupt_metadata_is_skipped(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"sequence_id": "s1", "tempo": 120.0}\n')
    (tmp_path / "b.json").write_text("{broken\n")
    assert [r.sequence_id for r in tb.read_metadata(spark, str(tmp_path)).collect()] == ["s1"]


def test_scratch_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = scratch_path(spark, "x")
    named = named or spark.sparkContext.getCheckpointDir()
    assert path.startswith(named.rstrip("/").replace("file:", "")) or path.startswith("/tmp/spark-")
