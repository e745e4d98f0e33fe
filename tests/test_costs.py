"""What a plan must not do: write a growing table in a fixed number of tasks, or compute a costly score twice."""

import pytest
from pyspark.sql import functions as F

from placeloom.catalog import QUERIES
from placeloom.sources import derived
from placeloom.sources.derived import Tables

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_stored_files_follow_rows(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    monkeypatch.setattr(derived, "FILE_ROWS", 5)
    assert Tables(spark, str(tmp_path))("viewports_v").inputFiles().__len__() == 20


def test_hours_alone(spark):
    assert "插座" not in plan(spark, "h17_extraction")  # no search for facilities where only hours are asked for


def test_note_score_not_in_filter(spark):
    lowest = plan(spark, "e11_newest_evidence").rsplit("Filter (", 1)[1]
    assert "published" in lowest and "regexp" not in lowest


def test_door_of_address_searched_once(spark):
    doors = "([^区县,，。；;]{1,30}"
    whole = plan(spark, "h16_note_scores")
    assert whole.count(doors) == whole.count("^" + doors) * 2  # every search with its split of the match, and no others


@pytest.mark.parametrize("name", ["h16_source_scores", "k6_rank_sources"])
def test_place_names_keyed_before_the_join(spark, name):
    text = plan(spark, name)
    joined, below = text[:text.index("Join Inner")], text[text.index("Join Inner"):]
    assert "[（(].*?[）)]" not in joined and "[（(].*?[）)]" in below


def test_url_parsed_once(spark):
    text = plan(spark, "k6_rank_sources")
    assert text[text.index("Join Inner"):].count("(?s)^(?:([^:/?#]+):)?") == 1


def test_scores_stay_out_of_join_conditions(spark):
    joins = [line for line in plan(spark, "g4_duplicates").split("\n") if "- Join " in line]
    assert joins and not any("regexp" in line for line in joins)


def test_reconcile_scores_once(spark):
    # the scores are stored, so the plan that reads them holds no scan of the candidates
    assert "cand_no" in plan(spark, "c17_address_reconcile") and Tables(spark, FOLDER).path("cands_v") not in plan_files(spark, "c17_address_reconcile")


def plan_files(spark, name):
    return " ".join(QUERIES[name](spark, FOLDER).inputFiles())


def test_snapshots_meet_no_place_of_every_viewport(spark, monkeypatch):
    from placeloom.operators import grid

    def refuse(*a, **k):
        raise AssertionError("all places of all viewports")

    monkeypatch.setattr(grid, "points_in_boxes", refuse)
    assert QUERIES["g3_snapshot_merge"](spark, FOLDER).count() > 0


def test_snapshot_stream_takes_each_newest_answer(spark, tmp_path):
    """Forty snapshots over all places: two answers a place enter the stream, not forty times two thirds of them."""
    from placeloom.catalog.tables import snapshot_parts

    spark.range(90).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("6700 + id * 9900 AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    t = Tables(spark, str(tmp_path))
    base, snaps, half, rows = snapshot_parts(t)
    p, met = t("places_v"), snaps.withColumn("late", F.col("seq") > half)
    inside = F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east"))
    answers = p.crossJoin(met).where(inside & (F.col("k") % 3 != F.col("seq") % 3))
    want = answers.groupBy("id", "late").agg(F.max("seq").alias("seq")).select("id", "seq").collect()
    assert answers.count() > 2 * len(want) and sorted(rows.select("id", "seq").collect()) == sorted(want)
