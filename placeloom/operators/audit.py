"""Record audit and report counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placeloom.functions import geo, rules
from placeloom.operators.duplicates import exact_duplicates


def findings(places: DataFrame) -> DataFrame:
    """One row per place and audit code; a column expression, no shuffle."""
    rows = places.select("id", "name", "category", "address", F.explode(rules.record_issues()).alias("issue"))
    return rows.withColumn("duplicate_of", F.lit(None).cast("string"))


def audit_places(places: DataFrame) -> DataFrame:
    """Record findings plus duplicate_place findings with the name of the first record."""
    dup = exact_duplicates(places).select("id", "name", "category", "address", F.lit("duplicate_place").alias("issue"), "duplicate_of")
    return findings(places).unionByName(dup)


def issue_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category", "issue").agg(F.count(F.lit(1)).alias("findings"))


def status_counts(results: DataFrame, statuses: list[str], open_status: str = "open") -> DataFrame:
    return results.agg(
        F.count_if(F.col("status") != open_status).alias("completed"), F.count_if(F.col("status") == open_status).alias("remaining"),
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def field_coverage(places: DataFrame) -> DataFrame:
    """Filled fields per category and city, with subtotals."""
    rows = places.withColumn("city", geo.city_of_address("address"))
    return rows.rollup("category", "city").agg(
        F.count(F.lit(1)).alias("places"), F.count_if(F.col("hours") != "").alias("with_hours"),
        F.count_if(F.col("description") != "").alias("with_description"), F.count_if(F.col("photo_count") > 0).alias("with_photos"))


def reason_counts(decisions: DataFrame) -> DataFrame:
    """Photos and places per reason; two-step count keeps one popular reason off a single task."""
    per_place = decisions.groupBy("reason", "place_id").agg(F.count(F.lit(1)).alias("n"))
    return per_place.groupBy("reason").agg(F.sum("n").alias("photos"), F.count(F.lit(1)).alias("places"))


def evidence_coverage(places: DataFrame, with_evidence: DataFrame) -> DataFrame:
    j = places.select("id", "category").join(with_evidence.withColumn("found", F.lit(True)), "id", "left")
    return j.groupBy("category").agg(F.count(F.lit(1)).alias("places"), F.count_if(F.col("found")).alias("with_evidence"))


def visit_options(visits: DataFrame) -> DataFrame:
    """Distinct locations and visitors with the label of the latest visit."""
    at = F.struct("created_at", "id")
    place = F.concat_ws(" ", *[F.nullif(F.col(c), F.lit("")) for c in ("province", "city", "district")])
    loc = visits.groupBy(F.concat_ws("|", "province", "city", "district").alias("value")).agg(F.max_by(place, at).alias("label"))
    who = F.when(F.col("visitor_name") != "", F.col("visitor_name")).otherwise(F.col("visitor_code"))
    vis = visits.where("visitor_code <> ''").groupBy(F.col("visitor_code").alias("value")).agg(F.max_by(who, at).alias("label"))
    return loc.select(F.lit("location").alias("kind"), "value", "label").unionByName(vis.select(F.lit("visitor").alias("kind"), "value", "label"))
