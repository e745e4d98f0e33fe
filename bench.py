"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from placeloom.catalog import QUERIES
from placeloom.session import build_session
from placeloom.sources.derived import Tables

HEADLINE = [
    "c2_nearby_pairs", "c3_duplicate_edges", "d7_duplicate_groups", "k2_resolve_duplicates", "c6_candidate_score", "c7_best_candidate",
    "c8_existing_name_address_60m", "c18_mentions", "d12_guard_hash", "e1_top_sources", "e7_free_slots", "e12_gallery", "g2_desired_state",
    "h14_fingerprint", "k1_audit_places", "k8_viewport_query", "b1_viewport", "i1_visit_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("placeloom-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    t = Tables(spark, folder)
    for name in ("places_v", "photos_v", "vision_v", "cands_v", "links_v", "desired_v", "viewports_v", "visits_v", "aliases_v"):
        t(name)  # the place tables are inputs; deriving them is not timed
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        # contrast: the near-pair search as a plain category self-join
        p = t("places_v").select("id", "category", "latitude", "longitude")
        a, b = (p.select(*[F.col(c).alias(x + c) if c != "category" else F.col(c) for c in p.columns]) for x in ("a_", "b_"))
        from placeloom.functions import geo

        start = time.perf_counter()
        d = geo.haversine_m("a_latitude", "a_longitude", "b_latitude", "b_longitude")
        a.join(b, "category").where((F.col("a_id") < F.col("b_id")) & (d <= 60)).write.format("noop").mode("overwrite").save()
        took["contrast_plain_self_join"] = round(time.perf_counter() - start, 3)
    total = round(sum(v for k, v in took.items() if not k.startswith("contrast")), 3)
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).replace("sf", "")}))


if __name__ == "__main__":
    main()
