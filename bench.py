"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = (
    "building_gap_centroid", "building_gap_intersects", "building_gap_within", "grid_candidate_pairs", "transport_lengths_rect", "transport_lengths_polygon", "transport_gap", "transport_gap_by_class",
    "poi_gap", "composite_score", "region_describe", "null_profile", "disparity_ratio", "county_leave_one_out", "albers_project", "geodesic_length", "point_in_polygon", "segmentize_roads", "variant_sweep", "road_distance", "transport_gap_projected", "road_coverage_distance",
)


def main() -> None:
    from lacuna.plans.queries import QUERIES
    from lacuna.session import session, timed

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(cpus, memory="8g", partitions=int(cpus))
    QUERIES["value_counts"](spark, sf).collect()  # starts the session
    took = {name: round(seconds, 3) for name, _, seconds in timed((name, lambda name=name: QUERIES[name](spark, sf)) for name in HEADLINE)}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
