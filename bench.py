"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "reference_cloud", "eligible_pixels", "unproject", "sample_every_nth_point", "frame_sampling_counts", "confidence_histogram", "residual_stats",
    "join_point_color", "project_to_camera", "polygon_select_pixels", "plane_fit", "nearest_support_polygon", "rigid_fit", "convex_overlap",
    "component_completeness", "inventory_diff", "evidence_closure", "set_identity_hash", "hierarchy_transforms", "edge_use_audit",
    "coplanar_overlap_area", "nearest_vertex_match", "view_cut_pipeline", "shared_edge_match", "raster_counts", "feature_coverage",
    "adjacent_shots", "depth_visibility", "bilinear_sample", "photo_blend", "ceiling_above", "rectangle_fit", "scan_depth",
]


def main() -> None:
    from plumbline.plans import QUERIES
    from plumbline.session import local_session

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "plumbline-bench", partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in ("reference_cloud", "plane_fit"):  # start the workers and warm the table files
        run(name)
    seconds = {}
    for name in names:
        first = run(name)
        # short queries are timed warm; long ones once
        seconds[name] = round(min(first, run(name)) if first < 15 else first, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(sf).name.removeprefix("sf"), "cpus": cpus}), flush=True)


if __name__ == "__main__":
    main()
