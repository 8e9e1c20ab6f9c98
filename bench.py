"""Timed headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the local cores.
Each query is run to the end with a no-op sink; the session is warmed up first.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spoorgrid.plans.catalog import REGISTRY  # noqa: E402
from spoorgrid.session import local_session  # noqa: E402

HEADLINE = """P1_box_crop P2_transform_points P7_distorted_pixel A1_grid_raster A3_patch_cells A4_voxel_first_point A5_two_stage_vote
A11_evidence_mix A6_error_summary A7_two_level_report A10_store_consistency A12_retrieval_quality A14_exposure_trigger A20_ranking_quality
J2_centred_time_window J4_truth_patch J8_radius_stability J9_nearest_future J11_stereo_labels J14_nearest_map_point J15_detector_agreement
J17_neighbourhood_patches J19_case_control J22_raster_correlation W1_top_k W7_ensemble W9_error_islands W10_presence_segments
W11_trailing_streaks W14_motion_labels W18_round_robin D3_hypothesis_choice D8_pose_stabiliser D9_patch_hysteresis D10_persistent_override
Q1_update_safety Q3_rerank_report Q6_error_mechanisms Q8_margin_scan Q11_learning_table Q12_presence_audit""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus), os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["A1_grid_raster"].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        REGISTRY[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_time_headline_queries", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf)}))


if __name__ == "__main__":
    main()
