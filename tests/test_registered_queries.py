"""A sample of the registered queries against DuckDB on the smallest tables, and checks on the registry itself."""

import re

import duckdb
import pytest

from spoorgrid.plans.bindings import BASE_TABLES
from spoorgrid.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
SAMPLE = ("A1_grid_raster A5_two_stage_vote A7_two_level_report A20_ranking_quality D3_hypothesis_choice D10_persistent_override D15_box_linking "
          "J4_truth_patch J5_negative_patches J14_nearest_map_point J19_case_control Q8_best_margin Q10_gate_quality W5_score_blend W9_error_islands "
          "W14_motion_labels").split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    q = REGISTRY[name]
    df = q.build(spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    rel = duck.execute(q.sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall()) and got


def test_names_and_plans(spark):
    assert len(REGISTRY) > 180 and all(re.match(r"^[A-Z]\d+_[a-z0-9_]+$", n) for n in REGISTRY)
    plan = REGISTRY["W1_top_k"].build(spark, SF)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    crop = REGISTRY["P1_box_crop"].build(spark, SF)._jdf.queryExecution().toString()
    assert "l_comment" not in crop and "ReadSchema" in crop
