"""Rows that expressions make of small files are joined by shuffling, never sent to every executor."""

import re

import pytest

from plumbline.plans import QUERIES

SF = "/root/testdata/sf0.001"


def broadcast_keys(df):
    """Left keys of the joins that send one side to every executor."""
    return set(re.findall(r"BroadcastHashJoin \[(.*?)\]", df._jdf.queryExecution().sparkPlan().toString()))


@pytest.mark.parametrize("name", ["view_cut_pipeline", "view_emission", "signed_volume", "inverted_closed_mesh"])
def test_only_the_table_of_views_is_broadcast(spark, name):
    assert not [k for k in broadcast_keys(QUERIES[name](spark, SF)) if "object_id" in k]


def test_edges_of_long_rings_meet_by_shuffling(spark):
    from pyspark.sql import functions as F

    from plumbline.operators.checks import check_polygon_ring

    at = lambda i: F.array(F.cos(i * 0.1), F.sin(i * 0.1), F.lit(0.0))
    rings = spark.range(3).select(F.col("id").alias("polygon_id"), F.transform(F.sequence(F.lit(0), F.lit(60)), at).alias("vertices"))
    found = check_polygon_ring(rings)
    assert not [k for k in broadcast_keys(found) if "__ring_id" in k]
    assert found.isEmpty()


def test_no_round_of_a_closure_broadcasts_its_links(spark, monkeypatch):
    from plumbline.operators import hierarchy

    plans, cut = [], hierarchy.cut_lineage
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df: plans.append(broadcast_keys(df)) or cut(df))
    assert not broadcast_keys(QUERIES["renderable_objects"](spark, SF))
    assert len(plans) >= 3 and not any(plans)
