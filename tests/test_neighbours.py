"""Sums over neighbours against the listed edges of the same nodes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions.vocabulary import ACTOR_CLASSES
from roadweave.operators import exports, gcn, gcn_tables, graphs, neighbours, subgraphs, temporal

KEY = ["frame_id"]


@pytest.fixture(scope="module")
def nodes(spark):
    """Three frames in two videos: crowded spots, equal places, places on whole numbers (distances equal to radii), negative ones, a lonely actor."""
    rng = random.Random(3)
    rows = [(f"v{f % 2}", f, i, rng.choice([*ACTOR_CLASSES, "sled"]), rng.choice([rng.uniform(-40, 40), float(rng.randint(-9, 9)), 27.0]), float(rng.randint(-6, 6)), rng.uniform(-3, 3), 0.5) for f in range(3) for i in range(120)]
    rows.append(("v0", 0, 999, "car", 1e6, 1e6, 0.0, 0.0))
    actors = spark.createDataFrame(rows, "video_id string, frame_id int, track_id long, actor_class string, x_m double, y_m double, vx double, vy double")
    return graphs.build_nodes(actors, KEY).join(actors.select("frame_id", "video_id").distinct(), "frame_id").cache()


@pytest.mark.parametrize("max_home", [16_384, 5])
@pytest.mark.parametrize("config", [graphs.GraphConfig(), graphs.GraphConfig(use_class_specific_radii=False, radius=5.0)])
def test_degrees_and_sums_are_those_of_the_edges(nodes, config, max_home):
    edges = graphs.build_edges(nodes, KEY, config)
    want = {(r[0], r[1]): (r[2], r[3]) for r in edges.groupBy("frame_id", "src").agg(F.count("*"), F.sum("dst")).collect()}
    got = neighbours.neighbour_sums(nodes.withColumn("v", F.array(F.col("node_id").cast("double"), F.lit(1.0))), KEY, config, "v", 2, max_home).collect()
    assert len(got) == nodes.count() and all(r.own[0] == r.node_id for r in got)
    assert {(r.frame_id, r.node_id): (r.degree, r.sums[0]) for r in got if r.degree} == want
    assert all(r.sums[1] == r.degree for r in got)


def test_squares_decide_as_roots():
    for r in (1e-8, 2.0, 3.5, 6.0, 0.1, 7.3):
        t = neighbours.most_square(r)
        assert np.sqrt(t) <= r < np.sqrt(np.nextafter(t, np.inf))


def test_validation_without_edges(spark, nodes):
    """also where an edge has an infinite channel, and for a graph without edges."""
    bad = nodes.withColumn("vx", F.when((F.col("frame_id") == 1) & (F.col("node_id") < 60), 1.7e308).when(F.col("frame_id") == 1, -1.7e308).otherwise(F.col("vx")))
    alone = nodes.where("frame_id = 2").orderBy("node_id").limit(1)
    for table in (nodes, bad, alone):
        want = sorted(graphs.validate_graphs(table, graphs.build_edges(table, KEY), KEY).collect())
        assert sorted(neighbours.validate_graphs(table, KEY).collect()) == want
    assert not {r.frame_id: r.finite_edge_features for r in neighbours.validate_graphs(bad, KEY).collect()}[1]
    again = exports.regraph_nodes(graphs.nested_nodes(nodes, KEY), KEY)
    assert sorted(again.drop("track_id").select("frame_id", "node_id", "x", "vx").collect()) == sorted(nodes.select("frame_id", "node_id", "x", "vx").collect())


@pytest.mark.parametrize("isolated", [True, False])
def test_subgraphs_without_edges(nodes, isolated):
    """F21, F28."""
    keep = F.col("class_index").isin(0, 4, 5)
    n, e = subgraphs.subgraph_by_mask(nodes, graphs.build_edges(nodes, KEY), KEY, keep, isolated)
    want = {(r[0], r[1]): 0 for r in n.select("frame_id", "node_id").collect()} | {(r[0], r[1]): r[2] for r in e.groupBy("frame_id", "src").agg(F.count("*")).collect()}
    got = subgraphs.subgraph_degrees(nodes, KEY, keep, keep_isolated_nodes=isolated)
    assert {(r.frame_id, r.node_id): r.degree for r in got.collect()} == want


def test_window_sums_without_edges(nodes):
    """F32."""
    key = ["video_id", "frame_id"]
    _, edges = temporal.window_graphs(nodes, graphs.build_edges(nodes, key), window_size=2)
    want = edges.groupBy("video_id", "window_index", "edge_type").agg(F.count("*"), F.sum("src"), F.sum("dst"))
    assert sorted(temporal.window_edge_sums(nodes, window_size=2).collect()) == sorted(want.collect())


@pytest.mark.parametrize("pool", gcn.POOLS)
def test_model_without_edges(nodes, pool):
    """F7, F8, F9: logits, gradients and counts as by the table of edges."""
    model = gcn.GCNModel(3, 4, 2, pool)
    rows = nodes.select("frame_id", "node_id", "x", "y", "actor_class", F.array(F.col("x") / 40, F.col("y") / 6, "size_prior").alias("features"))
    labels, edges = nodes.groupBy("frame_id").agg((F.max("frame_id") % 2).alias("label")), graphs.build_edges(nodes, KEY)
    places, listed = gcn_tables.prepare_places(rows, KEY, labels), gcn_tables.prepare(rows, edges, labels, KEY)
    (one, n1), (two, n2) = gcn_tables.gradients(places, model), gcn_tables.gradients(listed, model)
    assert np.allclose(n1, n2) and all(np.allclose(a, b) for a, b in zip(one, two))
    got, want = dict(gcn_tables.forward(places, model).collect()), dict(gcn.forward(rows, edges, KEY, model).collect())
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


@pytest.mark.parametrize("size", [3, 4096])
def test_edge_text_is_that_of_the_nested_graph(spark, monkeypatch, size):
    """Also in slices of three nodes; coinciding nodes, a frame without edges, classes with radii of their own."""
    rng = random.Random(9)
    rows = [(f, t, rng.choice(["car", "pedestrian", "bus", "two_wheeler"]), float(rng.randint(0, 30)), float(rng.randint(0, 8))) for f in range(3) for t in range(40)] + [(7, 1, "car", 0.0, 0.0), (7, 2, "car", 0.0, 0.0), (8, 1, "car", 0.0, 0.0), (8, 2, "car", 90.0, 0.0)]
    actors = spark.createDataFrame(rows, "frame_id int, track_id long, actor_class string, x double, y double")
    monkeypatch.setattr(neighbours, "SLICE", size)
    nodes = graphs.build_nodes(actors, ["frame_id"])
    frames = nodes.groupBy("frame_id").agg(F.count("*").alias("n"))
    got = {r.frame_id: (r.n, r.num_edges, r.edges) for r in neighbours.with_edge_text(frames, nodes, ["frame_id"]).collect()}
    text = lambda e: "-".join(str(e[c]) for c in ("src", "dst", "src_node", "dst_node"))
    assert got == {r.frame_id: (r.num_nodes, r.num_edges, ",".join(map(text, r.edges))) for r in graphs.build_interaction_graph(actors).collect()}
    assert got[0][1] > 20 and got[7][1:] == got[8][1:] == (0, "")


def test_steps_of_edges_come_back():
    src, dst = (np.array(v, np.int64) for v in zip(*sorted({(a, a + b) for a, b in np.random.default_rng(3).integers(1, 90_000, (400, 2)).tolist()} | {(0, 1), (0, 70_000), (5, 6)})))
    for n in (0, 1, 2, len(src)):
        assert [v.tolist() for v in neighbours._unpack(neighbours._pack(src[:n], dst[:n]))] == [src[:n].tolist(), dst[:n].tolist()]
