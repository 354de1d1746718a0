from __future__ import annotations

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions.vocabulary import EDGE_FEATURES
from roadweave.operators import exports, graphs, subgraphs, temporal

ACTORS = "frame_id long, track_id long, actor_class string, x double, y double, vx double, vy double"
ROWS = [(10, 1, "car", 0.0, 0.0, 2.0, 0.0), (10, 2, "two_wheeler", 3.0, 4.0, 1.0, 0.0), (10, 3, "pedestrian", 30.0, 0.0, 0.5, 0.0), (11, 1, "car", 1.0, 0.0, 2.0, 0.0), (11, 2, "two_wheeler", 4.0, 4.0, 1.0, 0.0)]
KEY = ["frame_id"]


@pytest.fixture
def actors(spark):
    return spark.createDataFrame(ROWS, ACTORS)


def test_interaction_graph(spark, actors):
    one, two = graphs.build_interaction_graph(actors).collect()
    assert (one.frame_id, one.num_nodes, one.num_edges, two.frame_id) == (10, 3, 1, 11)
    edge = one.edges[0]
    assert (edge.src, edge.dst, edge.src_node, edge.dst_node) == (1, 2, 0, 1)
    assert edge.features[EDGE_FEATURES.index("distance")] == 5.0  # the bound itself counts
    assert [len(n.features) for n in one.nodes] == [19] * 3


def test_plain_export_and_tensors(spark):
    rows = [(7, 10, "car", 0.0, 0.0, 2.0, 0.0), (7, 25, "two_wheeler", 3.0, 4.0, 1.0, 0.5), (7, 99, "pedestrian", 20.0, 0.0, 0.2, 0.0)]
    nested = graphs.build_interaction_graph(spark.createDataFrame(rows, ACTORS), radius=6.0)
    out = exports.plain_export(nested).first()
    assert (out.track_ids, out.edge_index, len(out.edge_attr), {len(v) for v in out.x}) == ([10, 25, 99], [[0], [1]], 1, {12})
    assert out.edge_attr[0] == [0.0] * 12  # undirected edges have no named channels
    t = exports.graph_tensors(nested).first()
    assert (t.edge_index, {len(v) for v in t.x}, len(t.edge_attr[0])) == ([[0, 1]], {12}, 15)
    directed = graphs.nested_graphs(*graphs.build_graphs(spark.createDataFrame(rows, ACTORS), KEY), KEY)
    assert exports.plain_export(directed).first().edge_attr[0][:3] == [3.0, 4.0, 5.0]
    assert exports.trim_edges(nested).first().num_edges == 1
    lonely = graphs.build_interaction_graph(spark.createDataFrame(rows[:1], ACTORS))
    assert exports.plain_export(lonely).first().edge_index == [[], []]


def test_tensor_fallback_counts_from_one(spark):
    schema = "nodes array<struct<track_id:long,features:array<double>>>, edges array<struct<src:int,dst:int,src_node:int,dst_node:int>>"
    df = spark.createDataFrame([([(1, [1.0] * 20)], [(1, 2, None, 0), (None, 2, None, None), (3, 4, 2, 3)])], schema)
    assert exports.graph_tensors(df).first().edge_index == [[0, 1], [2, 3]]
    assert exports.trim_edges(df).first().edges[0].src == 1


def test_reversed_edges(actors):
    _, edges = graphs.build_graphs(actors, KEY)
    by = {(r.frame_id, r.src, r.dst): r for r in edges.collect()}
    a, b = by[10, 0, 1], by[10, 1, 0]
    assert (a.dx, a.bearing_sin, a.size_src) == (-b.dx, -b.bearing_sin, b.size_dst)
    assert (a.distance, a.ttc, a.rel_heading_cos) == (b.distance, b.ttc, b.rel_heading_cos)
    plain = graphs.build_edges(graphs.build_nodes(actors, KEY), KEY, graphs.GraphConfig(bucketed=False))
    assert {str(r) for r in plain.collect()} == {str(r) for r in edges.collect()}


def test_edges_against_formulas(spark):
    rng = random.Random(1)
    rows = [(f, t, rng.choice(["car", "bus", "bicycle", "ufo"]), rng.uniform(0, 20), rng.uniform(0, 20), rng.uniform(-3, 3), rng.uniform(-3, 3)) for f in range(3) for t in range(12)]
    rows[1] = (*rows[0][:1], 1, "car", *rows[0][3:])  # coinciding actors have no edge
    radius = lambda a, b: {frozenset(("car", "bus")): 7, frozenset(("car",)): 6, frozenset(("bus",)): 8, frozenset(("car", "bicycle")): 4, frozenset(("bus", "bicycle")): 4.5, frozenset(("bicycle",)): 2.5}.get(frozenset((a, b)), 6)
    want = set()
    for f, t, c, x, y, _, _ in rows:
        for g, u, d, x2, y2, _, _ in rows:
            if f == g and t != u and 1e-8 < math.hypot(x2 - x, y2 - y) <= radius(c, d):
                want.add((f, t, u))
    _, edges = graphs.build_graphs(spark.createDataFrame(rows, ACTORS), KEY)
    assert {(r.frame_id, r.src, r.dst) for r in edges.collect()} == want


def test_options(actors):
    count = lambda **o: graphs.build_graphs(actors, KEY, graphs.GraphConfig(**o))[1].count()
    assert count() == 4
    assert count(directed=False) == 2
    assert count(use_class_specific_radii=False, radius=4.9) == 0
    assert count(use_class_specific_radii=False, radius=28.0) == 6
    assert count(use_velocity_adaptive_radius=True, velocity_radius_scale=15.0) > 4
    assert count(min_closing_speed=100.0) == 0


def test_aliases_and_strings(spark):
    df = spark.createDataFrame([(1, "a9", None, "", " BUS ", "5", None, 1.0)], "frame_id int, track_id string, actor_class string, class_name string, label string, x_m string, y double, heading double")
    nodes = graphs.build_nodes(df.withColumn("x", F.lit(9.0)), KEY)
    r = nodes.first()
    assert (r.track_id, r.actor_class, r.x, r.y, r.speed) == ("a9", "bus", 5.0, 0.0, 0.0)
    assert math.isclose(r.sin_heading, math.sin(1.0))
    assert graphs.build_nodes(df, KEY, numeric_tracks=True).first().track_id == 0


def test_statistics_and_normalisation(actors):
    nodes, edges = graphs.build_graphs(actors, KEY)
    stats = graphs.compute_feature_stats(nodes, edges)
    assert (len(stats["node_mean"]), len(stats["edge_std"])) == (19, 15)
    assert math.isclose(stats["node_mean"][0], 38 / 5)
    n, _ = graphs.normalize(nodes, edges, stats)
    assert abs(sum(r.features[0] for r in n.collect())) < 1e-9


def test_validation(spark, actors):
    nodes, edges = graphs.build_graphs(actors, KEY)
    assert all(all(r[1:]) for r in graphs.validate_graphs(nodes, edges, KEY).collect())
    bad = edges.withColumn("dst", F.lit(9)).withColumn("features", F.array(F.lit(float("nan"))))
    r = graphs.validate_graphs(nodes, bad, KEY).first()
    assert (r.valid_edge_indices, r.finite_edge_features, r.no_self_loops) == (False, False, True)
    assert subgraphs.layout_errors(nodes, edges, KEY, exact_width=True).count() == 0
    assert subgraphs.layout_errors(nodes, bad, KEY).count() == bad.count()


def graph(spark):
    nodes = spark.createDataFrame([(0, i, c, [float(i)] * 19) for i, c in enumerate([0, 0, 3])], "g int, node_id int, class_index int, features array<double>")
    edges = spark.createDataFrame([(0, a, b, [1.0] * 15) for a, b in ((0, 1), (1, 0), (1, 2), (2, 1))], "g int, src int, dst int, features array<double>")
    return nodes, edges


def test_subgraphs(spark):
    nodes, edges = graph(spark)
    n, e = subgraphs.subgraph_by_class(nodes, edges, ["g"], 0)
    assert (n.count(), e.count()) == (2, 2)
    n, e = subgraphs.subgraph_by_class(nodes, edges, ["g"], 5)
    assert (n.count(), e.count(), n.columns) == (0, 0, nodes.columns)
    n, e = subgraphs.subgraph_by_mask(nodes, edges, ["g"], F.col("node_id") != 1)
    assert (sorted(r.node_id for r in n.collect()), e.count()) == ([0, 1], 0)
    n, _ = subgraphs.subgraph_by_mask(nodes, edges, ["g"], F.col("node_id") != 1, keep_isolated_nodes=False)
    assert n.count() == 0
    n, e = subgraphs.subgraph_by_mask(nodes, edges, ["g"], F.col("node_id") > 0)
    assert sorted((r.src, r.dst) for r in e.collect()) == [(0, 1), (1, 0)]
    with pytest.raises(AttributeError):
        subgraphs.subgraph_by_class(nodes.drop("class_index"), edges, ["g"], 0)


def test_slices(spark):
    nodes, edges = graph(spark)
    r = nodes.select(F.size(subgraphs.node_kinematic_features()).alias("k"), F.size(subgraphs.class_one_hot()).alias("c"), F.size(subgraphs.node_heading_features()).alias("h"), subgraphs.positions(nodes).alias("p")).first()
    assert (r.k, r.c, r.h, r.p) == (8, 8, 2, [0.0, 0.0])
    assert {b: edges.select(F.size(subgraphs.edge_block(b)).alias("n")).first().n for b in ("distance", "kinematics", "angles", "risk")} == {"distance": 1, "kinematics": 8, "angles": 4, "risk": 7}
    new = subgraphs.with_node_features(nodes, {"speed": F.lit(7.0)}).where("node_id = 2").first()
    assert (new.features[4], new.features[3], len(new.features)) == (7.0, 2.0, 19)
    with pytest.raises(KeyError):
        subgraphs.named_features(["mass"])


def test_packages(spark):
    df = spark.createDataFrame([(1, [[1.0, 2.0]], [[0, 0]], [[1.0]]), (2, [[1.0]], [], []), (3, [[1.0, 2.0]], [[0, 0]], [])], "id int, x array<array<double>>, edge_index array<array<int>>, edge_attr array<array<double>>")
    assert {r.id for r in exports.package_errors(df).collect()} == {2, 3}
    assert exports.package(df).first().pos == [[1.0, 2.0]]


def test_regraph_keeps_or_loses_velocities(spark, actors):
    nested = graphs.build_interaction_graph(actors)
    speed = lambda lossless: sorted(r.vx for r in exports.regraph(nested, KEY, lossless)[0].where("frame_id = 10").collect())
    assert speed(True) == [0.5, 1.0, 2.0]
    assert speed(False) == [0.0, 0.0, 0.0]


def test_sliding_windows(spark):
    frames = spark.createDataFrame([("b", f) for f in (5, 1, 9, 3)] + [("a", f) for f in range(3)] + [("c", 1)], "video_id string, frame_id int")
    got = {}
    for r in temporal.sliding_windows(frames, window_size=2, stride=2).collect():
        got.setdefault((r.video_id, r.window_index), []).append((r.position, r.frame_id))
    assert {k: sorted(v) for k, v in got.items()} == {("a", 0): [(0, 0), (1, 1)], ("b", 1): [(0, 1), (1, 3)], ("b", 2): [(0, 5), (1, 9)]}
    for size in range(1, 6):
        for stride in range(1, 5):
            n = temporal.sliding_windows(frames.where("video_id = 'b'"), window_size=size, stride=stride).select("window_index").distinct().count()
            assert n == (max(0, (4 - size) // stride + 1) if size <= 4 else 0)


def test_tumbling_windows(spark):
    df = spark.createDataFrame([(f"g{i}",) for i in range(5)], "path string")
    got = temporal.tumbling_windows(df, "path", 2).orderBy("window_id").collect()
    assert [(r.window_id, r.members, r.num_graphs) for r in got] == [("window_001", ["g0", "g1"], 2), ("window_002", ["g2", "g3"], 2), ("window_003", ["g4"], 1)]


def test_window_graphs(spark):
    rows = [(10, 1, 0.0), (10, 2, 3.0), (11, 2, 3.0), (11, 2, 4.0), (12, 2, 3.0), (12, -5, 9.0), (13, -5, 9.0)]
    actors = spark.createDataFrame([("v", f, t, "car", x, 0.0) for f, t, x in rows], "video_id string, frame_id int, track_id long, actor_class string, x_m double, y_m double").withColumn("o", F.col("x_m"))
    nodes, edges = graphs.build_graphs(actors, ["video_id", "frame_id"], order_col="o")
    members, all_edges = temporal.window_graphs(nodes, edges, window_size=2)
    ids = {r.window_index: sorted(x.window_node_id for x in members.where(F.col("window_index") == r.window_index).collect()) for r in members.select("window_index").distinct().collect()}
    assert ids == {0: [0, 1, 2, 3], 1: [0, 1, 2, 3], 2: [0, 1, 2]}
    time = sorted((r.window_index, r.src, r.dst) for r in all_edges.where("edge_type = 1").collect())
    assert time == [(0, 1, 3), (0, 3, 1), (1, 1, 2), (1, 2, 1), (2, 1, 2), (2, 2, 1)]  # the last of two rows of a track stands for it
    _, fewer = temporal.window_graphs(nodes, edges, window_size=2, skip_negative_tracks=True, connect_bidirectional=False)
    assert fewer.where("edge_type = 1").count() == 2
    assert all(set(r.features) == {0.0} and len(r.features) == 15 for r in all_edges.where("edge_type = 1").collect())
    labels = temporal.last_label(members, F.when(F.col("frame_id") == 11, F.lit(1.0)))
    assert {r.window_index: r.y for r in labels.collect()} == {0: 1.0, 1: 1.0, 2: None}


def test_exports_are_json(spark, actors):
    assert json.loads(exports.plain_export(graphs.build_interaction_graph(actors)).toJSON().first())["num_nodes"] == 3


def test_first_edges_and_paired_edges_equal_those_of_whole_graphs(spark):
    rng = np.random.default_rng(5)
    rows = [(f, t, "car" if t % 2 else "pedestrian", *rng.uniform(0, 12, 2).tolist(), *rng.normal(0, 1, 2).tolist()) for f in range(5) for t in range(3 + 4 * f)] + [(9, 1, "car", 0.0, 0.0, 0.0, 0.0)]
    actors = spark.createDataFrame(rows, "frame_id long, track_id long, actor_class string, x double, y double, vx double, vy double")
    whole, first = (graphs.build_interaction_graph(actors, first_edge=f) for f in (False, True))
    for export in (exports.trim_edges, lambda g: exports.plain_export(g).drop("edges", "num_edges")):
        assert export(first).collect() == export(whole).collect()
    nodes, edges = graphs.build_graphs(actors, ["frame_id"])
    one, other = (graphs.undirected_edges(edges, ["frame_id"], paired=p) for p in (True, False))
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty() and not one.isEmpty()
    windows = [t._jdf.queryExecution().optimizedPlan().toString().count("Window [") for t in (one, other, edges)]
    assert windows == [windows[2], windows[2] + 1, windows[2]]  # none over edges
