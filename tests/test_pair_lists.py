"""Lists of near pairs against brute force and the joins."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.functions.scalars import round_digits
from roadweave.functions.vocabulary import ACTOR_CLASSES, EDGE_FEATURES, PAIR_RADII
from roadweave.operators import graphs, pair_lists, safety, trajectories

KEY = ["frame_id"]
ACTORS = "frame_id int, track_id long, actor_class string, x_m double, y_m double, vx double, vy double, heading_rad double"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    speed = lambda: rng.choice([0.0, rng.uniform(-3, 3), rng.uniform(-300, 300), 2e9 if rng.random() < 0.02 else 1.0])
    return [(f, t, rng.choice(ACTOR_CLASSES), rng.choice([rng.uniform(-60, 60), 4.0, -8.0]), float(rng.randint(-30, 30)), speed(), speed(), rng.uniform(-4, 4)) for f in (1, 2, None) for t in range(120)]


def test_speed_adaptive_radius_leaves_no_pair_out(spark, rows):
    """Speeds beyond 20 widen the radius as far as they say."""
    config = graphs.GraphConfig(use_velocity_adaptive_radius=True, velocity_radius_scale=0.05)
    nodes = graphs.build_nodes(spark.createDataFrame(rows, ACTORS), KEY, config).cache()
    at = [r for r in nodes.collect() if r.frame_id is not None]
    want = set()
    for a in at:
        for b in at:
            gap = math.hypot(a.x - b.x, a.y - b.y)
            radius = PAIR_RADII.get((a.actor_class, b.actor_class), PAIR_RADII.get((b.actor_class, a.actor_class), 6.0)) + 0.05 * max(a.speed, b.speed)
            if a.frame_id == b.frame_id and a.node_id != b.node_id and 1e-8 < gap <= radius:
                want.add((a.frame_id, a.node_id, b.node_id))
    assert any(math.dist((a.x, a.y), (b.x, b.y)) > 9.0 and (a.frame_id, a.node_id, b.node_id) in want for a in at for b in at)
    for edges in (graphs.build_edges(nodes, KEY, config), pair_lists.list_edges(nodes, KEY, config, ["distance"])):
        got = [(r.frame_id, r.src, r.dst) for r in edges.collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("options", [
    {}, {"directed": False, "use_class_specific_radii": False, "radius": 8.0, "min_closing_speed": 0.5, "max_ttc": 4.0},
    {"use_velocity_adaptive_radius": True, "velocity_radius_scale": 0.02, "pair_radii": {("car", "bus"): 9.0, ("bus", "car"): 3.0}},
])
def test_listed_edges_are_the_edges_of_the_join(spark, rows, options, monkeypatch):
    monkeypatch.setattr(pair_lists, "_PAIRS", 50)  # several parts from a cell
    config = graphs.GraphConfig(**options)
    nodes = graphs.build_nodes(spark.createDataFrame(rows, ACTORS), KEY, config)
    joined, listed = graphs.build_edges(nodes, KEY, config), pair_lists.list_edges(nodes, KEY, config)
    names = ["frame_id", "src", "dst", "direction", *EDGE_FEATURES]
    assert [(f.name, f.dataType) for f in joined.select(names).schema] == [(f.name, f.dataType) for f in listed.select(names).schema]
    mark = lambda df: sorted(tuple(round(v, 8) + 0.0 if isinstance(v, float) else v for v in r) for r in df.select(names).collect())
    one, two = mark(joined), mark(listed)
    assert len(one) == len(two) > 0
    for a, b in zip(one, two):
        assert a[:4] == b[:4] and all(math.isclose(u, v, rel_tol=1e-9, abs_tol=1e-7) for u, v in zip(a[4:], b[4:]))


def test_what_is_shuffled_grows_with_the_points(spark):
    # 300 actors on a line of 3 m: 44,850 pairs, but only the nodes are dealt, to four cells at most
    rows = [(1, t, "bus", t / 100.0, 0.5, 1.0, 0.0, 0.0) for t in range(300)]
    nodes = graphs.build_nodes(spark.createDataFrame(rows, ACTORS), KEY)
    edges = pair_lists.list_edges(nodes, KEY, graphs.GraphConfig(), ["distance", "ttc"], 6)
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert edges.count() == 300 * 299
    assert edges.where(F.col("distance") != F.round("distance", 6)).count() == 0


@pytest.fixture(scope="module")
def tracks(spark):
    """Two videos; crowded spots, repeated rows of a track, missing places, ids whose order as text is another."""
    rng = random.Random(12)
    rows = [(f"v{t % 2}", t, f, rng.choice([rng.uniform(-30, 30), 4.0, 15.0, None, float("nan")]), float(rng.randint(-12, 12))) for t in range(95, 160) for f in range(4) if rng.random() < 0.8]
    rows += [("v0", 100, 3, 1.0, 1.0), ("v0", 100, 3, 2.0, 1.0), (None, 5, 1, 0.0, 0.0), ("v1", 7, None, 4.0, 0.0)]
    return trajectories.compute_kinematics(spark.createDataFrame(rows, "video_id string, track_id long, frame_idx int, x_m double, y_m double"), fps=1.0).cache()


def same(one, two):
    assert one.columns == two.columns and [f.dataType for f in one.schema] == [f.dataType for f in two.schema]
    mark = lambda df: sorted(tuple(str(round(v, 9) + 0.0 if isinstance(v, float) else v) for v in r) for r in df.collect())
    assert mark(one) == mark(two) != []


@pytest.mark.parametrize("bucketed", [False, True])
def test_listed_nearby_pairs_are_those_of_the_join(tracks, bucketed):
    for per_video in (True, False):
        joined, listed = (trajectories.find_nearby_pairs(tracks, distance_threshold=7.0, bucketed=bucketed, per_video=per_video, listed=v) for v in (False, True))
        same(joined, listed)
        assert "Join" not in listed._jdf.queryExecution().optimizedPlan().toString()
    with pytest.raises(ValueError):
        trajectories.find_nearby_pairs(tracks, listed=True, speed_col="speed_mps")


def test_listed_times_to_collision_are_those_of_the_join(tracks):
    joined, listed = (safety.frame_pair_ttc(tracks, separation_in_status=False, listed=v) for v in (False, True))
    same(joined, listed)
    assert {r.status for r in listed.select("status").distinct().collect()} >= {"diverging_or_parallel", "no_collision", "collision_predicted"}


def test_ties_round_away_from_zero(spark):
    values = [0.5, 1.5, 2.5, -0.5, -2.5, 0.1234565, -0.0, 1e305, float("inf"), 3.0000005]
    want = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(round_digits("v", 0).alias("v")).collect()]
    with np.errstate(all="ignore"):
        got = pair_lists.rounded(np.array(values), 0).tolist()
    assert got == want and [math.copysign(1, v) for v in got] == [math.copysign(1, v) for v in want]


@pytest.mark.parametrize("options", [{}, {"use_velocity_adaptive_radius": True, "velocity_radius_scale": 0.05}])
def test_first_pairs_and_sums_are_those_of_the_edges(spark, rows, options, monkeypatch):
    monkeypatch.setattr(pair_lists, "_PAIRS", 50)
    config = graphs.GraphConfig(directed=False, **options)
    nodes = graphs.build_nodes(spark.createDataFrame(rows, ACTORS), KEY, config)
    edges = graphs.build_edges(nodes, KEY, config).cache()
    want = {r.frame_id: tuple(r)[1:] for r in edges.groupBy("frame_id").agg(F.count("*"), F.sum("src"), F.sum("dst")).collect()}
    assert {r.frame_id: tuple(r)[1:] for r in pair_lists.edge_sums(nodes, KEY, config).collect()} == want != {}
    least = lambda df: {r.frame_id: tuple(r.e) for r in df.groupBy("frame_id").agg(F.min(F.struct("src", "dst")).alias("e")).collect()}
    first = pair_lists.first_pairs(nodes, KEY, config)
    assert least(first) == least(edges) != {}


def test_a_crowded_frame_gives_one_first_pair_and_one_sum(spark):
    # 300 buses on a line of 3 m have 44,850 edges; one cell gives its first pair only, and edges are summed where they are found
    rows = [(1, t, "bus", 8.0 + t / 100.0, 8.0, 1.0, 0.0, 0.0) for t in range(300)]
    nodes = graphs.build_nodes(spark.createDataFrame(rows, ACTORS), KEY)
    config = graphs.GraphConfig(directed=False)
    assert [tuple(r) for r in pair_lists.first_pairs(nodes, KEY, config).collect()] == [(1, 0, 1)]
    sums = pair_lists.edge_sums(nodes, KEY, config)
    assert "ollect" not in sums._jdf.queryExecution().optimizedPlan().toString()  # no list of edges
    assert tuple(sums.first()) == (1, 44850, sum(a * (299 - a) for a in range(300)), sum(b * b for b in range(300)))
