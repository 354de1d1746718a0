from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import approach, crowded, safety, trajectories

SAMPLES = "video_id string, track string, frame_idx int, x_m double, y_m double, t_sec double"


def all_pairs(rows, radius):
    """Every pair of samples of two tracks of a video."""
    by = {}
    for v, t, f, x, y, _ in rows:
        by.setdefault((v, t), []).append((f, x, y))
    out = {}
    for (v, a), pa in by.items():
        for (w, b), pb in by.items():
            if v == w and a < b:
                best = min((float(np.hypot(xb - xa, yb - ya)), fa, fb) for fa, xa, ya in pa for fb, xb, yb in pb)
                if best[0] <= radius:
                    out[v, a, b] = best
    return out


def walks(rng, tracks, length, spread):
    rows = []
    for i in range(tracks):
        at = rng.uniform(0, spread, 2)
        for f in range(length):
            at = at + rng.normal(0, 0.4, 2)
            rows.append((f"v{i % 2}", f"t{i}", f, round(float(at[0]), 1), round(float(at[1]), 1), float(f)))
    return rows


@pytest.mark.parametrize(("tracks", "length", "spread"), [(30, 12, 30.0), (8, 150, 3.0), (6, 1, 2.0)])
def test_closest_samples_equal_all_pairs(spark, monkeypatch, tracks, length, spread):
    rows = walks(np.random.default_rng(length), tracks, length, spread)
    samples = spark.createDataFrame(rows, SAMPLES)
    got = approach.closest_approach(samples, ["video_id"], 2.0).collect()
    want = all_pairs(rows, 2.0)
    assert {(r.video_id, r.track_id_a, r.track_id_b) for r in got} == set(want)
    for r in got:
        d, fa, fb = want[r.video_id, r.track_id_a, r.track_id_b]
        assert abs(r.dist - d) < 1e-9 and (r.fa, r.fb) == (fa, fb)


def test_search_equals_all_pairs_and_looks_at_few():
    rng = np.random.default_rng(7)
    for n, m, grid in ((400, 300, 0.01), (500, 500, 0.25), (33, 1, 0.1), (1, 70, 0.1)):
        a, b = (np.round(rng.uniform(0, 2, (k, 2)) / grid) * grid for k in (n, m))
        fa, fb = rng.permutation(n), rng.permutation(m)
        d = np.hypot(b[None, :, 0] - a[:, None, 0], b[None, :, 1] - a[:, None, 1])
        i, j = min(np.argwhere(d == d.min()).tolist(), key=lambda p: (fa[p[0]], fb[p[1]]))
        assert approach.closest(a[:, 0], a[:, 1], fa, b[:, 0], b[:, 1], fb) == (d.min(), i, j)
    assert approach.closest(a[:, 0], a[:, 1], fa, b[:, 0] + 100, b[:, 1], fb, 2.0) is None


def test_crowded_spot_costs_lengths_not_products(monkeypatch):
    """Two tracks that stand side by side: pairs of samples that are computed, against all of them."""
    rng = np.random.default_rng(1)
    seen, spent = [], []
    real = np.hypot
    monkeypatch.setattr(np, "hypot", lambda x, y: (seen.append(np.size(x)), real(x, y))[1])
    for n in (1024, 4096):
        a = rng.normal(0, 0.3, (n, 2))
        b = a[:, ::-1] + [0.5, 0.0]
        seen.clear()
        approach.closest(a[:, 0], a[:, 1], np.arange(n), b[:, 0], b[:, 1], np.arange(n))
        spent.append(sum(seen))
    assert spent[0] < 0.25 * 1024**2 and spent[1] < 0.12 * 4096**2 and spent[1] < 7 * spent[0]  # 16 times the pairs


def test_samples_in_zones(spark):
    rows = walks(np.random.default_rng(3), 6, 80, 4.0)
    samples = spark.createDataFrame(rows, SAMPLES)
    zones = [(v, t, x, y, i) for i, (v, t, _, x, y, _) in enumerate(rows[::37])]
    got = approach.inside_zones(spark.createDataFrame(zones, "video_id string, track string, conflict_x double, conflict_y double, id int"), samples, ["video_id"], 1.5).collect()
    want = {(i, f) for v, t, cx, cy, i in zones for w, u, f, x, y, _ in rows if (v, t) == (w, u) and np.hypot(x - cx, y - cy) <= 1.5}
    assert {(r.id, r.frame_idx) for r in got} == want and all(r.t_sec == r.frame_idx for r in got)


def test_pet_of_given_pairs_is_pet_of_all(spark):
    rows = walks(np.random.default_rng(5), 12, 30, 6.0)
    tracks = spark.createDataFrame(rows, SAMPLES).withColumnRenamed("track", "track_id")
    every = {(r.video_id, r.event_id): r for r in safety.pet_events(tracks).collect()}
    assert every
    some = sorted(every)[::3]
    pairs = spark.createDataFrame([(every[k].track_id_b, every[k].track_id_a) for k in some], "track_id_a string, track_id_b string")
    assert {(r.video_id, r.event_id): r for r in safety.pet_events(tracks, pairs).collect()} == {k: every[k] for k in some}
    assert safety.pet_events(tracks.limit(0)).count() == 0
    assert safety.pet_events(tracks.drop("video_id").withColumn("track_id", F.col("track_id"))).count() >= len(every)


# Crowded places


def crowd(rng, n):
    """A third of all points on one spot, a third in one cell, the rest anywhere; ids repeat."""
    rows = [(1, f"p{i}", 5.0, -7.0) for i in range(n // 3)] + [(1, f"q{i}", *rng.uniform(0, 1.9, 2).tolist()) for i in range(n // 3)]
    rows += [(int(rng.integers(1, 3)), f"r{i % 40}", *rng.uniform(-20, 20, 2).tolist()) for i in range(n // 3)]
    return rows + [(1, "none", None, 1.0), (None, "nokey", 1.0, 1.0)]


@pytest.mark.parametrize("limit", [8, 1000])
@pytest.mark.parametrize("inclusive", [True, False])
def test_tree_gives_the_pairs_of_the_plain_join(spark, limit, inclusive):
    points = spark.createDataFrame(crowd(np.random.default_rng(limit), 180), "frame int, id string, x_m double, y_m double")
    marks = lambda df: sorted((r.a.frame, r.a.id, r.b.id, round(r.a.x_m, 9), round(r.b.x_m, 9), round(r.dist, 9)) for r in df.collect())
    plain = trajectories.pairs_within(points, ["frame"], "id", 2.0, inclusive=inclusive)
    assert marks(crowded.pairs_by_tree(points, ["frame"], "id", 2.0, inclusive, limit)) == marks(plain) != []
    assert crowded.pairs_by_tree(points.limit(0), ["frame"], "id", 2.0).count() == 0


def test_no_key_of_the_tree_holds_many_points(spark):
    points = spark.createDataFrame(crowd(np.random.default_rng(2), 3000), "frame int, id string, x_m double, y_m double").where("x_m is not null and frame is not null")
    cells = crowded.leaves(points, ["frame"], 2.0, 50)
    fine = 2.0 / 2**crowded.DEPTH
    at = points.withColumns({"__fx": F.floor(F.col("x_m") / fine), "__fy": F.floor(F.col("y_m") / fine)}).join(cells, ["frame", "__fx", "__fy"])
    sizes = at.groupBy("frame", "__level", "__lx", "__ly").agg(F.count("*").alias("n"), F.max("__chunks").alias("k")).collect()
    assert sum(r.n for r in sizes) == points.count() and max(r.n for r in sizes) >= 1000
    assert all(r.n / r.k <= 50 for r in sizes)


def test_ties_of_distances_are_those_of_roots_of_squares(spark):
    # equal as roots of sums of squares; np.hypot and F.hypot put the second below the first by a bit
    places = [(1, 6.13, 4.91), (2, 27.39, 26.17)]
    rows = [("v", t, f, x, y, float(f)) for f, a, b in places for t, x, y in (("a", a, 0.0), ("b", b, 3.0))]
    assert np.hypot(places[1][2] - places[1][1], 3.0) < np.hypot(places[0][2] - places[0][1], 3.0)
    (got,) = approach.closest_approach(spark.createDataFrame(rows, SAMPLES), ["video_id"], 4.0).collect()
    assert (got.fa, got.fb) == (1, 1)
    x = np.array([6.13, 27.39]), np.array([4.91, 26.17])
    assert approach.closest(x[0], np.zeros(2), np.array([1, 2]), x[1], np.full(2, 3.0), np.array([1, 2]))[1:] == (0, 0)
    kin = trajectories.compute_kinematics(spark.createDataFrame(rows, SAMPLES).withColumnRenamed("track", "track_id"), fps=1.0)
    for pairs in (trajectories.compute_conflict_pairs(kin, min_interaction_frames=2), safety.conflict_risk(kin, min_interaction_frames=2)):
        assert pairs.first().min_distance_frame == 1


def test_points_go_to_as_many_leaves_when_a_table_grows_in_place(spark, monkeypatch):
    monkeypatch.setattr(crowded, "LEAST", 16)
    monkeypatch.setattr(crowded, "LEAVES", 8)

    def copies(n):
        points = spark.range(n).select(F.lit(1).alias("frame"), F.rand(3).alias("x_m") * 4, F.rand(4) * 4).toDF("frame", "x_m", "y_m").cache()
        cells = crowded.leaves(points, ["frame"], 2.0, crowded.leaf_limit(n))
        fine = 2.0 / 2**crowded.DEPTH
        leaf = F.struct(F.col("__level").alias("level"), F.col("__lx").alias("x"), F.col("__ly").alias("y"))
        at = points.withColumns({"__fx": F.floor(F.col("x_m") / fine), "__fy": F.floor(F.col("y_m") / fine)}).join(cells, ["frame", "__fx", "__fy"]).select("frame", leaf.alias("leaf"))
        pairs = crowded.leaf_pairs(cells, ["frame"], 2.0).select("frame", F.struct("one.level", "one.x", "one.y").alias("leaf"))
        return at.join(pairs, ["frame", "leaf"]).count() / n

    assert copies(4000) < 1.3 * copies(250)
