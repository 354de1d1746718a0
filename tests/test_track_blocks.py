"""Pairs of tracks by blocks against the join of near rows."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.operators import safety, track_blocks, trajectories

SCHEMA = "video_id string, track_id long, frame_idx int, x_m double, y_m double"


@pytest.fixture(scope="module")
def kin(spark):
    """Two videos; crowded spots, repeated rows of a track, missing places, tracks without a second row, ids whose order as text is another."""
    rng = random.Random(5)
    rows = [(f"v{t % 2}", t, f, rng.choice([rng.uniform(-30, 30), 4.0, 15.0, None, float("nan")]), float(rng.randint(-12, 12))) for t in range(90) for f in range(6) if rng.random() < 0.8]
    rows += [("v0", 8, 3, 1.0, 1.0), ("v0", 8, 3, 2.0, 1.0), ("v0", 1000, 2, 0.0, 0.0), (None, 5, 1, 0.0, 0.0)]
    return trajectories.compute_kinematics(spark.createDataFrame(rows, SCHEMA), fps=1.0).cache()


def marks(df, *names):
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted(tuple(str(plain(r[n])) for n in names) for r in df.collect())


NAMES = ["track_id_a", "track_id_b", "frame_indices", "n_frames", "min_distance", "min_distance_frame", "avg_relative_speed"]


@pytest.mark.parametrize("per_video", [True, False])
@pytest.mark.parametrize("blocks", [1, 5])
def test_blocks_give_the_measures_of_the_join(kin, blocks, per_video):
    names = [*(["video_id"] if per_video else []), *NAMES]
    for least in (1, 3):
        joined, met = (trajectories.compute_conflict_pairs(kin, min_interaction_frames=least, per_video=per_video, blocks=b) for b in (0, blocks))
        assert marks(met, *names) == marks(joined, *names) != []
        assert [(f.name, f.dataType.simpleString()) for f in met.schema if f.name in names] == [(f.name, f.dataType.simpleString()) for f in joined.schema if f.name in names]
    joined, met = (safety.conflict_risk(kin, per_video=per_video, blocks=b) for b in (0, blocks))
    assert marks(met, *names, "min_ttc", "max_severity") == marks(joined, *names, "min_ttc", "max_severity") != []


def test_groups_of_tracks_give_the_same(kin):
    points = trajectories.block_points(kin, "frame_idx", "track_id", "x_m", "y_m", "speed_mps", True)
    whole, small = (track_blocks.conflict_measures(points, ["video_id"], "frame_idx", 15.0, 2, 3, candidates=c) for c in (track_blocks.CANDIDATES, 50))
    assert marks(whole, *NAMES) == marks(small, *NAMES) != []


def test_near_rows_are_not_shuffled(spark):
    # 400 tracks at one spot in 5 frames: 399,000 near rows; only the 2,000 rows are dealt, once for each block
    rows = spark.range(2000).select((F.col("id") % 400).alias("track_id"), (F.col("id") / 400).cast("int").alias("frame_idx"), F.lit(1.0).alias("x_m"), F.lit(2.0).alias("y_m"))
    pairs = trajectories.compute_conflict_pairs(rows, blocks=4)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    assert pairs.count() == 400 * 399 // 2
    assert pairs.where("n_frames <> 5 or min_distance <> 0").count() == 0


@pytest.mark.parametrize("per_video", [True, False])
@pytest.mark.parametrize("blocks", [1, 5])
def test_blocks_give_the_pet_events_of_the_joins(spark, blocks, per_video, monkeypatch):
    """Ties of distance, repeated frames of a track, tracks with a missing place or a single row; also in groups of one track."""
    rng = random.Random(6)
    rows = [(f"v{t % 2}", t, f, float(rng.randint(0, 9)) + rng.choice([0.0, 0.25]), float(rng.randint(0, 9))) for t in range(8, 60) for f in range(7) if rng.random() < 0.8]
    rows += [("v0", 8, 3, 4.0, 4.0), ("v0", 10, 90, None, 1.0), ("v1", 1000, 2, 0.0, 0.0), (None, 5, 1, 0.0, 0.0)]
    tracks = spark.createDataFrame(rows, SCHEMA).withColumn("t_sec", F.col("frame_idx") / 2.0)
    joined = safety.pet_events(tracks, proximity_threshold_m=1.0, per_video=per_video)
    for candidates in (track_blocks.CANDIDATES, 1):
        own = track_blocks.zone_measures
        with monkeypatch.context() as m:
            m.setattr(track_blocks, "zone_measures", lambda *a: own(*a, candidates))
            met = safety.pet_events(tracks, proximity_threshold_m=1.0, per_video=per_video, blocks=blocks)
        assert marks(met, *joined.columns) == marks(joined, *joined.columns) != []
        assert [(f.name, f.dataType.simpleString()) for f in met.schema] == [(f.name, f.dataType.simpleString()) for f in joined.schema]
