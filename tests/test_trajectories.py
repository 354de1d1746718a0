from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from roadweave.functions.scalars import round_digits
from roadweave.operators import safety
from roadweave.operators.trajectories import add_time_seconds, compute_conflict_pairs, compute_kinematics, filter_meaningful_conflicts, find_nearby_pairs, smooth_positions

POINTS = "track_id string, frame_idx int, x_m double, y_m double"


def test_time(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 15, 0.0, 0.0), ("a", 30, 0.0, 0.0)], POINTS)
    assert [r.t_sec for r in add_time_seconds(df, 30).orderBy("frame_idx").collect()] == [0.0, 0.5, 1.0]
    with pytest.raises(ValueError, match="fps"):
        add_time_seconds(df, 0)


def test_kinematics(spark):
    df = spark.createDataFrame([("a", 2, 2.0, 0.0), ("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0)], POINTS)
    rows = compute_kinematics(df, fps=1).orderBy("frame_idx").collect()
    assert [r.speed_mps for r in rows] == [None, 1.0, 1.0]
    assert (rows[1].heading_rad, rows[1].vx_mps, rows[1].vy_mps, rows[2].accel_mps2) == (0.0, 1.0, 0.0, 0.0)


def test_kinematics_without_time_or_place(spark):
    df = spark.createDataFrame([("a", 1, 0.0, 0.0), ("a", 1, 1.0, 0.0), ("b", 0, float("nan"), 0.0), ("b", 1, 1.0, 0.0)], POINTS)
    assert {r.speed_mps for r in compute_kinematics(df, fps=1).collect()} == {None}
    with pytest.raises(ValueError, match="Missing columns: .*x_m"):
        compute_kinematics(df.drop("x_m"))


@pytest.mark.parametrize(("window", "middle"), [(3, 10.0), (1, 10.0), (2, 5.0)])
def test_smoothing(spark, window, middle):
    df = spark.createDataFrame([("a", i, 10.0 * i, 0.0) for i in range(3)], POINTS)
    assert smooth_positions(df, "frame_idx", window=window).orderBy("frame_idx").collect()[1].x_m == middle


def test_smoothing_fills_gaps(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, float("nan"), None), ("a", 2, 20.0, 4.0)], POINTS)
    row = smooth_positions(df, "frame_idx").orderBy("frame_idx").collect()[1]
    assert (row.x_m, row.y_m) == (10.0, 2.0)
    with pytest.raises(ValueError, match="window"):
        smooth_positions(df, "frame_idx", window=0)


def test_nearby_pairs(spark):
    df = spark.createDataFrame([(i, t, x, x) for i in (0, 1) for t, x in (("a", 0), ("b", 2), ("c", 100))], "frame_idx int, track_id string, x_m int, y_m int")
    for bucketed in (False, True):
        got = {(r.frame_idx, r.track_id_a, r.track_id_b) for r in find_nearby_pairs(df, distance_threshold=5, bucketed=bucketed).collect()}
        assert got == {(0, "a", "b"), (1, "a", "b")}


def test_ids_compare_as_strings(spark):
    df = spark.createDataFrame([(0, 9, 0.0, 0.0), (0, 10, 1.0, 0.0)], "frame_idx int, track_id int, x_m double, y_m double")
    row = find_nearby_pairs(df).first()
    assert (row.track_id_a, row.track_id_b) == ("10", "9")


def test_bucketed_pairs_equal_plain_ones(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), f"t{i}", rng.uniform(-40, 40), rng.choice([rng.uniform(-40, 40), None, float("nan"), 5.0])) for i in range(150)]
    df = spark.createDataFrame(rows, "frame_idx int, track_id string, x_m double, y_m double")
    plain, bucketed = ({tuple(r) for r in find_nearby_pairs(df, distance_threshold=7, bucketed=b).collect()} for b in (False, True))
    assert plain == bucketed
    assert plain


def test_conflict_pairs(spark):
    rows = [(f, t, float(f * 2 if t == "b" else 0), 0.0, s) for f in range(4) for t, s in (("a", 1.0), ("b", 3.0 + f))]
    df = spark.createDataFrame(rows, "frame_idx int, track_id string, x_m double, y_m double, speed_mps double")
    r = compute_conflict_pairs(df).first()
    assert (r.frame_indices, r.min_distance, r.min_distance_frame, r.avg_relative_speed) == ([0, 1, 2, 3], 0.0, 0, 3.5)
    assert compute_conflict_pairs(df, min_interaction_frames=5).count() == 0
    assert filter_meaningful_conflicts(compute_conflict_pairs(df), min_avg_speed=4).count() == 0


def test_duplicate_rows_count_but_do_not_measure(spark):
    rows = [(0, "a", 0.0), (0, "a", 0.0), (0, "b", 1.0), (1, "a", 0.0), (1, "b", 3.0), (2, "a", 0.0), (2, "b", 4.0)]
    df = spark.createDataFrame([(f, t, x, 0.0) for f, t, x in rows], "frame_idx int, track_id string, x_m double, y_m double")
    r = compute_conflict_pairs(df).first()
    assert (r.frame_indices, r.min_distance, r.min_distance_frame) == ([0, 0, 1, 2], 3.0, 1)


def test_frame_pair_ttc(spark):
    df = spark.createDataFrame([(0, "a", 0.0, 0.0, 5.0, 0.0), (0, "b", 10.0, 0.0, -5.0, 0.0), (0, "c", 1.0, 1.0, None, None)], "frame_idx int, track_id string, x_m double, y_m double, vx_mps double, vy_mps double")
    (r,) = safety.frame_pair_ttc(df, min_distance=0.0).collect()
    assert (r.ttc_seconds, r.collision_x, r.is_critical, r.status) == (1.0, 5.0, True, "collision_predicted")


TRACK = "track_id string, frame_idx int, t_sec double, x_m double, y_m double"


def test_pet_event(spark):
    a = [("a", i, float(i), float(i), 0.0) for i in range(3)]
    b = [("b", 3, 2.2, 2.0, 1.0), ("b", 4, 3.2, 2.0, 0.2), ("b", 5, 4.2, 2.0, 0.0)]
    r = safety.pet_events(spark.createDataFrame(a + b, TRACK), proximity_threshold_m=0.5).first()
    assert (r.event_id, r.severity, r.start_frame, r.end_frame, r.pet_status) == ("PET_a_b", "critical", 0, 5, "agent1_then_agent2")
    assert math.isclose(r.min_value, 1.2)


def test_no_pet_for_short_or_broken_tracks(spark):
    rows = [("a", 0, 0.0, 0.0, 0.0), ("b", 0, 0.0, 0.0, 0.0), ("b", 1, 1.0, 1.0, 0.0), ("c", 0, 0.0, float("nan"), 0.0), ("c", 1, 1.0, 0.0, 0.0)]
    assert safety.pet_events(spark.createDataFrame(rows, TRACK)).count() == 0


def test_zone_pet(spark):
    one = [("a", i, float(i), float(i), 0.0) for i in range(4)]
    two = [("b", i, 3.2 + i, 2.0, y) for i, y in enumerate((1.0, 0.6, 0.3, 0.0))]
    df = spark.createDataFrame([("p", *r) for r in one + two], "pair string, side string, idx int, t double, x double, y double")
    r = safety.conflict_zone_pet(df, ["pair"], inside=F.hypot(F.col("x") - 2, F.col("y")) <= 0.25).first()
    assert math.isclose(r.pet_seconds, 4.2)
    assert r.pet_status == "agent1_then_agent2"
    r = safety.conflict_zone_pet(df.where("side = 'a'"), ["pair"], inside=F.lit(True)).first()
    assert (r.pet_seconds, r.pet_status) == (math.inf, "empty_trajectory")
    r = safety.conflict_zone_pet(df, ["pair"], inside=F.col("x") > 90).first()
    assert r.pet_status == "one_or_both_never_enter_zone"


def test_status_of_ttc_without_separation(spark):
    rows = [(1, t, x, y, vx, 0.0) for t, x, y, vx in (("a", 0.0, 0.0, 1.0), ("b", 4.0, 0.0, -1.0), ("c", 5.0, 4.0, -1.0))]
    kin = spark.createDataFrame(rows, "frame_idx int, track_id string, x_m double, y_m double, vx_mps double, vy_mps double")
    full, plain = (safety.frame_pair_ttc(kin, separation_in_status=s) for s in (True, False))
    one, other = ({(r.track_id_a, r.track_id_b): r for r in d.collect()} for d in (full, plain))
    assert one["a", "c"].status == "no_collision_min_sep_4.000" and other["a", "c"].status == "no_collision"
    assert all({**one[k].asDict(), "status": ""} == {**other[k].asDict(), "status": ""} for k in one) and one.keys() == other.keys()
    assert "format_string" not in plain._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("bucketed", [False, True])
def test_one_crowded_frame_is_dealt_over_tasks(spark, bucketed):
    points = spark.range(600).select(F.lit(1).alias("frame_idx"), F.col("id").alias("track_id"), (F.col("id") % 50 * 3.0).alias("x_m"), (F.col("id") % 7 * 9.0).alias("y_m"))
    pairs = find_nearby_pairs(points, distance_threshold=7.0, bucketed=bucketed)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 8
    assert pairs.count() == points.alias("a").join(points.alias("b"), F.expr("a.track_id < b.track_id and pow(a.x_m - b.x_m, 2) + pow(a.y_m - b.y_m, 2) < 49")).count() > 0


def test_rounding_is_that_of_sql(spark):
    import duckdb

    values = [0.0, -0.0, 0.0003125, -0.0003125, 0.00031249999999999995, 1.0000005, 2.5e-7, -1e-9, 12345.6789015, 1e15 + 0.3, 1e300, -1e305, float("inf"), 0.49999999999999994e-6, 1.5e-6, 2.5e-6, -2.5e-6]
    got = [r.v for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(round_digits("v").alias("v")).collect()]
    assert got == [duckdb.execute("select round(?::double, 6) + 0.0", [v]).fetchone()[0] for v in values]
    assert str(got[1]) == str(got[7]) == "0.0"
    assert spark.range(1).select(round_digits(F.lit(None).cast("double"))).first()[0] is None and math.isnan(spark.range(1).select(round_digits(F.lit(float("nan")))).first()[0])
