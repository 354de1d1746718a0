from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from roadweave.functions import scalars as s
from roadweave.functions import vocabulary as v
from roadweave.operators import calibration, records


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "want"), [("1.5", 1.5), (" 2 ", 2.0), ("abc", 0.0), ("NaN", 0.0), ("inf", 0.0), ("-Infinity", 0.0), (None, 0.0), (True, 1.0), (3, 3.0)])
def test_safe_float(spark, raw, want):
    assert value(spark, s.safe_float(F.lit(raw))) == want


@pytest.mark.parametrize(("names", "want"), [(["", " Car "], "car"), ([None, None], "other"), (["  ", "bus"], "other"), (["van"], "other"), (["Two_Wheeler", "car"], "two_wheeler")])
def test_actor_class(spark, names, want):
    assert value(spark, s.actor_class(*(F.lit(n).cast("string") for n in names))) == want


def test_class_index_and_one_hot(spark):
    assert value(spark, s.class_index(F.lit("bus"))) == 4
    assert value(spark, s.class_index(F.lit("ufo"))) == 7
    assert value(spark, s.one_hot(F.lit("ufo"), ["car", "bus"])) == [0.0, 1.0]
    with pytest.raises(PySparkException):
        value(spark, s.class_index(F.lit("ufo"), ["car", "bus"]))


def test_pair_radius_is_symmetric(spark):
    assert value(spark, s.pair_radius(F.lit("bicycle"), F.lit("car"), 6.0)) == value(spark, s.pair_radius(F.lit("car"), F.lit("bicycle"), 6.0)) == 4.0
    assert value(spark, s.pair_radius(F.lit("other"), F.lit("car"), 6.0)) == 6.0
    assert len(v.PAIR_RADII) == 28


@pytest.mark.parametrize(
    ("args", "status", "ttc"),
    [
        ((0, 0, 5, 0, 10, 0, -5, 0, 0), "collision_predicted", 1.0),
        ((0, 0, 1, 0, 10, 0, 1, 0, 1.5), "zero_relative_speed", math.inf),
        ((0, 0, -1, 0, 10, 0, 1, 0, 1.5), "diverging_or_parallel", math.inf),
        ((0, 0, 1, 0, 10, 5, -1, 0, 1.5), "no_collision_min_sep_5.000", math.inf),
        ((0, 0, 1, 0, 1, 0, 0, 0, 1.5), "collision_predicted", 2.5),  # overlapping already: the way out counts
    ],
)
def test_ttc(spark, args, status, ttc):
    r = value(spark, s.ttc_constant_velocity(*(F.lit(float(a)) for a in args[:8]), min_distance=args[8]))
    assert (r.status, r.ttc_seconds) == (status, ttc)


def test_ttc_simple(spark):
    lit = lambda *a: [F.lit(float(x)) for x in a]
    assert value(spark, s.ttc_simple(*lit(10, 0, -2, 0))) == 4.25
    assert value(spark, s.ttc_simple(*lit(10, 0, 0, 0))) == 10.0
    assert value(spark, s.ttc_simple(*lit(10, 0, -0.1, 0), max_ttc=5)) == 5.0
    assert value(spark, s.ttc_simple(*lit(1.5, 0, -1, 0))) == 0.0


@pytest.mark.parametrize(("t", "ttc", "pet", "sev"), [(0.0, False, True, 1.0), (3.0, True, True, 0.4), (5.0, False, False, 0.0), (math.inf, False, False, 0.0), (1.0, True, True, 0.8)])
def test_critical_and_severity(spark, t, ttc, pet, sev):
    c = F.lit(t)
    assert (value(spark, s.ttc_is_critical(c)), value(spark, s.pet_is_critical(c))) == (ttc, pet)
    assert math.isclose(value(spark, s.severity(c)), sev)


def test_closing_speed_angles_sigmoid(spark):
    lit = lambda *a: [F.lit(float(x)) for x in a]
    assert value(spark, s.closing_speed(*lit(3, 4, -3, -4, 5))) == 5.0
    assert value(spark, s.closing_speed(*lit(0, 0, 1, 1, 0))) == 0.0
    assert math.isclose(value(spark, s.wrap_angle(F.lit(3 * math.pi / 2))), -math.pi / 2)
    assert value(spark, s.sigmoid(F.lit(-1000.0))) == 0.0
    assert value(spark, s.drac(F.lit(4.0), F.lit(2.0))) == 4.0
    assert value(spark, s.toy_ssm_value(F.lit(20))) == 0.0


def test_z_score(spark):
    assert value(spark, s.z_score(F.array(F.lit(3.0), F.lit(5.0)), [1.0, 5.0], [2.0, 0.0])) == [1.0, 0.0]
    assert value(spark, s.z_score(F.array(F.lit(3.0)), None, None)) == [3.0]


BOX = (10.0, 20.0, 30.0, 60.0)


def detection(spark, box=BOX, confidence=0.5, frame=0):
    return spark.createDataFrame([("v", frame, None, "car", confidence, box)], records.DETECTION)


def test_records(spark):
    r = value(spark, s.bbox_bottom_center(*(F.lit(x) for x in BOX)))
    assert (r.x, r.y) == (20.0, 60.0)
    assert records.validate(detection(spark), "detection").count() == 0
    assert records.validate(detection(spark, (30.0, 20.0, 10.0, 60.0)), "detection").first().reason == "bbox x2 must be >= x1"
    assert records.validate(detection(spark, (math.nan, 0.0, 1.0, 1.0)), "detection").count() == 0
    assert records.validate(detection(spark, confidence=math.nan), "detection").count() == 1
    assert records.validate(detection(spark, frame=-1), "detection").count() == 1
    with pytest.raises(PySparkException):
        records.validate(detection(spark, frame=-1), "detection", strict=True).collect()
    with pytest.raises(ValueError, match="unknown record kind"):
        records.validate(detection(spark), "ghost")
    assert '"actor_id":null' in records.as_json(detection(spark)).first().record


def test_other_records(spark):
    video = spark.createDataFrame([("v", "f", "l", 0.0, 1, 1, None, None, {})], records.VIDEO)
    event = spark.createDataFrame([("v", "e", "PET", "a", "b", 5, 3, 1.0, None, None, {})], records.SSM_EVENT)
    place = spark.createDataFrame([("v", 0, "t", "car", 0.0, 0.0, -1.0, None, None, None, "homography")], records.TRAJECTORY)
    assert [records.validate(d, k).count() for d, k in ((video, "video"), (event, "ssm_event"), (place, "trajectory"))] == [1, 1, 1]


def test_track_to_detection(spark):
    tracks = spark.createDataFrame([("v", 0, "t1", "car", BOX, None, None, False), ("v", 1, "t1", "car", BOX, (1.0, 2.0), 0.5, False)], records.TRACK)
    assert [(r.actor_id, r.confidence) for r in records.track_to_detection(tracks).orderBy("frame_idx").collect()] == [("t1", 1.0), ("t1", 0.5)]
    at = calibration.tracks_to_world(tracks, np.diag([2.0, 2.0, 1.0])).orderBy("frame_idx").collect()
    assert [(r.x_m, r.y_m) for r in at] == [(40.0, 120.0), (2.0, 4.0)]


def test_homography(spark):
    h = np.array([[1.2, 0.1, 3.0], [-0.05, 0.9, 1.0], [0.0005, 0.0002, 1.0]])
    rng = np.random.default_rng(0)
    p = rng.uniform(0, 100, (12, 2))
    q = np.c_[p, np.ones(12)] @ h.T
    q = q[:, :2] / q[:, 2:]
    got = calibration.fit_homography(p, q)
    assert np.allclose(got.matrix, h, atol=1e-8)
    assert got.rms_error < 1e-8
    noisy = calibration.fit_homography(p, q + rng.normal(0, 0.1, q.shape))
    assert 0.01 < noisy.rms_error < 0.2
    assert np.allclose(calibration.invert(h) @ h, np.eye(3))
    with pytest.raises(ValueError, match="4 pairs"):
        calibration.fit_homography(p[:3], q[:3])
    flat = spark.createDataFrame([(1.0, 1.0)], "x double, y double")
    with pytest.raises(PySparkException):
        calibration.image_points_to_world(flat, np.array([[1, 0, 0], [0, 1, 0], [1, -1, 0.0]])).collect()
    assert calibration.image_points_to_world(flat, np.array([[1, 0, 0], [0, 1, 0], [1, -1, 0.0]]), strict=False).first().x_m is None


def test_layout_constants():
    assert (v.node_feature_dim(), v.edge_feature_dim(), v.class_slice()) == (19, 15, slice(11, 19))
    assert v.node_feature_index("speed") == 4
    with pytest.raises(KeyError, match="valid"):
        v.node_feature_index("mass")
