"""Record schemas and their validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.scalars import bbox_bottom_center


# Schemas as DDL, as readers and createDataFrame take them.
BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
VIDEO = "video_id string, file_name string, location string, fps double, width int, height int, start_time string, duration_sec double, metadata map<string,string>"
DETECTION = f"video_id string, frame_idx int, actor_id string, class_name string, confidence double, bbox {BOX}"
TRACK = f"video_id string, frame_idx int, track_id string, class_name string, bbox {BOX}, footpoint_img struct<x:double,y:double>, confidence double, occluded boolean"
TRAJECTORY = "video_id string, frame_idx int, track_id string, class_name string, x_m double, y_m double, t_sec double, speed_mps double, heading_rad double, accel_mps2 double, source string"
SSM_EVENT = "video_id string, event_id string, metric_name string, track_id_a string, track_id_b string, start_frame int, end_frame int, min_value double, threshold double, severity string, metadata map<string,string>"


def _below(a: Column, b: Column) -> Column:
    """a < b as plain floating-point comparison: false where either is NaN (a SQL engine ranks NaN above all)."""
    return F.coalesce((a < b) & ~F.isnan(a) & ~F.isnan(b), F.lit(False))


def _outside_unit(c: Column) -> Column:
    return F.isnan(c) | (c < 0) | (c > 1)


def _box() -> list[tuple[Column, str]]:
    return [(_below(F.col("bbox.x2"), F.col("bbox.x1")), "bbox x2 must be >= x1"), (_below(F.col("bbox.y2"), F.col("bbox.y1")), "bbox y2 must be >= y1")]


def rules(kind: str) -> list[tuple[Column, str]]:
    """(violation, reason) pairs of a record kind, in the order in which they are tested."""
    frame = (F.col("frame_idx") < 0, "frame_idx must be >= 0") if kind in ("detection", "track", "trajectory") else None
    table = {
        "video": lambda: [(~(F.col("fps") > 0) | F.isnan("fps"), "fps must be > 0"), ((F.col("width") <= 0) | (F.col("height") <= 0), "width and height must be > 0")],
        "detection": lambda: [*_box(), (_outside_unit(F.col("confidence")), "confidence must be in [0, 1]"), frame],
        "track": lambda: [*_box(), frame, (F.col("confidence").isNotNull() & _outside_unit(F.col("confidence")), "confidence must be in [0, 1]")],
        "trajectory": lambda: [frame, (_below(F.col("t_sec"), F.lit(0.0)), "t_sec must be >= 0")],
        "ssm_event": lambda: [(F.col("start_frame") > F.col("end_frame"), "start_frame must be <= end_frame")],
    }
    if kind not in table:
        raise ValueError(f"unknown record kind {kind!r}; available: {sorted(table)}")
    return table[kind]()


def validate(records: DataFrame, kind: str, strict: bool = False) -> DataFrame:
    """Strict: the records, and an error at the first bad one when they are read. Else the bad records with ``reason``, the first that applies."""
    reason = F.lit(None).cast("string")
    for bad, why in reversed(rules(kind)):
        reason = F.when(F.coalesce(bad, F.lit(False)), why).otherwise(reason)
    if strict:
        return records.where(F.when(reason.isNotNull(), F.raise_error(reason).cast("boolean")).otherwise(True))
    return records.withColumn("reason", reason).where("reason is not null")


def track_to_detection(tracks: DataFrame, confidence: float = 1.0) -> DataFrame:
    return tracks.select("video_id", "frame_idx", F.col("track_id").alias("actor_id"), "class_name", F.coalesce("confidence", F.lit(float(confidence))).alias("confidence"), "bbox")


def footpoint() -> Column:
    """The track's foot point, else the middle of its box's lower edge."""
    return F.coalesce(F.col("footpoint_img"), bbox_bottom_center("bbox.x1", "bbox.y1", "bbox.x2", "bbox.y2"))


def as_json(records: DataFrame, name: str = "record") -> DataFrame:
    return records.select(F.to_json(F.struct(*records.columns), {"ignoreNullFields": "false"}).alias(name))
