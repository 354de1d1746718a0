"""Trajectories: time, smoothing, kinematics, nearby pairs and conflict pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.numbering import task_count
from roadweave.functions.scalars import distance, nan_to_null, require_columns
from roadweave.operators import crowded, pair_lists, track_blocks


#: Chunks of a key in the plain join of near points; the other side goes to each.
CHUNKS = 16


def keys_of(df: DataFrame, *names: str, video_col: str = "video_id", per_video: bool = True) -> list[str]:
    """Key columns, with the video if the table has one and per_video holds (without it, videos are mixed)."""
    return [*([video_col] if per_video and video_col in df.columns else []), *names]


def add_time_seconds(df: DataFrame, fps: float, frame_col: str = "frame_idx") -> DataFrame:
    if fps <= 0:
        raise ValueError(f"fps has to be positive: {fps}")
    require_columns(df, frame_col)
    return df.withColumn("t_sec", F.col(frame_col).cast("double") / F.lit(float(fps)))


def smooth_positions(df: DataFrame, order_col: str, track_id_col: str = "track_id", x_col: str = "x_m", y_col: str = "y_m", window: int = 3, per_video: bool = True) -> DataFrame:
    """Centred moving mean of each track's places; gaps (null or NaN) are skipped and filled.

    ``order_col`` stands for row order. An even window reaches one row further back than ahead.
    """
    if window < 1:
        raise ValueError(f"window has to hold a row at least: {window}")
    require_columns(df, order_col, track_id_col, x_col, y_col)
    near = Window.partitionBy(*keys_of(df, track_id_col, per_video=per_video)).orderBy(order_col).rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumns({c: F.avg(nan_to_null(c)).over(near) for c in (x_col, y_col)})


def compute_kinematics(df: DataFrame, track_id_col: str = "track_id", frame_col: str = "frame_idx", x_col: str = "x_m", y_col: str = "y_m", fps: float = 30.0, per_video: bool = True) -> DataFrame:
    """Adds t_sec, dx, dy, dt, distance_m, speed_mps, heading_rad, vx_mps, vy_mps and accel_mps2 by one window over (track, frame).

    Null at a track's first row and where time stands still.
    """
    if fps <= 0:
        raise ValueError(f"fps has to be positive: {fps}")
    require_columns(df, track_id_col, frame_col, x_col, y_col)
    along = Window.partitionBy(*keys_of(df, track_id_col, per_video=per_video)).orderBy(frame_col)
    step = lambda c: c - F.lag(c).over(along)
    per_second = lambda c: F.try_divide(F.col(c), F.col("dt"))
    out = add_time_seconds(df.withColumns({x_col: nan_to_null(x_col), y_col: nan_to_null(y_col)}), fps, frame_col)
    out = out.withColumns({"dx": step(F.col(x_col)), "dy": step(F.col(y_col)), "dt": step(F.col("t_sec"))})
    out = out.withColumn("distance_m", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    out = out.withColumns({"speed_mps": per_second("distance_m"), "heading_rad": F.atan2("dy", "dx"), "vx_mps": per_second("dx"), "vy_mps": per_second("dy")})
    return out.withColumn("accel_mps2", F.try_divide(step(F.col("speed_mps")), F.col("dt")))


def pairs_within(points: DataFrame, key: list[str], id_col: str, radius: float, condition: Column | None = None, inclusive: bool = False, bucketed: bool | str = False, x_col: str = "x_m", y_col: str = "y_m", wanted: DataFrame | None = None) -> DataFrame:
    """Unordered pairs of points of one key closer than ``radius``: structs a and b (a's id smaller) and dist.

    Plain: an equi-join by key and a chunk of one side's points, with the distance as a condition of the join. Bucketed: by key and a grid
    of cells as wide as the radius, one side also sent to the 8 cells around; a pair meets in exactly one
    cell, so a crowded frame is dealt over its cells. ``"tree"``: by a quadtree, so that crowded cells are
    dealt too (``crowded.pairs_by_tree``). All give the same pairs. ``condition`` may use a and b.
    ``wanted`` (__a, __b) are the only pairs of ids that may meet: the first goes along as a part of the key.
    """
    if bucketed == "tree" and wanted is None:
        out = crowded.pairs_by_tree(points, key, id_col, radius, inclusive, x_col=x_col, y_col=y_col)
        return out if condition is None else out.where(condition)
    gap = lambda: distance(F.col("r.__x") - F.col("l.__x"), F.col("r.__y") - F.col("l.__y"))
    all_of = F.struct(*(F.col(c) for c in points.columns))
    placed = points.where(F.col(x_col).isNotNull() & F.col(y_col).isNotNull())
    names = [f"__k{i}" for i in range(len(key))]
    # what every comparison reads stands outside the structs
    own = [*(F.col(k).alias(n) for k, n in zip(key, names)), F.col(x_col).alias("__x"), F.col(y_col).alias("__y"), F.col(id_col).alias("__id")]
    one, two = placed.select(*own, all_of.alias("a")), placed.select(*own, all_of.alias("b"))
    if bucketed:
        cell = lambda s, c: F.floor(F.col(s)[c] / F.lit(float(radius)))
        one = one.withColumns({"__cx": cell("a", x_col), "__cy": cell("a", y_col)})
        around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
        two = two.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around))
        two = two.withColumns({"__cx": cell("b", x_col) + F.col("__dx"), "__cy": cell("b", y_col) + F.col("__dy")}).drop("__dx", "__dy")
        names = [*names, "__cx", "__cy"]
    if wanted is not None:
        one = one.withColumn("__a", F.col("a")[id_col]).join(wanted, "__a").drop("__a")
        two = two.withColumn("__b", F.col("b")[id_col])
        names = [*names, "__b"]
    if not bucketed and wanted is None:  # a frame is dealt into chunks, as one key would be one task
        one = one.withColumn("__chunk", F.pmod(F.xxhash64("__id", "__x", "__y"), F.lit(CHUNKS)).cast("int"))
        two = two.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.lit(CHUNKS - 1))))
        names = [*names, "__chunk"]
    one, two = (side.repartition(task_count(points), *names) for side in (one, two))
    near = gap() <= radius if inclusive else gap() < radius
    joined = one.alias("l").join(two.alias("r"), [F.col(f"l.{n}") == F.col(f"r.{n}") for n in names] + [near, F.col("l.__id") < F.col("r.__id")])
    out = joined.select("a", "b", gap().alias("dist"))
    return out if condition is None else out.where(condition)


def find_nearby_pairs(df: DataFrame, frame_col: str = "frame_idx", track_col: str = "track_id", x_col: str = "x_m", y_col: str = "y_m", distance_threshold: float = 15.0,
                      speed_col: str | None = None, bucketed: bool | str = True, per_video: bool = True, mark_repeated: bool = False, carry: tuple[str, ...] = (), listed: bool = False, digits: int | None = None) -> DataFrame:
    """(frame, track_id_a, track_id_b, dist[, rel_speed]): pairs strictly closer than the threshold, ids ordered as strings.

    ``mark_repeated`` adds ``repeated``: whether a track of the pair has several rows in the frame.
    ``carry`` adds structs a and b with x_m, y_m and these columns.
    ``listed``: pairs leave numpy tasks as finished rows (``pair_lists``, by chunks if not bucketed), rounded if ``digits`` are given: for
    crowded frames, and for the four plain columns only.
    """
    if listed and (speed_col or mark_repeated or carry or bucketed == "tree"):
        raise ValueError("listed pairs have no other columns and no tree")
    require_columns(df, frame_col, track_col, x_col, y_col)
    key = keys_of(df, frame_col, per_video=per_video)
    speed = speed_col if speed_col and speed_col in df.columns else None
    points = df.select(
        *key, F.col(track_col).cast("string").alias("track"), nan_to_null(x_col).alias("x_m"), nan_to_null(y_col).alias("y_m"), *([nan_to_null(speed).alias("speed")] if speed else []), *carry
    ).where(F.col(frame_col).isNotNull())
    if mark_repeated:  # partitioned by track already where kinematics came before
        points = points.withColumn("repeated", F.count("*").over(Window.partitionBy(*key, "track")) > 1)
    if listed:
        return pair_lists.list_nearby(points, key, distance_threshold, digits, 0 if bucketed else CHUNKS // 2)
    pairs = pairs_within(points, key, "track", distance_threshold, bucketed=bucketed)
    return pairs.select(
        *(F.col("a")[k].alias(k) for k in key), F.col("a.track").alias("track_id_a"), F.col("b.track").alias("track_id_b"), "dist",
        *([F.abs(F.col("a.speed") - F.col("b.speed")).alias("rel_speed")] if speed else []), *([(F.col("a.repeated") | F.col("b.repeated")).alias("repeated")] if mark_repeated else []), *(["a", "b"] if carry else []),
    )


def compute_conflict_pairs(df: DataFrame, frame_col: str = "frame_idx", track_col: str = "track_id", x_col: str = "x_m", y_col: str = "y_m", speed_col: str = "speed_mps",
                           min_interaction_frames: int = 3, distance_threshold: float = 15.0, bucketed: bool = True, per_video: bool = True, blocks: int = 0) -> DataFrame:
    """Pairs near each other in enough frames: frame_indices, min_distance, min_distance_frame, avg_relative_speed.

    Duplicate rows of a track in a frame count as near frames, once each, but their distances and speeds don't.
    ``blocks`` deals tracks into so many blocks that meet pair by pair, in place of a join of near rows: for crowded
    frames, where near rows are many for each row (``track_blocks``).
    """
    if blocks:
        return track_blocks.conflict_measures(block_points(df, frame_col, track_col, x_col, y_col, speed_col, per_video), keys_of(df, per_video=per_video), frame_col, distance_threshold, min_interaction_frames, blocks)
    near = find_nearby_pairs(df, frame_col, track_col, x_col, y_col, distance_threshold, speed_col, bucketed, per_video, mark_repeated=True)
    return near.groupBy(*keys_of(df, per_video=per_video), "track_id_a", "track_id_b").agg(*conflict_measures(near, frame_col)).where(F.col("n_frames") >= min_interaction_frames)


def block_points(df: DataFrame, frame_col: str, track_col: str, x_col: str, y_col: str, speed_col: str, per_video: bool, carry: tuple[str, ...] = ()) -> DataFrame:
    """What ``track_blocks.conflict_measures`` reads."""
    require_columns(df, frame_col, track_col, x_col, y_col)
    speed = nan_to_null(speed_col) if speed_col in df.columns else F.lit(None).cast("double")
    return df.select(*keys_of(df, frame_col, per_video=per_video), F.col(track_col).cast("string").alias("track"), nan_to_null(x_col).alias("x_m"), nan_to_null(y_col).alias("y_m"), speed.alias("speed"), *carry)


def conflict_measures(near: DataFrame, frame_col: str) -> list[Column]:
    """Aggregates of a pair's near frames (dist, rel_speed if there is one, repeated)."""
    dist, speed = F.when(~F.col("repeated"), F.col("dist")), F.when(~F.col("repeated"), F.col("rel_speed")) if "rel_speed" in near.columns else F.lit(None).cast("double")
    return [
        F.sort_array(F.collect_list(frame_col)).alias("frame_indices"), F.count("*").alias("n_frames"), F.coalesce(F.min(dist), F.lit(float("inf"))).alias("min_distance"),
        F.coalesce(F.min(F.when(~F.col("repeated"), F.struct("dist", F.col(frame_col).alias("f"))))["f"], F.lit(-1)).alias("min_distance_frame"),
        F.coalesce(F.avg(speed), F.lit(0.0)).alias("avg_relative_speed"),
    ]


def filter_meaningful_conflicts(pairs: DataFrame, max_min_distance: float = 5.0, min_avg_speed: float = 0.0) -> DataFrame:
    return pairs.where((F.col("min_distance") <= max_min_distance) & (F.col("avg_relative_speed") >= min_avg_speed))
