"""Windows over frames and spatio-temporal graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.numbering import row_number, running_sum
from roadweave.functions.scalars import require_columns, safe_float
from roadweave.functions.vocabulary import EDGE_FEATURES
from roadweave.operators.graphs import GraphConfig
from roadweave.operators.neighbours import neighbour_sums


def sliding_windows(frames: DataFrame, video_col: str = "video_id", frame_col: str = "frame_id", window_size: int = 8, stride: int = 1) -> DataFrame:
    """(video, window_index, position, frame): windows over the frames of a video in order, gaps allowed; short tails dropped.

    Window numbers count over videos in the order of their ids. A frame's windows follow from its place and
    the video's length, so no windows are enumerated apart.
    """
    if window_size < 1 or stride < 1:
        raise ValueError("window_size and stride must be >= 1")
    require_columns(frames, video_col, frame_col)
    own = Window.partitionBy(video_col)
    placed = frames.select(video_col, frame_col).distinct().withColumns({"p": F.row_number().over(own.orderBy(frame_col)) - 1, "n": F.count("*").over(own)}).where(F.col("n") >= window_size)
    per_video = frames.select(video_col, frame_col).distinct().groupBy(video_col).agg(F.count("*").alias("n")).where(F.col("n") >= window_size)
    windows = F.floor((F.col("n") - window_size) / stride).cast("long") + 1
    base = running_sum(per_video, [video_col], windows, "base").select(video_col, "base")
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - window_size + 1) / stride)).cast("long")
    last = F.least(F.floor(F.col("p") / stride), F.floor((F.col("n") - window_size) / stride)).cast("long")
    members = placed.where(first <= last).withColumn("w", F.explode(F.sequence(first, last)))
    return members.join(base, video_col).select(
        video_col, (F.col("base") + F.col("w")).alias("window_index"), (F.col("p") - F.col("w") * stride).cast("int").alias("position"), frame_col
    )


def tumbling_windows(graphs: DataFrame, order_col: str, window_size: int = 2, name_col: str | None = None, group_cols: list[str] | None = None) -> DataFrame:
    """(window_id, members, num_graphs): chunks of rows in order, the short last one kept; window_001 and on.

    Without ``group_cols`` all rows are numbered in one order, as one manifest of files is.
    """
    if window_size < 1:
        raise ValueError("window_size must be >= 1")
    by = group_cols or []
    if by:
        placed = graphs.withColumn("__p", F.row_number().over(Window.partitionBy(*by).orderBy(order_col)) - 1)
    else:
        placed = row_number(graphs, [order_col], "__p")
    rows = placed.withColumn("__w", F.floor(F.col("__p") / window_size).cast("int")).groupBy(*by, "__w").agg(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(name_col or order_col).alias("m")))).alias("s"))
    return rows.select(*by, F.format_string("window_%03d", F.col("__w") + 1).alias("window_id"), F.transform("s", lambda x: x["m"]).alias("members"), F.size("s").alias("num_graphs"))


def window_nodes(windows: DataFrame, nodes: DataFrame, video_col: str = "video_id", frame_col: str = "frame_id") -> DataFrame:
    """Nodes of each window, numbered through its frames: window_node_id."""
    order = Window.partitionBy(video_col, "window_index").orderBy("position", "node_id")
    return windows.join(nodes, [video_col, frame_col]).withColumn("window_node_id", (F.row_number().over(order) - 1).cast("int"))


def temporal_edges(members: DataFrame, video_col: str = "video_id", connect_bidirectional: bool = True, skip_negative_tracks: bool = False) -> DataFrame:
    """(video, window_index, src, dst, edge_type 1): the same track in two consecutive frames of a window.

    A track's last node stands for it if a frame holds it more than once.
    """
    own = Window.partitionBy(video_col, "window_index", "position", "track_id").orderBy(F.col("node_id").desc())
    rows = members.withColumn("__r", F.row_number().over(own)).where("__r = 1").select(video_col, "window_index", "position", "track_id", "window_node_id")
    if skip_negative_tracks:
        rows = rows.where(safe_float("track_id") >= 0)
    key = [video_col, "window_index", "track_id", "position"]
    ahead = rows.withColumn("position", F.col("position") - 1).withColumnRenamed("window_node_id", "next_id")
    pairs = rows.join(ahead, key)
    ends = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    both = [ends("window_node_id", "next_id"), *([ends("next_id", "window_node_id")] if connect_bidirectional else [])]
    return pairs.select(video_col, "window_index", F.explode(F.array(*both)).alias("e")).select(video_col, "window_index", "e.src", "e.dst", F.lit(1).alias("edge_type"))


def spatial_window_edges(members: DataFrame, edges: DataFrame, video_col: str = "video_id", frame_col: str = "frame_id") -> DataFrame:
    """Edges of the frames of each window, with the window's node numbers; edge_type 0."""
    ids = members.select(video_col, frame_col, "window_index", "node_id", "window_node_id")
    a = ids.withColumnRenamed("node_id", "src").withColumnRenamed("window_node_id", "__s")
    b = ids.withColumnRenamed("node_id", "dst").withColumnRenamed("window_node_id", "__d")
    out = edges.join(a, [video_col, frame_col, "src"]).join(b, [video_col, frame_col, "window_index", "dst"])
    return out.select(video_col, "window_index", F.col("__s").alias("src"), F.col("__d").alias("dst"), F.lit(0).alias("edge_type"), "features")


def window_graphs(nodes: DataFrame, edges: DataFrame, video_col: str = "video_id", frame_col: str = "frame_id", window_size: int = 8, stride: int = 1,
                  connect_bidirectional: bool = True, skip_negative_tracks: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all windows; temporal edges have zero features of the same width."""
    require_columns(nodes, video_col, frame_col, "node_id", "track_id", "features")
    require_columns(edges, video_col, frame_col, "src", "dst", "features")
    windows = sliding_windows(nodes.select(video_col, frame_col), video_col, frame_col, window_size, stride)
    members = window_nodes(windows, nodes, video_col, frame_col)
    zero = F.array_repeat(F.lit(0.0), len(EDGE_FEATURES)).alias("features")
    time = temporal_edges(members, video_col, connect_bidirectional, skip_negative_tracks).select("*", zero)
    return members, spatial_window_edges(members, edges, video_col, frame_col).unionByName(time)


def window_edge_sums(nodes: DataFrame, config: GraphConfig = GraphConfig(), video_col: str = "video_id", frame_col: str = "frame_id", window_size: int = 8, stride: int = 1,
                     connect_bidirectional: bool = True, skip_negative_tracks: bool = False) -> DataFrame:
    """(video, window_index, edge_type, n, src_sum, dst_sum): number and sums of the node numbers of the edges that ``window_graphs`` gives for ``graphs.build_edges``.

    A node's edges in a window are those of its frame, so its degree, found once for each frame, says what it adds; no edge is listed.
    """
    windows = sliding_windows(nodes.select(video_col, frame_col), video_col, frame_col, window_size, stride)
    members = window_nodes(windows, nodes.select(video_col, frame_col, "node_id", "track_id"), video_col, frame_col)
    degrees = neighbour_sums(nodes, [video_col, frame_col], config)
    ends = F.sum(F.col("degree") * F.col("window_node_id"))
    space = members.join(degrees, [video_col, frame_col, "node_id"]).groupBy(video_col, "window_index").agg(F.lit(0).alias("edge_type"), F.sum("degree").alias("n"), ends.alias("src_sum"), ends.alias("dst_sum"))
    time = temporal_edges(members, video_col, connect_bidirectional, skip_negative_tracks).groupBy(video_col, "window_index", "edge_type").agg(F.count("*").alias("n"), F.sum("src").alias("src_sum"), F.sum("dst").alias("dst_sum"))
    return space.where("n > 0").unionByName(time)


def last_label(members: DataFrame, label: Column, video_col: str = "video_id") -> DataFrame:
    """Label of the last frame of each window that has one."""
    return members.groupBy(video_col, "window_index").agg(F.max_by(F.when(label.isNotNull(), label), F.when(label.isNotNull(), F.col("position"))).alias("y"))
