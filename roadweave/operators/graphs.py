"""Interaction graphs of all frames at once: a nodes table and an edges table, and their nested forms.

nodes: key columns, node_id, track_id, actor_class, class_index, the base channels and ``features``.
edges: key columns, src, dst, ordinal, the edge channels and ``features``. One node is one actor row.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.scalars import actor_class, class_index, closing_speed, one_hot, pair_radius, safe_float, size_prior, ttc_simple, wrap_angle, z_score
from roadweave.functions.vocabulary import ACTOR_CLASSES, EDGE_FEATURES, NODE_FEATURES, ODD_EDGE_FEATURES, PAIR_RADII
from roadweave.operators import pair_lists
from roadweave.operators.trajectories import pairs_within


@dataclass
class GraphConfig:
    """Options of the graph builder. Self-loops never appear: coinciding actors have no edge.

    ``radius`` serves class pairs outside the table, or all pairs without class radii. A speed-adaptive radius
    has no bound: every pair within its own radius is an edge.
    """

    radius: float = 6.0
    directed: bool = True
    actor_classes: list[str] | None = None
    pair_radii: dict[tuple[str, str], float] | None = None
    use_class_specific_radii: bool = True
    use_velocity_adaptive_radius: bool = False
    velocity_radius_scale: float = 0.5
    min_closing_speed: float | None = None
    max_ttc: float | None = None
    collision_radius: float = 1.5
    bucketed: bool = True

    @property
    def classes(self) -> list[str]:
        return ACTOR_CLASSES if self.actor_classes is None else self.actor_classes

    @property
    def radii(self) -> dict[tuple[str, str], float]:
        return PAIR_RADII if self.pair_radii is None else self.pair_radii

    @property
    def search_radius(self) -> float:
        """No pair farther apart is an edge; infinite if radii grow with speeds."""
        if self.use_velocity_adaptive_radius:
            return float("inf")
        return max([self.radius, *self.radii.values()]) if self.use_class_specific_radii else self.radius


def _first(df: DataFrame, *names: str) -> Column | None:
    found = [F.col(n) for n in names if n in df.columns]
    return F.coalesce(*found) if found else None


def build_nodes(actors: DataFrame, key: list[str], config: GraphConfig = GraphConfig(), order_col: str | None = None, numeric_tracks: bool = False) -> DataFrame:
    """Nodes of every frame. Aliases: x_m before x, heading_rad before heading, actor_class before class_name, class, label.

    ``order_col`` gives the row order within a frame (default: track id). ``numeric_tracks`` reads ids as
    whole numbers, other strings as 0; else they stay as they are.
    """
    num = lambda *names: F.lit(0.0) if (c := _first(actors, *names)) is None else safe_float(c)
    order = order_col or "track_id"
    position = (F.row_number().over(Window.partitionBy(*key).orderBy(order)) - 1).cast("int")
    labels = [F.col(n).cast("string") for n in ("actor_class", "class_name", "class", "label") if n in actors.columns]
    out = actors.withColumn("node_id", position)
    track = F.col("node_id").cast("long") if "track_id" not in actors.columns else safe_float("track_id").cast("long") if numeric_tracks else F.col("track_id")
    out = out.select(
        *key, "node_id", track.alias("track_id"), (actor_class(*labels, classes=None) if labels else F.lit("other")).alias("actor_class"),
        num("x_m", "x").alias("x"), num("y_m", "y").alias("y"), num("vx", "vx_mps").alias("vx"), num("vy", "vy_mps").alias("vy"),
        num("ax").alias("ax"), num("ay").alias("ay"), num("heading_rad", "heading").alias("heading"),
    )
    out = out.withColumns({
        "speed": F.hypot("vx", "vy"), "accel_mag": F.hypot("ax", "ay"), "sin_heading": F.sin("heading"), "cos_heading": F.cos("heading"),
        "size_prior": size_prior("actor_class"), "class_index": class_index("actor_class", config.classes, strict=True),
    })
    return out.withColumn("features", F.concat(F.array(*NODE_FEATURES), one_hot("actor_class", config.classes)))


def edge_channels(config: GraphConfig) -> dict[str, Column]:
    """The named channels of a pair row with structs a (source) and b (target)."""
    a, b = (lambda c: F.col("a")[c]), (lambda c: F.col("b")[c])
    turn = wrap_angle(b("heading") - a("heading"))
    return {
        "dx": b("x") - a("x"), "dy": b("y") - a("y"), "distance": F.col("dist"), "dvx": b("vx") - a("vx"), "dvy": b("vy") - a("vy"),
        "relative_speed": F.hypot(b("vx") - a("vx"), b("vy") - a("vy")),
        "closing_speed": closing_speed(b("x") - a("x"), b("y") - a("y"), b("vx") - a("vx"), b("vy") - a("vy"), F.col("dist")),
        "bearing_sin": F.when(F.col("dist") > 1e-8, (b("y") - a("y")) / F.col("dist")).otherwise(0.0),
        "bearing_cos": F.when(F.col("dist") > 1e-8, (b("x") - a("x")) / F.col("dist")).otherwise(0.0),
        "rel_heading_sin": F.sin(turn), "rel_heading_cos": F.cos(turn),
        "ttc": ttc_simple(b("x") - a("x"), b("y") - a("y"), b("vx") - a("vx"), b("vy") - a("vy"), config.collision_radius, 10.0 if config.max_ttc is None else config.max_ttc),
        "same_class": (a("actor_class") == b("actor_class")).cast("double"), "size_src": a("size_prior"), "size_dst": b("size_prior"),
    }


def reversed_channels() -> dict[str, Column]:
    """The channels of the opposite direction, from those of one direction."""
    out = {c: -F.col(c) if c in ODD_EDGE_FEATURES else F.col(c) for c in EDGE_FEATURES}
    return out | {"size_src": F.col("size_dst"), "size_dst": F.col("size_src")}


def _near(nodes: DataFrame, key: list[str], config: GraphConfig, more: list[str]) -> DataFrame:
    """Pairs (a, b, dist) of nodes apart by more than 1e-8 and at most their radius. ``more``: what the structs hold beside places and classes."""
    radius = pair_radius("a.actor_class", "b.actor_class", config.radius, config.radii) if config.use_class_specific_radii else F.lit(float(config.radius))
    if config.use_velocity_adaptive_radius:
        radius = radius + config.velocity_radius_scale * F.greatest(F.col("a.speed"), F.col("b.speed"))
    points = nodes.select(*key, "node_id", "actor_class", "x", "y", "speed", *more)
    keep = (F.col("dist") > 1e-8) & (F.col("dist") <= radius)
    bound = config.search_radius
    return pairs_within(points, key, "node_id", bound, condition=keep, inclusive=True, bucketed=config.bucketed and bound < float("inf"), x_col="x", y_col="y")


def build_edges(nodes: DataFrame, key: list[str], config: GraphConfig = GraphConfig()) -> DataFrame:
    """Edges of every frame: pairs apart by more than 1e-8 and at most their radius; both directions if directed."""
    out = _near(nodes, key, config, ["vx", "vy", "heading", "size_prior"])
    out = out.select("*", *(c.alias(n) for n, c in edge_channels(config).items()))
    if config.min_closing_speed is not None:
        out = out.where(F.col("closing_speed") >= config.min_closing_speed)
    ends = lambda s, t, i: [F.col(f"{s}.node_id").alias("src"), F.col(f"{t}.node_id").alias("dst"), F.lit(i).alias("direction")]
    forward = F.struct(*ends("a", "b", 0), *(F.col(c) for c in EDGE_FEATURES))
    backward = F.struct(*ends("b", "a", 1), *(c.alias(n) for n, c in reversed_channels().items()))
    both = F.array(forward, backward) if config.directed else F.array(forward)
    out = out.select(*(F.col("a")[k].alias(k) for k in key), F.explode(both).alias("e")).select(*key, "e.*")
    return out.withColumn("features", F.array(*EDGE_FEATURES))


def first_edges(nodes: DataFrame, key: list[str], config: GraphConfig = GraphConfig()) -> DataFrame:
    """The first edge of each graph, by its smaller and larger node, forward.

    The least pair of node numbers is found without listing pairs (``pair_lists.first_pairs``); only its two nodes become an edge with channels.
    """
    if config.min_closing_speed is not None:
        pairs = build_edges(nodes, key, replace(config, directed=False)).select(*key, "src", "dst")
    else:
        pairs = pair_lists.first_pairs(nodes, key, config)
    first = pairs.groupBy(*key).agg(F.min(F.shiftleft(F.col("src").cast("long"), 32) + F.col("dst")).alias("__first"))
    ends = nodes.join(first, key).where((F.col("node_id") == F.shiftright("__first", 32)) | (F.col("node_id") == F.col("__first").bitwiseAND(F.lit((1 << 32) - 1)))).drop("__first")
    return build_edges(ends, key, replace(config, directed=False))


def edge_order() -> list[Column]:
    """Order of edges in a graph: pairs by their smaller and larger node, forward before backward."""
    return [F.least("src", "dst"), F.greatest("src", "dst"), F.col("direction")]


def undirected_edges(edges: DataFrame, key: list[str], paired: bool = False) -> DataFrame:
    """The first edge of each unordered pair, with 1-based src, dst and 0-based src_node, dst_node.

    ``paired``: edges as ``build_edges`` gives them, where each pair has one forward edge, which is its first; nothing is shuffled then.
    """
    if paired:
        kept = edges.where("src <> dst and direction = 0")
    else:
        first = F.row_number().over(Window.partitionBy(*key, F.least("src", "dst"), F.greatest("src", "dst")).orderBy("direction"))
        kept = edges.where("src <> dst").withColumn("__n", first).where("__n = 1").drop("__n")
    return kept.withColumns({"src_node": F.col("src"), "dst_node": F.col("dst"), "src": F.col("src") + 1, "dst": F.col("dst") + 1})


def normalize(nodes: DataFrame, edges: DataFrame, stats: dict[str, list[float] | None]) -> tuple[DataFrame, DataFrame]:
    return (
        nodes.withColumn("features", z_score("features", stats.get("node_mean"), stats.get("node_std"))),
        edges.withColumn("features", z_score("features", stats.get("edge_mean"), stats.get("edge_std"))),
    )


def build_graphs(actors: DataFrame, key: list[str], config: GraphConfig = GraphConfig(), stats: dict[str, list[float] | None] | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of all frames of a table of actors; features normalised if statistics are given."""
    nodes = build_nodes(actors, key, config, **options)
    edges = build_edges(nodes, key, config)
    return normalize(nodes, edges, stats) if stats else (nodes, edges)


def feature_stats(rows: DataFrame, column: str = "features") -> DataFrame:
    """(channel, mean, std): position by position over all arrays of a column; population deviation."""
    return rows.select(F.posexplode(column).alias("channel", "v")).groupBy("channel").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def compute_feature_stats(nodes: DataFrame, edges: DataFrame) -> dict[str, list[float] | None]:
    """Means and deviations as lists, one number for each channel."""
    out: dict[str, list[float] | None] = {}
    for name, rows in (("node", nodes), ("edge", edges)):
        got = sorted(map(tuple, feature_stats(rows).collect()))  # as many rows as channels
        out |= {f"{name}_mean": [m for _, m, _ in got] or None, f"{name}_std": [s for _, _, s in got] or None}
    return out


def nested_nodes(nodes: DataFrame, key: list[str]) -> DataFrame:
    """(key, nodes): the node structs of each frame as one array."""
    keep = ["node_id", "track_id", "actor_class", "x", "y", "features"]
    return nodes.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*keep))).alias("nodes"))


def nested_graphs(nodes: DataFrame, edges: DataFrame, key: list[str], radius: float = 6.0, form: str = "directed", paired: bool = False) -> DataFrame:
    """One row per frame with arrays of node and edge structs.

    ``directed``: every edge with its named channels. ``undirected``: one edge per pair with its feature vector;
    ``paired`` as for ``undirected_edges``.
    """
    by_node = nested_nodes(nodes, key)
    if form == "directed":
        rows = edges.select(*key, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(edge_order()))).alias("o"), F.struct(
            F.col("src").alias("src_node"), F.col("dst").alias("dst_node"), *((F.col(c) > 0.5 if c == "same_class" else F.col(c)).alias(c) for c in EDGE_FEATURES)).alias("e"))
    elif form == "undirected":
        rows = undirected_edges(edges, key, paired).select(*key, F.struct("src_node", "dst_node").alias("o"), F.struct("src", "dst", "src_node", "dst_node", "features").alias("e"))
    else:
        raise ValueError(f"unknown form {form!r}: directed or undirected")
    by_edge = rows.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "e"))), lambda x: x["e"]).alias("edges"))
    none = F.array().cast(by_edge.schema["edges"].dataType)
    return by_node.join(by_edge, key, "left").withColumn("edges", F.coalesce("edges", none)).select(
        *key, F.lit(True).alias("directed"), F.lit(float(radius)).alias("radius"), F.size("nodes").alias("num_nodes"), F.size("edges").alias("num_edges"), "nodes", "edges"
    )


def build_interaction_graph(actors: DataFrame, radius: float = 6.0, actor_classes: list[str] | None = None, ignore_video: bool = False, first_edge: bool = False) -> DataFrame:
    """Undirected nested graph of each frame, in ascending frame order. ``ignore_video`` mixes videos.

    ``first_edge``: with the first edge only, for exports that keep no other; the rest is found but never gathered.
    """
    key = ["frame_id"] if ignore_video or "video_id" not in actors.columns else ["video_id", "frame_id"]
    config = GraphConfig(radius=radius, actor_classes=actor_classes, directed=False)
    nodes = build_nodes(actors, key, config)
    edges = (first_edges if first_edge else build_edges)(nodes, key, config)
    return nested_graphs(nodes, edges, key, radius, "undirected", paired=True).orderBy(*key)


def _finite(column: str) -> Column:
    return ~F.exists(column, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def validate_graphs(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Six checks of each graph."""
    n = nodes.groupBy(*key).agg(F.count("*").alias("n"), F.bool_and(_finite("features")).alias("fn"))
    e = edges.groupBy(*key).agg(
        F.count("*").alias("m"), F.bool_and(_finite("features")).alias("fe"), F.min(F.least("src", "dst")).alias("lo"), F.max(F.greatest("src", "dst")).alias("hi"),
        F.bool_or(F.col("src") == F.col("dst")).alias("loops"),
    )
    return checks(n, e, key)


def checks(n: DataFrame, e: DataFrame, key: list[str]) -> DataFrame:
    """The six checks from measures of each graph's nodes (n, fn) and edges (m, fe, lo, hi, loops)."""
    count = F.coalesce("n", F.lit(0))
    return n.join(e, key, "full").select(
        *key, (count > 0).alias("has_nodes"), (F.coalesce("m", F.lit(0)) > 0).alias("has_edges"), F.coalesce("fn", F.lit(True)).alias("finite_node_features"),
        F.coalesce("fe", F.lit(True)).alias("finite_edge_features"), (F.coalesce("lo", F.lit(0)) >= 0).alias("_lo"), (F.col("hi").isNull() | (F.col("hi") < count)).alias("_hi"),
        (~F.coalesce("loops", F.lit(False))).alias("no_self_loops"),
    ).withColumn("valid_edge_indices", F.col("_lo") & F.col("_hi")).drop("_lo", "_hi")
