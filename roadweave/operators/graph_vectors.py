"""Graph-level feature vectors: 42 numbers for each graph, from tables of nodes and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATS = ["mean", "std", "min", "max"]
ATTRIBUTES = ["frame_id", "video_id", "track_id", "node_frame_index", "actor_class_index"]

COLUMNS = [
    "num_nodes", "num_edges", "density", "node_dim", "edge_dim", "pos_dim",
    *(f"{b}_{s}" for b in ("x", "x_l2") for s in STATS), "x_nonzero",
    *(f"{b}_{s}" for b in ("e", "e_l2") for s in STATS), "e_nonzero",
    *(f"pos_{s}" for s in STATS), *(f"y_{s}" for s in STATS),
    *(f"{a}_{s}" for a in ATTRIBUTES for s in ("mean", "unique")),
]


def _fold(c: Column, f) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda acc, v: acc + f(v))


def _array_stats(rows: DataFrame, key: list[str], column: str, name: str, l2: bool) -> DataFrame:
    """Mean, deviation, least, most of all entries (and of row norms), share of nonzero entries: sums per row first, then per graph, nothing exploded."""
    v = F.col(column)
    per = rows.where(F.size(v) > 0).select(
        *key, F.size(v).alias("n"), _fold(v, lambda x: x).alias("s"), _fold(v, lambda x: x * x).alias("ss"), F.array_min(v).alias("lo"), F.array_max(v).alias("hi"), _fold(v, lambda x: F.when(x != 0, 1.0).otherwise(0.0)).alias("nz")
    ).withColumn("l2", F.sqrt("ss"))
    mean = F.sum("s") / F.sum("n")
    out = [mean.alias(f"{name}_mean"), F.sqrt(F.greatest(F.sum("ss") / F.sum("n") - mean * mean, F.lit(0.0))).alias(f"{name}_std"), F.min("lo").alias(f"{name}_min"), F.max("hi").alias(f"{name}_max"), F.max("n").alias(f"{name}_dim")]
    if l2:
        out += [F.avg("l2").alias(f"{name}_l2_mean"), F.stddev_pop("l2").alias(f"{name}_l2_std"), F.min("l2").alias(f"{name}_l2_min"), F.max("l2").alias(f"{name}_l2_max"), (F.sum("nz") / F.sum("n")).alias(f"{name}_nonzero")]
    return per.groupBy(*key).agg(*out)


def graph_vectors(nodes: DataFrame, edges: DataFrame, key: list[str], labels: DataFrame | None = None, include_label_stats: bool = True) -> DataFrame:
    """One row per graph with the columns of COLUMNS, zeros where there is nothing.

    nodes: key, features, pos? and any of the attributes; edges: key, features; labels: key, y.
    Statistics of the label are part of the layout; leave them out of honest training.
    """
    counted = [F.count("*").alias("num_nodes")]
    for a in ATTRIBUTES:
        if a in nodes.columns:
            counted += [F.avg(F.col(a).try_cast("double")).alias(f"{a}_mean"), F.count_distinct(a).cast("double").alias(f"{a}_unique")]
    out = nodes.groupBy(*key).agg(*counted).join(_array_stats(nodes, key, "features", "x", True), key, "left")
    if "pos" in nodes.columns:
        out = out.join(_array_stats(nodes, key, "pos", "pos", False), key, "left")
    out = out.join(edges.groupBy(*key).agg(F.count("*").alias("num_edges")), key, "left").join(_array_stats(edges, key, "features", "e", True), key, "left")
    if labels is not None and include_label_stats:
        y = F.col("y").cast("double")
        out = out.join(labels.groupBy(*key).agg(F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), F.min(y).alias("y_min"), F.max(y).alias("y_max")), key, "left")
    n, m = F.col("num_nodes"), F.coalesce("num_edges", F.lit(0))
    out = out.withColumns({"density": F.when(n > 1, m / F.greatest(n * (n - 1), F.lit(1))).otherwise(0.0), "node_dim": F.col("x_dim"), "edge_dim": F.col("e_dim")})
    have = set(out.columns)
    return out.select(*key, *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) if c in have else F.lit(0.0).alias(c) for c in COLUMNS))


def as_array(vectors: DataFrame, key: list[str]) -> DataFrame:
    return vectors.select(*key, F.array(*COLUMNS).alias("features"))
