"""Composed jobs: tracks to risk events, actors to window graphs, labelled graphs to predictions. Each is one lazy plan."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.functions.scalars import round_digits
from roadweave.functions.vocabulary import ACTOR_CLASSES
from roadweave.operators import calibration, gcn, gcn_tables, graphs, metrics, safety, splits, temporal
from roadweave.operators.trajectories import compute_kinematics, filter_meaningful_conflicts, find_nearby_pairs, smooth_positions
from roadweave.sources import files


def event_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks from the events table: the first event of each user and day is a place; track_id, frame_idx, x_m, y_m, cls_idx.

    A partial aggregate, so a user's events of a day meet once.
    """
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    first = F.min(F.struct("event_id", "value"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("track_id"), day.alias("frame_idx")).agg(first.alias("e"))
    return rows.select("track_id", "frame_idx", F.col("e.value").alias("x_m"), (F.col("e.event_id") % 100).cast("double").alias("y_m"), (F.col("track_id") % 8).cast("int").alias("cls_idx"))


def event_actors(spark: SparkSession, sf_dir: str, video: bool = False) -> DataFrame:
    """Actors with velocities from those tracks; frame_id, track_id, actor_class, and a video for every fourth track."""
    names = F.array(*map(F.lit, ACTOR_CLASSES))
    rows = compute_kinematics(event_trajectories(spark, sf_dir), fps=1.0)
    out = rows.select(F.col("frame_idx").alias("frame_id"), "track_id", F.get(names, F.col("cls_idx")).alias("actor_class"), "x_m", "y_m", F.col("vx_mps").alias("vx"), F.col("vy_mps").alias("vy"), "heading_rad")
    return out.withColumn("video_id", F.concat(F.lit("v"), (F.col("track_id") % 4).cast("string"))) if video else out


def conflicts(tracks: DataFrame, h: np.ndarray | None = None, fps: float = 30.0, smooth: int | None = 3, distance_threshold: float = 15.0, min_frames: int = 3, max_min_distance: float | None = None, bucketed: bool = True) -> DataFrame:
    """Tracks -> pairs near each other long enough, with their least time to collision.

    Optionally from image boxes by a homography, and smoothed. Pairs are found once, with velocities on board.
    """
    rows = calibration.tracks_to_world(tracks, h) if h is not None else tracks
    if smooth:
        rows = smooth_positions(rows, order_col="frame_idx", window=smooth)
    rows = compute_kinematics(rows, fps=fps)
    pairs = safety.conflict_risk(rows, distance_threshold=distance_threshold, min_interaction_frames=min_frames, bucketed=bucketed)
    return pairs if max_min_distance is None else filter_meaningful_conflicts(pairs, max_min_distance)


def window_dataset(actors: DataFrame, window_size: int = 8, stride: int = 1, config: graphs.GraphConfig = graphs.GraphConfig()) -> tuple[DataFrame, DataFrame]:
    """Actors of several videos -> (nodes, edges) of their spatio-temporal windows."""
    nodes, edges = graphs.build_graphs(actors, ["video_id", "frame_id"], config)
    return temporal.window_graphs(nodes, edges, window_size=window_size, stride=stride)


def train_and_evaluate(nodes: DataFrame, edges: DataFrame, labels: DataFrame, key: str = "sample_id", width: int | None = None, group_key: str = "site_id", val_frac: float = 0.2, seed: int = 42,
                       hidden: int = 64, num_layers: int = 2, epochs: int = 30, lr: float = 1e-3, weight_decay: float = 1e-4, dropout: float = 0.0, batches: int = 1, run_dir: str | None = None, by_tables: bool = False) -> tuple[gcn.GCNModel, list[dict], DataFrame]:
    """Graph tables and labels (key, label, ids) -> (model, history, predictions with split).

    ``by_tables`` trains by joins, for graphs too large for one task, in place of one row for each graph.
    ``run_dir``, a folder on the driver, gets config.json, history.json, last.json, best.json, metrics.json (of the
    validation rows) and predictions.jsonl of these; ``evaluate_stored`` reads last.json and best.json.
    """
    split = splits.grouped_split(labels, key, group_key, val_frac, seed)
    first = nodes.select(F.size("features").alias("n")).first()
    model = gcn.build_model(width or first["n"], hidden, num_layers, dropout=dropout, seed=seed)
    if by_tables:
        sides = [gcn_tables.prepare(nodes, edges, split.where(F.col("split") == side), [key]) for side in ("train", "val")]
        history = gcn_tables.train(sides[0], model, epochs, lr, weight_decay, batches=batches, validation=sides[1])
        for side in sides:
            side.drop()
    else:
        rows = gcn.as_graph_rows(nodes, edges, [key]).join(split, key)
        history = gcn.train(rows.where("split = 'train'"), model, epochs, lr, weight_decay, batches=batches, validation=rows.where("split = 'val'"))
    if run_dir is not None:
        files.write_json(f"{run_dir}/history.json", {"history": history})
        for name, weights in (("last", model.weights), ("best", model.best_weights)):
            files.write_json(f"{run_dir}/{name}.json", gcn.model_to_dict(model, weights))
    found = metrics.predictions(gcn.forward(nodes, edges, [key], model).join(split, key))
    if run_dir is not None:
        config = {"hidden": hidden, "num_layers": num_layers, "epochs": epochs, "lr": lr, "weight_decay": weight_decay, "dropout": dropout, "batches": batches, "val_frac": val_frac, "group_key": group_key, "seed": seed, "by_tables": by_tables}
        held = found.where(F.col("split") == "val")
        files.write_json(f"{run_dir}/config.json", config | {f"{r['split']}_size": r["count"] for r in found.groupBy("split").count().collect()})
        files.write_json(f"{run_dir}/metrics.json", summary_of(held, history))
        files.write_jsonl(held, f"{run_dir}/predictions.jsonl")
    return model, history, found


def summary_of(found: DataFrame, history: list[dict] | None = None) -> dict:
    """Metrics and warnings of predictions as plain values, for a JSON file."""
    one = {**metrics.validation_summary(found, "label", "pred_label").first().asDict(recursive=True), **metrics.binary_metrics(found, "label", "logit").first().asDict()}
    return one | ({"history": history, "best_val_f1": max((h.get("val_f1", 0.0) for h in history), default=0.0)} if history is not None else {})


def evaluate_stored(path: str, nodes: DataFrame, edges: DataFrame, labels: DataFrame, key: str = "sample_id") -> tuple[DataFrame, DataFrame]:
    """A stored model over graph tables and labels -> (predictions, metrics)."""
    model = gcn.model_from_dict(json.loads(Path(path).read_text(encoding="utf-8")))
    found = metrics.predictions(gcn.forward(nodes, edges, [key], model).join(labels, key))
    return found, metrics.binary_metrics(found, "label", "logit")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of event tracks near each other on at least 3 days: frames, least distance and its frame, mean speed difference, least time to collision."""
    rows = compute_kinematics(event_trajectories(spark, sf_dir), fps=1.0)
    finite = F.when(F.col("min_ttc") < float("inf"), F.col("min_ttc"))
    return safety.conflict_risk(rows, blocks=32).select(
        "track_id_a", "track_id_b", F.col("n_frames").cast("long").alias("n_frames"), round_digits("min_distance").alias("min_distance"), "min_distance_frame",
        round_digits("avg_relative_speed").alias("avg_relative_speed"), round_digits(finite).alias("min_ttc"),
    )


__all__ = ["conflicts", "event_actors", "event_trajectories", "evaluate_stored", "find_nearby_pairs", "flagship", "train_and_evaluate", "window_dataset"]
