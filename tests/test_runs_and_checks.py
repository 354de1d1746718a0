from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave import cli, queries
from roadweave.functions import numbering
from roadweave.functions.vocabulary import EDGE_FEATURES, NODE_FEATURES
from roadweave.operators import graphs, metrics, subgraphs, temporal

KEY = ["video_id", "frame_id"]


@pytest.fixture(scope="module")
def actors(spark):
    rng = np.random.default_rng(0)
    rows = [(f"v{v}", f, t, "car" if t % 2 else "pedestrian", *rng.uniform(0, 12, 2).tolist(), *rng.normal(0, 1, 2).tolist()) for v in range(4) for f in range(6) for t in range(4 + v)]
    return spark.createDataFrame(rows, "video_id string, frame_id long, track_id long, actor_class string, x double, y double, vx double, vy double")


def test_watched_layout_counts_without_a_pass_of_its_own(spark, actors):
    nodes, edges = graphs.build_graphs(actors, KEY)
    watch = subgraphs.LayoutWatch()
    a, b = watch.nodes(nodes), watch.edges(edges)
    assert a.count() > 0 and b.count() > 0
    watch.check()
    broken = nodes.withColumn("features", F.when(F.col("node_id") == 0, F.slice("features", 1, 3)).when(F.col("node_id") == 1, F.lit(None)).otherwise(F.col("features")))
    broken = broken.withColumn("pos", F.when(F.col("node_id") == 2, F.array(F.lit(1.0))).otherwise(F.slice("features", 1, 2)))
    bad = edges.withColumn("features", F.slice("features", 1, len(EDGE_FEATURES) - F.when(F.col("src") == 0, 1).otherwise(0))).withColumn("dst", F.when(F.col("src") != 1, F.col("dst")))
    watch = subgraphs.LayoutWatch(require_pos=True)
    n = {"graphs": nodes.where("node_id = 0").count(), "src0": edges.where("src = 0").count(), "src1": edges.where("src = 1").count()}
    watch.nodes(broken).write.format("noop").mode("overwrite").save()
    watch.edges(bad).write.format("noop").mode("overwrite").save()
    found = watch.errors()
    assert sorted(found.values()) == sorted([2 * n["graphs"], 2 * n["graphs"], n["src0"], n["src1"]])
    with pytest.raises(ValueError, match="edge width is not"):
        watch.check()
    with pytest.raises(ValueError, match="pos"):
        subgraphs.LayoutWatch(require_pos=True).nodes(nodes.drop("pos"))
    with pytest.raises(ValueError, match="src"):
        subgraphs.LayoutWatch().edges(edges.drop("src"))
    with pytest.raises(ValueError, match="track_id"):
        temporal.window_graphs(nodes.drop("track_id"), edges)


def test_block_of_node_features_is_replaced(actors):
    nodes, _ = graphs.build_graphs(actors, KEY)
    new = subgraphs.with_node_feature_block(nodes, ["speed", "x"], F.array(F.lit(7.0), F.lit(-1.0)))
    before, after = nodes.orderBy(*KEY, "node_id").first().features, new.orderBy(*KEY, "node_id").first().features
    at = {NODE_FEATURES.index("speed"): 7.0, NODE_FEATURES.index("x"): -1.0}
    assert after == [at.get(i, v) for i, v in enumerate(before)]
    with pytest.raises(KeyError):
        subgraphs.with_node_feature_block(nodes, ["nothing"], F.array(F.lit(7.0)))
    with pytest.raises(Exception, match="block width 1 is not 2"):
        subgraphs.with_node_feature_block(nodes, ["speed", "x"], F.array(F.lit(7.0))).collect()


def test_running_sums_come_from_one_set_of_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).select(((F.col("id") * 7919) % 5000).alias("k"), (F.col("id") % 5).alias("v"))
    out = numbering.running_sum(rows, ["k"], F.col("v"), "s", bands=9)
    plan = out._jdf.queryExecution().toString()
    assert "RepartitionByExpression" not in plan and "rangepartitioning" not in plan
    got = {r.k: r.s for r in out.collect()}
    v = {(i * 7919) % 5000: i % 5 for i in range(5000)}
    total = 0
    for k in range(5000):
        assert got[k] == total
        total += v[k]
    scored = spark.range(300).select((F.col("id") % 2).alias("y_true"), ((F.col("id") * 37 % 101) / 10).alias("logit"))
    assert metrics.roc_auc(scored, bands=5).first()[0] == pytest.approx(metrics.roc_auc(scored, bands=1).first()[0])


@pytest.mark.parametrize("by_tables", [False, True])
def test_dataset_train_and_evaluate_commands(spark, actors, tmp_path, by_tables):
    actors.write.parquet(str(tmp_path / "actors"))
    labels = actors.select(*KEY).distinct().withColumns({"label": (F.col("frame_id") % 2).cast("int"), "site_id": F.concat(F.lit("s"), F.substring("video_id", 2, 1))})
    labels.write.parquet(str(tmp_path / "labels"))
    at = {name: str(tmp_path / name) for name in ("actors", "labels", "samples", "run", "eval")}
    cli.main(["dataset", "--actors", at["actors"], "--labels", at["labels"], "--outdir", at["samples"]])
    lines = [json.loads(line) for p in (tmp_path / "samples").glob("part*") for line in p.read_text().splitlines()]
    assert len(lines) == 24 and {"sample_id", "site_id", "label", "graph"} <= set(lines[0])
    cli.main(["train", "--graphs", at["samples"], "--outdir", at["run"], "--epochs", "2", "--hidden", "4", "--val-frac", "0.25", *(["--by-tables"] if by_tables else [])])
    run = {name: json.loads((tmp_path / "run" / f"{name}.json").read_text()) for name in ("config", "metrics", "history", "best", "environment")}
    assert run["config"]["train_size"] + run["config"]["val_size"] == 24 and len(run["history"]["history"]) == 2 == len(run["metrics"]["history"])
    assert run["metrics"]["val_sample_count"] == run["config"]["val_size"] and (tmp_path / "run" / "git_commit.txt").exists()
    held = [json.loads(line) for p in (tmp_path / "run" / "predictions.jsonl").glob("part*") for line in p.read_text().splitlines()]
    assert len(held) == run["config"]["val_size"] and {"sample_id", "label", "split", "logit", "prob", "pred_label"} <= set(held[0])
    cli.main(["evaluate", "--graphs", at["samples"], "--model", f"{at['run']}/best.json", "--outdir", at["eval"]])
    found = json.loads((tmp_path / "eval" / "metrics.json").read_text())
    assert found["val_sample_count"] == 24 and 0 <= found["accuracy"] <= 1


def test_detections_shuffle_actors_without_sums(spark, tmp_path):
    """Null frames, actors and measures and repeated rows count as by a distinct count beside the sums; what is shuffled for each actor is its key alone."""
    rows = [(i % 40, None if i % 11 == 0 else i % 5, None if i % 7 == 0 else i % 13, None if i % 6 == 0 else float(i % 9), None if i % 8 == 0 else i % 10 / 100, 0.5) for i in range(400)]
    rows += rows[:50] + [(1, 6, None, 1.0, 0.1, 0.1)] * 3 + [(1, 7, 5, None, None, None)] * 3 + [(None,) * 6] * 2
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_discount double, l_tax double")
    lines.repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = queries.QUERIES["detections_from_tracks"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString().splitlines()
    by_actor = [below for line, below in zip(plan, plan[1:], strict=False) if "Exchange hashpartitioning" in line and "actor_id" in line]
    assert len(by_actor) == 1 and "functions=[]" in by_actor[0]
    want = {}
    for _, frame, actor, quantity, discount, _ in rows:
        n, conf, x2, actors = want.setdefault(frame, (0, 0.0, None, set()))
        one = discount if frame is not None and frame > 2 and discount is not None else 1.0
        want[frame] = (n + 1, conf + one, x2 if quantity is None else (x2 or 0.0) + quantity + 4, actors | ({actor} - {None}))
    rounded = sorted(((f, "car", n, round(c, 4), x2 if x2 is None else round(x2, 2), len(a)) for f, (n, c, x2, a) in want.items()), key=str)
    assert sorted((tuple(r) for r in got.collect()), key=str) == rounded
    assert got.schema.simpleString() == "struct<frame_idx:int,class_name:string,n:bigint,confidence:double,x2:double,actors:bigint>"
    lines.limit(0).write.parquet(f"{tmp_path}/empty/lineitem.parquet")
    assert queries.QUERIES["detections_from_tracks"](spark, f"{tmp_path}/empty").count() == 0
