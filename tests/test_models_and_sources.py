from __future__ import annotations

import json
import math
import random
import re
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave import cli
from roadweave.operators import baselines, gcn, graph_vectors, metrics, splits
from roadweave.sources import files
from roadweave.streaming import tracks

ROOT = Path(__file__).resolve().parent.parent


def scored(spark, rows):
    return spark.createDataFrame(rows, "y_true int, logit double")


def test_binary_metrics(spark):
    r = metrics.binary_metrics(scored(spark, [(1, 2.0), (0, -2.0), (1, 1.5), (0, -1.0)])).first()
    assert (r.accuracy, r.precision, r.recall, r.f1) == (1.0, 1.0, 1.0, 1.0)
    assert metrics.binary_metrics(scored(spark, [(1, 0.2), (0, 0.1)]), threshold=0.6).first().accuracy == 0.5
    assert metrics.binary_metrics(scored(spark, [])).first().f1 == 0.0


def test_rank_metrics_with_ties(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(2), float(rng.randrange(8))) for _ in range(120)]
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    ap, last = 0.0, 0.0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, k = sum(s >= t for s in pos), sum(s >= t for _, s in rows)
        ap, last = ap + (tp / len(pos) - last) * tp / k, tp / len(pos)
    df = scored(spark, rows)
    assert math.isclose(metrics.roc_auc(df, bands=3).first()[0], auc)
    assert math.isclose(metrics.average_precision(df, bands=3).first()[0], ap)
    r = metrics.all_metrics(df).first()
    assert math.isclose(r.pr_auc, ap)
    assert metrics.roc_auc(df.where("y_true = 1")).first()[0] is None
    assert metrics.average_precision(df.where("y_true = 0")).first()[0] is None


def test_summary_loss_and_best_epoch(spark):
    r = metrics.validation_summary(spark.createDataFrame([(1, 0), (1, 0)], "label int, pred_label int")).first()
    assert (r.val_sample_count, r.fn, len(r.warnings)) == (2, 2, 3)
    assert math.isclose(metrics.bce_loss(scored(spark, [(1, 0.0), (0, 800.0)])).first().loss, (math.log(2) + 800) / 2)
    h = spark.createDataFrame([(1, 0.5), (2, 0.7), (3, 0.7)], "epoch int, f1 double")
    assert tuple(metrics.best_epoch(h).first()) == (2, 0.7)
    assert metrics.calibration_error(scored(spark, [(1, 50.0), (0, -50.0)])).first()[0] < 1e-9


def test_grouped_split(spark):
    rows = [(i, f"s{i % 5}", None) for i in range(40)] + [(100, None, "v"), (101, "", None)]
    df = spark.createDataFrame(rows, "sample_id int, site_id string, video_id string")
    got = splits.grouped_split(df, "sample_id", val_frac=0.3).collect()
    sides = {}
    for r in got:
        sides.setdefault(r.site_id or r.video_id or r.sample_id, set()).add(r.split)
    assert all(len(s) == 1 for s in sides.values())
    assert sum(s == {"val"} for s in sides.values()) == math.ceil(0.3 * 7)
    one = splits.grouped_split(df.where("site_id = 's1'"), "sample_id", val_frac=0.25).collect()
    assert sorted((r.sample_id, r.split) for r in one) == [(i, "train" if i < 31 else "val") for i in range(1, 40, 5)]
    assert splits.seeded_group_split(["b", "a", "a", "c"], 0.3, 1) <= {"a", "b", "c"}


def test_graph_vectors(spark):
    rng = np.random.default_rng(0)
    x = {g: rng.normal(size=(n, 4)).round(3) for g, n in ((1, 5), (2, 1))}
    e = rng.normal(size=(3, 2)).round(3)
    nodes = spark.createDataFrame([(g, v.tolist(), v[:2].tolist(), int(i)) for g, m in x.items() for i, v in enumerate(m)], "g int, features array<double>, pos array<double>, track_id int")
    edges = spark.createDataFrame([(1, v.tolist()) for v in e], "g int, features array<double>")
    got = {r.g: r for r in graph_vectors.graph_vectors(nodes, edges, ["g"], spark.createDataFrame([(1, 1)], "g int, y int")).collect()}
    assert len(graph_vectors.COLUMNS) == 42
    r = got[1]
    l2 = np.linalg.norm(x[1], axis=1)
    for name, want in {"num_nodes": 5, "num_edges": 3, "density": 3 / 20, "node_dim": 4, "x_mean": x[1].mean(), "x_std": x[1].std(), "x_l2_std": l2.std(), "x_l2_max": l2.max(), "e_min": e.min(), "pos_max": x[1][:, :2].max(), "y_mean": 1, "track_id_mean": 2, "track_id_unique": 5, "x_nonzero": 1}.items():
        assert math.isclose(r[name], want, abs_tol=1e-9), name
    assert (got[2].density, got[2].num_edges, got[2].e_mean, got[2].y_mean) == (0, 0, 0, 0)
    assert len(graph_vectors.as_array(graph_vectors.graph_vectors(nodes, edges, ["g"]), ["g"]).first().features) == 42


@pytest.mark.parametrize(("name", "options"), [("majority", {}), ("logistic", {}), ("random_forest", {"n_estimators": 5, "max_depth": 3}), ("mlp", {"hidden": (4,), "max_iter": 30})])
def test_baselines(spark, name, options):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([([float(v), float(rng.normal())], int(v > 0)) for v in rng.normal(0, 2, 80)], "features array<double>, y int")
    model = baselines.get_baseline(name, **options)
    with pytest.raises(RuntimeError):
        model.predict(df)
    got = model.fit(df).predict(df).collect()
    assert all(math.isclose(sum(r.probability), 1.0) for r in got)
    assert np.mean([r.prediction == r.y for r in got]) > (0.85 if name != "majority" else 0.4)


def test_majority_ties_and_registry(spark):
    df = spark.createDataFrame([(1,), (0,), (1,), (0,)], "y int")
    assert baselines.get_baseline("majority").fit(df).majority == 0
    with pytest.raises(ValueError, match="logistic"):
        baselines.get_baseline("oracle")


def dense_forward(model, x, edges):
    n = len(x)
    a = np.eye(n)
    for s, d in edges:
        a[d, s] += 1
    deg = 1 / np.sqrt(1 + np.bincount([d for _, d in edges], minlength=n))
    a = a * deg[:, None] * deg[None]
    h = x
    for i in range(model.num_layers):
        h = np.maximum(a @ h @ model.weights[2 * i] + model.weights[2 * i + 1], 0)
    pooled = {"mean": h.mean(0), "max": h.max(0), "add": h.sum(0)}[model.pool]
    return float(pooled @ model.weights[-2][:, 0] + model.weights[-1][0])


def tables(spark, graphs_):
    nodes = spark.createDataFrame([(g, i, v.tolist()) for g, (x, _) in graphs_.items() for i, v in enumerate(x)], "g int, node_id int, features array<double>")
    edges = spark.createDataFrame([(g, s, d) for g, (_, e) in graphs_.items() for s, d in e], "g int, src int, dst int")
    return nodes, edges


@pytest.mark.parametrize("pool", gcn.POOLS)
def test_gcn_forward(spark, pool):
    rng = np.random.default_rng(3)
    data = {0: (rng.normal(size=(3, 6)), [(0, 1), (1, 2)]), 1: (rng.normal(size=(2, 6)), [(0, 1)]), 2: (rng.normal(size=(1, 6)), [])}
    model = gcn.build_model(6, hidden=4, num_layers=2, pool=pool)
    got = {r.g: r.logit for r in gcn.forward(*tables(spark, data), ["g"], model).collect()}
    for g, (x, e) in data.items():
        assert math.isclose(got[g], dense_forward(model, x, e), abs_tol=1e-9)
        logit, _, grads = gcn._gradients(x, np.array([s for s, _ in e], int), np.array([d for _, d in e], int), 1.0, model.weights, 2, pool)
        assert math.isclose(logit, got[g], abs_tol=1e-9)
        w = [v.copy() for v in model.weights]
        w[0][1, 2] += 1e-6
        _, up, _ = gcn._gradients(x, np.array([s for s, _ in e], int), np.array([d for _, d in e], int), 1.0, w, 2, pool)
        _, base, _ = gcn._gradients(x, np.array([s for s, _ in e], int), np.array([d for _, d in e], int), 1.0, model.weights, 2, pool)
        assert abs((up - base) / 1e-6 - grads[0][1, 2]) < 1e-3


def test_gcn_training_learns(spark):
    rng = np.random.default_rng(4)
    data = {g: (rng.normal(2.0 * (g % 2) - 1, 0.3, (4, 3)), [(0, 1), (1, 2), (2, 3)]) for g in range(24)}
    nodes, edges = tables(spark, data)
    rows = gcn.as_graph_rows(nodes, edges, ["g"]).withColumn("label", F.col("g") % 2)
    model = gcn.build_model(3, hidden=8)
    history = gcn.train(rows, model, epochs=40, lr=0.05)
    assert history[-1]["train_loss"] < 0.5 * history[0]["train_loss"]
    again = gcn.build_model(3, hidden=8, dropout=0.2)
    history = gcn.train(rows, again, epochs=12, lr=0.05, batches=2, validation=rows)
    assert history[-1]["train_loss"] < history[0]["train_loss"]
    assert max(h["val_f1"] for h in history) > 0.9
    stored = gcn.model_from_dict(json.loads(json.dumps(gcn.model_to_dict(again, again.best_weights))))
    assert all((a == b).all() for a, b in zip(stored.weights, again.best_weights))
    for bad in ({"num_layers": 1}, {"pool": "median"}):
        with pytest.raises(ValueError):
            gcn.build_model(3, **bad)


SAMPLES = [
    {"sample_id": "a", "label": 1, "graph": {"frame_id": 7, "nodes": [{"node_id": 0, "track_id": 1, "features": [1.0]}, {"node_id": 1, "track_id": 2}], "edges": [{"src": 1, "dst": 2}], "site_id": "s", "weather": "dry"}, "operator": "x"},
    {"sample_id": None, "graph": {"sample_id": "inner", "label": 1, "frame_idx": 3, "nodes": []}},
    {"nodes": [{"track_id": 9}], "edges": [], "label": 0, "frame": 4},
]


def test_jsonl_round_trip(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text("\n".join(json.dumps(s) for s in SAMPLES[:1]) + "\n\n  \n" + "\n".join(json.dumps(s) for s in SAMPLES[1:]))
    one, two, three = sorted(files.read_graph_samples(spark, str(path)).collect(), key=lambda r: -r.frame_id)
    assert (one.frame_id, one.y, one.track_ids, one.site_id, one.sample_id, one.extras) == (7, [1.0], [1, 2], "s", "a", {"weather": "dry", "operator": "x"})
    assert (two.frame_id, two.track_ids, two.y) == (4, [9], [0.0])
    assert (three.frame_id, three.sample_id, three.y) == (3, None, [1.0])  # an explicit null counts as given
    assert sorted(r.missing for r in files.samples_missing_keys(spark, str(path)).collect()) == [["label"], ["sample_id", "graph"]]
    files.write_jsonl(spark.createDataFrame([("é", None)], "a string, b int"), str(tmp_path / "out"))
    assert json.loads("".join(p.read_text() for p in (tmp_path / "out").glob("part*"))) == {"a": "é", "b": None}  # other parts are empty


def test_graph_files(spark, tmp_path):
    df = spark.createDataFrame([("v", 3, 1), ("v", 12, 2)], "video_id string, frame_id long, n int")
    files.write_graphs(df, str(tmp_path / "g"))
    back = files.read_graph(spark, str(tmp_path / "g"))
    assert {r.sample_name for r in back.collect()} == {"sample_v_f000003", "sample_v_f000012"}
    folder = files.read_graph_folder(spark, str(tmp_path / "g"), recursive=True)
    assert files.graph_at(folder, 0).first().n == 2  # paths are in string order: 12 before 3
    for call in (files.read_graph, files.read_graph_folder):
        with pytest.raises(FileNotFoundError):
            call(spark, str(tmp_path / "none"))
    files.snapshot_environment(spark, ROOT, tmp_path / "run")
    assert json.loads((tmp_path / "run" / "environment.json").read_text())["spark"] == spark.version


def test_command_line(spark, tmp_path):
    assert cli.main([]) == 0
    cli.main(["demo-graphs", "--outdir", str(tmp_path / "g")])
    assert json.loads(next((tmp_path / "g").glob("part*")).read_text())["track_ids"] == [10, 25, 99]
    cli.main(["build-trajectories", "--outdir", str(tmp_path / "t")])
    cli.main(["compute-ssm", "--traj-path", str(tmp_path / "t"), "--outdir", str(tmp_path / "e")])
    events = [json.loads(line) for p in (tmp_path / "e").glob("part*") for line in p.read_text().splitlines()]
    assert sorted(e["value"] for e in events) == [3.5, 4.0]
    cli.main(["make-windows", "--graph-dir", str(tmp_path / "t"), "--outdir", str(tmp_path / "w")])
    assert [json.loads(line)["window_id"] for p in (tmp_path / "w").glob("part*") for line in p.read_text().splitlines()][0] == "window_001"


def test_trajectory_json(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps([{"track_id": "t1", "class_name": "car", "frames": [{"frame_id": 0, "x": 1.0, "y": 2.0}, {"frame_id": 1, "x": 2.0, "y": 2.0}]}]))
    assert files.read_trajectories(spark, str(tmp_path / "t.json")).count() == 2


def test_streaming_kinematics(spark, tmp_path):
    for i, rows in enumerate(([("a", 0, 0.0, 0.0), ("a", 1, 1.0, 0.0)], [("a", 1, 9.0, 9.0), ("a", 3, 5.0, 0.0), ("b", 0, 0.0, 0.0)])):
        spark.createDataFrame(rows, "track_id string, frame_idx long, x_m double, y_m double").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = spark.readStream.schema("track_id string, frame_idx long, x_m double, y_m double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = tracks.stream_kinematics(stream, fps=1).writeStream.format("memory").queryName("kin").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r.track_id, r.frame_idx): r.speed_mps for r in spark.sql("select * from kin").collect()}
    assert got["a", 1] == 1.0
    assert got["a", 3] == 2.0
    assert len(got) == 4


def test_streaming_windows_and_batches(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:00:30' ts, 'x' event_type, 2.0D value union all select timestamp '2024-01-01 00:20:00', 'x', 1.0D").write.parquet(str(tmp_path / "in"))
    schema = "ts timestamp, event_type string, value double"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = tracks.windowed_counts(stream).writeStream.format("memory").queryName("win").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.n, r.total) for r in spark.sql("select * from win").collect()] == [(1, 2.0)]
    q = tracks.run_on_batches(stream, lambda b: b.groupBy("event_type").count(), str(tmp_path / "out"), str(tmp_path / "c2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).first()["count"] == 2


def test_nothing_else_imports_the_training_data_package():
    for p in (ROOT / "roadweave").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert not re.search(r"roadweave\.llm|from \.+llm", p.read_text()), p


def test_entry_imports_without_the_training_data_package(tmp_path):
    for p in [ROOT / "__spark_entry__.py", *(q for q in (ROOT / "roadweave").rglob("*.py") if "llm" not in q.relative_to(ROOT).parts)]:
        to = tmp_path / p.relative_to(ROOT)
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text(p.read_text())
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); assert not any(n.startswith('op') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) > 50
