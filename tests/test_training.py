from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadweave.operators import baselines, forest, gcn, gcn_tables, mlp

# Graph convolution over tables


def random_graphs(rng, sizes, width):
    nodes, edges, labels = [], [], []
    for g, n in enumerate(sizes):
        nodes += [(g, i, rng.normal(size=width).round(2).tolist()) for i in range(n)]
        edges += [(g, int(a), int(b)) for a, b in {tuple(rng.integers(0, n, 2)) for _ in range(2 * n)} if a != b]
        labels.append((g, float(g % 2)))
    return nodes, edges, labels


def tables_of(spark, data):
    nodes, edges, labels = data
    return (spark.createDataFrame(nodes, "g int, node_id int, features array<double>"), spark.createDataFrame(edges, "g int, src int, dst int"), spark.createDataFrame(labels, "g int, label double"))


def summed_gradients(data, model):
    nodes, edges, labels = data
    total, counts = None, np.zeros(5)
    for g, y in labels:
        x = np.array([f for h, _, f in nodes if h == g])
        if not len(x):
            continue
        e = np.array([(a, b) for h, a, b in edges if h == g], int).reshape(-1, 2)
        logit, loss, grads = gcn._gradients(x, e[:, 0], e[:, 1], y, model.weights, model.num_layers, model.pool)
        total = grads if total is None else [a + b for a, b in zip(total, grads)]
        counts += [1, loss, logit >= 0 and y > 0.5, logit >= 0 and y <= 0.5, logit < 0 and y > 0.5]
    return total, counts


@pytest.mark.parametrize(("pool", "layers"), [("mean", 2), ("max", 2), ("add", 3)])
def test_table_gradients_equal_those_of_rows(spark, pool, layers):
    rng = np.random.default_rng(1)
    data = random_graphs(rng, [1, 4, 9, 30], 3)
    data[2].append((77, 1.0))  # a label without nodes takes no part
    data[0].append((88, 0, [1.0, 1.0, 1.0]))  # nor do nodes without a label
    model = gcn.build_model(3, hidden=4, num_layers=layers, pool=pool)
    t = gcn_tables.prepare(*tables_of(spark, data), ["g"])
    got, counts = gcn_tables.gradients(t, model)
    want, expected = summed_gradients(data, model)
    assert np.allclose(counts, expected)
    for a, b in zip(got, want):
        assert a.shape == b.shape and np.allclose(a, b, atol=1e-9)
    t.drop()


def test_table_training_equals_training_by_rows(spark):
    data = random_graphs(np.random.default_rng(2), [6] * 12, 3)
    nodes, edges, labels = tables_of(spark, data)
    by_row, by_table = gcn.build_model(3, hidden=4), gcn.build_model(3, hidden=4)
    first = gcn.train(gcn.as_graph_rows(nodes, edges, ["g"]).join(labels, "g"), by_row, epochs=3, lr=0.02)
    t = gcn_tables.prepare(nodes, edges, labels, ["g"])
    second = gcn_tables.train(t, by_table, epochs=3, lr=0.02, validation=t.only(F.col("g") < 4))
    assert np.allclose([x["train_loss"] for x in first], [x["train_loss"] for x in second])
    assert all(np.allclose(a, b) for a, b in zip(by_row.weights, by_table.weights))
    assert all(0 <= x["val_f1"] <= 1 and x["val_loss"] > 0 for x in second)


def test_dropout_draws_alike_in_both_passes(spark):
    data = random_graphs(np.random.default_rng(3), [20, 20], 3)
    t = gcn_tables.prepare(*tables_of(spark, data), ["g"])
    model = gcn.build_model(3, hidden=4, dropout=0.5)
    got, counts = gcn_tables.gradients(t, model, seed=5, dropout=0.5)
    up, down, eps = model.weights[0].copy(), model.weights[0].copy(), 1e-5
    up[1, 2] += eps
    down[1, 2] -= eps
    loss = []
    for w in (up, down):
        model.weights[0] = w
        loss.append(gcn_tables.gradients(t, model, seed=5, dropout=0.5)[1][1])
    assert abs((loss[0] - loss[1]) / (2 * eps) - got[0][1, 2]) < 1e-4
    assert counts[0] == 2


# Dense networks


def plain_gradients(x, y, net):
    """Differences of the summed loss."""
    def loss():
        h = x
        for i in range(0, len(net.weights), 2):
            h = h @ net.weights[i] + net.weights[i + 1]
            h = np.maximum(h, 0) if i < len(net.weights) - 2 else h
        if len(net.classes) == 2:
            return float(np.logaddexp(0, -h[:, 0] * (2 * y - 1)).sum())
        return float((np.log(np.exp(h).sum(1)) - h[np.arange(len(h)), y]).sum())

    for w in net.weights:
        for at in np.ndindex(w.shape):
            keep = w[at]
            w[at] = keep + 1e-6
            up = loss()
            w[at] = keep - 1e-6
            down = loss()
            w[at] = keep
            yield (up - down) / 2e-6


@pytest.mark.parametrize("classes", [[0, 1], [2, 5, 9]])
def test_network_gradients_equal_differences(classes):
    rng = np.random.default_rng(0)
    net = mlp.DenseNet.drawn(4, (5, 3), classes, 1)
    x, y = rng.normal(size=(20, 4)), rng.integers(0, len(classes), 20)
    assert np.allclose(net.gradient_sums(x, y)[2:], list(plain_gradients(x, y, net)), atol=1e-4)


def rings(spark, n, seed=0, labels=(0, 1)):
    rng = np.random.default_rng(seed)
    r, a = rng.uniform(0, 2, n), rng.uniform(0, 2 * np.pi, n)
    return spark.createDataFrame([([float(p * np.cos(q)), float(p * np.sin(q))], labels[int(p > 1)]) for p, q in zip(r, a)], "features array<double>, y int")


def test_network_learns_rings_and_stops_early(spark):
    """A linear model can't tell a disc from the ring around it."""
    found = mlp.train(rings(spark, 600), (16, 8), rate=0.02, max_iter=80, batch_rows=60)
    assert found.stopped and len(found.losses) < 80 and len(found.scores) == len(found.losses)
    best = max(range(len(found.scores)), key=lambda i: (found.scores[i], -i))
    assert len(found.scores) - best - 1 >= 10 and found.scores[best] > 0.85
    p = rings(spark, 300, seed=5).withColumn("p", found.net.probability(F.col("features"))).collect()
    assert np.mean([(r.p[1] > 0.5) == r.y for r in p]) > 0.85


def test_network_cases(spark):
    rows = rings(spark, 200, labels=(3, 7)).union(spark.createDataFrame([(None, 3), ([0.0, 0.0], None)], "features array<double>, y int"))
    model = baselines.get_baseline("mlp", hidden=(4,), max_iter=3, held_out=0.0).fit(rows)
    assert model.trained.scores == [] and len(model.trained.losses) == 3
    got = model.predict(rows).collect()
    assert {r.prediction for r in got} <= {3, 7, None} and [r.prediction for r in got if r.features is None] == [None]
    one = baselines.get_baseline("mlp", hidden=(4,), max_iter=2).fit(rows.where("y = 3"))
    assert {r.prediction for r in one.predict(rows.where("features is not null")).collect()} == {3}
    with pytest.raises(ValueError, match="no rows"):
        mlp.train(rows.limit(0))
    with pytest.raises(ValueError, match="lengths"):
        mlp.train(rows.union(spark.createDataFrame([([1.0], 3)], "features array<double>, y int")))


# Forests


def leaves(subtree):
    r = subtree.ready()
    return r.value[r.feature < 0]


def deepest(nodes):
    r, depth, most = nodes.ready(), {0: 0}, 0
    for i in range(len(r.feature)):
        if r.feature[i] >= 0:
            for child in (int(r.left[i]), int(r.right[i])):
                depth[child] = depth[i] + 1
                most = max(most, depth[child])
    return most


@pytest.mark.parametrize("task_rows", [10_000, 30])
def test_trees_grow_to_pure_leaves(spark, task_rows):
    rows = spark.createDataFrame([([float(i % 26), float(i // 26)], (i + i // 26) % 2) for i in range(104)], "features array<double>, y int")
    model = forest.train(rows, forest.Options(trees=1, bootstrap=False, task_rows=task_rows))
    got = forest.probability(model, rows).collect()
    assert all(r.probability[r.y] == 1.0 for r in got)


def test_a_tree_deeper_than_30(spark):
    x = np.arange(120.0)[:, None]
    y = np.arange(120) % 2
    w = 4.0 ** np.minimum(np.arange(120), 60)  # weights so uneven that each split cuts off the heaviest end
    tree = forest.grow(x, y, w, 2, forest.Options(), 0, [3])
    assert deepest(tree) > 30 and all(np.count_nonzero(v) == 1 for v in leaves(tree))


def test_forest_by_histograms_and_exact_agree_in_kind(spark):
    rows = rings(spark, 900)
    for options in (forest.Options(trees=12, task_rows=100_000), forest.Options(trees=12, task_rows=100, most_nodes=20)):
        model = forest.train(rows, options)
        assert len(model.tops) == 12 and (options.task_rows < 1000) == any(len(t.feature) > 1 for t in model.tops)
        for sent in (1 << 26, 0):
            got = forest.probability(model, rings(spark, 400, seed=8), sent_bytes=sent).collect()
            assert len(got) == 400 and np.mean([(r.probability[1] > 0.5) == r.y for r in got]) > 0.93
            assert all(abs(sum(r.probability) - 1) < 1e-9 for r in got)


def test_both_ways_of_prediction_are_equal(spark):
    rows = rings(spark, 300).unionByName(spark.createDataFrame([(None, 1)], "features array<double>, y int"))
    model = forest.train(rows, forest.Options(trees=5, task_rows=60))
    key = lambda r: (r.features is None, tuple(r.features or ()), r.y)
    a, b = (sorted(forest.probability(model, rows, sent_bytes=s).collect(), key=key) for s in (1 << 26, 0))
    assert [r.probability is None for r in a] == [r.probability is None for r in b] and sum(r.probability is None for r in a) == 1
    assert np.allclose([r.probability for r in a if r.probability], [r.probability for r in b if r.probability])


def test_copies_and_limits(spark):
    """A third of all rows is one point with both labels: a leaf of its own, found without one task getting them all."""
    rows = rings(spark, 400).union(spark.createDataFrame([([9.0, 9.0], i % 2) for i in range(200)], "features array<double>, y int"))
    model = forest.train(rows, forest.Options(trees=3, task_rows=50, bootstrap=False), balanced=False)
    got = forest.probability(model, rows).where("features[0] = 9").collect()
    assert {round(r.probability[0], 9) for r in got} == {0.5}
    largest = max(t.value[t.feature < 0].sum(1).max() for t in model.tops)
    assert largest >= 200
    shallow = forest.train(rows, forest.Options(trees=2, max_depth=2, min_leaf=20, bootstrap=False), balanced=False)
    for r in shallow.subtrees.collect():
        tree = forest.Nodes.from_bytes(bytes(r["data"]))
        assert deepest(tree) <= 2 and tree.value[tree.feature < 0].sum(1).min() >= 20
    split = forest.train(rows, forest.Options(trees=1, min_split=500, bootstrap=False), balanced=False).subtrees.collect()
    tree = forest.Nodes.from_bytes(bytes(split[0]["data"]))
    assert all(v.sum() >= 500 for v, f in zip(tree.value, tree.feature) if f >= 0)


def test_balanced_weights_and_cases(spark):
    rows = spark.createDataFrame([([float(i)], int(i >= 90)) for i in range(100)] + [(None, 1), ([1.0], None)], "features array<double>, y int")
    model = forest.train(rows, forest.Options(trees=1, bootstrap=False))
    (data,) = [forest.Nodes.from_bytes(bytes(r["data"])) for r in model.subtrees.collect()]
    assert np.allclose(data.value[0], [50, 50])  # of 90 and 10
    one = forest.train(rows.where("y = 1"), forest.Options(trees=2))
    assert {tuple(r.probability) for r in forest.probability(one, rows.where("features is not null")).collect()} == {(1.0,)}
    for bad, what in ((rows.limit(0), "no rows"), (rows.union(spark.createDataFrame([([1.0, 2.0], 1)], "features array<double>, y int")), "lengths")):
        with pytest.raises(ValueError, match=what):
            forest.train(bad)


def test_draws_are_uniform_and_poisson():
    u = forest.draw(np.arange(20_000), 5, 1)
    assert abs(u.mean() - 0.5) < 0.01 and abs(np.corrcoef(u, forest.draw(np.arange(20_000), 5, 2))[0, 1]) < 0.03
    k = forest.times_drawn(np.arange(50_000), 3, forest.Options())
    assert abs(k.mean() - 1) < 0.02 and abs((k == 0).mean() - np.exp(-1)) < 0.01 and abs(k.var() - 1) < 0.03


def test_large_nodes_are_split_exactly(spark):
    rng = np.random.default_rng(11)
    x, y = rng.integers(0, 40, (3000, 4)) / 7.0, rng.integers(0, 2, 3000)
    y = np.where(x[:, 2] > 3.2, y | (rng.random(3000) < 0.4), y)
    rows = spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, y)], "features array<double>, y int").repartition(5)
    common = {"trees": 1, "max_depth": 1, "features": 4, "bootstrap": False}
    in_task, spread = (forest.train(rows, forest.Options(**common, task_rows=n, exact=True)).first_splits()[0] for n in (50_000, 100))
    assert spread[:2] == pytest.approx(in_task[:2]) and all(np.allclose(a, b) for a, b in zip(spread[2:], in_task[2:]))
    deep = [forest.probability(forest.train(rows, forest.Options(trees=1, features=4, bootstrap=False, task_rows=n, exact=True)), rows).select(F.round(F.get("probability", F.lit(1)), 9).alias("p"), "features").distinct().orderBy("features").collect() for n in (50_000, 700)]
    assert deep[0] == deep[1]
    alike = spark.range(500).select(F.array(F.lit(1.0)).alias("features"), (F.col("id") % 2).cast("int").alias("y"))
    assert forest.train(alike, forest.Options(trees=1, bootstrap=False, task_rows=100, exact=True)).first_splits() == {}


@pytest.mark.parametrize("least", [1, 3])
def test_features_of_a_node_are_sorted_at_once(monkeypatch, least):
    rng = np.random.default_rng(9)
    x, y, w = rng.integers(0, 6, (40, 7)).astype(float), rng.integers(0, 3, 40), rng.integers(1, 4, 40).astype(float)
    x[:, 2] = 1.0  # constant: takes no part
    order, weight = np.array([2, 5, 0, 3, 1, 4, 6]), lambda at: np.bincount(y[at], w[at], 3)
    want = None
    for j in (5, 0, 3, 1):
        values = np.unique(x[:, j])
        for low, high in zip(values, values[1:]):
            left, right = np.flatnonzero(x[:, j] <= low), np.flatnonzero(x[:, j] > low)
            gain = sum((weight(s) ** 2).sum() / weight(s).sum() for s in (left, right))
            if min(len(left), len(right)) >= least and (want is None or gain > want[0] + 1e-9):
                want = gain, j, (low + high) / 2
    sorts, plain = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: sorts.append(1) or plain(*a, **k))
    got = forest.best_exact(np.ascontiguousarray(x.T), np.arange(40), y, w, 3, forest.Options(min_leaf=least), order, 4)
    assert got == want[1:]
    assert len(sorts) <= 2  # four features, and one more after the constant one
