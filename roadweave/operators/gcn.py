"""Graph convolution risk model: distributed forward pass by joins and sums, and distributed training.

Forward: ``h' = relu(D^-1/2 (A + I) D^-1/2 h W + b)`` layer by layer, then pooling and a linear head. In
training each partition computes gradients of its own graphs with NumPy and only their sums, as large as
the weights, come back.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POOLS = ("mean", "max", "add")


@dataclass
class GCNModel:
    in_channels: int
    hidden: int = 32
    num_layers: int = 2
    pool: str = "mean"
    seed: int = 42
    weights: list[np.ndarray] = field(default_factory=list)  # W and b of each layer, then the head's
    dropout: float = 0.0
    best_weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if self.num_layers < 2:
            raise ValueError("num_layers must be >= 2")
        if self.pool not in POOLS:
            raise ValueError(f"pool must be one of {POOLS}")
        if not self.weights:
            rng, width = np.random.default_rng(self.seed), self.in_channels
            for _ in range(self.num_layers):
                bound = np.sqrt(6 / (width + self.hidden))
                self.weights += [rng.uniform(-bound, bound, (width, self.hidden)), np.zeros(self.hidden)]
                width = self.hidden
            bound = 1 / np.sqrt(width)
            self.weights += [rng.uniform(-bound, bound, (width, 1)), rng.uniform(-bound, bound, 1)]


def build_model(in_channels: int, hidden: int = 32, num_layers: int = 2, dropout: float = 0.0, pool: str = "mean", seed: int = 42) -> GCNModel:
    return GCNModel(in_channels, hidden, num_layers, pool, seed, dropout=dropout)


def _linear(x: Column, w: np.ndarray, b: np.ndarray | None = None) -> Column:
    def dot(weights: np.ndarray, bias: float) -> Column:
        products = F.zip_with(x, F.array(*(F.lit(float(v)) for v in weights)), lambda u, v: u * v)
        return F.aggregate(products, F.lit(float(bias)), lambda acc, v: acc + v)

    return F.array(*(dot(w[:, j], 0.0 if b is None else b[j]) for j in range(w.shape[1])))


def pool_nodes(nodes: DataFrame, key: list[str], width: int, how: str = "mean", column: str = "h") -> DataFrame:
    """Per-graph mean, max or sum of each channel, as an array."""
    if how not in POOLS:
        raise ValueError(f"pool must be one of {POOLS}")
    f = {"mean": F.avg, "max": F.max, "add": F.sum}[how]
    return nodes.groupBy(*key).agg(F.array(*(f(F.get(F.col(column), F.lit(j))) for j in range(width))).alias(column))


def normalized_edges(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, src, dst, w): edges and self-loops with w = 1 / sqrt(degree of src x degree of dst); degrees count incoming edges and the loop."""
    degree = edges.groupBy(*key, F.col("dst").alias("node_id")).agg(F.count("*").alias("d"))
    scale = nodes.select(*key, "node_id").join(degree, [*key, "node_id"], "left").select(*key, "node_id", (1 / F.sqrt(F.coalesce("d", F.lit(0)) + 1.0)).alias("s"))
    of = lambda end: scale.select(*key, F.col("node_id").alias(end), F.col("s").alias(f"s_{end}"))
    moved = edges.select(*key, "src", "dst").join(of("src"), [*key, "src"]).join(of("dst"), [*key, "dst"])
    loops = scale.select(*key, F.col("node_id").alias("src"), F.col("node_id").alias("dst"), (F.col("s") * F.col("s")).alias("w"))
    return moved.select(*key, "src", "dst", (F.col("s_src") * F.col("s_dst")).alias("w")).unionByName(loops)


def propagate(h: DataFrame, weights: DataFrame, key: list[str], width: int) -> DataFrame:
    """(key, node_id, h): weighted sums over incoming edges. All layers read the same exchange of the weights."""
    sent = weights.join(h.withColumnRenamed("node_id", "src"), [*key, "src"])
    return sent.groupBy(*key, F.col("dst").alias("node_id")).agg(F.array(*(F.sum(F.get("h", F.lit(j)) * F.col("w")) for j in range(width))).alias("h"))


def forward(nodes: DataFrame, edges: DataFrame, key: list[str], model: GCNModel, features_col: str = "features") -> DataFrame:
    """(key, logit) of each graph. The product with W comes before the sum over neighbours."""
    h = nodes.select(*key, "node_id", F.col(features_col).cast("array<double>").alias("h"))
    weights, width = normalized_edges(nodes, edges, key), model.in_channels
    for layer in range(model.num_layers):
        w, b = model.weights[2 * layer], model.weights[2 * layer + 1]
        h = propagate(h.withColumn("h", _linear(F.col("h"), w)), weights, key, model.hidden)
        h = h.withColumn("h", F.zip_with("h", F.array(*(F.lit(float(v)) for v in b)), lambda u, v: F.greatest(u + v, F.lit(0.0))))
        width = model.hidden
    w, b = model.weights[-2], model.weights[-1]
    return pool_nodes(h, key, width, model.pool).select(*key, F.get(_linear(F.col("h"), w, b), F.lit(0)).alias("logit"))


def _gradients(x: np.ndarray, src: np.ndarray, dst: np.ndarray, y: float, model_weights: list[np.ndarray], layers: int, pool: str, dropout: float = 0.0, seed: int = 0) -> tuple[float, float, list[np.ndarray]]:
    """(logit, loss, gradients) of one graph, by sums over its edges. With dropout, channels of each layer go by a draw that the seed fixes."""
    n, rng = len(x), np.random.default_rng(seed)
    d = 1 / np.sqrt(1.0 + np.bincount(dst, minlength=n))
    along = (d[src] * d[dst])[:, None]

    def spread(h: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = h * (d * d)[:, None]
        np.add.at(out, b, h[a] * along)
        return out

    inputs, masks, h = [], [], x
    for i in range(layers):
        inputs.append(spread(h, src, dst))
        z = inputs[-1] @ model_weights[2 * i] + model_weights[2 * i + 1]
        keep = (rng.random(z.shape) >= dropout) / (1 - dropout) if dropout else 1.0
        masks.append((z > 0) * keep)
        h = z * masks[-1]
    pooled = {"mean": h.mean(0), "add": h.sum(0), "max": h.max(0)}[pool]
    logit = float(pooled @ model_weights[-2][:, 0] + model_weights[-1][0])
    loss = max(logit, 0) - logit * y + np.log1p(np.exp(-abs(logit)))
    g = 1 / (1 + np.exp(-np.clip(logit, -500, 500))) - y
    out: list[np.ndarray] = [g * pooled[:, None], np.array([g])]
    back = g * model_weights[-2][:, 0]
    if pool == "max":
        dh = np.zeros_like(h)
        dh[h.argmax(0), np.arange(h.shape[1])] = back
    else:
        dh = np.repeat(back[None], n, 0) / (n if pool == "mean" else 1)
    for i in reversed(range(layers)):
        dz = dh * masks[i]
        out = [inputs[i].T @ dz, dz.sum(0), *out]
        dh = spread(dz @ model_weights[2 * i].T, dst, src)
    return logit, float(loss), out


def _sums(graphs: DataFrame, model: GCNModel, seed: int, dropout: float) -> dict[str, np.ndarray]:
    """Sums over the graphs: gradients, number, loss and confusion counts. Each partition returns one row of the weights' size."""
    weights, layers, pool = [w.copy() for w in model.weights], model.num_layers, model.pool

    def summed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, counts = [np.zeros_like(w) for w in weights], np.zeros(5)  # graphs, loss, true and false positives, false negatives
        for pdf in parts:
            for x, src, dst, y, h in zip(pdf["x"], pdf["src"], pdf["dst"], pdf["y"], pdf["h"]):
                if len(x):
                    logit, one, g = _gradients(np.stack(x).astype(float), np.array(src, int), np.array(dst, int), y, weights, layers, pool, dropout, [seed, h & (1 << 63) - 1])
                    total = [t + u for t, u in zip(total, g)]
                    counts += [1, one, logit >= 0 and y > 0.5, logit >= 0 and y <= 0.5, logit < 0 and y > 0.5]
        yield pd.DataFrame({"g": [np.concatenate([t.ravel() for t in total])], "counts": [counts]})

    parts = graphs.mapInPandas(summed, "g array<double>, counts array<double>").collect()
    n = sum(w.size for w in weights)
    return {"g": np.sum([r["g"] for r in parts], axis=0) if parts else np.zeros(n), "counts": np.sum([r["counts"] for r in parts], axis=0) if parts else np.zeros(5)}


def train(graphs: DataFrame, model: GCNModel, epochs: int = 30, lr: float = 1e-3, weight_decay: float = 1e-4, label_col: str = "label", batches: int = 1, validation: DataFrame | None = None) -> list[dict[str, float]]:
    """Adam over ``batches`` steps an epoch; ``graphs`` has one row per graph: x array<array>, src, dst arrays, label.

    Each step takes the graphs that a hash of graph and epoch deals to it (about n / batches; with 1, all).
    Training rows are cached while training runs. Returns the history: mean loss and, with validation
    rows of the same form, their loss and F1 at 0.5. The model's weights change; ``best_weights`` are those
    of the first epoch with the greatest F1 (without validation rows, the last).
    """
    form = lambda t: t.select("x", "src", "dst", F.col(label_col).cast("double").alias("y"), F.xxhash64("x", "src", "dst").alias("h"))
    graphs, held = form(graphs).persist(), None if validation is None else form(validation).persist()
    m, v, history, step, best = [np.zeros_like(w) for w in model.weights], [np.zeros_like(w) for w in model.weights], [], 0, -1.0
    model.best_weights = [w.copy() for w in model.weights]
    try:
        for epoch in range(1, epochs + 1):
            seen = np.zeros(5)
            for batch in range(batches):
                rows = graphs if batches == 1 else graphs.where(F.pmod(F.xxhash64("h", F.lit(model.seed + epoch)), F.lit(batches)) == batch)
                got = _sums(rows, model, model.seed + 1000 * epoch + batch, model.dropout)
                n = got["counts"][0]
                if not n:
                    continue
                seen, step, at = seen + got["counts"], step + 1, 0
                for i, w in enumerate(model.weights):
                    g = got["g"][at : at + w.size].reshape(w.shape) / n + weight_decay * w
                    at += w.size
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    model.weights[i] = w - lr * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
            line = {"epoch": epoch, "train_loss": seen[1] / max(1.0, seen[0])}
            if held is not None:
                n, loss, tp, fp, fn = _sums(held, model, 0, 0.0)["counts"]
                line |= {"val_loss": loss / max(1.0, n), "val_f1": 2 * tp / max(1.0, 2 * tp + fp + fn)}
            if line.get("val_f1", 0.0) > best or held is None:
                best, model.best_weights = line.get("val_f1", 0.0), [w.copy() for w in model.weights]
            history.append(line)
    finally:
        graphs.unpersist()
        if held is not None:
            held.unpersist()
    return history


def model_to_dict(model: GCNModel, weights: list[np.ndarray] | None = None) -> dict:
    """A model as plain numbers, for a JSON file."""
    options = {"in_channels": model.in_channels, "hidden": model.hidden, "num_layers": model.num_layers, "pool": model.pool, "seed": model.seed, "dropout": model.dropout}
    return options | {"weights": [w.tolist() for w in (model.weights if weights is None else weights)]}


def model_from_dict(stored: dict) -> GCNModel:
    return GCNModel(**{k: v for k, v in stored.items() if k != "weights"}, weights=[np.array(w, float) for w in stored["weights"]])


def as_graph_rows(nodes: DataFrame, edges: DataFrame, key: list[str], features_col: str = "features") -> DataFrame:
    """(key, x, src, dst): one row per graph, as training takes them."""
    x = nodes.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("node_id", F.col(features_col).alias("f")))), lambda r: r["f"]).alias("x"))
    e = edges.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("src", "dst"))).alias("e"))
    none = F.expr("cast(array() as array<struct<src:int,dst:int>>)")
    out = x.join(e, key, "left").withColumn("e", F.coalesce("e", none))
    return out.select(*key, "x", F.transform("e", lambda r: r["src"]).alias("src"), F.transform("e", lambda r: r["dst"]).alias("dst"))
