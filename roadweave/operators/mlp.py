"""Dense networks with ReLU units: distributed mini-batch training with early stopping, and prediction over Arrow batches.

Rows are dealt to mini-batches once, by a draw that is stored with them, and each mini-batch to some
partitions of numpy blocks; a step is a job over its own partitions only, which return the sum of their
gradients, so an epoch reads each row once. A tenth of the rows is held out; training ends when accuracy
there (without held-out rows, the training loss) has not risen by ``tol`` for ``patience`` epochs, and the
best epoch's weights stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.optim import Adam, flat, tree_sum, unflat
from roadweave.sources.tables import drop, store

#: Rows of one numpy block.
BLOCK_ROWS = 32_768


@dataclass
class DenseNet:
    """W and b of each layer. Two classes have one output unit (logistic), more have one each (softmax)."""

    classes: list[int]
    weights: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def drawn(cls, width: int, hidden: tuple[int, ...], classes: list[int], seed: int) -> DenseNet:
        rng, weights = np.random.default_rng(seed), []
        sizes = [width, *hidden, 1 if len(classes) <= 2 else len(classes)]
        for i, (a, b) in enumerate(zip(sizes, sizes[1:])):
            bound = np.sqrt((2.0 if i == len(sizes) - 2 else 6.0) / (a + b))
            weights += [rng.uniform(-bound, bound, (a, b)), rng.uniform(-bound, bound, b)]
        return cls(list(classes), weights)

    def activations(self, x: np.ndarray) -> list[np.ndarray]:
        """Inputs of each layer, then the output units before logistic or softmax."""
        out = [x]
        for i in range(0, len(self.weights), 2):
            z = out[-1] @ self.weights[i] + self.weights[i + 1]
            out.append(np.maximum(z, 0) if i < len(self.weights) - 2 else z)
        return out

    def chances(self, z: np.ndarray) -> np.ndarray:
        """Probability of each class from the output units."""
        if len(self.classes) == 1:
            return np.ones((len(z), 1))
        if len(self.classes) == 2:
            p = 1 / (1 + np.exp(-np.clip(z[:, 0], -500, 500)))
            return np.column_stack([1 - p, p])
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def gradient_sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """One array: rows, loss, and the sums of the gradients of all weights. ``y``: places of the classes."""
        layers = self.activations(x)
        p, n = self.chances(layers[-1]), np.arange(len(x))
        loss = -np.log(np.maximum(p[n, y], 1e-15)).sum()
        d = p.copy()
        d[n, y] -= 1
        d = d[:, 1:] if len(self.classes) == 2 else np.zeros_like(layers[-1]) if len(self.classes) == 1 else d
        out: list[np.ndarray] = []
        for i in reversed(range(0, len(self.weights), 2)):
            h = layers[i // 2]
            out = [h.T @ d, d.sum(0), *out]
            d = (d @ self.weights[i].T) * (h > 0) if i else d
        return np.concatenate([[len(x), loss], flat(out)])

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Rows, and how many of them have their class as the likeliest."""
        return np.array([len(x), (self.chances(self.activations(x)[-1]).argmax(1) == y).sum()], float)

    def probability(self, features: Column) -> Column:
        """Probability of each class as an array; null where features are."""
        net = self

        @F.pandas_udf("array<double>")
        def of(batch: pd.Series) -> pd.Series:
            known = batch.notna().to_numpy()
            out: list[np.ndarray | None] = [None] * len(batch)
            if known.any():
                chances = net.chances(net.activations(np.stack(batch[known].to_list()).astype(float))[-1])
                for i, p in zip(np.flatnonzero(known).tolist(), chances):
                    out[i] = p
            return pd.Series(out, dtype=object)

        return of(features.cast("array<double>"))


def _blocks(rows: DataFrame, width: int) -> RDD:
    """(x, y) numpy blocks of the rows of each partition; kept while training runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, len(b), BLOCK_ROWS):
                part = b.slice(lo, BLOCK_ROWS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.column(0).flatten().to_numpy(zero_copy_only=False).tobytes()], pa.binary()), pa.array([part.column(1).to_numpy().astype(np.int32).tobytes()], pa.binary())], names=["x", "y"])

    packed = rows.select("x", "y").mapInArrow(run, "x binary, y binary").rdd
    return packed.map(lambda r: (np.frombuffer(bytes(r[0])).reshape(-1, width), np.frombuffer(bytes(r[1]), np.int32))).persist(StorageLevel.MEMORY_AND_DISK)


def gradient_sums(rows: DataFrame, net: DenseNet, width: int) -> np.ndarray:
    """Rows, loss and gradients of rows (x array, y place of the class), summed in a tree."""
    blocks, size = _blocks(rows, width), sum(w.size for w in net.weights) + 2
    try:
        return tree_sum(blocks.map(lambda b: net.gradient_sums(*b)), size)
    finally:
        blocks.unpersist()


@dataclass
class Trained:
    net: DenseNet
    losses: list[float]
    scores: list[float]
    stopped: bool


def train(rows: DataFrame, hidden: tuple[int, ...] = (128, 64, 32), features_col: str = "features", label_col: str = "y", alpha: float = 1e-4, rate: float | None = None, batch_rows: int = 200, max_iter: int = 500,
          held_out: float = 0.1, tol: float = 1e-4, patience: int = 10, most_steps: int = 64, step_tasks: int = 64, task_rows: int = 50_000, seed: int = 42) -> Trained:
    """Adam on the mean loss with L2. ``batch_rows`` rows a step, more if an epoch would have over ``most_steps`` steps; at most ``step_tasks`` tasks a step.

    ``rate`` is 0.001 by default, more where ``max_iter`` leaves so few steps that they couldn't move the weights
    (3 over the number of steps, at most 0.05). Rows without features or label take no part. Classes are the distinct labels, in order.
    """
    known = rows.select(F.col(features_col).cast("array<double>").alias("x"), F.col(label_col).cast("long").alias("label")).where("x is not null and label is not null")
    dealt = store(known.withColumns({"held": F.rand(seed) < held_out, "draw": F.rand(seed + 1)}))
    sizes = dealt.groupBy("label").agg(F.count("*").alias("n"), F.count(F.when(~F.col("held"), 1)).alias("own"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).orderBy("label").collect()  # one row a class
    if not sizes:
        raise ValueError("no rows to fit on")
    width = sizes[0]["most"]
    if {s["least"] for s in sizes} | {s["most"] for s in sizes} != {width}:
        raise ValueError("features of several lengths")
    classes = [s["label"] for s in sizes]
    net = DenseNet.drawn(width, hidden, classes, seed)
    n = sum(s["own"] for s in sizes)
    steps = max(1, min(most_steps, -(-n // batch_rows)))
    tasks = max(1, min(step_tasks, -(-n // (steps * task_rows))))
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1
    placed = dealt.select("x", place.alias("y"), "held", "draw")
    own = _blocks(placed.where("not held").repartitionById(steps * tasks, F.least(F.floor(F.col("draw") * (steps * tasks)), F.lit(steps * tasks - 1)).cast("int")), width)
    test = _blocks(placed.where("held"), width)
    rate = rate or max(1e-3, min(0.05, 3.0 / (steps * max(1, max_iter))))
    sc, adam, size = rows.sparkSession.sparkContext, Adam(net.weights, rate), sum(w.size for w in net.weights)
    losses, scores, best, waited, kept, stopped = [], [], -np.inf, 0, [w.copy() for w in net.weights], False
    rng = np.random.default_rng(seed)
    has_test = any(s["n"] > s["own"] for s in sizes)
    try:
        for _ in range(max_iter):
            seen = np.zeros(2)
            for step in rng.permutation(steps).tolist():

                def partial(blocks, net=net):
                    yield sum((net.gradient_sums(x, y) for x, y in blocks), np.zeros(size + 2))

                got = np.sum(sc.runJob(own, partial, list(range(step * tasks, (step + 1) * tasks))), axis=0)
                if got[0]:
                    seen += got[:2]
                    decay = [alpha * w if w.ndim == 2 else np.zeros_like(w) for w in net.weights]
                    adam.step([(g + d) / got[0] for g, d in zip(unflat(got[2:], net.weights), decay)])
            losses.append(float(seen[1] / max(1.0, seen[0])))
            if has_test:
                count, right = tree_sum(test.map(lambda b, net=net: net.right(*b)), 2)
                scores.append(float(right / max(1.0, count)))
            score = scores[-1] if has_test else -losses[-1]
            waited = waited + 1 if score < best + tol else 0
            if score > best:
                best, kept = score, [w.copy() for w in net.weights]
            if waited > patience:
                stopped = True
                break
    finally:
        own.unpersist()
        test.unpersist()
        drop(dealt)
    net.weights = kept
    return Trained(net, losses, scores, stopped)
