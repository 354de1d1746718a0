"""Random forests of any depth: large nodes are split by histograms over all partitions, the rest grows exactly in tasks.

Each tree sees a row as often as a Poisson draw says, made from hashes of row and tree, so that nothing
has to be stored for it. While a node has over ``task_rows`` rows, one pass samples it for thresholds, and
one sums class weights by threshold in each partition; the split with the least Gini impurity is added to
the top of its tree. Tops are a few arrays, sent to the tasks, which route their rows through them; trees
are taken in groups such that at most ``most_nodes`` nodes are split at a time. Once all nodes fit, the rows
of each go to one task, which grows the subtree to pure leaves (or the limits) over all thresholds.
With ``exact``, large nodes are split over all thresholds too: the rows of each value are counted, and
running counts along a feature come from ranges of its values in parallel.

A model is the tops and a stored table of subtrees. It grows with the data, so prediction sends it to the
tasks only up to ``sent_bytes``; beyond, rows and subtrees meet in a sort by subtree and stream past each other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.numbering import banded
from roadweave.sources.tables import drop, store

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Rows of a node that are looked at for thresholds, and thresholds of a feature.
SAMPLE, BINS = 128, 32
#: Values of several features that a node sorts at once.
_CELLS = 1 << 18


@dataclass(frozen=True)
class Options:
    trees: int = 200
    max_depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: int | None = None  # looked at in each node; None: the root of their number
    bootstrap: bool = True
    seed: int = 42
    task_rows: int = 50_000
    most_nodes: int = 4096
    exact: bool = False  # large nodes too: a row for each node, feature and different value is counted


def draw(rows: np.ndarray, *salts: int) -> np.ndarray:
    """Uniform numbers in [0, 1) by a hash of row numbers and salts (the mixing steps of splitmix64)."""
    with np.errstate(over="ignore"):
        z = rows.astype(np.uint64)
        for s in (*salts, 0):
            z = z + np.uint64((0x9E3779B97F4A7C15 * (s + 1)) & (2**64 - 1))
            z = (z ^ (z >> np.uint64(30))) * _M1
            z = (z ^ (z >> np.uint64(27))) * _M2
            z ^= z >> np.uint64(31)
    return (z >> np.uint64(11)) * 2.0**-53


def times_drawn(rows: np.ndarray, tree: int, o: Options) -> np.ndarray:
    """How often a tree sees each row: Poisson with mean 1."""
    if not o.bootstrap:
        return np.ones(len(rows), np.int64)
    steps = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))
    return np.searchsorted(steps, draw(rows, o.seed, tree), "right")


@dataclass
class Nodes:
    """Nodes of a tree or subtree as arrays; feature -1 stands for a leaf. ``value``: class weights."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def add(self, value: np.ndarray) -> int:
        for part, v in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, value)):
            part.append(v)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, threshold: float, left: np.ndarray, right: np.ndarray) -> tuple[int, int]:
        a, b = self.add(left), self.add(right)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, a, b
        return a, b

    def ready(self) -> Nodes:
        return Nodes(*(np.array(x) for x in (self.feature, self.threshold, self.left, self.right)), np.array(self.value))

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row; of a ``ready`` tree."""
        at, open_ = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(open_ := open_[self.feature[at[open_]] >= 0]):
            node = at[open_]
            at[open_] = np.where(x[open_, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return at

    def to_bytes(self) -> bytes:
        r = self.ready()
        return b"".join([np.array([len(r.feature), r.value.shape[1]], "<i4").tobytes(), *(a.astype("<i4").tobytes() for a in (r.feature, r.left, r.right)), r.threshold.astype("<f8").tobytes(), r.value.astype("<f8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> Nodes:
        n, k = np.frombuffer(data, "<i4", 2)
        feature, left, right = np.frombuffer(data, "<i4", 3 * n, 8).reshape(3, n)
        numbers = np.frombuffer(data, "<f8", n * (1 + k), 8 + 12 * n)
        return cls(feature, numbers[:n], left, right, numbers[n:].reshape(n, k))


def gini_gain(left: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What is gained (in weighted impurity, up to a constant) by splits with these class weights at the left; the last axis is classes."""
    right = total - left
    a, b = left.sum(-1), right.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((a > 0) & (b > 0), (left * left).sum(-1) / a + (right * right).sum(-1) / b, -np.inf)


def best_exact(columns: np.ndarray, rows: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, o: Options, order: np.ndarray, most: int) -> tuple[int, float] | None:
    """The best split of some rows over all thresholds of the first ``most`` features of ``order`` that aren't constant; None if all are. ``columns``: a line for each feature."""
    n = len(rows)
    weights = [np.where(y[rows] == c, w[rows], 0.0) for c in range(classes)]
    best, seen, start = None, 0, 0
    while seen < most and start < len(order):  # as many features at once as are still wanted; constant ones don't count
        wanted = order[start : start + min(most - seen, max(1, _CELLS // n))]
        start += len(wanted)
        part = columns[wanted[:, None], rows]
        varied = np.flatnonzero(part.min(1) < part.max(1))
        if not len(varied):
            continue
        seen += len(varied)
        part = part[varied]
        at = np.argsort(part, 1, kind="stable")
        v = np.take_along_axis(part, at, 1)
        a = b = up = down = 0.0
        for weight in weights:  # as ``gini_gain``, class by class
            left = np.cumsum(weight[at], 1)[:, :-1]
            right = weight.sum() - left
            a, b, up, down = a + left, b + right, up + left * left, down + right * right
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((a > 0) & (b > 0), up / a + down / b, -np.inf)
        gain[v[:, 1:] == v[:, :-1]] = -np.inf
        if o.min_leaf > 1:
            gain[:, : o.min_leaf - 1] = gain[:, max(0, n - o.min_leaf) :] = -np.inf
        for k, i in enumerate(gain.argmax(1).tolist()):
            if gain[k, i] > -np.inf and (best is None or gain[k, i] > best[0]):
                middle = (v[k, i] + v[k, i + 1]) / 2
                best = (gain[k, i], int(wanted[varied[k]]), float(middle if middle < v[k, i + 1] else v[k, i]))
    return None if best is None else best[1:]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, o: Options, depth: int, seed: list[int]) -> Nodes:
    """A whole subtree over rows that fit a task."""
    rng, out = np.random.default_rng(seed), Nodes()
    most = o.features or max(1, int(np.sqrt(x.shape[1])))
    value = lambda rows: np.bincount(y[rows], w[rows], classes)
    columns, everything = np.ascontiguousarray(x.T), np.arange(len(x))
    todo = [(out.add(value(everything)), everything, depth)]
    while todo:
        node, rows, at = todo.pop()
        if len(rows) < max(o.min_split, 2) or (o.max_depth is not None and at >= o.max_depth) or np.count_nonzero(out.value[node]) < 2:
            continue
        found = best_exact(columns, rows, y, w, classes, o, rng.permutation(x.shape[1]), most)
        if found is None:
            continue
        side = columns[found[0], rows] <= found[1]
        a, b = rows[side], rows[~side]
        left, right = out.split(node, *found, value(a), value(b))
        todo += [(right, b, at + 1), (left, a, at + 1)]
    return out


@dataclass
class Forest:
    classes: list[int]
    tops: list[Nodes]
    subtrees: DataFrame  # (tree, node, data): of the leaves of tops that have one
    options: Options
    width: int

    def __post_init__(self) -> None:
        self.tops = [t.ready() for t in self.tops]

    def first_splits(self) -> dict[int, tuple[int, float, np.ndarray, np.ndarray]]:
        """(feature, threshold, class weights left, right) of each tree's root, from its top or, if that is one node, from its subtree; trees of one leaf have none."""
        roots = {t: top for t, top in enumerate(self.tops) if top.feature[0] >= 0}
        single = [t for t in range(len(self.tops)) if t not in roots]
        if single:
            for r in self.subtrees.where(F.col("tree").isin(single) & (F.col("node") == 0)).collect():
                roots[r["tree"]] = Nodes.from_bytes(bytes(r["data"]))
        return {t: (int(n.feature[0]), float(n.threshold[0]), n.value[n.left[0]], n.value[n.right[0]]) for t, n in roots.items() if n.feature[0] >= 0}


def _batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        yield b.column(0).to_numpy(), b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), b.column(2).to_numpy(), b.column(3).to_numpy()


class _Grower:
    """Tops of a group of trees while they are split. ``rows``: (row, x, y, w), stored."""

    def __init__(self, rows: DataFrame, width: int, weights: list[float], o: Options, trees: list[int]):
        self.rows, self.width, self.classes, self.weights, self.o, self.trees = rows, width, len(weights), np.array(weights), o, trees
        self.tops = {t: Nodes() for t in trees}
        self.depth: dict[tuple[int, int], int] = {}
        self.size: dict[tuple[int, int], int] = {}
        self.done: set[tuple[int, int]] = set()  # leaves that nothing is to be grown in

    def summed(self, of) -> dict:
        """Arrays by key, summed over all partitions. ``of`` gives (key, array) for a tree's routed rows."""
        tops, width, o = {t: n.ready() for t, n in self.tops.items()}, self.width, self.o

        def run(part):
            held: dict = {}
            for number, x, y, w in _batches(part, width):
                for t, top in tops.items():
                    k = times_drawn(number, t, o)
                    use = k > 0
                    for key, a in of(t, top.route(x[use]), number[use], x[use], y[use], w[use] * k[use]):
                        held[key] = held[key] + a if key in held else a
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in held], pa.int32()), pa.array([n for _, n in held], pa.int32()), pa.array([a.ravel() for a in held.values()], pa.list_(pa.float64()))], names=["t", "node", "a"])

        parts = self.rows.mapInArrow(run, "t int, node int, a array<double>").rdd.map(lambda r: ((r[0], r[1]), np.array(r[2])))
        return dict(parts.reduceByKey(lambda a, b: a + b).collect())  # at most most_nodes arrays of bounded size

    def plant(self) -> None:
        c = self.classes

        def of(t, node, number, x, y, w):
            if len(y):
                yield (t, 0), np.append(np.bincount(y, w, c), len(y))

        for top in self.tops.values():
            top.add(np.zeros(c))
        found = self.summed(of)
        for t in self.trees:
            a = found.get((t, 0), np.zeros(c + 1))
            self.tops[t].value[0] = a[:c]
            self.depth[t, 0], self.size[t, 0] = 0, int(a[c])

    def large(self) -> list[tuple[int, int]]:
        o = self.o
        return sorted(
            k for k, n in self.size.items()
            if n > o.task_rows and k not in self.done and self.tops[k[0]].feature[k[1]] < 0 and n >= o.min_split
            and (o.max_depth is None or self.depth[k] < o.max_depth) and np.count_nonzero(self.tops[k[0]].value[k[1]]) > 1
        )

    def level(self, nodes: list[tuple[int, int]]) -> None:
        """Splits each of the nodes, or finds that all its rows are alike."""
        most = self.o.features or max(1, int(np.sqrt(self.width)))
        orders = {k: np.random.default_rng([self.o.seed, *k]).permutation(self.width) for k in nodes}
        if self.o.exact:
            self.exact_level(orders, most)
            return
        bounds = self.thresholds(orders, most)
        self.done |= {k for k in nodes if k not in bounds}
        c = self.classes

        def of(t, node, number, x, y, w):
            for n in np.unique(node).tolist():
                if (t, n) in bounds:
                    here = node == n
                    features, cuts = bounds[t, n]
                    out = np.zeros((len(features), BINS + 1, c, 2))
                    for i, j in enumerate(features):
                        at = np.searchsorted(cuts[i], x[here, j])
                        np.add.at(out[i], (at, y[here]), np.column_stack([w[here], np.ones(here.sum())]))
                    yield (t, n), out.ravel()

        for (t, n), flat in self.summed(of).items():
            features, cuts = bounds[t, n]
            h = flat.reshape(len(features), BINS + 1, c, 2)
            left = np.cumsum(h, 1)[:, :-1]
            total = h[0].sum(0)
            gain = gini_gain(left[..., 0], total[:, 0])
            count, every = left[..., 1].sum(-1), total[:, 1].sum()
            gain[(count < self.o.min_leaf) | (every - count < self.o.min_leaf)] = -np.inf
            i, j = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[i, j] == -np.inf:
                self.done.add((t, n))
                continue
            a, b = self.tops[t].split(n, int(features[i]), float(cuts[i][j]), left[i, j, :, 0], total[:, 0] - left[i, j, :, 0])
            for child, rows in ((a, count[i, j]), (b, every - count[i, j])):
                self.depth[t, child], self.size[t, child] = self.depth[t, n] + 1, int(rows)

    def exact_level(self, orders: dict, most: int) -> None:
        """As ``level``, over all thresholds."""
        tops, width, o, c = {t: n.ready() for t, n in self.tops.items()}, self.width, self.o, range(self.classes)
        open_ = {t: np.array([n for s, n in orders if s == t]) for t in tops}

        def run(part):
            for number, x, y, _ in _batches(part, width):
                for t, top in tops.items():
                    k, node = times_drawn(number, t, o), top.route(x)
                    at = np.flatnonzero((k > 0) & np.isin(node, open_[t]))
                    if len(at):
                        each = lambda a, kind: pa.array(np.repeat(a[at], width), kind)  # noqa: B023, E731
                        cols = [pa.array(np.full(len(at) * width, t), pa.int32()), each(node, pa.int32()), pa.array(np.tile(np.arange(width), len(at)), pa.int32()), pa.array(x[at].ravel()), each(y, pa.int32()), each(k, pa.int64())]
                        yield pa.RecordBatch.from_arrays(cols, names=["t", "node", "j", "v", "y", "k"])

        group = ["t", "node", "j"]
        counts = [f"n{i}" for i in c] + ["rows"]
        values = self.rows.mapInArrow(run, "t int, node int, j int, v double, y int, k long").groupBy(*group, "v").agg(*(F.sum(F.when(F.col("y") == i, F.col("k")).otherwise(0)).alias(f"n{i}") for i in c), F.count("*").alias("rows"))
        ranged = banded(values, [*group, "v"])
        parts = ranged.groupBy(*group, "__b").agg(*(F.sum(n).alias(n) for n in counts), F.count("*").alias("values"))  # a row for each range and feature
        along, whole = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*group)
        parts = parts.select(*group, "__b", *(F.coalesce(F.sum(n).over(along), F.lit(0)).alias(f"before_{n}") for n in counts), *(F.sum(n).over(whole).alias(f"all_{n}") for n in counts), F.sum("values").over(whole).alias("values"))
        own = Window.partitionBy(*group, "__b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        left = ranged.select(*group, "__b", "v", *(F.sum(n).over(own).alias(n) for n in counts)).join(parts, [*group, "__b"]).withColumns({n: F.col(n) + F.col(f"before_{n}") for n in counts})

        def side(of) -> Column:
            weighed = [of(f"n{i}") * float(self.weights[i]) for i in c]
            total = sum(weighed[1:], weighed[0])
            return sum((w * w for w in weighed[1:]), weighed[0] * weighed[0]) / F.when(total > 0, total)

        rest = lambda n: F.col(f"all_{n}") - F.col(n)
        fits = (F.col("rows") >= max(o.min_leaf, 1)) & (rest("rows") >= max(o.min_leaf, 1))
        gain = F.when(fits, side(F.col) + side(rest))
        best = left.groupBy(*group).agg(F.max(F.when(gain.isNotNull(), F.struct(gain.alias("gain"), (-F.col("v")).alias("down"), "v", *counts))).alias("m"), *(F.first(f"all_{n}").alias(f"all_{n}") for n in counts), F.first("values").alias("values"))
        found: dict = {}
        for r in best.collect():  # one row for each node and feature
            found.setdefault((r["t"], r["node"]), {})[r["j"]] = r
        chosen = {}
        for k, order in orders.items():
            seen = [found[k][j] for j in order.tolist() if found[k][j]["values"] > 1][:most]
            split = max((r for r in seen if r["m"] is not None), key=lambda r: r["m"]["gain"], default=None)
            if split is None:
                self.done.add(k)
            else:
                chosen[k] = split
        if chosen:
            at = self.rows.sparkSession.createDataFrame([(*k, r["j"], r["m"]["v"]) for k, r in chosen.items()], "t int, node int, j int, cut double")
            above = {(r["t"], r["node"]): r["next"] for r in ranged.join(F.broadcast(at), group).where("v > cut").groupBy("t", "node").agg(F.min("v").alias("next")).collect()}
        drop(ranged)
        for (t, n), r in chosen.items():
            v, after = r["m"]["v"], above[t, n]
            middle = (v + after) / 2
            count, every = (np.array([of(f"n{i}") for i in c]) for of in (lambda x: r["m"][x], lambda x: r[f"all_{x}"]))  # noqa: B023
            a, b = self.tops[t].split(n, r["j"], middle if middle < after else v, count * self.weights, (every - count) * self.weights)
            for child, rows in ((a, r["m"]["rows"]), (b, r["all_rows"] - r["m"]["rows"])):
                self.depth[t, child], self.size[t, child] = self.depth[t, n] + 1, rows

    def thresholds(self, orders: dict, most: int) -> dict:
        """(features, thresholds of each) of each node from about SAMPLE of its rows; if these are alike, from the least and greatest values of all its rows."""
        tops, width, o, sizes = {t: n.ready() for t, n in self.tops.items()}, self.width, self.o, {k: self.size[k] for k in orders}

        def run(part):
            for number, x, _, _ in _batches(part, width):
                for t, top in tops.items():
                    use = times_drawn(number, t, o) > 0
                    node, mine = top.route(x[use]), x[use]
                    share = np.array([2.0 * SAMPLE / sizes[t, n] if (t, n) in sizes else 0.0 for n in range(len(top.feature))])
                    at = np.flatnonzero(draw(number[use], o.seed, t, 7) < share[node])
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t), pa.int32()), pa.array(node[at], pa.int32()), pa.array(list(mine[at]), pa.list_(pa.float64()))], names=["t", "node", "x"])

        found = self.rows.mapInArrow(run, "t int, node int, x array<double>").groupBy("t", "node").applyInArrow(_quantiles(orders, most), "t int, node int, features array<int>, cuts array<double>")
        out = {(r["t"], r["node"]): (np.array(r["features"]), np.array(r["cuts"]).reshape(-1, BINS)) for r in found.collect() if r["features"]}
        alike = set(orders) - set(out)
        if alike:
            out |= self.middles(alike, orders, most)
        return out

    def middles(self, alike: set, orders: dict, most: int) -> dict:
        tops, width, o = {t: n.ready() for t, n in self.tops.items()}, self.width, self.o

        def run(part):
            held: dict = {}
            for number, x, _, _ in _batches(part, width):
                for t, top in tops.items():
                    use = times_drawn(number, t, o) > 0
                    node, mine = top.route(x[use]), x[use]
                    for n in np.unique(node).tolist():
                        if (t, n) in alike:
                            low, high = mine[node == n].min(0), mine[node == n].max(0)
                            a, b = held.get((t, n), (low, high))
                            held[t, n] = np.minimum(a, low), np.maximum(b, high)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.int32()), pa.array([k[1] for k in held], pa.int32()), *(pa.array([v[i] for v in held.values()], pa.list_(pa.float64())) for i in (0, 1))], names=["t", "node", "low", "high"])

        parts = self.rows.mapInArrow(run, "t int, node int, low array<double>, high array<double>").rdd.map(lambda r: ((r[0], r[1]), (np.array(r[2]), np.array(r[3]))))
        out = {}
        for k, (low, high) in parts.reduceByKey(lambda a, b: (np.minimum(a[0], b[0]), np.maximum(a[1], b[1]))).collect():
            features = [j for j in orders[k].tolist() if low[j] < high[j]][:most]
            if features:
                out[k] = np.array(features), np.array([np.linspace(low[j], high[j], BINS, endpoint=False) for j in features])
        return out

    def subtrees(self) -> DataFrame:
        """(tree, node, data) of all leaves that are to be grown."""
        tops, width, o, c = {t: n.ready() for t, n in self.tops.items()}, self.width, self.o, self.classes
        skip, depth = self.done, dict(self.depth)

        def run(part):
            for number, x, y, w in _batches(part, width):
                for t, top in tops.items():
                    k = times_drawn(number, t, o)
                    node = top.route(x)
                    shut = np.array([(t, n) in skip for n in range(len(top.feature))])
                    at = np.flatnonzero((k > 0) & ~shut[node])
                    if len(at):
                        cols = [pa.array(np.full(len(at), t), pa.int32()), pa.array(node[at], pa.int32()), pa.array(number[at]), pa.array(list(x[at]), pa.list_(pa.float64())), pa.array(y[at], pa.int32()), pa.array((w * k)[at])]
                        yield pa.RecordBatch.from_arrays(cols, names=["tree", "node", "row", "x", "y", "w"])

        def planted(table: pa.Table) -> pa.Table:
            t, n = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
            order = np.argsort(table.column("row").to_numpy(), kind="stable")  # so that a task that runs again draws alike
            x = table.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)[order]
            grown = grow(x, table.column("y").to_numpy()[order], table.column("w").to_numpy()[order], c, o, depth[t, n], [o.seed, t, n])
            return pa.table({"tree": pa.array([t], pa.int32()), "node": pa.array([n], pa.int32()), "data": pa.array([grown.to_bytes()], pa.binary())})

        routed = self.rows.mapInArrow(run, "tree int, node int, row long, x array<double>, y int, w double")
        return routed.groupBy("tree", "node").applyInArrow(planted, "tree int, node int, data binary")


def _quantiles(orders: dict, most: int):
    def of(table: pa.Table) -> pa.Table:
        k = table.column("t")[0].as_py(), table.column("node")[0].as_py()
        x = np.sort(np.stack(table.column("x").to_pylist()), 0)
        features = [j for j in orders[k].tolist() if x[0, j] < x[-1, j]][:most]
        at = (np.arange(BINS) * (len(x) - 1) / BINS).astype(int)
        return pa.table({"t": pa.array([k[0]], pa.int32()), "node": pa.array([k[1]], pa.int32()), "features": pa.array([features], pa.list_(pa.int32())), "cuts": pa.array([x[at][:, features].T.ravel()], pa.list_(pa.float64()))})

    return of


def train(rows: DataFrame, options: Options = Options(), features_col: str = "features", label_col: str = "y", balanced: bool = True) -> Forest:
    """Rows without features or label take no part. ``balanced``: a class's rows weigh n / (classes x rows of the class)."""
    known = rows.select(F.col(features_col).cast("array<double>").alias("x"), F.col(label_col).cast("long").alias("label")).where("x is not null and label is not null")
    numbered = store(known.withColumn("row", F.monotonically_increasing_id()))
    sizes = numbered.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("x")).alias("least"), F.max(F.size("x")).alias("most")).orderBy("label").collect()  # one row a class
    if not sizes:
        raise ValueError("no rows to fit on")
    width = sizes[0]["most"]
    if {s["least"] for s in sizes} | {s["most"] for s in sizes} != {width}:
        raise ValueError("features of several lengths")
    classes, n = [s["label"] for s in sizes], sum(s["n"] for s in sizes)
    weights = [n / (len(sizes) * s["n"]) if balanced else 1.0 for s in sizes]
    place = F.array_position(F.array(*map(F.lit, classes)), F.col("label")).cast("int") - 1
    base = numbered.select("row", "x", place.alias("y"), F.get(F.array(*map(F.lit, weights)), place).alias("w"))
    at_once = max(1, min(options.trees, options.most_nodes * options.task_rows // max(1, n)))
    tops, grown = [], []
    for lo in range(0, options.trees, at_once):
        group = _Grower(base, width, weights, options, list(range(lo, min(options.trees, lo + at_once))))
        group.plant()
        while nodes := group.large():
            group.level(nodes)
        tops += [group.tops[t] for t in group.trees]
        grown.append(store(group.subtrees()))
    out = grown[0]
    for more in grown[1:]:
        out = out.unionByName(more)
    drop(numbered)
    return Forest(classes, tops, out, options, width)


def probability(model: Forest, rows: DataFrame, features_col: str = "features", column: str = "probability", sent_bytes: int = 64 << 20) -> DataFrame:
    """``rows`` with the mean over trees of the leaves' class shares, as an array in the order of ``classes``; null where features are."""
    size = model.subtrees.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    if size <= sent_bytes:
        return rows.withColumn(column, _sent(model)(F.col(features_col).cast("array<double>")))
    return _met(model, rows, features_col, column)


def _shares(leaf: np.ndarray) -> np.ndarray:
    return leaf / np.maximum(leaf.sum(1, keepdims=True), 1e-300)


def _sent(model: Forest):
    held: dict[int, dict[int, bytes]] = {}
    for r in model.subtrees.collect():  # at most sent_bytes
        held.setdefault(r["tree"], {})[r["node"]] = bytes(r["data"])
    sent = model.subtrees.sparkSession.sparkContext.broadcast((model.tops, held))
    width, k = model.width, len(model.classes)

    @F.arrow_udf("array<double>")
    def of(column: pa.Array) -> pa.Array:
        tops, subtrees = sent.value
        known = column.is_valid().to_numpy(zero_copy_only=False)
        x = column.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        total = np.zeros((len(x), k))
        for t, top in enumerate(tops):
            node = top.route(x)
            for n in np.unique(node).tolist():
                at = np.flatnonzero(node == n)
                if n in subtrees.get(t, {}):
                    below = Nodes.from_bytes(subtrees[t][n])
                    total[at] += _shares(below.value[below.route(x[at])])
                else:
                    total[at] += _shares(top.value[n][None])
        out: list = [None] * len(column)
        for i, p in zip(np.flatnonzero(known).tolist(), total / len(tops)):
            out[i] = p
        return pa.array(out, pa.list_(pa.float64()))

    return of


def _met(model: Forest, rows: DataFrame, features_col: str, column: str) -> DataFrame:
    """Rows go to each tree's subtree in a shuffle; subtrees stand first in the order of their partition."""
    tops, width, k = model.tops, model.width, len(model.classes)
    numbered = store(rows.withColumn("__row", F.monotonically_increasing_id()))

    def routed(part):
        for b in part:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            for t, top in enumerate(tops):
                node = top.route(x)
                own = [_shares(top.value[n][None])[0] for n in node.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(node, pa.int32()), b.column(0), b.column(1), pa.array(own, pa.list_(pa.float64()))], names=["tree", "node", "row", "x", "p"])

    asked = numbered.where(F.col(features_col).isNotNull()).select("__row", F.col(features_col).cast("array<double>").alias("x")).mapInArrow(routed, "tree int, node int, row long, x array<double>, p array<double>")
    trees = model.subtrees.select("tree", "node", F.lit(None).cast("long").alias("row"), F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<double>").alias("p"), "data")
    met = trees.unionByName(asked.withColumn("data", F.lit(None).cast("binary"))).repartition("tree", "node").sortWithinPartitions("tree", "node", F.col("data").isNull())

    def answered(part):
        now, below = None, None
        for b in part:
            keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            lo = 0
            while lo < len(keys):
                if b.column(5)[lo].is_valid:
                    now, below = keys[lo], Nodes.from_bytes(b.column(5)[lo].as_py())
                    lo += 1
                    continue
                hi = lo + 1
                while hi < len(keys) and keys[hi] == keys[lo] and not b.column(5)[hi].is_valid:
                    hi += 1
                p = b.column(4).slice(lo, hi - lo)
                if now == keys[lo]:
                    x = b.column(3).slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                    p = pa.array(list(_shares(below.value[below.route(x)])), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(2).slice(lo, hi - lo), p], names=["row", "p"])
                lo = hi

    votes = met.mapInArrow(answered, "row long, p array<double>").groupBy("row").agg(F.array(*(F.sum(F.get("p", F.lit(j))) / float(len(tops)) for j in range(k))).alias(column))
    return numbered.join(votes.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")
