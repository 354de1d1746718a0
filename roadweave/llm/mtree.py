"""M-tree over integer vectors: paged metric nodes and exact best-first search by inner product.

A node has a routing vector ``c``, a covering radius ``r`` and the distance ``p`` of ``c`` to its
parent's routing vector; leaf entries store their distance to the leaf's routing vector. For a query
``q`` every vector ``v`` below a node obeys ``q.v <= q.c + |q| d(v, c)``, so

* ``q.c + |q| r`` bounds a node whose product ``q.c`` was computed, and
* ``q.c' + |q| (p + r)``, with the parent's product and the stored distances (triangle inequality),
  bounds it before any product is computed; a leaf entry likewise with ``r = 0``.

Nodes are taken best bound first; the search ends when no bound reaches the k-th best result.
"""

from __future__ import annotations

import heapq
import io

import numpy as np

#: The k-th best score of a query that has no k results yet.
NONE = np.iinfo(np.int64).min

_FIELDS = ("ids", "vectors", "entry_dist", "center", "radius", "parent_dist", "first", "last", "leaf", "least_id")


class MTree:
    """Arrays of nodes; children of a node, and entries of a leaf, are the range first..last."""

    def __init__(self, **arrays: np.ndarray):
        for name in _FIELDS:
            setattr(self, name, arrays[name])

    @classmethod
    def build(cls, ids: np.ndarray, vectors: np.ndarray, page: int = 512, fanout: int = 32) -> MTree:
        """Bulk load: points go to the nearest of some far-apart routing vectors, level by level."""
        x = vectors.astype(np.float64)
        nodes: list[list] = [[np.arange(len(ids)), 0, 0.0]]  # points, routing point, distance to the parent's
        center, radius, parent, first, last, leaf, order, entry = [], [], [], [], [], [], [], []
        at, placed = 0, 0
        while at < len(nodes):
            points, c, up = nodes[at]
            dist = np.linalg.norm(x[points] - x[c], axis=1)
            center.append(c)
            radius.append(dist.max() if len(points) else 0.0)
            parent.append(up)
            leaf.append(len(points) <= page)
            if leaf[-1]:
                far = np.lexsort((ids[points], -dist))  # farthest first, so that what a bound lets through is a prefix
                order.append(points[far])
                entry.append(-dist[far])
                first.append(placed)
                placed += len(points)
                last.append(placed)
            else:
                first.append(len(nodes))
                for group, seed in cls._split(x, ids, points, c, dist, min(fanout, -(-len(points) // page))):
                    nodes.append([group, seed, float(np.linalg.norm(x[seed] - x[c]))])
                last.append(len(nodes))
            nodes[at] = [None, c, up]
            at += 1
        rows = np.concatenate(order)
        tree = cls(
            ids=ids[rows], vectors=vectors[rows], entry_dist=np.concatenate(entry), center=vectors[np.array(center)], radius=np.array(radius), parent_dist=np.array(parent),
            first=np.array(first), last=np.array(last), leaf=np.array(leaf), least_id=np.zeros(len(center), np.int64),
        )
        for i in reversed(range(len(center))):  # children stand behind their parents
            span = slice(first[i], last[i])
            tree.least_id[i] = (tree.ids if leaf[i] else tree.least_id)[span].min()
        return tree

    @staticmethod
    def _split(x, ids, points, c, dist, k):
        seeds, near = [c], dist.copy()
        own = np.zeros(len(points), np.int64)
        while len(seeds) < k and near.max() > 0:
            seeds.append(int(points[near.argmax()]))
            d = np.linalg.norm(x[points] - x[seeds[-1]], axis=1)
            own[d < near] = len(seeds) - 1
            near = np.minimum(near, d)
        groups = [points[own == s] for s in range(len(seeds))]
        if len(groups) == 1:  # equal vectors: pages by id
            by_id = points[np.argsort(ids[points], kind="stable")]
            return [(part, c) for part in np.array_split(by_id, k)]
        return [(g, s) for g, s in zip(groups, seeds) if len(g)]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{name: getattr(self, name) for name in _FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> MTree:
        with np.load(io.BytesIO(data)) as f:
            tree = cls(**{name: f[name] for name in _FIELDS})
        return tree

    def prepare(self) -> MTree:
        """Floating-point copies for search; whole numbers below 2**53 stay exact."""
        self.fv, self.fc = self.vectors.astype(np.float64), self.center.astype(np.float64)
        self.most = float(np.abs(self.fv).sum(1).max(initial=0))
        self.reach = self.parent_dist + self.radius
        return self

    def search(self, q: np.ndarray, k: int, floor: np.ndarray | None = None, floor_id: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """Up to k (scores, ids) of each query (row of q), best first, ties to the smaller id.

        Queries share the walk: nodes are taken by the best bound that any of them has, and a page is
        multiplied with those queries only whose own bound reaches their own k-th best. ``floor`` and
        ``floor_id``: a k-th best found elsewhere (NONE: none); only better ones return. Scores are kept and
        compared as whole numbers; only bounds are floating-point, with a slack above their rounding.
        """
        fq = q.astype(np.float64)
        norm = np.sqrt((fq * fq).sum(1))
        safe = self.most * float(np.abs(fq).max(initial=0)) < 2**53
        vectors, centers, asked = (self.fv, self.fc, fq) if safe else (self.vectors.astype(np.int64), self.center.astype(np.int64), q.astype(np.int64))
        slack = 1e-9 * (norm * (1 + self.most) + 1)  # above any rounding in a bound
        worst = np.full(len(q), NONE) if floor is None else np.array(floor, np.int64)
        least_of = lambda of: np.where(worst[of] == NONE, -np.inf, worst[of].astype(np.float64))
        worst_id = np.full(len(q), np.iinfo(np.int64).max) if floor_id is None else np.array(floor_id, np.int64)
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))  # query, score, id: the k best so far of each
        every = np.arange(len(q))
        product = (centers[:1] @ asked.T)[0]
        todo = [(-np.inf, 0, every, product, product + norm * self.radius[0] + slack)]
        while todo:
            _, node, of, product, bound = heapq.heappop(todo)
            # scores are whole: a bound within 1 of the k-th best leaves ties at most, and those lose if all ids are larger
            low = least_of(of)
            live = (bound >= low) & ~(safe & (bound < low + 1) & (self.least_id[node] > worst_id[of]))
            if not live.any():
                continue
            of, product, low = of[live], product[live], low[live]
            lo, hi = self.first[node], self.last[node]
            need = np.divide(low - product - slack[of], norm[of], out=np.full(len(of), -np.inf), where=norm[of] > 0)
            if self.leaf[node]:
                hi = lo + int(np.searchsorted(self.entry_dist[lo:hi], -need.min(), "right"))  # by the stored distance to the leaf's routing vector
                if hi == lo:
                    continue
                scores = vectors[lo:hi] @ asked[of].T
                scores = scores.astype(np.int64)
                least = worst[of]
                if hi - lo > k and (least == NONE).any():
                    least = np.maximum(least, np.partition(scores, hi - lo - k, axis=0)[hi - lo - k])
                entry, column = np.nonzero(scores >= least)
                new = of[column], scores[entry, column], self.ids[lo + entry]
                keep = (new[1] > worst[new[0]]) | (new[2] <= worst_id[new[0]])
                if keep.any():
                    found = self._best(k, *(np.concatenate([x, y[keep]]) for x, y in zip(found, new)))
                    self._raise(k, found, worst, worst_id)
            else:
                pass_by = self.reach[lo:hi, None] >= need[None]  # by the stored distances, before any product
                near = np.flatnonzero(pass_by.any(1))
                if not len(near):
                    continue
                products = centers[lo + near] @ asked[of].T
                bounds = products + norm[of] * self.radius[lo + near][:, None] + slack[of]
                passed = pass_by[near] & (bounds >= low)
                for n, p, b, w in zip((lo + near).tolist(), products, bounds, passed):
                    if w.any():
                        heapq.heappush(todo, (-float(b[w].max()), n, of[w], p[w], b[w]))
        cuts = np.searchsorted(found[0], every[1:])
        return list(zip(np.split(found[1], cuts), np.split(found[2], cuts))) if len(q) else []

    @staticmethod
    def _best(k: int, of: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((ids, -scores, of))
        of = of[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        order = order[rank < k]
        return of[rank < k], scores[order], ids[order]

    @staticmethod
    def _raise(k: int, found: tuple[np.ndarray, ...], worst: np.ndarray, worst_id: np.ndarray) -> None:
        """The k-th best of queries that have k."""
        of, scores, ids = found
        last = np.flatnonzero(np.append(of[1:] != of[:-1], True))
        last = last[last - np.searchsorted(of, of[last]) == k - 1]
        better = (scores[last] > worst[of[last]]) | ((scores[last] == worst[of[last]]) & (ids[last] < worst_id[of[last]]))
        last = last[better]
        worst[of[last]], worst_id[of[last]] = scores[last], ids[last]
