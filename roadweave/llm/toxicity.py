"""Operator 10: toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms. ``y = w0 + sum w_i + sum_{i<j} <v_i, v_j>``: the
linear part catches single terms, the factors catch pairs (an insult together with a group
mention) that additive weights cannot. Only a bounded sample of labelled rows is used to fit
(``max_train``, a documented parameter); scoring streams every whole text once, without a shuffle.

Defined cases: a null or empty text has no terms and scores like the intercept; repeated rows
score alike; an empty label table (or one without both classes) gives the smoothed share of
toxic labels for all; an empty input gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import alnum_words

HASH_BITS = 20
#: The word cache of a task is emptied when it holds this many words.
CACHE_WORDS = 300_000
#: Least chi-square of a term beside a strong one: chance reaches it about once in 10^5 terms.
PARTNER_CHI = 20.0


@dataclass
class FactorizationMachine:
    """Weights of the kept buckets; at most ``max_features`` x (1 + factors) floats, so safe to send out."""

    buckets: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def raw(self, rows: list[np.ndarray]) -> np.ndarray:
        """Raw scores of documents given as arrays of positions in ``buckets``."""
        lens = np.fromiter(map(len, rows), np.int64, len(rows))
        out = np.full(len(rows), self.w0)
        if lens.sum():
            flat = np.concatenate(rows)
            at = np.repeat(np.arange(len(rows)), lens)
            out += np.bincount(at, self.w[flat], len(rows))
            for f in range(self.v.shape[1]):
                part = self.v[flat, f]
                out += 0.5 * (np.bincount(at, part, len(rows)) ** 2 - np.bincount(at, part * part, len(rows)))
        return out

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.raw(rows), -30, 30)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _hashes(word: str) -> list[int]:
    """Buckets of a word and of its openings of 3 to 6 letters, so inflected forms share what was learned."""
    mask = (1 << HASH_BITS) - 1
    forms = [word, *(f"^{word[:k]}" for k in range(3, 7) if len(word) >= k)]
    return [zlib.crc32(x.encode("utf-8", "replace")) & mask for x in forms]


def _terms(text: str | None) -> np.ndarray:
    return np.unique(np.array([h for w in set(alnum_words((text or "").lower())) for h in _hashes(w)], np.int32))


def _term_batches(batches):
    for b in batches:
        terms = [_terms(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.list_(pa.int32())), b.column(1)], names=["terms", "y"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        max_train: int = 20_000, max_features: int = 2048, anchors: int = 8, max_partners: int = 1024, min_docs: int = 4, factors: int = 6, epochs: int = 40, seed: int = 7) -> FactorizationMachine:
    """Fit on at most ``max_train`` labelled rows (the smallest by a hash of the id), never on held-out ids.

    Equal term sets with one label count once, so groups of copies don't stand for many documents.
    Buckets found in fewer than ``min_docs`` of these are left out; the ``max_features`` with the
    largest chi-square against the label stay, and beside them ``max_partners`` with the largest
    chi-square among the documents of one of the ``anchors`` strongest toxic buckets: terms that are
    neutral alone and decide beside another. That chi-square must reach PARTNER_CHI, so that terms that
    stand there by chance don't join.
    """
    picked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("id")))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(max_train)
    )
    sample = (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .join(F.broadcast(picked), "id")  # bounded by max_train rows of two numbers
        .select("text", F.col("y").cast("int").alias("y"))
        .mapInArrow(_term_batches, "terms array<int>, y int")
        .distinct()
    ).limit(max_train).persist()
    try:
        by_class = {r["y"]: r["n"] for r in sample.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
        pos, neg = by_class.get(1, 0), by_class.get(0, 0)
        prior = (pos + 0.5) / (pos + neg + 1.0)
        w0 = float(np.log(prior / (1 - prior)))
        none = FactorizationMachine(np.zeros(0, np.int32), w0 if pos or neg else -4.0, np.zeros(0), np.zeros((0, factors)))
        if not pos or not neg:
            return none
        a, b = F.col("a"), F.col("b")

        def chi(n_pos: Column, n_neg: Column) -> Column:
            return (a * (n_neg - b) - b * (n_pos - a)) ** 2 / ((a + b) * (n_pos + n_neg - a - b) + 1.0)

        counts = [F.sum((F.col("y") > 0).cast("double")).alias("a"), F.sum((F.col("y") <= 0).cast("double")).alias("b")]
        single = sample.select(F.explode("terms").alias("t"), "y").groupBy("t").agg(*counts).where(a + b >= min_docs).orderBy(chi(F.lit(pos), F.lit(neg)).desc(), "t").limit(max_features)
        kept = [(r["t"], r["a"], r["b"]) for r in single.select("t", "a", "b").collect()]
        strong: dict[tuple, int] = {}  # buckets that stand in the same documents count once
        for t, in_pos, in_neg in kept:
            if in_pos * neg > in_neg * pos and len(strong) < anchors:
                strong.setdefault((in_pos, in_neg), t)
        chosen = {t for t, _, _ in kept} | set(_partners(sample, strong, chi, counts, min_docs, max_partners))
        buckets = np.sort(np.array(sorted(chosen), np.int32))
        if not len(buckets):
            return none
        found = sample.select(F.array_sort(F.array_intersect("terms", F.array(*[F.lit(int(x)) for x in buckets]))).alias("terms"), "y").toArrow()  # flat arrays; rows of Python numbers would take the driver many times their memory
    finally:
        sample.unpersist()
    if not found.num_rows:
        return none
    x, y = _in_order(found.column("terms").combine_chunks(), found.column("y").to_numpy() > 0)
    return _train(buckets, [np.searchsorted(buckets, t) for t in x], y.astype(np.float64), w0, factors, epochs, seed)


def _in_order(terms: pa.ListArray, y: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows by their terms, then by y, so that a fit doesn't depend on the order in which rows came."""
    at, flat = terms.offsets.to_numpy(), terms.values.to_numpy()
    keys = (flat.astype(np.int64) + (1 << 31)).astype(">u4").tobytes()  # bytes in the order of the numbers
    order = sorted(range(len(y)), key=lambda i: (keys[4 * at[i] : 4 * at[i + 1]], y[i]))
    return [flat[at[i] : at[i + 1]] for i in order], y[order]


def _partners(sample: DataFrame, strong: dict[tuple, int], chi, counts: list[Column], min_docs: int, most: int) -> list[int]:
    """Buckets with the largest chi-square within the documents that hold one of the strong ones."""
    if not strong or not most:
        return []
    held = sample.select(F.explode(F.array_intersect("terms", F.array(*map(F.lit, strong.values())))).alias("anchor"), "terms", "y")
    n = {c: F.lit(None) for c in "ab"}
    for (in_pos, in_neg), t in strong.items():
        for c, v in (("a", in_pos), ("b", in_neg)):
            n[c] = F.when(F.col("anchor") == t, v).otherwise(n[c])
    pairs = held.select("anchor", F.explode("terms").alias("t"), "y").groupBy("anchor", "t").agg(*counts).where(F.col("a") + F.col("b") >= min_docs)
    best = pairs.groupBy("t").agg(F.max(chi(n["a"], n["b"])).alias("chi")).where(F.col("chi") >= PARTNER_CHI).orderBy(F.col("chi").desc(), "t").limit(most)
    return [r["t"] for r in best.select("t").collect()]


def _train(buckets: np.ndarray, x: list[np.ndarray], y: np.ndarray, w0: float, factors: int, epochs: int, seed: int) -> FactorizationMachine:
    """AdaGrad on the logistic loss with L2, over bounded sample rows only."""
    rng, n = np.random.default_rng(seed), len(buckets)
    m = FactorizationMachine(buckets, w0, np.zeros(n), rng.normal(0, 0.01, (n, factors)))
    g0, gw, gv = 1e-6, np.full(n, 1e-6), np.full((n, factors), 1e-6)
    rate, l2w, l2v, size = 0.25, 2e-5, 5e-4, min(256, max(16, len(x) // 40))  # small samples get enough steps too
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(order), size):
            rows = order[lo : lo + size]
            lens = np.fromiter((len(x[i]) for i in rows), np.int64, len(rows))
            flat = np.concatenate([x[i] for i in rows]) if lens.sum() else np.zeros(0, np.int64)
            at = np.repeat(np.arange(len(rows)), lens)
            err = 1 / (1 + np.exp(-np.clip(m.raw([x[i] for i in rows]), -30, 30))) - y[rows]
            step = err.mean()
            g0 += step * step
            m.w0 -= rate * step / np.sqrt(g0)
            if not len(flat):
                continue
            e = err[at] / len(rows)
            dw = np.bincount(flat, e, n) + l2w * m.w
            dv = np.empty_like(m.v)
            for f in range(factors):
                part = m.v[flat, f]
                total = np.bincount(at, part, len(rows))
                dv[:, f] = np.bincount(flat, e * (total[at] - part), n)
            dv += l2v * m.v
            gw += dw * dw
            gv += dv * dv
            m.w -= rate * dw / np.sqrt(gw)
            m.v -= 0.3 * rate * dv / np.sqrt(gv)
    return m


def _scorer(model: FactorizationMachine):
    """A function from texts to scores; its word cache lives as long as the task."""
    at = {int(b): i for i, b in enumerate(model.buckets)}
    seen: dict[str, tuple[int, ...]] = {}

    def positions(word: str) -> tuple[int, ...]:
        i = seen.get(word)
        if i is None:
            if len(seen) >= CACHE_WORDS:
                seen.clear()
            i = seen[word] = tuple(at[h] for h in _hashes(word) if h in at)
        return i

    def scores(texts: list[str | None]) -> np.ndarray:
        return model.scores([np.array(sorted({i for w in set(alnum_words((t or "").lower())) for i in positions(w)}), np.int64) for t in texts])

    return scores


def score(docs: DataFrame, model: FactorizationMachine, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: id, held_out, score (0 to 1), predicted. A single pass without a shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scored(batches):
        scores = _scorer(model)
        for b in batches:
            s = scores(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
        .mapInArrow(scored, f"id {kind}, held_out boolean, score double, predicted int")
        .withColumnRenamed("id", id_col)
    )


def drop_toxic(docs: DataFrame, model: FactorizationMachine, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that score below the threshold, with their columns as they are."""
    at = docs.columns.index(text_col)

    def kept(batches):
        scores = _scorer(model)
        for b in batches:
            yield b.filter(pa.array(scores(b.column(at).to_pylist()) < threshold))

    return docs.mapInArrow(kept, docs.schema)
