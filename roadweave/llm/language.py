"""Operator 11: language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over them, each filter's greatest answer in a window
is kept (max pooling) and a softmax gives a probability for each language. A text is dealt into windows of
``window`` bytes that overlap by the widest filter, so every byte sequence a filter can see is seen; the
text's probabilities are the mean of its windows', weighted by their bytes. Windows of many texts go
through the network together.

The network is fitted in numpy on the driver from a bounded sample: for each language about
``per_class`` different texts (the smallest by a hash of the text) with at most ``per_text`` windows
each, spread evenly over the text. Labels of many rows only change which texts the hash picks. Scoring
is one scan of all whole texts without a shuffle.

Defined cases: texts that are null, empty or without a letter are ``und`` with score 0, as is every text
if nothing could be learned; one language alone has score 1; rows with a null id or lang are not learned
from; repeated rows score alike and are learned once; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 256
UNKNOWN = "und"
#: Windows that go through the network at a time.
CHUNK = 256
LETTER = r"\p{L}"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class ByteCNN:
    """Weights: E (257 x width of the embedding, the last row stands for padding), one W and b for each filter width, and the softmax layer."""

    languages: list[str]
    window: int = 64
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    embedding: int = 8
    seed: int = 11
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.weights:
            rng, n = np.random.default_rng(self.seed), len(self.widths) * self.filters
            self.weights = {"E": rng.normal(0, 0.3, (PAD + 1, self.embedding)), "V": rng.normal(0, 0.1, (n, len(self.languages))), "c": np.zeros(len(self.languages))}
            for w in self.widths:
                self.weights |= {f"W{w}": rng.normal(0, (2 / (w * self.embedding)) ** 0.5, (w * self.embedding, self.filters)), f"b{w}": np.zeros(self.filters)}
            self.weights["E"][PAD] = 0
            self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    @property
    def length(self) -> int:
        """Bytes of a window with what it shares with the next."""
        return self.window + max(self.widths) - 1

    def kernel(self) -> tuple[np.ndarray, np.ndarray]:
        """All filters as one matrix over the widest one's bytes, and their biases."""
        top = max(self.widths) * self.embedding
        w = [np.vstack([self.weights[f"W{k}"], np.zeros((top - k * self.embedding, self.filters), np.float32)]) for k in self.widths]
        return np.hstack(w), np.concatenate([self.weights[f"b{k}"] for k in self.widths])

    def patches(self, windows: np.ndarray) -> np.ndarray:
        """(places, windows, bytes of the widest filter x embedding) of a (windows, length) matrix of bytes."""
        x, k = self.weights["E"][windows.T], max(self.widths)
        return np.concatenate([x[i : i + self.window] for i in range(k)], axis=2)

    def hidden(self, windows: np.ndarray, kernel: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
        w, b = kernel or self.kernel()
        return np.maximum((self.patches(windows) @ w).max(0) + b, 0)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        kernel, out = self.kernel(), []
        for lo in range(0, len(windows), CHUNK):
            out.append(softmax(self.hidden(windows[lo : lo + CHUNK], kernel) @ self.weights["V"] + self.weights["c"]))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def gradients(self, windows: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss and its gradient for each weight."""
        w, b = self.kernel()
        patches = self.patches(windows)
        z = patches @ w
        best, n, e = z.argmax(0), len(windows), self.embedding
        pooled = np.take_along_axis(z, best[None], 0)[0] + b
        h = np.maximum(pooled, 0)
        p = softmax(h @ self.weights["V"] + self.weights["c"])
        loss = float(-np.log(np.maximum(p[np.arange(n), y], 1e-9)).mean())
        d = p.copy()
        d[np.arange(n), y] -= 1
        d /= n
        dh = (d @ self.weights["V"].T) * (pooled > 0)
        out = {"V": h.T @ d, "c": d.sum(0), "E": np.zeros_like(self.weights["E"])}
        for i, k in enumerate(self.widths):
            mine = slice(i * self.filters, (i + 1) * self.filters)
            seen = patches[best[:, mine], np.arange(n)[:, None]][:, :, : k * e]  # windows x filters x bytes that answered most
            g = dh[:, mine]
            out[f"W{k}"] = np.einsum("nfk,nf->kf", seen, g)
            out[f"b{k}"] = g.sum(0)
            back = (g[:, :, None] * self.weights[f"W{k}"].T[None]).reshape(n, self.filters, k, e)
            at = best[:, mine]
            for j in range(k):
                np.add.at(out["E"], windows[np.arange(n)[:, None], at + j], back[:, :, j])
        out["E"][PAD] = 0
        return loss, out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def windows_of(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, window: int, length: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first ``most`` windows of texts that lie in one array of bytes: a (windows, length) matrix padded with PAD, the text of each, its own bytes."""
    counts = np.minimum(-(-sizes // window), most)
    text = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = nth * window
    left = sizes[text] - begin
    at = (starts[text] + begin)[:, None] + np.arange(length)
    inside = np.arange(length) < left[:, None]
    found = flat[np.minimum(at, max(0, len(flat) - 1))].astype(np.int16) if len(flat) else np.zeros(at.shape, np.int16)
    return np.where(inside, found, np.int16(PAD)), text, np.minimum(left, window)


def _as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in one array, where each begins and how long it is."""
    raw = pa.concat_arrays([texts.cast(pa.large_binary())])
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    flat = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8)
    return flat, offsets[:-1], np.diff(offsets)


def _sampler(window: int, length: int, per_text: int):
    """(text, lang) -> (window, lang): at most ``per_text`` windows of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, starts, sizes = _as_bytes(pc.fill_null(b.column(0), ""))
            rows, langs = [], b.column(1).to_pylist()
            for s, n, lang in zip(starts.tolist(), sizes.tolist(), langs):
                count = -(-n // window)
                for i in np.unique(np.linspace(0, count - 1, min(count, per_text)).astype(int)).tolist() if count else ():
                    rows.append((flat[s + i * window : s + min(n, i * window + length)].tobytes(), lang))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], names=["window", "lang"])

    return run


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", window: int = 64, length: int = 67, per_class: int = 600, per_text: int = 8, most_languages: int = 200) -> DataFrame:
    """(window bytes, lang) of the texts to learn from, of the ``most_languages`` languages with most different texts.

    A first pass estimates how many different texts each language has, so that the second keeps about
    ``per_class`` of each by a hash of the text; equal texts of a language count once.
    """
    open_ = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where(
        F.col("id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("id")) & F.col("text").rlike(LETTER))
    hashed = open_.withColumn("hash", F.xxhash64("text"))
    sizes = hashed.groupBy("lang").agg(F.approx_count_distinct("hash", 0.03).alias("texts")).orderBy(F.col("texts").desc(), "lang").limit(most_languages).collect()
    learned = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, per_class / r["texts"])) for r in sizes], "lang string, share double")
    share = F.col("hash").bitwiseAND((1 << 62) - 1) / float(1 << 62)
    kept = hashed.join(F.broadcast(learned), "lang").where(share <= F.col("share"))  # at most most_languages rows
    picked = kept.select("text", "lang", "hash").dropDuplicates(["hash", "lang"])
    return picked.select("text", "lang").mapInArrow(_sampler(window, length, per_text), "window binary, lang string")


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 600, per_text: int = 8, most_languages: int = 200, epochs: int = 12, batch: int = 128, rate: float = 3e-3, seed: int = 11) -> ByteCNN:
    """Fit on the sample by Adam. ``most_languages`` bounds the sample; languages beyond it are not learned."""
    shape = ByteCNN([], seed=seed)
    table = sample(
        docs, id_col=id_col, text_col=text_col, lang_col=lang_col, window=shape.window, length=shape.length, per_class=per_class, per_text=per_text, most_languages=most_languages
    ).toArrow()  # about languages x per_class x per_text windows at most
    langs = set(table.column("lang").to_pylist())
    model = ByteCNN(sorted(langs), seed=seed)
    if len(langs) < 2:
        return model
    rows = sorted(zip(table.column("window").to_pylist(), table.column("lang").to_pylist()))
    x = np.full((len(rows), model.length), PAD, np.int16)
    for i, (raw, _) in enumerate(rows):
        x[i, : len(raw)] = np.frombuffer(raw, np.uint8)
    place = {lang: i for i, lang in enumerate(model.languages)}
    return train(model, x, np.array([place[lang] for _, lang in rows]), epochs, batch, rate)


def train(model: ByteCNN, x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 3e-3) -> ByteCNN:
    rng = np.random.default_rng(model.seed)
    m, v, step = {k: np.zeros_like(w) for k, w in model.weights.items()}, {k: np.zeros_like(w) for k, w in model.weights.items()}, 0
    epochs = max(epochs, min(200, -(-300 * batch // max(1, len(x)))))  # small samples get enough steps too
    total = epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            _, g = model.gradients(x[rows], y[rows])
            step += 1
            now = rate * (1 - 0.9 * step / total)
            for k, w in model.weights.items():
                d = g[k] + (1e-4 * w if k != "E" else 0)
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                model.weights[k] = (w - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def predict(texts: pa.Array, model: ByteCNN) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    known = pc.fill_null(pc.match_substring_regex(texts, LETTER), False).to_pylist()
    n = len(texts)
    if not model.languages:
        return [UNKNOWN] * n, np.zeros(n)
    if len(model.languages) == 1:
        return [model.languages[0] if k else UNKNOWN for k in known], np.array(known, float)
    flat, starts, sizes = _as_bytes(pc.if_else(pa.array(known), pc.fill_null(texts, ""), ""))
    total = np.zeros((n, len(model.languages)))
    # texts one after the other, and one text's windows in parts, so that little is held at a time
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(sizes) >> 22)) + 1).tolist(), n]
    most = 1 << 14
    for lo, hi in zip(cuts, cuts[1:]):
        for part in range(0, int(sizes[lo:hi].max(initial=0)), model.window * most):
            windows, text, own = windows_of(flat, starts[lo:hi] + part, np.clip(sizes[lo:hi] - part, 0, None), model.window, model.length, most)
            p = model.probabilities(windows) * own[:, None]
            for j in range(p.shape[1]):
                total[lo:hi, j] += np.bincount(text, p[:, j], hi - lo)
    best = total.argmax(1)
    score = total[np.arange(n), best] / np.maximum(sizes, 1)
    return [model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known)], np.clip(np.where(known, score, 0.0), 0, 1)


def identify(docs: DataFrame, model: ByteCNN, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, lang_pred, score (0 to 1)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, score = predict(b.column(1), model)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["id", "held_out", "lang_pred", "score"])

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))
        .mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double")
        .withColumnRenamed("id", id_col)
    )
