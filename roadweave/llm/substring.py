"""Operator 2: substring deduplication by repeated-phrase automata.

A window is ``window`` consecutive words. Words covered by a window whose sequence also starts in a
document with a smaller id are removed. Steps, each bounded in memory and dealt evenly:

1. Anchors. Every window has an anchor, its smallest k-gram hash; equal windows have equal anchors, so
   windows recur only where anchors do. Distinct anchors (about a fifth of the windows) meet in hash
   buckets as packed numbers; a document learns which of its anchors other documents have too.
2. Confirmed passages. Only windows with such an anchor meet by their 128-bit hashes, in runs that share
   an anchor. The answer to a document: runs of windows that recur in an earlier document, and where.
3. Automata. Both texts of each run go to the shard of that earlier passage. A shard compiles its
   windows into an Aho-Corasick automaton (pyahocorasick, over word numbers) and streams the texts of
   all documents dealt to it through the automaton, which finds every occurrence word for word. Texts
   without a confirmed passage are not streamed: every shard would have to read the whole corpus.
4. Documents are joined with their verified runs; the words that stay are hashed.

Before each shuffle a task settles what it can see itself: of equal anchors or windows in its batch, one
goes out, and the other documents refer to it. Where many documents hold a window they refer to each
other as a tree: each to one a ``FAN_OUT``-th of its place in their order, which is earlier and holds the
window too. So a passage that a third of all documents share is no larger a shard than others. The
documents' texts are shuffled once, by id; the joins of steps 2, 3 and 4 read that same exchange. Hash
buckets hold about ``PART_BYTES`` of text each, so their number follows the input and a task's memory does not.

Words have two 64-bit hashes that mix eight bytes at a time, and windows two sums of these with
multipliers of their own for each place, so different windows are told apart by 128 bits.

Defined cases: null and empty texts have no words; texts below ``window`` words lose none; a null id is
neither smaller nor greater than another: such rows lose no words and are no source; rows of one id do
not count as earlier than each other and each keep a row; empty tables give no rows; very long texts
are cut into several automata; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import n_partitions
from roadweave.llm.packed import deal, from_low_bytes, low_bytes, pack, starts, unpack

#: Bytes of an anchor hash that are sent; a false recurrence only costs a confirmation.
ANCHOR_BYTES = 6
#: Entries that a task gathers before it settles and sends them.
BATCH_ENTRIES = 1_500_000
#: Windows of one earlier document that one automaton holds at most.
AUTOMATON_WINDOWS = 16_384

#: Later documents that one earlier passage serves, for each task that settles and once among them.
FAN_OUT = 64
#: Bytes of text whose anchors or windows meet in one bucket.
PART_BYTES = 32 << 20
#: Longer words are hashed one by one, shorter ones all at once.
LONG_WORD = 256

_MIX, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def split_words(text: bytes | None) -> list[bytes]:
    """bytes.split cuts at x20 and x09-x0D only."""
    return (text or b"").split()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX_2
    return h ^ (h >> np.uint64(31))


class WordHasher:
    """Two 64-bit hashes of all words of a text at once: eight bytes of each word are mixed in at a time."""

    #: Longer texts are hashed in parts that end at white space.
    part = 1 << 19
    #: Multipliers of the two hashes.
    series = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)

    def _hash(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(first byte, hashes) of each word."""
        padded = data + bytes(8)
        b = np.frombuffer(data, np.uint8)
        eights = np.ndarray((len(b) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
        inside = np.zeros(len(b) + 2, np.int8)
        inside[1:-1] = ~_IS_SPACE[b]
        edges = np.flatnonzero(np.diff(inside))
        first, end = edges[::2], edges[1::2]
        size = end - first
        h = size.astype(np.uint64)[:, None] * self.series
        short = size <= LONG_WORD
        of, done = np.flatnonzero(short), 0
        while len(of):
            v = eights[first[of] + done] & _LOW_BYTES[np.minimum(size[of] - done, 8)]
            h[of] = _mixed((h[of] ^ v[:, None]) * self.series)
            done += 8
            of = of[size[of] > done]
        for i in np.flatnonzero(~short).tolist():
            h[i] = np.frombuffer(hashlib.blake2b(data[first[i] : end[i]], digest_size=16).digest(), "<u8")
        return first, h

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The words' hashes of each text; short texts are hashed together."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) + 1 <= self.part:
                size += len(texts[hi]) + 1
                hi += 1
            if size > self.part:
                out.append(self._long(texts[lo]))
            else:
                first, h = self._hash(b"\n".join(texts[lo:hi]))
                bounds = np.cumsum([len(t) + 1 for t in texts[lo:hi]])
                out += np.split(h, np.searchsorted(first, bounds[:-1]))
            lo = hi
        return out

    def _long(self, text: bytes) -> np.ndarray:
        found, at = [], 0
        while at < len(text):
            end = at + self.part
            if end < len(text):
                cut = max(text.rfind(bytes([c]), at, end) for c in np.flatnonzero(_IS_SPACE).tolist())
                while cut < at and end < len(text):  # one word fills the part
                    end = min(2 * end - at, len(text))
                    cut = max(text.rfind(bytes([c]), at, end) for c in np.flatnonzero(_IS_SPACE).tolist())
                end = cut + 1 if cut >= at else len(text)
            found.append(self._hash(text[at:end])[1])
            at = end
        return np.concatenate(found)


def _rolled(h: np.ndarray, size: int, series: int = 0) -> np.ndarray:
    """64-bit hashes of each ``size`` consecutive values; each series has multipliers of its own."""
    n = len(h) - size + 1
    out = np.zeros(n, np.uint64)
    for j, m in enumerate(np.random.default_rng((series, size)).integers(0, 1 << 63, size, np.uint64)):
        out += h[j : j + n] * (m * np.uint64(2) + np.uint64(1))
    out ^= out >> np.uint64(31)
    out *= _MIX
    return out ^ (out >> np.uint64(29))


def _anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window, cut to ANCHOR_BYTES."""
    g = _rolled(h, gram) & np.uint64((1 << 8 * ANCHOR_BYTES) - 1)
    n = len(h) - window + 1
    out = g[:n].copy()
    for j in range(1, window - gram + 1):
        np.minimum(out, g[j : j + n], out=out)
    return out


def _windows(hasher: WordHasher, texts: list[bytes | None], window: int, gram: int, with_hashes: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(anchors, two window hashes) of each text, empty below ``window`` words. Neighbouring texts are rolled over together; windows across their border are left out."""
    none, no_hashes = np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64)
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or b"") <= hasher.part):
            size += len(texts[hi] or b"")
            hi += 1
        words = hasher.texts([t or b"" for t in texts[lo:hi]])
        h = np.concatenate(words)
        one, two = np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])
        anchors = _anchors(one, window, gram) if len(h) >= window else none
        hashes = np.stack([_rolled(one, window), _rolled(two, window, 1)], 1) if with_hashes and len(h) >= window else no_hashes
        at = 0
        for w in words:
            n = len(w) - window + 1
            yield (anchors[at : at + n], hashes[at : at + n]) if n > 0 else (none, no_hashes)
            at += len(w)
        lo = hi


def _by_part(part: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """(part, columns of its entries in their order) for each part."""
    order = np.argsort(part, kind="stable")
    at = starts(part[order])
    for lo, hi in zip(at, [*at[1:], len(order)]):
        rows = order[lo:hi]
        yield int(part[rows[0]]), [c[rows] for c in columns]


# 1. Anchors

_MET = "part int, known boolean, docs binary, data binary"


def _send_anchors(docs: list[int], found: list[np.ndarray], parts: int) -> pa.RecordBatch:
    """Of the documents that share an anchor here, the smallest stands for it; all of them know already."""
    doc = np.repeat(np.array(docs, np.int64), [len(f) for f in found])
    h = np.concatenate(found) if found else np.zeros(0, np.uint64)
    order = np.lexsort((doc, h))
    doc, h = doc[order], h[order]
    at = starts(h)
    size = np.diff(np.append(at, len(h)))
    shared = np.repeat(doc[at] != doc[np.append(at[1:], len(h)) - 1], size) if len(h) else np.zeros(0, bool)
    rows: list[tuple] = []
    first = np.zeros(len(h), bool)
    first[at] = True
    for known, keep in ((False, first), (True, shared)):
        d, a = doc[keep], h[keep]
        order = np.argsort(d, kind="stable")
        d, a = d[order], a[order]
        rows += [(p, known, pack(x), low_bytes(y, ANCHOR_BYTES)) for p, (x, y) in _by_part(deal(d if known else a, parts), d, a)]
    return _batch(rows, _MET)


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def shared_anchors(docs: DataFrame, *, window: int, gram: int, parts: int) -> DataFrame:
    """docs (id, text) -> (doc, anchors): for each document the sorted anchors that another document has too."""

    def sent(batches):
        hasher = WordHasher()
        ids: list[int] = []
        found: list[np.ndarray] = []
        n = 0
        for b in batches:
            for doc, (anchors, _) in zip(b.column(0).to_pylist(), _windows(hasher, b.column(1).to_pylist(), window, gram, False)):
                if len(anchors):
                    ids.append(doc)
                    found.append(np.unique(anchors))
                    n += len(found[-1])
                if n >= BATCH_ENTRIES:
                    yield _send_anchors(ids, found, parts)
                    ids, found, n = [], [], 0
        yield _send_anchors(ids, found, parts)

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        docs_, hashes = {}, {}
        for known in (False, True):
            own = pdf[pdf["known"] == known]
            docs_[known] = np.concatenate([np.zeros(0, np.int64), *map(unpack, own["docs"])])
            hashes[known] = np.concatenate([np.zeros(0, np.uint64), *(from_low_bytes(x, ANCHOR_BYTES) for x in own["data"])])
        doc, h = docs_[False], hashes[False]
        order = np.lexsort((doc, h))
        doc, h = doc[order], h[order]
        at = starts(h)
        ends = np.append(at[1:], len(h))
        again = np.repeat(doc[at] != doc[ends - 1], ends - at) if len(h) else np.zeros(0, bool)
        doc, h = np.concatenate([doc[again], docs_[True]]), np.concatenate([h[again], hashes[True]])
        order = np.argsort(doc, kind="stable")
        doc, h = doc[order], h[order]
        rows = [(p, pack(x), low_bytes(y, ANCHOR_BYTES)) for p, (x, y) in _by_part(deal(doc, parts), doc, h)]
        return pd.DataFrame(rows, columns=["part", "docs", "data"])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = np.concatenate([np.zeros(0, np.int64), *map(unpack, pdf["docs"])])
        h = np.concatenate([np.zeros(0, np.uint64), *(from_low_bytes(x, ANCHOR_BYTES) for x in pdf["data"])])
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        keep = starts(doc, h)
        doc, h = doc[keep], h[keep]
        at = starts(doc)
        rows = [(int(doc[lo]), low_bytes(h[lo:hi], ANCHOR_BYTES)) for lo, hi in zip(at, [*at[1:], len(doc)])]
        return pd.DataFrame(rows, columns=["doc", "anchors"])

    met_rows = docs.mapInArrow(sent, _MET).groupBy("part").applyInPandas(met, "part int, docs binary, data binary")
    return met_rows.groupBy("part").applyInPandas(told, "doc long, anchors binary")


# 2. Confirmed passages: kind 0 are windows to meet, 1 runs that recur earlier, 2 passages that are such an earlier one

_RUNS = "part int, kind int, doc binary, crc binary, at binary, n binary, to binary, to_crc binary, to_at binary, data binary"


def _runs(doc, crc, at, to, to_crc, to_at) -> list[np.ndarray]:
    """Single windows -> runs (doc, crc, at, n, to, to_crc, to_at) along which both places move on together."""
    order = np.lexsort((at, crc, doc))
    doc, crc, at, to, to_crc, to_at = (x[order] for x in (doc, crc, at, to, to_crc, to_at))
    shift = to_at - at
    head = starts(doc, crc, at - np.arange(len(at)), to, to_crc, shift)
    n = np.diff(np.append(head, len(at)))
    return [doc[head], crc[head], at[head], n, to[head], to_crc[head], to_at[head]]


def _run_rows(kind: int, runs: list[np.ndarray], parts: int) -> list[tuple]:
    """Earlier passages (kind 2) are their own place, which isn't sent again."""
    rows = _by_part(deal(runs[0], parts), *runs) if len(runs[0]) else []
    return [(p, kind, *map(pack, c), None) if kind == 1 else (p, kind, *map(pack, c[:4]), None, None, None, None) for p, c in rows]


def _earlier(h, doc, crc, at) -> tuple[np.ndarray, np.ndarray]:
    """(order, source): windows sorted by hash and document, and for each sorted one the position in that order of an earlier document's, or its own.

    The documents of a group form a tree of FAN_OUT children each; the first one is its own source.
    """
    order = np.lexsort((at, crc, doc, h[:, 1], h[:, 0]))
    if not len(order):
        return order, np.zeros(0, np.int64)
    one, two, d = h[order, 0], h[order, 1], doc[order]
    group = starts(one, two)  # first row of each group, and of each document in it
    holder = starts(one, two, d)
    group_of = np.repeat(np.arange(len(group)), np.diff(np.append(group, len(order))))
    holder_of = np.repeat(np.arange(len(holder)), np.diff(np.append(holder, len(order))))
    base = np.searchsorted(holder, group)[group_of]  # the group's first document
    place = holder_of - base
    return order, holder[base + np.maximum(place - 1, 0) // FAN_OUT]


def _referred(h, doc, crc, at, parts: int) -> tuple[list[tuple], np.ndarray]:
    """Rows of kinds 1 and 2 for what these windows show, and which windows are later than another's."""
    order, source = _earlier(h, doc, crc, at)
    d, c, a = doc[order], crc[order], at[order]
    later = d > d[source] if len(d) else np.zeros(0, bool)
    s = source[later]
    rows = _run_rows(1, _runs(d[later], c[later], a[later], d[s], c[s], a[s]), parts)
    u = np.unique(s)
    rows += _run_rows(2, _runs(d[u], c[u], a[u], d[u], c[u], a[u]), parts)
    flags = np.zeros(len(h), bool)
    flags[order] = later
    return rows, flags


def recurring_runs(joined: DataFrame, *, window: int, gram: int, parts: int) -> DataFrame:
    """joined (id, crc, text, anchors) -> (doc, runs): a document's runs, packed by its text's crc."""

    def settled(ids, crcs, hs, ats, anchors) -> pa.RecordBatch:
        sizes = [len(x) for x in hs]
        doc, crc = np.repeat(np.array(ids, np.int64), sizes), np.repeat(np.array(crcs, np.int64), sizes)
        h = np.concatenate(hs) if hs else np.zeros((0, 2), np.uint64)
        at, anchor = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((ats, np.int64), (anchors, np.uint64)))
        rows, later = _referred(h, doc, crc, at, parts)
        keep = ~later
        doc, crc, h, at, anchor = doc[keep], crc[keep], h[keep], at[keep], anchor[keep]
        order = np.lexsort((at, crc, doc))
        doc, crc, h, at, anchor = doc[order], crc[order], h[order], at[order], anchor[order]
        head = starts(doc, crc, at - np.arange(len(at)), anchor)
        n = np.diff(np.append(head, len(at)))
        for p, (first, size) in _by_part(deal(anchor[head], parts), head, n):
            inside = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            rows.append((p, 0, pack(doc[first]), pack(crc[first]), pack(at[first]), pack(size), None, None, None, h[inside].astype("<u8").tobytes()))
        return _batch(rows, _RUNS)

    def sent(batches):
        hasher = WordHasher()
        held: list[list] = [[], [], [], [], []]
        n = 0
        for b in batches:
            docs, crcs, texts, replies = (c.to_pylist() for c in b.columns)
            for doc, crc, told, (anchor, h) in zip(docs, crcs, replies, _windows(hasher, texts, window, gram, True)):
                if not len(anchor):
                    continue
                known = from_low_bytes(told, ANCHOR_BYTES)
                at = np.flatnonzero(known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor)
                for x, y in zip(held, (doc, crc, h[at], at, anchor[at])):
                    x.append(y)
                n += len(at)
                if n >= BATCH_ENTRIES:
                    yield settled(*held)
                    held, n = [[], [], [], [], []], 0
        yield settled(*held)

    def met(pdf: pd.DataFrame) -> pd.DataFrame:
        own, rest = pdf[pdf["kind"] == 0], pdf[pdf["kind"] > 0]
        rows = [tuple(r) for r in rest.itertuples(index=False)]
        if len(own):
            doc, crc, at, n = (np.concatenate([unpack(x) for x in own[c]]) for c in ("doc", "crc", "at", "n"))
            h = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in own["data"]]).astype(np.uint64)
            at = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            rows += _referred(h, np.repeat(doc, n), np.repeat(crc, n), at, parts)[0]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _RUNS.split(",")])

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        found: dict[int, dict[int, list]] = {}
        for kind in (1, 2):
            own = pdf[pdf["kind"] == kind]
            if not len(own):
                continue
            cols = [np.concatenate([unpack(x) for x in own[c]]) for c in ("doc", "crc", "at", "n", *(("to", "to_crc", "to_at") if kind == 1 else ("doc", "crc", "at")))]
            order = np.lexsort((cols[2], cols[1], cols[0]))
            cols = [c[order] for c in cols]
            at = starts(cols[0], cols[1])
            for lo, hi in zip(at, [*at[1:], len(order)]):
                entry = found.setdefault(int(cols[0][lo]), {}).setdefault(int(cols[1][lo]), [b"", b""])
                entry[kind - 1] = b"".join(len(x).to_bytes(4, "little") + x for x in map(pack, (c[lo:hi] for c in cols[2:])))
        rows = [(doc, [(crc, *x) for crc, x in by_crc.items()]) for doc, by_crc in found.items()]
        return pd.DataFrame([(d, [{"crc": c, "later": x, "earlier": y} for c, x, y in r]) for d, r in rows], columns=["doc", "runs"])

    out = "doc long, runs array<struct<crc:long,later:binary,earlier:binary>>"
    return joined.mapInArrow(sent, _RUNS).groupBy("part").applyInPandas(met, _RUNS).groupBy("part").applyInPandas(told, out)


def _unjoined(data: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        out.append(unpack(data[at + 4 : at + 4 + n]))
        at += 4 + n
    return out or [np.zeros(0, np.int64)] * 5


# 3. Automata

_TEXTS = "to long, to_crc long, piece int, later boolean, doc long, crc long, at long, text binary"


def _pieces(at: np.ndarray, n: np.ndarray, to, to_crc, to_at) -> list[tuple[int, int, int, int, int]]:
    """(to, to_crc, piece, at, n): runs cut where the earlier place passes into another automaton, neighbours of one automaton joined."""
    cut: list[list[int]] = []
    for a, size, t, c, q in zip(at.tolist(), n.tolist(), to.tolist(), to_crc.tolist(), to_at.tolist()):
        while size > 0:
            piece = q // AUTOMATON_WINDOWS
            take = min(size, (piece + 1) * AUTOMATON_WINDOWS - q)
            if cut and cut[-1][:3] == [t, c, piece] and a == cut[-1][3] + cut[-1][4]:
                cut[-1][4] += take
            else:
                cut.append([t, c, piece, a, take])
            a, q, size = a + take, q + take, size - take
    return [tuple(x) for x in cut]


def passages(joined: DataFrame, window: int) -> DataFrame:
    """joined (id, crc, text, runs) -> the texts of earlier passages and of those to be searched, keyed by automaton."""

    def texts(batches):
        rows: list[tuple] = []
        size = 0
        for b in batches:
            for doc, crc, text, runs in zip(*(c.to_pylist() for c in b.columns)):
                own = [r for r in runs if r["crc"] == crc]
                words = split_words(text) if own else []
                for r in own:
                    for later in (True, False):
                        for t, c, piece, at, n in _pieces(*_unjoined(r["later" if later else "earlier"])):
                            part = b" ".join(words[at : at + n + window - 1])
                            rows.append((t, c, piece, later, doc, crc, at, part))
                            size += len(part)
                if size > 4_000_000 or len(rows) > 20_000:
                    yield _batch(rows, _TEXTS)
                    rows, size = [], 0
        yield _batch(rows, _TEXTS)

    return joined.mapInArrow(texts, _TEXTS)


class PassageAutomaton:
    """Aho-Corasick automaton of all windows of the given passages, over word numbers."""

    def __init__(self, passages: list[bytes], window: int):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for text in passages:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in text.split())
            for i in range(len(ids) - window + 1):
                self.automaton.add_word(ids[i : i + window])
        self.window = window
        if len(self.automaton):
            self.automaton.make_automaton()

    def starts(self, text: bytes) -> list[int]:
        """First words of all windows of the passages that stand in the text."""
        if not len(self.automaton):
            return []
        number = self.numbers.get
        return [end - self.window + 1 for end, _ in self.automaton.iter(tuple(number(w, 0) for w in text.split()))]


def verified(texts: DataFrame, window: int) -> DataFrame:
    """(doc, found): each occurrence of an earlier passage's windows, as runs by the text's crc."""
    key = ["to", "to_crc", "piece"]

    def searched(batches):
        now, sources, automaton = None, [], None
        rows: list[tuple] = []
        for b in batches:
            for t, c, piece, later, doc, crc, at, text in zip(*(x.to_pylist() for x in b.columns)):
                if (t, c, piece) != now:
                    now, sources, automaton = (t, c, piece), [], None
                if not later:
                    sources.append(text)
                    automaton = None
                    continue
                automaton = automaton or PassageAutomaton(sources, window)
                hits = np.array(automaton.starts(text), np.int64)
                if len(hits):
                    head = starts(hits - np.arange(len(hits)))
                    rows.append((doc, crc, pack(hits[head] + at), pack(np.diff(np.append(head, len(hits))))))
            yield _batch(rows, "doc long, crc long, at binary, n binary")
            rows = []

    found = texts.repartition(*key).sortWithinPartitions(*key, "later").mapInArrow(searched, "doc long, crc long, at binary, n binary")
    return found.groupBy("doc").agg(F.collect_list(F.struct("crc", "at", "n")).alias("found"))


# 4. Documents


def kept_words(docs: DataFrame, window: int, with_text: bool) -> DataFrame:
    """docs (id, crc, text, found) -> one row each: id, n_words, n_removed, kept_sha256 (and kept_text)."""

    def reduced(batches):
        for b in batches:
            out = []
            for crc, text, found in zip(*(c.to_pylist() for c in b.columns[1:])):
                words = split_words(text)
                gone = np.zeros(len(words), bool)
                for r in found or ():
                    if r["crc"] == crc:
                        for at, n in zip(unpack(r["at"]), unpack(r["n"])):
                            gone[at : at + n + window - 1] = True
                removed = int(gone.sum())
                stay = [w for w, g in zip(words, gone.tolist()) if not g] if removed else words
                joined = b" ".join(stay)
                out.append((len(words), removed, hashlib.sha256(joined).hexdigest(), *([joined.decode()] if with_text else [])))
            columns = list(zip(*out)) if out else [()] * (3 + with_text)
            types = [pa.int64(), pa.int64(), pa.string(), *[pa.string()] * with_text]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    return docs.withColumn("text", F.col("text").cast("binary")).mapInArrow(reduced, "id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, gram: int = 5, parts: int | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_sha256 and, if asked, kept_text (the words that stay, joined by one space)."""
    if not 0 < gram < window:
        raise ValueError("gram must be below window")
    kind = docs.schema[id_col].dataType.simpleString()
    # a column that has its name already gets no alias: the optimizer drops one in some joins only, and then their exchanges differ
    text = F.col(text_col) if text_col == "text" else F.col(text_col).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), F.crc32(F.col(text_col).cast("binary")).alias("crc"), text)
    named = rows.where("id is not null").withColumn("id", F.col("id").cast("long"))
    if parts is None:
        size = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(n_partitions(docs), -(-size // PART_BYTES))
    anchors = shared_anchors(named.select("id", F.col("text").cast("binary")), window=window, gram=gram, parts=parts)
    runs = recurring_runs(_with(named, anchors, "inner").select("id", "crc", F.col("text").cast("binary"), "anchors"), window=window, gram=gram, parts=parts)
    found = verified(passages(_with(named, runs, "inner").select("id", "crc", F.col("text").cast("binary"), "runs"), window), window)
    last = _with(named, found, "left").select("id", "crc", "text", "found")
    nameless = rows.where("id is null").select(F.lit(None).cast("long").alias("id"), "crc", "text", F.lit(None).cast("array<struct<crc:bigint,at:binary,n:binary>>").alias("found"))
    return kept_words(last.unionByName(nameless), window, with_text).withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id_col)


def _with(named: DataFrame, replies: DataFrame, how: str) -> DataFrame:
    """Documents joined with what is known of them; always by the same exchange of documents, whose texts aren't sorted."""
    return named.join(replies.hint("shuffle_hash"), named["id"] == replies["doc"], how)
