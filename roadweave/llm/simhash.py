"""Operator 5: near-duplicates by SimHash fingerprints in BK-trees.

A fingerprint bit is 1 if it is set in over half of the XXH64 values of the document's word shingles
(repeats included). Equal fingerprints are one node. Two nodes within ``radius`` bits agree on at
least ``blocks - radius`` of ``blocks`` bit blocks, so each node goes to one shard for every choice of
that many blocks, and every link is inside some shard: nothing is missed and no pair is compared
outside a shard. A shard is a BK-tree (children keyed by Hamming distance to the parent) that answers
queries by following only edges within the radius. Shards of more than ``max_shard`` nodes are cut
into parts, and each pair of parts becomes a task of its own: one part's tree, the other's queries.

Trees are small and meet their queries in a shuffle by shard: a broadcast of all of them would grow
with the corpus. A task gives only links that join two groups it had not joined yet (a spanning
forest), so a group of n near copies yields n - 1 links for each shard, not n squared.

Defined cases: null and empty texts, or texts without words, have fingerprint zero and are linked
like any other; fewer words than a shingle: the whole sequence is one; repeated rows are equal
nodes; a null id takes no part in linking and gets the component of its fingerprint, if any row with
an id has that one, else null; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest, xxh64_intdigest

from roadweave.llm.common import cut, release
from roadweave.llm.components import components
from roadweave.llm.packed import mix


def fingerprint(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """bytes.lower and bytes.split touch A-Z and ASCII white space only, as the contract asks."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size, joined = min(shingle, len(words)), b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - size + 1].tolist()
    total, n = np.zeros(64, np.int64), len(starts)
    ends = ends[size - 1 :].tolist()
    for lo in range(0, n, 65_536):  # bounded memory for very long texts
        part = zip(starts[lo : lo + 65_536], ends[lo : lo + 65_536])
        h = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in part], np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, *, id_col: str, text_col: str, shingle: int, seed: int = 42) -> DataFrame:
    """(id, fp) for every row; fp as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(hashed, f"id {kind}, fp long")


class BKTree:
    """Values with children keyed by their integer Hamming distance to the parent."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        at, new = 0, len(self.values) - 1
        while at != new:
            at = self.children[at].setdefault((value ^ self.values[at]).bit_count(), new)

    def within(self, value: int, radius: int) -> list[int]:
        """Positions of the values within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def _forest(fps: list[int], ids: list[int], split: int, radius: int) -> list[tuple[int, int]]:
    """Links of a shard's spanning forest. split 0: all among each other; else the first ``split`` form the tree and the rest query it."""
    up = list(range(len(fps)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    tree, links = BKTree(), []
    for i, fp in enumerate(fps):
        if not split or i >= split:
            for j in tree.within(fp, radius):
                a, b = root(i), root(j)
                if a != b:
                    up[a] = b
                    links.append((ids[i], ids[j]))
        if not split or i < split:
            tree.insert(fp)
    return links


def blocks_for(n: int, radius: int) -> int:
    """The fewest blocks whose keys (64 / blocks bits for each block beyond the radius) are at most four times fewer than the nodes."""
    return next((b for b in range(radius + 2, 2 * radius) if n <= 1 << (64 * (b - radius) // b + 2)), 2 * radius)


def shard_links(nodes: DataFrame, *, radius: int, blocks: int, max_shard: int) -> DataFrame:
    """nodes (fp, id) -> links (u, v) between ids whose fingerprints differ in at most ``radius`` bits."""
    agree = blocks - radius
    if agree < 1:
        raise ValueError("blocks must exceed radius")
    bounds = [round(64 * i / blocks) for i in range(blocks + 1)]
    masks = [sum(((1 << (bounds[b + 1] - bounds[b])) - 1) << bounds[b] for b in chosen) for chosen in combinations(range(blocks), agree)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    keyed = nodes.select("fp", "id", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("j", "v"))
    return links_in_shards(keyed, radius=radius, max_shard=max_shard)


def links_in_shards(keyed: DataFrame, *, radius: int, max_shard: int) -> DataFrame:
    """keyed (j, v, fp, id): one row for each shard (j, v) of a node; fp is a long -> links (u, v)."""
    shared = keyed.groupBy("j", "v").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / max_shard).cast("int")
    mine = keyed.join(shared, ["j", "v"]).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    units = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "j", "v", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "fp", "id"
    )
    keys = ["j", "v", "x", "y"]

    def linked(batches):
        rest: list[np.ndarray] | None = None

        def run(cols: list[np.ndarray], last: bool):
            """Links of the whole units in cols; an unfinished last unit is kept for the next batch."""
            change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols[:4]], axis=0)) + 1
            cuts = [0, *change.tolist(), *([len(cols[0])] if last else [])]
            links = []
            for lo, hi in zip(cuts, cuts[1:]):
                if hi - lo > 1:
                    x, y = cols[2][lo], cols[3][lo]
                    first = int((cols[4][lo:hi] == x).sum()) if x != y else 0
                    if x == y or 0 < first < hi - lo:
                        links += _forest([f & (1 << 64) - 1 for f in cols[5][lo:hi].tolist()], cols[6][lo:hi].tolist(), first, radius)
            return links, None if last else [c[cuts[-1] :] for c in cols]

        def batch(links):
            u, v = zip(*links) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate(p) for p in zip(rest, cols)]
            links, rest = run(cols, False) if len(cols[0]) else ([], rest)
            yield batch(links)
        if rest is not None and len(rest[0]):
            yield batch(run(rest, True)[0])

    return units.repartition(*keys).sortWithinPartitions(*keys, "own", "fp").mapInArrow(linked, "u long, v long").distinct()


# Near copies by exact shingle similarity

#: MinHash bands: texts of shingle similarity J share a band with probability 1 - (1 - J^ROWS)^BANDS, 0.9998 at 0.8, whatever their length.
BANDS, ROWS = 48, 8
_MULTIPLIERS = np.random.default_rng(5).integers(0, 1 << 32, BANDS * ROWS, np.uint32) | np.uint32(1)
_BAND_MIX = np.random.default_rng(6).integers(0, 1 << 63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles, in order; fewer words than a shingle: the whole sequence is one."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    size, joined = min(shingle, len(words)), b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - size + 1]
    return np.unique(np.array([xxh3_64_intdigest(joined[s:e]) for s, e in zip(starts.tolist(), ends[size - 1 :].tolist())], np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key for each MinHash band of a set of shingle hashes."""
    least, low = np.full(BANDS * ROWS, (1 << 32) - 1, np.uint32), hashes.astype(np.uint32)
    for lo in range(0, len(low), 512):  # bounded memory, and products that stay in the cache
        np.minimum(least, (low[lo : lo + 512, None] * _MULTIPLIERS).min(0), out=least)
    bands = np.arange(BANDS, dtype=np.uint64) << np.uint64(58)
    return mix((least.reshape(BANDS, ROWS) * _BAND_MIX).sum(1, dtype=np.uint64) ^ bands).view(np.int64)


def shingle_sets(docs: DataFrame, *, shingle: int) -> DataFrame:
    """docs (id, text) -> (id, t, size, fp, keys): hash of the text, number of distinct shingles, 128-bit hash of their set, MinHash bands."""

    def hashed(batches):
        for b in batches:
            sets = [shingle_hashes(t, shingle) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(h) for h in sets], pa.int64()), pa.array([xxh3_128_digest(h.tobytes()) for h in sets], pa.binary()), pa.array([band_keys(h) for h in sets], pa.list_(pa.int64()))],
                names=["id", "t", "size", "fp", "keys"],
            )

    return docs.select("id", F.xxhash64("text").alias("t"), "text").mapInArrow(hashed, "id long, t long, size long, fp binary, keys array<long>")


def _alike(shared, a, b, similarity: float):
    """Whether sets of a and b members that share so many reach the Jaccard similarity."""
    return shared >= similarity * (a + b - shared) - 1e-9


def similar_sets(sets: list[np.ndarray], similarity: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (places in the list) of a spanning forest of the pairs whose Jaccard similarity reaches ``similarity``.

    Sets of one ``known`` class count as joined already and are not compared with each other.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    group = np.arange(n) if known is None else np.unique(np.array(known), return_inverse=True)[1]
    if n < 2 or (group == group[0]).all():
        return []

    def direct(i: int, j: int) -> bool:
        return bool(_alike(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), sizes[i], sizes[j], similarity))

    if n == 2:
        return [(1, 0)] if direct(1, 0) else []
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders, first, at = np.repeat(np.arange(n), sizes)[np.argsort(token, kind="stable")], np.cumsum(count) - count, np.cumsum(sizes) - sizes
    links = []
    for i in range(1, n):
        if group[i] != group[i - 1] and direct(i, i - 1):
            group[group == group[i]] = group[i - 1]
            links.append((i, i - 1))
        if (group[:i] == group[i]).all():
            continue
        mine = token[at[i] : at[i] + sizes[i]]
        mine = mine[count[mine] > 1]
        c = count[mine]
        shared = np.bincount(holders[np.repeat(first[mine] - (np.cumsum(c) - c), c) + np.arange(c.sum())], minlength=n)[:i]
        for j in np.flatnonzero(_alike(shared, sizes[i], sizes[:i], similarity)).tolist():
            if group[j] != group[i]:
                group[group == group[i]] = group[j]
                links.append((i, j))
    return links


def _link_batch(links: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*links) if links else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def leader_classes(stars: DataFrame, nodes: DataFrame, keyed: DataFrame, *, shingle: int, similarity: float, max_docs: int) -> DataFrame:
    """stars (id, leader) -> components (node, component) of those links whose shingle sets reach the similarity.

    A leader's followers are dealt over slices of about ``max_docs``; each slice gets the leader's text and
    the followers stream past it, so a task holds one leader whatever its number of followers.
    """
    crowded = stars.groupBy("leader").agg(F.ceil(F.count("*") / max_docs).cast("int").alias("parts")).where("parts > 1")
    dealt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id"), F.col("parts"))).cast("int")
    followers = cut(stars.join(crowded, "leader", "left").select(F.col("leader").alias("g"), dealt.alias("s"), F.lit(1).alias("role"), "id"))
    leaders = followers.select("g", "s").distinct().select("g", "s", F.lit(0).alias("role"), F.col("g").alias("id"))
    wanted = nodes.select("id", "t").join(followers.unionByName(leaders), "id")
    units = keyed.join(wanted.hint("shuffle_hash"), ["id", "t"]).select("g", "s", "role", "id", "text")

    def linked(batches):
        unit, heads = None, []
        for b in batches:
            links = []
            for g, s, role, d, text in zip(*(c.to_pylist() for c in b.columns)):
                if (g, s) != unit:
                    unit, heads = (g, s), []
                mine = shingle_hashes(text, shingle)
                if not role:
                    heads.append(mine)
                elif any(_alike(len(np.intersect1d(h, mine, assume_unique=True)), len(h), len(mine), similarity) for h in heads):
                    links.append((d, g))
            yield _link_batch(links)

    out = components(units.repartition("g", "s").sortWithinPartitions("g", "s", "role").mapInArrow(linked, "u long, v long"))
    release(followers)
    return out


def near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, max_docs: int = 1024, max_shingles: int = 1 << 20) -> DataFrame:
    """One row per document: id, component_id. Documents are linked where the Jaccard similarity of their shingle sets reaches ``similarity``.

    Documents of one SimHash class (the links of ``near_duplicates``: fingerprints in BK-trees) form a loose group, together with
    those that they share a MinHash band with, which finds copies whose fingerprints lie further apart; only links
    whose shingle sets were compared count. First each document is compared with its leaders, the
    smallest and the largest id that it shares a band with; this joins most of a group to one class at a cost in
    proportion to its size. Where a loose group still has several classes, the documents outside its
    largest class are compared with all of the group: both sides are cut into parts of at most ``max_docs``
    documents or ``max_shingles`` shingles, and each pair of parts is a task of its own.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    keyed = texts.withColumn("t", F.xxhash64("text"))
    rows = cut(shingle_sets(texts, shingle=shingle))
    nodes = cut(rows.where("id is not null").groupBy("fp").agg(F.min(F.struct("id", "t", "size", "keys")).alias("n")).select("fp", "n.*"))
    banded = nodes.select("id", F.explode("keys").alias("v"))
    ends = banded.groupBy("v").agg(F.min("id").alias("m"), F.max("id").alias("x"), F.count("*").alias("n")).where("m <> x")
    ends = ends.select("v", "m", F.expr("if(n > 2, x, null)").alias("x"))  # of a pair, one is the other's leader
    led = banded.join(ends, "v").groupBy("id").agg(F.min("m").alias("m"), F.max("x").alias("x"))
    same = rows.where("id is not null").select("id", "fp").join(nodes.select("fp", F.col("id").alias("own")), "fp").select("id", "own").distinct()
    prints, print_nodes, linked_prints = fingerprint_links(texts, id_col="id")
    close_prints = cut(linked_prints.unionByName(prints.join(print_nodes.withColumnRenamed("id", "v"), "fp").where("id <> v").select(F.col("id").alias("u"), "v")))
    alike = close_prints.join(same.select(F.col("id").alias("u"), F.col("own").alias("a")), "u").join(same.select(F.col("id").alias("v"), F.col("own").alias("b")), "v").where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v"))
    near = cut(banded.join(ends.select("v", "m"), "v").where("id <> m").select(F.col("id").alias("u"), F.col("m").alias("v")).unionByName(alike).distinct())
    stars = cut(led.select("id", F.explode(F.array_distinct(F.array("m", "x"))).alias("leader")).where("id <> leader"))
    loose = components(near)
    close = leader_classes(stars, nodes, keyed, shingle=shingle, similarity=similarity, max_docs=max_docs)
    release(near, stars, prints, print_nodes, close_prints)
    classes = cut(nodes.join(close, nodes["id"] == close["node"], "left").select("fp", "id", "t", "size", F.coalesce("component", "id").alias("c")))
    members = cut(classes.join(loose, classes["id"] == loose["node"]).select("id", "t", "size", "c", F.col("component").alias("g")))
    release(close, loose)

    def n_parts(n, size):
        return F.greatest(F.ceil(F.col(n) / max_docs), F.ceil(F.col(size) / max_shingles), F.lit(1)).cast("int")

    sizes = members.groupBy("g", "c").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    mixed = sizes.groupBy("g").agg(F.max(F.struct("n", "size", "c")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.count("*").alias("classes")).where("classes > 1")
    mixed = mixed.select("g", F.col("main.c").alias("main"), F.col("main.n").alias("n0"), F.col("main.size").alias("size0"), (F.col("n") - F.col("main.n")).alias("n1"), (F.col("size") - F.col("main.size")).alias("size1"))
    mixed = mixed.select("g", "main", n_parts("n0", "size0").alias("inner"), n_parts("n1", "size1").alias("outer"))
    at, inside = F.xxhash64("id", "t"), F.col("c") == F.col("main")
    placed = members.join(mixed, "g").withColumn("own", F.when(inside, F.col("outer") + F.pmod(at, F.col("inner"))).otherwise(F.pmod(at, F.col("outer"))).cast("int"))
    others = F.when(inside, F.sequence(F.lit(0), F.col("outer") - 1)).otherwise(F.array_except(F.sequence(F.lit(0), F.col("outer") + F.col("inner") - 1), F.array("own")))
    placed = placed.withColumn("other", F.explode(others)).select("id", "t", "c", "g", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    units = keyed.join(placed.hint("shuffle_hash"), ["id", "t"]).select("g", "x", "y", "c", "text")

    def linked(batches):
        unit, known, sets = None, [], []

        def found() -> list[tuple[int, int]]:
            return [(known[i], known[j]) for i, j in similar_sets(sets, similarity, known)]

        for b in batches:
            links = []
            for g, x, y, c, text in zip(*(c.to_pylist() for c in b.columns)):
                if (g, x, y) != unit:
                    links += found()
                    unit, known, sets = (g, x, y), [], []
                known.append(c)
                sets.append(shingle_hashes(text, shingle))
            yield _link_batch(links)
        yield _link_batch(found())

    keys = ["g", "x", "y"]
    joined = components(units.repartition(*keys).sortWithinPartitions(*keys, "c").mapInArrow(linked, "u long, v long"))
    release(members)
    labelled = classes.join(joined, classes["c"] == joined["node"], "left").select("fp", F.coalesce("component", "c").alias("component_id"))
    return rows.join(labelled, "fp", "left").select(F.col("id").alias(id_col), "component_id")


def fingerprint_links(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None, max_shard: int = 2048) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows (id, fp), nodes (fp, id: its smallest), links (u, v) between these ids); the first two are stored."""
    rows = cut(fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle).select(F.col("id").cast("long").alias("id"), "fp"))
    nodes = cut(rows.groupBy("fp").agg(F.min("id").alias("id")))
    blocks = blocks or blocks_for(nodes.count(), radius)
    return rows, nodes, shard_links(nodes.where("id is not null"), radius=radius, blocks=blocks, max_shard=max_shard)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4, blocks: int | None = None, max_shard: int = 2048) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id (the smallest id that it reaches).

    ``blocks``: by default as many as keep shards of unlike fingerprints at a few nodes; the links are the same for any number.
    """
    rows, nodes, links = fingerprint_links(docs, id_col=id_col, text_col=text_col, shingle=shingle, radius=radius, blocks=blocks, max_shard=max_shard)
    found = components(links)
    labelled = nodes.join(found, nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return rows.join(labelled, "fp", "left").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs that stay: of each component of near copies those with its smallest id.

    Rows of one id stay or go together; of equal rows of one id one stays. Rows without an id stay.
    """
    found = near_copies(docs, id_col=id_col, **options)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    kept = docs.join(gone.hint("shuffle_hash"), docs[id_col] == gone["__gone"], "left_anti")
    repeated = cut(found.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("__n")).where("__n > 1").select(F.col(id_col).alias("__again")))
    if repeated.isEmpty():
        return kept
    again = kept[id_col] == repeated["__again"]
    return kept.join(repeated, again, "left_anti").unionByName(kept.join(repeated, again, "left_semi").dropDuplicates())
