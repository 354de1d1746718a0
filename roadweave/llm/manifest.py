"""Operator 12: Merkle manifest of a dataset, by Pregel-style supersteps over RDDs.

Rows become leaves (sha256 of all their fields) in one scan of DataFrame functions, written as a small
table; everything after it works on digests alone. Leaves are sorted by (source, id) into ranges; one
summary row a partition tells each where its first source began, so a leaf knows its tree, its place
and its tree's size without any source meeting in one task. A node stands for a *run* of up to ``fan``
consecutive nodes below it. A vertex is a *block*: the runs that lie side by side under one node
``levels`` above, so up to ``span`` = ``fan`` ** ``levels`` consecutive nodes of one tree.

* Up: in each superstep every complete block hashes its runs, level by level, and sends the last digest
  to the block of its parent; blocks alone at their level are subroots, and these are the leaves of one
  more tree.
* Down: in each superstep every block sends each child the path above it (the digests of the child's
  runs, its slots in them, and what is above), until each lowest block has its path. It then gives every
  leaf its siblings, folds the leaf or its tampered form up to a root and compares.

Messages go to blocks of at most ``span`` nodes, so a source with a third of all rows is spread over its
blocks; the number of supersteps is the logarithm of the largest tree, and one further up has so many
partitions fewer as it has nodes fewer. A lost executor's part is made again from the leaf table:
sorting keys are total up to equal leaves, so the result is the same.

Defined cases: null fields hash as ``-``; null sources are one source, before all others; null ids come
first in their source and are never tampered with; equal ids are ordered by their leaf; an empty table
gives no rows; other columns are ignored; texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from hashlib import sha256
from itertools import groupby
from operator import itemgetter

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadweave.llm.common import ascii_lower, cut, n_partitions

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_OUT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_hash(fields: Iterable[Column]) -> Column:
    """sha256 of ``-`` for null, else byte count, ``:`` and value of each field."""
    as_text = [c.cast("string") for c in fields]
    parts = [F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in as_text]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def lowered(text: Column | str) -> Column:
    """As ``ascii_lower``. A text of ASCII only has as many bytes as characters; ``lower`` takes it bytewise, ``translate`` looks up every character."""
    c = (F.col(text) if isinstance(text, str) else text).cast("string")
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(ascii_lower(c))


def combine(digests: Iterable[bytes]) -> bytes:
    """H of nodes: sha256 of their digests as hex text, one after the other."""
    return sha256(b"".join(digests).hex().encode()).digest()


# A block is (n, nodes): how many nodes its tree has at this level, and its own ones in order. Its key is (tree, place among the blocks).
Block = tuple[int, list[bytes]]


def climb(block: Block, fan: int, span: int) -> list[Block]:
    """The block's levels from its nodes up to the one node that it stands for; a tree's only node stands for itself."""
    levels, width = [block], 1
    while (n := levels[-1][0]) > 1 and width < span:
        nodes = levels[-1][1]
        levels.append((-(-n // fan), [combine(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]))
        width *= fan
    return levels


class Tree:
    """Blocks of one or many trees, superstep by superstep, as RDDs; ``parts``: partitions of the lowest blocks."""

    def __init__(self, blocks: RDD, depth: int, fan: int, span: int, parts: int):
        self.fan, self.span, self.levels = fan, span, [blocks]
        self.parts = [-(-2 * parts // span**level) if level else parts for level in range(depth)]  # a block is half full at least, but for its tree's last
        for level in range(1, depth):
            self.levels.append(self._up(self.levels[-1], self.parts[level]))

    def _up(self, blocks: RDD, parts: int) -> RDD:
        """One superstep: digests of complete blocks meet at the blocks above; blocks alone at their level send nothing."""
        fan, span = self.fan, self.span

        def send(vertex):
            (tree, place), (n, nodes) = vertex
            if n > span:
                above, (digest,) = climb((n, nodes), fan, span)[-1]
                yield (tree, place // span), (place % span, above, digest)

        def collect(vertex):
            (tree, place), messages = vertex
            got = sorted(messages)
            n = got[0][1]
            if len(got) != min(span, n - place * span):
                raise ValueError(f"block {place} of tree {tree} is not complete")
            return (tree, place), (n, [d for _, _, d in got])

        return blocks.flatMap(send).groupByKey(parts).mapPartitions(lambda vertices: map(collect, vertices), preservesPartitioning=True)

    def tops(self) -> RDD:
        """(tree, (superstep, digest)) of each tree."""
        fan, span = self.fan, self.span

        def of(level: int):
            return lambda v: [(v[0][0], (level, climb(v[1], fan, span)[-1][1][0]))] if v[1][0] <= span else []

        found = [blocks.flatMap(of(level)) for level, blocks in enumerate(self.levels)]
        return found[0].context.union(found)

    def down(self, above: RDD) -> RDD:
        """(key, path) of the lowest blocks. ``above``: (tree, (superstep of its top, what each path of the tree ends with))."""
        fan, span = self.fan, self.span

        def at(level: int):
            return above.flatMap(lambda t: [((t[0], 0), t[1][1])] if t[1][0] == level else [])

        def send(vertex):
            (tree, place), (block, path) = vertex
            levels = climb(block, fan, span)
            for slot in range(len(block[1])):
                yield (tree, place * span + slot), extend(path, slot, levels, fan)

        paths = at(len(self.levels) - 1).partitionBy(self.parts[-1])
        for level in reversed(range(1, len(self.levels))):
            paths = self.levels[level].join(paths, self.parts[level]).flatMap(send).union(at(level - 1)).partitionBy(self.parts[level - 1])
        return paths


#: A path is (steps, subroot, root): steps are (slot, nodes of the run) from the lowest to the highest.
def extend(path: tuple, slot: int, levels: list[Block], fan: int) -> tuple:
    """The path of the node at ``slot`` of a block, which has these levels, from the path of the block."""
    steps, subroot, root = path
    own = []
    for _, nodes in levels[:-1]:
        start = slot - slot % fan
        own.append((slot - start, b"".join(nodes[start : start + fan])))
        slot //= fan
    return (*own, *steps), subroot, root


def _sides(text: bytes, slot: int, start: int, end: int) -> tuple[bytes, bytes]:
    """The hex text of a run, from ``start`` to ``end`` of these nodes, before and after its slot."""
    return text[64 * start : 64 * slot], text[64 * slot + 64 : 64 * end]


def proof(sides: list[tuple[bytes, bytes]]) -> str:
    """H of all siblings, level by level."""
    return sha256(b"".join(text for side in sides for text in side)).hexdigest()


def fold(leaf: str, sides: list[tuple[bytes, bytes]]) -> str:
    """The root that a leaf and its siblings give."""
    for before, after in sides:
        leaf = sha256(before + leaf.encode() + after).hexdigest()
    return leaf


# Places in trees from sorted ranges


def _source(row: tuple) -> tuple[bool, bytes]:
    return row[1] is not None, bytes(row[1] or b"")


def _summary(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(partition, first source, its rows, last source, its rows, sources, most rows of a source inside, rows)."""
    runs = [(s, sum(1 for _ in g)) for s, g in groupby(rows, _source)]
    if runs:
        yield part, *runs[0], *runs[-1], len(runs), max(n for _, n in runs), sum(n for _, n in runs)


def _starts(summaries: list[tuple]) -> tuple[dict[int, tuple], int, int, int]:
    """For each partition (tree of the first source, place of its first row, rows of the first and of the last source, sources); trees; rows of the largest; rows. One row a partition comes in."""
    total: dict[tuple, int] = {}
    for _, first, n, last, m, sources, _, _ in summaries:
        total[first] = total.get(first, 0) + n
        if sources > 1:
            total[last] = total.get(last, 0) + m
    out, tree, before, place = {}, -1, None, 0
    for part, first, n, last, m, sources, _, _ in summaries:
        tree, place = (tree, place) if first == before else (tree + 1, 0)
        out[part] = (tree, place, total[first], total[last], sources)
        tree, place, before = tree + sources - 1, m + (place if sources == 1 else 0), last
    return out, tree + 1, max([*total.values(), *(s[6] for s in summaries), 0]), sum(s[7] for s in summaries)


def _placed(starts: dict[int, tuple], span: int):
    """Sorted rows -> ((tree, place of the block), (slot of the first, rows of the tree, rows side by side)). Only a source that lies wholly in one partition is held, to be counted."""

    def run(part: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        if part not in starts:
            return
        tree, place, n_first, n_last, sources = starts[part]
        for k, (_, group) in enumerate(groupby(rows, _source)):
            if k:
                tree, place = tree + 1, 0
            if 0 < k < sources - 1:
                group = list(group)
            n = n_first if not k else n_last if k == sources - 1 else len(group)
            for block, some in groupby(enumerate(group, place), lambda r: r[0] // span):
                some = list(some)
                yield (tree, block), (some[0][0] % span, n, [(doc_id, bytes(leaf), tampered and bytes(tampered)) for _, (doc_id, _, leaf, tampered) in some])

    return run


def _blocks(dealt: RDD, parts: int) -> RDD:
    """Rows of each lowest block in order: (key, (n, rows))."""

    def collect(vertex):
        key, messages = vertex
        return key, _in_order(messages)

    return dealt.groupByKey(parts).mapPartitions(lambda vertices: map(collect, vertices), preservesPartitioning=True)


def _in_order(messages: Iterable[tuple]) -> tuple[int, list]:
    got = sorted(messages, key=itemgetter(0))
    return got[0][1], [row for _, _, rows in got for row in rows]


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _ordered(leaves: DataFrame, parts: int) -> RDD:
    """Leaves by source, id and leaf, nulls first, in ranges."""
    order = ("source", "id", "leaf")
    # Spark draws thrice as many rows a range: about 20 reach the driver for each, as RDD.sortByKey draws, not 300
    with _setting(leaves.sparkSession, "spark.sql.execution.rangeExchange.sampleSizePerPartition", "7"):
        return leaves.repartitionByRange(parts, *order).sortWithinPartitions(*order).rdd


def _depth(n: int, span: int) -> int:
    depth = 1
    while n > span:
        n, depth = -(-n // span), depth + 1
    return depth


def _verified(n: int, rows: list[tuple], path: tuple, fan: int, span: int) -> Iterator[tuple]:
    levels = climb((n, [leaf for _, leaf, _ in rows]), fan, span)
    steps, subroot, root = path[0], path[1].hex(), path[2].hex()
    texts = [b"".join(nodes).hex().encode() for _, nodes in levels[:-1]]  # once for all rows of the block
    above = [_sides(nodes.hex().encode(), slot, 0, fan) for slot, nodes in steps]
    for i, (doc_id, leaf, tampered) in enumerate(rows):
        sides, slot = [], i
        for text in texts:
            start = slot - slot % fan
            sides.append(_sides(text, slot, start, start + fan))
            slot //= fan
        sides += above
        found = fold((tampered or leaf).hex(), sides)
        yield doc_id, leaf.hex(), subroot, root, proof(sides), found, found == root


def manifest(docs: DataFrame, *, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", fan: int = 16, levels: int = 2, tamper_every: int = 5) -> DataFrame:
    """One row per document: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` are hashed in their order. Rows whose crc32 of the decimal id divides by ``tamper_every``
    are verified with their text's A-Z lower-cased; ``verified`` says whether the root is found all the same.
    ``levels``: of runs that one superstep crosses; a task holds blocks of ``fan`` ** ``levels`` rows. They don't change the result.
    """
    spark = docs.sparkSession
    of = lambda tampered: leaf_hash(lowered(text_col) if c == text_col and tampered else F.col(c) for c in fields)
    touched = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % tamper_every == 0, F.lit(False))
    leaves = cut(docs.select(
        F.col(id_col).alias("id"), F.col(source_col).cast("string").cast("binary").alias("source"), F.unhex(of(False)).alias("leaf"),
        F.when(touched & F.col(text_col).isNotNull(), F.unhex(of(True))).alias("tampered")))
    parts, span = n_partitions(docs), fan**levels
    ordered = _ordered(leaves, parts)
    starts, trees, largest, n_rows = _starts(sorted(ordered.mapPartitionsWithIndex(_summary).collect()))  # one row a partition
    dealt = ordered.mapPartitionsWithIndex(_placed(starts, span)).partitionBy(parts)
    sources = Tree(_blocks(dealt, parts).mapValues(lambda block: (block[0], [leaf for _, leaf, _ in block[1]])), _depth(largest, span), fan, span, parts)
    few = max(1, -(-parts * trees // max(n_rows, 1)))  # partitions for subroots, as many of them in each as of leaves
    upper_dealt = sources.tops().map(lambda t: ((-1, t[0] // span), (t[0] % span, trees, [(t[0], *t[1])]))).partitionBy(few)
    upper_rows = _blocks(upper_dealt, few)  # (block of the upper tree, (trees, [(tree, superstep of its top, subroot)]))
    upper = Tree(upper_rows.mapValues(lambda block: (block[0], [digest for _, _, digest in block[1]])), _depth(trees, span), fan, span, few)
    crown = upper.down(upper.tops().mapValues(lambda top: (top[0], ((), b"", top[1]))))

    def to_trees(vertex):
        _, ((n, below), path) = vertex
        own = climb((n, [digest for _, _, digest in below]), fan, span)
        for slot, (tree, level, digest) in enumerate(below):
            steps, _, root = extend(path, slot, own, fan)
            yield tree, (level, (steps, digest, root))

    paths = sources.down(upper_rows.join(crown, few).flatMap(to_trees))

    def verified(vertex):
        _, met = vertex
        met = list(met)
        n, rows = _in_order(m for is_path, m in met if not is_path)
        (path,) = (m for is_path, m in met if is_path)
        return _verified(n, rows, path, fan, span)

    # rows and paths have one partitioner, so nothing moves
    tagged = dealt.mapValues(lambda rows: (False, rows)).union(paths.mapValues(lambda path: (True, path)))
    found = tagged.groupByKey(parts).flatMap(verified)
    return spark.createDataFrame(found, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {_OUT}", verifySchema=False)
