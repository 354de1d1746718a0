"""Operator 6: sum-of-squares online packing of tokenised documents.

Each document is its ids and an end id. A full window is cut off as long as a document is longer
than one; its rest is placed online into the fill level that makes the sum over levels of squared
numbers of open windows smallest (Csirik et al.), kept in a level array of ``window`` counters. When
a task ends, or more than ``max_open`` windows are open, the open windows are merged: fullest first,
the emptiest are cut to fill the gaps, so at most one window of each task stays partly filled. That
last one is cut into windows of power-of-two lengths, which need no padding.

Tasks pack their own input split as it streams through: no shuffle, no state beyond the open windows
(``max_open`` x ``window`` ids at most). Sequence ids hold the partition number in their upper bits,
so a task that runs again after a lost executor makes the same rows.

Ids are those of the tokenizers library for the given vocabulary; by default the tiktoken library
computes them from the same vocabulary's ranks, about four times as fast. Texts with characters that the
two libraries' Unicode tables may class differently, with very long runs of white space, or that hold
the string of an added token (which tokenizers turns into that token's id), are given to tokenizers itself.

Defined cases: a null text is empty: one piece with the end id; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters whose classes are old and stable: ASCII, Latin-1 letters and signs, general punctuation, Greek and Cyrillic letters, CJK ideographs.
_STABLE = re.compile("[\t\n\r\x20-\x7e¡-ɏΑ-ωА-я‐-‧‰-⁞一-龥]*+").fullmatch
#: Longer runs of white space, on which tiktoken's pattern can run out of stack, go to tokenizers.
_LONG_SPACE = re.compile(r"\s{1024}").search


class Encoder:
    """Text -> uint32 ids with the end id appended."""

    def __init__(self, vocabulary: str, ranks: str | None, pattern: str | None, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(vocabulary)
        self.added = [t.content for t in self.exact.get_added_tokens_decoder().values()]
        self.fast, self.end_id = None, end_id
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        alike = self.fast and _STABLE(text) and not _LONG_SPACE(text) and not any(a in text for a in self.added)
        ids = self.fast.encode_ordinary(text) if alike else self.exact.encode(text, add_special_tokens=False).ids
        return np.array([*ids, self.end_id], np.uint32)


class Packer:
    """Places pieces (row, start, ids) into windows; ``out`` gets (row, start, ids, sequence, offset) once a window is final."""

    def __init__(self, window: int, max_open: int):
        self.window, self.max_open = window, max_open
        self.counts = np.zeros(window + 1, np.int64)  # the level array: open windows by fill level; 0 stands for a fresh one
        self.open: list[list[list]] = [[] for _ in range(window + 1)]  # windows at each level: lists of pieces
        self.n_open, self.next_id = 0, 0
        self.out: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for row, start, ids in pieces:
            self.out.append((row, start, ids, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def level_for(self, size: int) -> int:
        """Fill level (0: a fresh window) at which a piece of this size keeps the sum of squares smallest; ties to the fullest."""
        n, w = self.counts, self.window
        change = 2 * (np.append(n[size + 0 : w], 0) if size < w else np.zeros(1, np.int64)) + 1  # a window arrives at level h + size
        change[-1] = 0  # level w: it is full and leaves
        change[1:] += 1 - 2 * n[1 : len(change)]  # a window leaves level h
        change[1:][n[1 : len(change)] == 0] = np.iinfo(np.int64).max
        return len(change) - 1 - int(np.argmin(change[::-1]))

    def add(self, row: int, ids: np.ndarray) -> None:
        w, start = self.window, 0
        while len(ids) - start >= w:
            self.close([(row, start, ids[start : start + w])])
            start += w
        size = len(ids) - start
        if not size:
            return
        h = self.level_for(size)
        pieces = self.open[h].pop() if h else []
        if h:
            self.counts[h] -= 1
            self.n_open -= 1
        pieces.append((row, start, ids[start:]))
        self._put(h + size, pieces)
        if self.n_open > self.max_open:
            self.merge(keep=self.max_open // 2)

    def _put(self, level: int, pieces: list) -> None:
        if level == self.window:
            self.close(pieces)
        else:
            self.counts[level] += 1
            self.open[level].append(pieces)
            self.n_open += 1

    def merge(self, keep: int = 0) -> None:
        """Fill the fullest open windows with cuts of the emptiest, until at most ``keep`` (or one) are open."""
        levels = [(h, pieces) for h in range(1, self.window) for pieces in self.open[h]]
        low, high = 0, len(levels) - 1
        while low < high and high - low + 1 > max(keep, 1):
            h, target = levels[high]
            room = self.window - h
            while room and low < high:
                have, source = levels[low]
                row, start, ids = source.pop()
                take = min(room, len(ids))
                target.append((row, start + len(ids) - take, ids[len(ids) - take :]))
                if take < len(ids):
                    source.append((row, start, ids[: len(ids) - take]))
                room, have = room - take, have - take
                levels[low] = (have, source)
                low += not have
            if room:
                levels[high] = (self.window - room, target)
                break
            self.close(target)
            high -= 1
        self.counts[:], self.n_open = 0, 0
        self.open = [[] for _ in range(self.window + 1)]
        for h, pieces in levels[low : high + 1]:
            if h:
                self._put(h, pieces)

    def finish(self) -> None:
        self.merge()
        for h in range(1, self.window):
            for pieces in self.open[h]:
                left = [list(p) for p in pieces]
                for bit in reversed(range(h.bit_length())):
                    room, part = h & (1 << bit), []
                    while room:
                        row, start, ids = left[0]
                        take = min(room, len(ids))
                        part.append((row, start, ids[:take]))
                        left[0] = [row, start + take, ids[take:]]
                        if take == len(ids):
                            left.pop(0)
                        room -= take
                    if part:
                        self.close(part)
        self.counts[:], self.n_open, self.open = 0, 0, [[] for _ in range(self.window + 1)]


def pack_documents(docs: DataFrame, *, vocabulary: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 1, id_col: str = "doc_id",
                   text_col: str = "text", window: int = 2048, max_open: int = 4096, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids themselves, if asked)."""
    kind = docs.schema[id_col].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}.get(kind)
    if id_type is None:
        raise ValueError(f"{id_col}: {kind} ids aren't supported")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, first = Encoder(vocabulary, ranks, pattern, end_id), Packer(window, max_open), TaskContext.get().partitionId() << 40
        live: dict[int, tuple] = {}  # rows with pieces that aren't out yet: id, tokens, tokens left
        n = 0

        def rows() -> pa.RecordBatch:
            out, packer.out = packer.out, []
            columns: list[list] = [[] for _ in range(7 + with_ids)]
            for row, start, ids, sequence, offset in out:
                doc, tokens, left = live[row]
                for c, v in zip(columns, (doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, first + sequence, offset, *([ids] if with_ids else []))):
                    c.append(v)
                if left == len(ids):
                    del live[row]
                else:
                    live[row] = (doc, tokens, left - len(ids))
            types = [id_type, *[pa.int64()] * 6, *[pa.list_(pa.int64())] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = encode(text)
                live[n] = (doc, len(ids), len(ids))
                packer.add(n, ids)
                n += 1
                if len(packer.out) >= 8192:
                    yield rows()
        packer.finish()
        yield rows()

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    schema = ", ".join(f"{c} {kind if c == 'id' else 'array<long>' if c == 'ids' else 'long'}" for c in names).replace("offset", "`offset`")
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(packed, schema).withColumnRenamed("id", id_col)
