"""Operator 13: alignment of two tokenizers' tokens, by segment deduplication.

A text with a space before it is cut before every run of white space that begins with U+0020 after a
character that isn't white space. ``Pair`` verifies from the vocabularies that neither tokenizer can
merge across such a place (else texts stay whole). So tokens of a text are those of its segments, one
after the other, and a segment has to be encoded and aligned once, wherever it stands:

1. each task cuts its texts into segments, block by block (``block_chars`` characters), and keeps a
   document as codes into its block's segments; texts are read once, and each block sends a segment once;
2. distinct segments are encoded by both tokenizers and aligned, with their numbers of occurrences;
3. counts of linked id pairs are sums over segments; each segment gets the sum of its links' counts
   and how many are the highest of their B id. Up to ``max_sent`` pairs are sent to the tasks as arrays,
   more are joined in a shuffle;
4. segments are joined back to the blocks that hold them, and each block composes its documents.

No stage holds more than a block or a batch of segments; the joins of frequent segments are plain
joins, which adaptive execution splits. A segment whose joined bytes differ from its text (U+2581 in
a text, which B reads as a space) leaves its whole document without tokens, and what such documents
hold is taken off the counts.

Defined cases: null and empty texts have no tokens; repeated rows and ids are composed each; a null id
stays null; other columns are ignored; an empty table gives no rows; a text without spaces is one segment,
however long.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import cut, release

#: Characters after which no cut is made: white space and what a regular expression may take for it.
_SPACE_LIKE = "\\s\x0b\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u3000\ufeff"
_CUTS = re.compile(f"(?<=[^{_SPACE_LIKE}])(?= )").split
#: Texts in which not every space is a cut.
_ODD = f"[{_SPACE_LIKE}] |^ | $"
#: Characters of segments that are encoded at a time.
_BATCH_CHARS = 1 << 18


def _byte_alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, others for 256 and up in turn."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xAD)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Both tokenizers: ``encode`` gives ids of segments, ``bytes_a`` and ``bytes_b`` the bytes of each id."""

    def __init__(self, vocabulary_a: str, model_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(vocabulary_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=model_b)
        alphabet = _byte_alphabet()
        entries = self.a.get_vocab()
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.cuttable = self._cuts_at_byte_level() and self._pieces_open_with_space(pieces)

    def _cuts_at_byte_level(self) -> bool:
        """A splits before white space by its pattern, and no entry holds a space after a character that a cut may follow."""
        own = json.loads(self.a.to_str())
        rule = own.get("pre_tokenizer") or {}
        words = own.get("normalizer") is None and own["model"]["type"] == "BPE" and rule.get("type") == "ByteLevel" and rule.get("use_regex") and not rule.get("add_prefix_space")
        return bool(words) and not any(re.search(f"[^{_SPACE_LIKE}] ", x.decode(errors="replace")) for x in self.bytes_a)

    def _pieces_open_with_space(self, pieces: list[str]) -> bool:
        """No piece of B holds a space after another character, spaces are kept as they are and one is put in front."""
        spell = lambda t: "".join(pieces[i] for i in self.b.encode(t))
        kept = all(spell(t) == "\u2581" + t.replace(" ", "\u2581") for t in ("a", " a", "a  b", "a ", "\u00c4b"))
        return kept and not any(re.search("[^\u2581]\u2581", p) for p in pieces)

    def encode(self, keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments given without the space that opens them."""
        ids_a = [e.ids for e in self.a.encode_batch([" " + k for k in keys], add_special_tokens=False)]
        return ids_a, self.b.encode(keys, num_threads=1)


def segments(text: str, cuttable: bool = True) -> list[str]:
    """The segments of a space and the text, each without the space that opens it."""
    if not cuttable:
        return [text]
    parts = [s[1:] for s in _CUTS(" " + text)]
    if len(parts) > 1 and not parts[-1]:  # a lone space at the end stays with what is before it
        parts[-2:] = [parts[-2] + " "]
    return parts


def _packed(codes: np.ndarray) -> bytes:
    """Codes of a document: frequent segments have small codes, so byte by byte they take little room."""
    return zstandard.ZstdCompressor(level=1).compress(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()) if len(codes) else b""


def _unpacked(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.int32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4")[:, 0]


def _blocks(cuttable: bool, block_chars: int):
    """Turns (id, text) into rows of documents (block, id, codes) and rows of segments (block, segment, code, n)."""

    def block(number: int, ids: pa.Array, texts: pa.Array, schema: pa.Schema):
        whole = pc.fill_null(pc.not_equal(pc.binary_length(texts), 0), False)
        odd = pc.fill_null(pc.match_substring_regex(texts, _ODD), False) if cuttable else pa.array([True] * len(texts))
        plain = pc.if_else(pc.and_(whole, pc.invert(odd)), texts, None)
        lists = pc.split_pattern(plain, " ")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = pc.indices_nonzero(pc.and_(whole, odd)).to_pylist()
        cut_up = [segments(texts[i].as_py(), cuttable) for i in rest]
        parts = [lists.flatten(), pa.array([s for x in cut_up for s in x], pa.string())]
        codes = pa.chunked_array(parts).combine_chunks().dictionary_encode()
        at = codes.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        starts = np.cumsum(counts) - counts
        extra = int(counts.sum())
        for i, x in zip(rest, cut_up):
            starts[i], counts[i] = extra, len(x)
            extra += len(x)
        held = [_packed(at[s : s + n]) for s, n in zip(starts.tolist(), counts.tolist())]
        n, m = len(ids), len(codes.dictionary)
        yield pa.RecordBatch.from_arrays([pa.array([number] * n, pa.int64()), ids, pa.array(held, pa.binary()), *(pa.nulls(n, schema.field(i).type) for i in (3, 4, 5))], schema=schema)
        if m:
            each = np.bincount(at, minlength=m)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * m, pa.int64()), pa.nulls(m, schema.field(1).type), pa.nulls(m, pa.binary()), codes.dictionary.cast(pa.string()), pa.array(np.arange(m, dtype=np.int32)), pa.array(each)], schema=schema)

    def run(batches):
        number, held, chars = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, [], 0

        def close():
            ids, texts = (pa.chunked_array([b.column(c) for b in held]).combine_chunks() for c in (0, 1))
            schema = pa.schema([("block", pa.int64()), ("id", ids.type), ("codes", pa.binary()), ("seg", pa.string()), ("code", pa.int32()), ("n", pa.int64())])
            return block(number, ids, texts, schema)

        for b in batches:
            at = 0
            sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False))
            while at < len(b):
                before = int(sizes[at - 1]) if at else 0
                upto = max(at + 1, int(np.searchsorted(sizes, before + block_chars - chars, "right")))
                held.append(b.slice(at, upto - at))
                chars += int(sizes[upto - 1]) - before
                at = upto
                if chars >= block_chars or at < len(b):
                    yield from close()
                    number, held, chars = number + 1, [], 0
        if held:
            yield from close()

    return run


def align(key: str, a: list[int], b: list[int], bytes_a: list[bytes], bytes_b: list[bytes]) -> tuple[list[int], list[int]]:
    """Groups of a segment, one after the other, each as n_a, n_b, its A ids and its B ids; and its links as a << 32 | b. Both are empty if joined bytes differ from the segment."""
    raw = b" " + key.encode()
    if b"".join([bytes_a[i] for i in a]) != raw or b"".join([bytes_b[i] for i in b]) != raw:
        return [], []
    if len(a) == 1 and len(b) == 1:
        return [1, 1, a[0], b[0]], [a[0] << 32 | b[0]]
    groups: list[int] = []
    links = []
    i = j = last_a = last_b = 0
    end_a, end_b = len(bytes_a[a[0]]), len(bytes_b[b[0]])
    while True:
        if end_a == end_b:
            groups += (i + 1 - last_a, j + 1 - last_b, *a[last_a : i + 1], *b[last_b : j + 1])
            links.append(a[i] << 32 | b[j])
            i, j = i + 1, j + 1
            last_a, last_b = i, j
            if i == len(a):
                return groups, links
            end_a += len(bytes_a[a[i]])
            end_b += len(bytes_b[b[j]])
        elif end_a < end_b:
            i += 1
            end_a += len(bytes_a[a[i]])
        else:
            j += 1
            end_b += len(bytes_b[b[j]])


class _Names(dict):
    """Decimal text of numbers, made once."""

    def __missing__(self, i: int) -> str:
        self[i] = out = str(i)
        return out


def spell(groups: list[int], names: _Names) -> tuple[str, int, int, int]:
    """Groups as text, with their numbers of A ids, B ids and groups."""
    out, at, n_a, n_b, size = [], 0, 0, 0, len(groups)
    while at < size:
        a, b = groups[at], groups[at + 1]
        if a == b == 1:
            out.append(f"{names[groups[at + 2]]}|{names[groups[at + 3]]}")
            at, n_a, n_b = at + 4, n_a + 1, n_b + 1
            continue
        mid = at + 2 + a
        end = mid + b
        first = names[groups[at + 2]] if a == 1 else ",".join([names[i] for i in groups[at + 2 : mid]])
        out.append(f"{first}|{names[groups[mid]] if b == 1 else ','.join([names[i] for i in groups[mid:end]])}")
        n_a, n_b, at = n_a + a, n_b + b, end
    return ";".join(out), n_a, n_b, len(out)


_ALIGNED = "seg string, n long, groups binary, links array<long>"


def _short(groups: list[int]) -> bytes:
    """Two bytes a number if all fit, marked by an odd length, else four (a long run without a common end has large counts)."""
    return array("H", groups).tobytes() + b"s" if max(groups, default=0) < 1 << 16 else array("I", groups).tobytes()


def _numbers(data: bytes) -> list[int]:
    return memoryview(data[:-1]).cast("H").tolist() if len(data) % 2 else memoryview(data).cast("I").tolist()


def _aligner(vocabulary_a: str, model_b: str):
    def run(batches):
        pair = Pair(vocabulary_a, model_b)
        for batch in batches:
            keys, n = batch.column(0), batch.column(1)
            bounds = (np.cumsum(pc.binary_length(keys).to_numpy(zero_copy_only=False)) // _BATCH_CHARS).tolist()
            lo = 0
            while lo < len(keys):
                hi = lo + 1
                while hi < len(keys) and bounds[hi] == bounds[lo]:
                    hi += 1
                some = keys.slice(lo, hi - lo).to_pylist()
                ids_a, ids_b = pair.encode(some)
                groups, links = zip(*(align(k, a, b, pair.bytes_a, pair.bytes_b) for k, a, b in zip(some, ids_a, ids_b)))
                yield pa.RecordBatch.from_arrays(
                    [keys.slice(lo, hi - lo), n.slice(lo, hi - lo), pa.array(list(map(_short, groups)), pa.binary()), pa.array(links, pa.list_(pa.int64()))], names=["seg", "n", "groups", "links"])
                lo = hi

    return run


def _lost(batches):
    """(block, code, n) of the documents that hold a code of ``bad``."""
    for batch in batches:
        for block, codes, bad in zip(*(batch.column(i).to_pylist() for i in range(3))):
            at = _unpacked(codes)
            if np.isin(at, bad).any():
                found, n = np.unique(at, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(found), pa.int64()), pa.array(found), pa.array(n, pa.int64())], names=["block", "code", "n"])


def _without_lost(aligned: DataFrame, docs: DataFrame, held: DataFrame) -> DataFrame:
    """``aligned`` with the occurrences in documents without tokens taken off n."""
    bad = aligned.where(F.size("links") == 0).select("seg")
    if bad.isEmpty():
        return aligned
    blocks = held.join(bad, "seg").groupBy("block").agg(F.collect_list("code").alias("bad"))  # at most a block's segments
    lost = docs.join(blocks, "block").select("block", "codes", "bad").mapInArrow(_lost, "block long, code int, n long").groupBy("block", "code").agg(F.sum("n").alias("lost"))
    by_segment = held.join(lost, ["block", "code"]).groupBy("seg").agg(F.sum("lost").alias("lost"))
    return aligned.join(by_segment, "seg", "left").withColumn("n", F.col("n") - F.coalesce("lost", F.lit(0))).drop("lost")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold the pair; whether that is its B id's highest count."""
    counts = aligned.where("n > 0").select("n", F.explode("links").alias("pair")).groupBy("pair").agg(F.sum("n").alias("count"))
    top = counts.groupBy(F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("pair").bitwiseAND(0xFFFFFFFF)).join(top, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def _valued(aligned: DataFrame, pairs: DataFrame, max_sent: int) -> DataFrame:
    """``aligned`` with n_best and count_sum of each segment's links in place of n and links."""
    some = pairs.limit(max_sent + 1)
    if some.count() > max_sent:
        links = aligned.select("seg", F.explode("links").alias("pair")).join(pairs, "pair")
        sums = links.groupBy("seg").agg(F.sum(F.col("best").cast("int")).cast("int").alias("n_best"), F.sum("count").alias("count_sum"))
        return aligned.select("seg", "groups").join(sums, "seg", "left").fillna(0, ["n_best", "count_sum"])
    table = pairs.orderBy("pair").toArrow()  # at most max_sent rows of 17 bytes
    sent = aligned.sparkSession.sparkContext.broadcast([table.column(c).to_numpy() for c in ("pair", "count", "best")])

    def run(batches):
        pair, count, best = sent.value
        for b in batches:
            links = b.column(2)
            flat, size = links.flatten().to_numpy(), pc.list_value_length(links).to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(pair, flat), max(0, len(pair) - 1))
            known = pair[at] == flat if len(pair) else np.zeros(len(flat), bool)  # pairs of documents without tokens alone aren't counted
            row, good = np.repeat(np.arange(len(b)), size)[known], at[known]
            n_best = np.bincount(row[best[good]], minlength=len(b)).astype(np.int32)
            total = np.zeros(len(b), np.int64)
            np.add.at(total, row, count[good])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_best), pa.array(total)], names=["seg", "groups", "n_best", "count_sum"])

    return aligned.select("seg", "groups", "links").mapInArrow(run, "seg string, groups binary, n_best int, count_sum long")


def _bundles(batches):
    """(block, code, groups, n_best, count_sum) -> (block, data): what a task has for a block, compressed together."""

    def bundled(held: list[pa.RecordBatch]):
        block = np.concatenate([b.column(0).to_numpy() for b in held])
        order = np.argsort(block, kind="stable")
        block = block[order]
        numbers = [np.concatenate([b.column(i).to_numpy() for b in held])[order] for i in (1, 3, 4)]
        groups = pa.chunked_array([b.column(2) for b in held]).combine_chunks().take(pa.array(order))
        sizes, text, at = pc.binary_length(groups).to_numpy(), b"".join(groups.to_pylist()), 0
        ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)).tolist()
        data, lo = [], 0
        for hi in ends:
            upto = at + int(sizes[lo:hi].sum())
            planes = [a[lo:hi].astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes() for a in (*numbers, sizes)]
            data.append(zstandard.ZstdCompressor(level=1).compress(b"".join([np.int64(hi - lo).tobytes(), *planes, text[at:upto]])))
            lo, at = hi, upto
        return pa.RecordBatch.from_arrays([pa.array(block[np.array(ends) - 1]), pa.array(data, pa.binary())], names=["block", "data"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= 500_000:
            yield bundled(held)
            held, n = [], 0
    if n:
        yield bundled(held)


def _opened(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Codes, n_best, count_sum and groups of a bundle."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    planes = np.frombuffer(raw, np.uint8, 32 * n, 8).reshape(4, 8, n).transpose(0, 2, 1)
    codes, n_best, count_sum, sizes = np.ascontiguousarray(planes).view("<i8")[:, :, 0]
    ends = (8 + 32 * n + np.cumsum(sizes)).tolist()
    return codes, n_best, count_sum, [raw[a:b] for a, b in zip([8 + 32 * n, *ends], ends)]


def _compose(docs: pa.Table, held: pa.Table) -> pa.Table:
    """A block's documents from its segments: sums of what these give, and the hash of their groups in order."""
    bundles, names = held.column("data").to_pylist(), _Names()
    codes, sums, texts = [np.zeros(0, np.int64)], [np.zeros((5, 0), np.int64)], []
    for i, data in enumerate(bundles):  # opened one at a time
        bundles[i] = None
        own, n_best, count_sum, groups = _opened(data)
        spelled = [spell(_numbers(g), names) for g in groups]
        texts += [x[0] for x in spelled]
        codes.append(own)
        sums.append(np.vstack([*(np.fromiter((x[k] for x in spelled), np.int64, len(spelled)) for k in (1, 2, 3)), n_best, count_sum]))
    codes, sums = np.concatenate(codes), np.concatenate(sums, 1)
    place = np.full(int(codes.max(initial=0)) + 1, -1)
    place[codes] = np.arange(len(codes))
    rows = []
    for data in docs.column("codes").to_pylist():
        at = place[_unpacked(data)]
        if len(at) and sums[0, at].all():
            rows.append((*sums[:, at].sum(1).tolist(), hashlib.sha256(";".join([texts[i] for i in at.tolist()]).encode()).hexdigest()))
        else:
            rows.append((0,) * 5 + ("",))
    n_a, n_b, n_links, n_best, count_sum, sha = zip(*rows)
    longs = [pa.array(x, pa.int64()) for x in (n_a, n_b, n_links, n_links, n_best, count_sum)]
    return pa.Table.from_arrays([docs.column("id").combine_chunks(), *longs, pa.array(sha, pa.string())], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, *, vocabulary_a: str, model_b: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 32_000_000, max_sent: int = 4_000_000) -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs), groups_sha256.

    Every group ends in one link, so both numbers are equal.
    """
    cuttable = Pair(vocabulary_a, model_b).cuttable
    kind = docs.schema[id_col].dataType.simpleString()
    coded = cut(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(_blocks(cuttable, block_chars), f"block long, id {kind}, codes binary, seg string, code int, n long"),
        "zstd",
    )
    again = docs.sparkSession.read.schema(coded.schema).parquet(coded._table)  # so that the two sides of the last join have columns of their own
    texts = again.where("codes is not null").select("block", "id", "codes")
    held = coded.where("seg is not null").select("block", "seg", "code", "n")
    aligned = cut(held.groupBy("seg").agg(F.sum("n").alias("n")).mapInArrow(_aligner(vocabulary_a, model_b), _ALIGNED), "zstd")
    pairs = cut(pair_counts(_without_lost(aligned, texts, held.drop("n"))))
    valued = _valued(aligned, pairs, max_sent)
    back = held.select("block", "seg", "code").join(valued, "seg").select("block", "code", "groups", "n_best", "count_sum").mapInArrow(_bundles, "block long, data binary")
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = cut(texts.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_compose, schema))
    release(coded, aligned, pairs)
    return out.withColumnRenamed("id", id_col)
