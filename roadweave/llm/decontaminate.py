"""Operator 7: benchmark decontamination by winnowing, DataFrame functions only.

Every ``window`` consecutive words of an item (all its words, if it has fewer) form one window. With
k-grams of ``gram`` words, each window keeps its minimum k-gram hash; document positions that hold the
minimum of any window around them are the document's fingerprints (ties all stay), so every shared
window shares the fingerprint at the same place in it. Items below ``window`` words are looked up at
every position by a hash of as many words.

Documents are read once, whatever the benchmark. Inside the row, a Bloom filter of the benchmark's
hashes (one bit each, ``FILTER_BITS`` at most, so of bounded size; a fuller one only lets more through)
picks the fingerprints to look up; each goes on with the few words around it. They are joined with the
windows - broadcast up to ``broadcast_windows`` of them, else in a shuffle - and each hit is extended: the
document's words are compared with the window's. Item ids are joined last, by window, to the hits alone.

Rows are told apart by their id and two hashes of the text, which are the same whenever a task is run again.

Defined cases: null and empty texts have no words and no hits; items without words take no part; items
without an id hit like any others and count as one item together, but add nothing to the list of ids;
repeated rows (also of one id) each get their row; an empty benchmark hits nothing; an empty document
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import cut

#: As ALNUM_WORD before lower-casing.
_RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits of the filter: 64 for each hash, between these two powers of two.
LEAST_BITS, FILTER_BITS = 1 << 15, 1 << 24
#: Bits that one row of a bitmap aggregate holds.
_BUCKET = 32_768
#: Hexadecimal digits as characters whose low four bits are the digit.
_DIGITS = bytes.maketrans(b"0123456789abcdef", bytes(range(0x40, 0x50)))


def words_of(text: Column) -> Column:
    """Words with A-Z lower-cased; plain ASCII words take the fast built-in."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_RAW_WORD), F.lit(0))
    return F.transform(raw, lambda w: F.when(F.octet_length(w) == F.length(w), F.lower(w)).otherwise(F.translate(w, _UPPER, _LOWER)))


def _gram(words: str, at: Column, size: int) -> Column:
    return F.xxhash64(*(F.get(F.col(words), at + j) for j in range(size)))


def _grams(words: str, size: int) -> Column:
    last = F.size(words) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: _gram(words, i, size))).otherwise(F.expr("cast(array() as array<bigint>)"))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(item, win): windows of every item, as arrays of words."""
    words = items.select(F.col(id_col).alias("item"), words_of(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(window))
    return words.select("item", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.slice("w", i + 1, size))).alias("win"))


def hashed_windows(wins: DataFrame, window: int, gram: int) -> DataFrame:
    """Distinct windows: win, size, hash and off (place of the hashed gram in it)."""
    rows = wins.select("win").distinct().withColumn("size", F.size("win")).withColumn("h", F.when(F.col("size") == window, _grams("win", gram)))
    return rows.select(
        "win", "size", F.coalesce(F.array_min("h"), F.xxhash64(F.concat_ws(" ", "win"))).alias("hash"),
        F.coalesce(F.array_position("h", F.array_min("h")).cast("int") - 1, F.lit(0)).alias("off"),
    )


def bloom_filter(hashes: DataFrame, bits: int) -> bytes:
    """Column hash -> a bitmap of the hashes modulo ``bits``, four bits in each byte."""
    v = F.pmod(F.col("hash"), F.lit(bits)) + 1
    got = hashes.groupBy(F.bitmap_bucket_number(v).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("m")).collect()  # bits / 32,768 rows of 4 kB
    parts = {r["b"]: bytes(r["m"]) for r in got}
    return b"".join(parts.get(b, bytes(_BUCKET // 8)) for b in range(1, bits // _BUCKET + 1)).hex().encode().translate(_DIGITS)


def _may_hold(bloom: bytes, bits: int, h: Column) -> Column:
    at = F.pmod(h, F.lit(bits)).cast("int")
    # a byte's high four bits come first in its two digits
    digit = F.shiftright(at, 3) * 2 + F.when(at.bitwiseAND(F.lit(4)) == 0, 1).otherwise(0)
    return F.getbit(F.ascii(F.substring(F.lit(bloom), digit + 1, F.lit(1)).cast("string")), at.bitwiseAND(F.lit(3))) == 1


def _is_fingerprint(p: Column, span: int) -> Column:
    """Whether the hash at p is the minimum of one of the windows of ``span`` hashes that hold it."""
    near = {j: F.get(F.col("h"), p + j) for j in range(1 - span, span)}
    windows = [F.when(near[s].isNotNull() & near[s + span - 1].isNotNull(), F.least(*(near[s + j] for j in range(span)))) for s in range(1 - span, 1)]
    return F.coalesce(*(F.when(w == near[0], True) for w in windows), F.lit(False))


_SPOT = "struct<p:int,size:int,hash:bigint,at:int,around:array<string>>"


def _short_spots(size: int, bloom: bytes, bits: int, none: Column) -> Column:
    """Places of ``size`` words that may be a whole item."""
    words = lambda p: F.slice("w", p + 1, F.lit(size))
    whole = lambda p: F.xxhash64(F.concat_ws(" ", words(p)))
    held = F.filter(F.sequence(F.lit(0), F.col("n").cast("int") - size), lambda p: _may_hold(bloom, bits, whole(p)))
    spots = F.transform(held, lambda p: F.struct(p.alias("p"), F.lit(size).alias("size"), whole(p).alias("hash"), p.alias("at"), words(p).alias("around")))
    return F.when(F.col("n") >= size, spots).otherwise(none)


def _spots(rows: DataFrame, sizes: list[int], bloom: bytes, bits: int, window: int, gram: int) -> DataFrame:
    """rows (.., w, n) get ``spots``: places whose hash the benchmark may have, with the words around them (from word ``at`` on)."""
    none = F.expr(f"cast(array() as array<{_SPOT}>)")
    found, hashed = [none], rows
    if window in sizes:
        hashed = rows.withColumn("h", F.when(F.col("n") >= window, _grams("w", gram)))
        held = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda p: F.when(_may_hold(bloom, bits, F.get(F.col("h"), p)), _is_fingerprint(p, window - gram + 1)).otherwise(F.lit(False)))

        def spot(p: Column) -> Column:
            at = F.greatest(p - (window - gram), F.lit(0))
            return F.struct(p.alias("p"), F.lit(window).alias("size"), F.get(F.col("h"), p).alias("hash"), at.alias("at"), F.slice("w", at + 1, p + window - at).alias("around"))

        found.append(F.when(F.col("n") >= window, F.transform(held, spot)).otherwise(none))
    found += [_short_spots(size, bloom, bits, none) for size in sizes if size != window]
    return hashed.withColumn("spots", F.concat(*found))


KEY = ["id", "t", "u"]


def hits(docs: DataFrame, wins: DataFrame, *, id_col: str, text_col: str, window: int, gram: int, broadcast_windows: int) -> DataFrame:
    """(id, t, u, n, s, e, win): a row without a place for every document, and one for each place at which a window stands."""
    found = hashed_windows(wins, window, gram)
    count = {r["size"]: r["n"] for r in found.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most `window` rows
    total = sum(count.values())
    bits = min(max(1 << (64 * max(total, 1) - 1).bit_length(), LEAST_BITS), FILTER_BITS)
    bloom = bloom_filter(found, bits) if total else b""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("t"), F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)).alias("u"), words_of(text).alias("w")).withColumn("n", F.size("w").cast("long"))
    itself = F.expr(f"array(cast(named_struct('p', -1, 'size', 0, 'hash', null, 'at', 0, 'around', null) as {_SPOT}))")
    spots = _spots(rows, sorted(count, reverse=True), bloom, bits, window, gram).select(*KEY, "n", F.explode(F.concat(itself, "spots")).alias("s")).select(*KEY, "n", "s.*")
    if not total:
        none = F.lit(None)
        return spots.select(*KEY, "n", none.cast("int").alias("s"), none.cast("int").alias("e"), none.cast("array<string>").alias("win"))
    known = F.broadcast(found) if total <= broadcast_windows else found.hint("shuffle_hash")
    keyed = spots.withColumn("hash", F.coalesce("hash", "t"))  # a document's own row is joined with nothing, but has to go somewhere
    joined = keyed.alias("d").join(known.alias("k"), (F.col("d.hash") == F.col("k.hash")) & (F.col("d.p") >= 0) & (F.col("d.size") == F.col("k.size")), "left")
    start = F.col("p") - F.col("off")
    hit = F.coalesce(F.when(start >= F.col("at"), F.slice("around", F.greatest(start - F.col("at"), F.lit(0)) + 1, F.col("d.size")) == F.col("win")), F.lit(False))
    looked = joined.select(*KEY, "n", "p", start.cast("int").alias("s"), (start + F.col("d.size")).cast("int").alias("e"), "win", hit.alias("hit")).where("hit or p < 0")
    return looked.select(*KEY, "n", *(F.when(F.col("p") >= 0, F.col(c)).alias(c) for c in ("s", "e", "win")))


def _covered(spans: str) -> Column:
    """Words inside a sorted array of (s, e, ...)."""
    start = F.struct(F.lit(0).alias("to"), F.lit(0).alias("n"))
    step = lambda acc, x: F.struct(F.greatest(acc["to"], x["e"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(acc["to"], x["s"]))).alias("n"))
    return F.aggregate(spans, start, step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
                  window: int = 10, gram: int = 5, broadcast_windows: int = 100_000) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    wins = item_windows(items, item_col, item_text_col, window)
    found = cut(hits(docs, wins, id_col=id_col, text_col=text_col, window=window, gram=gram, broadcast_windows=broadcast_windows))
    places = F.array_sort(F.filter(F.collect_set(F.struct("s", "e")), lambda x: x["s"].isNotNull()))
    by_doc = found.groupBy(*KEY).agg(F.count(F.when(F.col("s").isNull(), 1)).cast("int").alias("copies"), F.max("n").alias("n"), places.alias("places"))
    pairs = found.where("s is not null").select(*KEY, "win").distinct().join(wins, "win").select(*KEY, F.col("item").cast("string").alias("item")).distinct()
    ids = pairs.groupBy(*KEY).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("ids")).select(*(F.col(c).alias(f"i_{c}") for c in KEY), "n_items", "ids")
    same = F.col("id").eqNullSafe(F.col("i_id")) & (F.col("t") == F.col("i_t")) & (F.col("u") == F.col("i_u"))
    out = by_doc.join(ids, same, "left").withColumn("n_hit", _covered("places").cast("long"))
    return out.select(
        "id", F.col("n").alias("n_words"), "n_hit", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("ids", F.lit("")).cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy").withColumnRenamed("id", id_col)
