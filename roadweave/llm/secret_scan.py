"""Operator 4: secret scans, DataFrame functions only.

Base kinds (assign, access, hex) are the leftmost non-overlapping matches of fixed patterns; places
come from the lengths of what stands between and inside the matches. The method adds spans: every
candidate string (a long run of key-like characters with letters and digits) is scanned by a sliding
window whose Shannon entropy follows from incremental counts: ``H = log2 w - S / w`` with
``S = sum c log2 c``, where one character enters and one leaves at each step. Hex strings and mixed
strings are separate character classes with thresholds of their own. An allow-list suppresses known
harmless strings; a harmless word clears only the windows that overlap its piece of a path, url or
key=value run. Spans inside a base span add nothing.

All work is per row: no shuffle, no state. Defined cases: a null text is empty: counts 0, the hash of
the empty string, no spans; repeated rows answer alike; empty tables give no rows; other columns are
ignored. Places are code points, the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Base patterns with their least length (of group 2 for assign, else of the match).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# A run below its least length never matches longer from a later start, so these give the same spans.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
MIXED = r"^(?=.*[0-9])(?=.*[A-Za-z]).*$"
# Strings that look random but are no secrets.
# Words clear the piece between / = _ - that holds them, whole forms the run.
ALLOWED_WORDS = r"(?i)example|sample|dummy|placeholder|changeme|lorem|xxxx|test_?key|abcdefghij|0123456789|qwertyuiop"
ALLOWED_PIECE = rf"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?:{ALLOWED_WORDS})[A-Za-z0-9+]*"
ALLOWED = [
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(?:sha(?:1|256|384|512)|md5)-",
    # possessive, so that very long strings of many words don't take the matcher's stack
    r"^[/_=-]*+(?:[A-Za-z]++[0-9]{0,4}+[/_=-]++)++[A-Za-z]*+[0-9]{0,4}+$",
]
#: Least entropy in bits of a window of ENTROPY_WINDOW characters, by character class.
ENTROPY_WINDOW = 20
#: Results of a row that are appended at a time.
CHUNK = 256
THRESHOLDS = {"hex_entropy": 3.0, "mixed_entropy": 3.7}


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once a row though ``use`` names it in lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _gathered(items: Column, state: Column, step, kind: str) -> Column:
    """Array of what ``step(state, item) -> (state, array of results)`` gives along the items.

    Results are appended in chunks, so that a row with very many of them isn't copied for each.
    """
    none = F.expr(f"cast(array() as array<{kind}>)")

    def inner(acc: Column, x: Column) -> Column:
        now, found = step(acc["at"], x)
        return F.struct(now.alias("at"), F.concat(acc["out"], found).alias("out"))

    def outer(xs: Column) -> Column:
        chunks = F.sequence(F.lit(0), F.floor((F.greatest(F.size(xs), F.lit(1)) - 1) / CHUNK).cast("int"))
        start = F.struct(state.alias("at"), F.expr(f"cast(array() as array<array<{kind}>>)").alias("out"))

        def chunk(acc: Column, c: Column) -> Column:
            part = F.aggregate(F.slice(xs, c * CHUNK + 1, F.lit(CHUNK)), F.struct(acc["at"].alias("at"), none.alias("out")), inner)
            return _bound(part, lambda p: F.struct(p["at"].alias("at"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

        return F.flatten(F.aggregate(chunks, start, chunk)["out"])

    return _bound(items, outer)


def matches(text: Column, pattern: str, between: bool = False, measure=F.length) -> Column:
    """Array of (s, e, m): leftmost non-overlapping matches, or what stands between them, with their places in code points (or as ``measure`` counts)."""
    pieces = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    kind = "struct<s:int,e:int,m:string>"
    none = F.expr(f"cast(array() as array<{kind}>)")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        s = at + measure(x["p"])
        e = s + F.coalesce(measure(x["m"]), F.lit(0))
        if between:
            return e, F.array(F.struct(at.alias("s"), s.alias("e"), x["p"].alias("m")))
        return e, F.when(x["m"].isNull(), none).otherwise(F.array(F.struct(s.alias("s"), e.alias("e"), x["m"].alias("m"))))

    whole = F.array(F.struct(F.lit(0).alias("s"), measure(text).alias("e"), text.alias("m"))) if between else none
    return F.when(text.rlike(pattern), _gathered(pieces, F.lit(0), step, kind)).otherwise(whole)


SPAN = "struct<s:int,k:int,e:int,kind:string>"


def _spans(found: Column, kind: str, rank: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(rank).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _n_log_n(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))


def hot_range(text: Column, threshold: Column, window: int = ENTROPY_WINDOW) -> Column:
    """(first, last): the characters of an ASCII string from the first to the last window of at least this entropy; nulls if there is none.

    The 128 counts are the characters of one string (a count of 0 is the space), so a step overwrites
    two of them; ``window`` is at most 90.
    """
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))

    def count(n: Column, code: Column) -> Column:
        return F.ascii(F.substring(n, code + 1, F.lit(1))) - 32

    def with_count(n: Column, code: Column, value: Column) -> Column:
        return F.overlay(n, F.char(value + 32), code + 1, F.lit(1))

    start = F.struct(
        F.lit(" " * 128).alias("n"), F.lit(0.0).alias("s"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last")
    )

    def move(acc: Column, x: Column) -> Column:
        leaves = F.when(x["go"] < 0, F.struct(acc["n"].alias("n"), acc["s"].alias("s"))).otherwise(_bound(count(acc["n"], x["go"]), lambda c: F.struct(
            with_count(acc["n"], x["go"], c - 1).alias("n"), (acc["s"] - _n_log_n(c) + _n_log_n(c - 1)).alias("s"))))
        enters = _bound(leaves, lambda v: _bound(count(v["n"], x["come"]), lambda c: F.struct(
            with_count(v["n"], x["come"], c + 1).alias("n"), (v["s"] + _n_log_n(c + 1) - _n_log_n(c)).alias("s"))))

        def moved(v: Column) -> Column:
            i = acc["i"] + 1
            hot = (i >= window) & ((F.log2(F.lit(float(window))) - v["s"] / window) >= threshold - 1e-9)
            return F.struct(
                v["n"].alias("n"), v["s"].alias("s"), i.alias("i"),
                F.coalesce(acc["first"], F.when(hot, i - window)).alias("first"), F.when(hot, i).otherwise(acc["last"]).alias("last"),
            )

        return _bound(enters, moved)

    def scanned(codes: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(-1), window), codes)  # what leaves when a character enters; -1: nothing
        steps = F.filter(F.zip_with(codes, gone, lambda a, b: F.struct(a.alias("come"), b.alias("go"))), lambda x: x["come"].isNotNull())
        return F.aggregate(steps, start, move, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))

    return _bound(codes, scanned)


def entropy_spans(text: Column, measure=F.length) -> Column:
    """Candidates are ASCII, so places inside them count alike in code points and bytes."""
    allowed = lambda m: F.lit(False) if not ALLOWED else _any(m.rlike(p) for p in ALLOWED)
    suspect = lambda x: x["m"].rlike(MIXED) & ~allowed(x["m"])

    def cleared(x: Column) -> Column:
        """What stands between the pieces with allowed words: the windows that overlap no such piece lie there."""
        rest = F.filter(matches(x["m"], ALLOWED_PIECE, between=True), lambda r: (F.length(r["m"]) >= ENTROPY_WINDOW) & suspect(r))
        return F.transform(rest, lambda r: F.struct((x["s"] + r["s"]).alias("s"), (x["s"] + r["e"]).alias("e"), r["m"].alias("m")))

    runs = F.filter(matches(text, CANDIDATE, measure=measure), suspect)
    candidates = F.flatten(F.transform(runs, lambda x: F.when(x["m"].rlike(ALLOWED_WORDS), cleared(x)).otherwise(F.array(x))))

    def span(x: Column) -> Column:
        is_hex = x["m"].rlike("^[0-9a-fA-F]+$")
        hot_hex, hot_mixed = (hot_range(x["m"], F.lit(THRESHOLDS[kind])) for kind in ("hex_entropy", "mixed_entropy"))
        return _bound(F.when(is_hex, hot_hex).otherwise(hot_mixed), lambda hot: F.struct(
            (x["s"] + hot["first"]).alias("s"), F.when(is_hex, 3).otherwise(4).alias("k"), (x["s"] + hot["last"]).alias("e"),
            F.when(is_hex, "hex_entropy").otherwise("mixed_entropy").alias("kind"),
        ))

    return F.filter(F.transform(candidates, span), lambda x: x["s"].isNotNull())


def _any(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out | c
    return out


def with_spans(docs: DataFrame, text_col: str, measure=F.length) -> DataFrame:
    """Adds __assign, __access, __hex and __spans (base and added, in order), with places as ``measure`` counts them."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn("__t", text).select(
        *docs.columns,
        _spans(F.filter(matches(F.col("__t"), ASSIGN, measure=measure), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 6), "assign", 0).alias("__assign"),
        _spans(matches(F.col("__t"), ACCESS_LONG, measure=measure), "access", 1).alias("__access"),
        _spans(matches(F.col("__t"), HEX_LONG, measure=measure), "hex", 2).alias("__hex"),
        entropy_spans(F.col("__t"), measure).alias("__more"),
    )
    base = base.withColumn("__base", F.array_sort(F.concat("__assign", "__access", "__hex")))

    def merged(to: Column, x: Column) -> tuple[Column, Column]:
        """to: the furthest end of the base spans so far, which come first of those that start alike."""
        none = F.expr(f"cast(array() as array<{SPAN}>)")
        return F.when(x["k"] < 3, F.greatest(to, x["e"])).otherwise(to), F.when((x["k"] < 3) | (x["e"] > to), F.array(x)).otherwise(none)

    spans = _gathered(F.array_sort(F.concat("__base", "__more")), F.lit(-1), merged, SPAN)
    return base.withColumn("__spans", F.when(F.size("__more") > 0, spans).otherwise(F.col("__base")))


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = with_spans(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), "__text")
    return found.select(
        F.col("__id").alias(id_col), *(F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")),
        F.sha2(_joined("__base").cast("binary"), 256).alias("base_sha256"), _joined("__spans").alias("spans"),
    )


def redact_secrets(docs: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each span (overlapping ones together) replaced by ``mark``; null texts stay null."""
    found = with_spans(docs, text_col, F.octet_length)
    text, data = F.col(text_col), F.col(text_col).cast("binary")  # bytes are cut without a walk from the start

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        """at: the end of the spans so far. One that starts there or later adds what stands before it, and the mark."""
        before = F.substring(data, at + 1, F.greatest(x["s"] - at, F.lit(0))).cast("string")
        none = F.expr("cast(array() as array<string>)")
        return F.greatest(at, x["e"]), F.when(x["k"] < 0, F.array(before)).when(x["s"] >= at, F.array(before, F.lit(mark))).otherwise(none)

    end = F.struct(F.octet_length(text).alias("s"), F.lit(-1).alias("k"), F.octet_length(text).alias("e"), F.lit("").alias("kind"))
    masked = F.array_join(_gathered(F.concat("__spans", F.array(end)), F.lit(0), step, "string"), "")
    return found.withColumn("__new", F.when(F.size("__spans") > 0, masked).otherwise(text)).select(*(F.col("__new").alias(c) if c == text_col else F.col(c) for c in docs.columns))
