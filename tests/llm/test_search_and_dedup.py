from __future__ import annotations

import random
from pathlib import Path

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from roadweave.llm import simhash, substring, topk
from roadweave.llm.common import release, shared_dir
from roadweave.llm.components import components
from roadweave.llm.mtree import MTree
from roadweave.llm.packed import from_low_bytes, low_bytes, pack, unpack

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string"


def best(ids, x, q, k, own):
    scores = [int(s) for s in x.astype(object) @ q.astype(object)]
    return sorted(((s, int(i)) for s, i in zip(scores, ids) if i != own), key=lambda r: (-r[0], r[1]))[:k]


@pytest.mark.parametrize("seed", range(12))
def test_mtree_equals_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, d = int(rng.integers(1, 500)), int(rng.integers(1, 9))
    x = rng.integers(-4, 5, (n, d)) * (2 * 10**8 if seed % 4 == 0 else 1)  # products beyond 2**53 too
    x[rng.random(n) < 0.4] = x[0]
    ids = rng.permutation(2 * n)[:n].astype(np.int64)
    tree = MTree.from_bytes(MTree.build(ids, x, page=int(rng.integers(2, 20)), fanout=4).to_bytes()).prepare()
    q = x[rng.integers(0, n, 7)]
    want = [best(ids, x, v, 10, None) for v in q]
    assert [list(zip(s.tolist(), i.tolist())) for s, i in tree.search(q, 10)] == want
    full = [w for w in range(len(q)) if len(want[w]) == 10]
    if full:
        floor, floor_id = (np.array(c) for c in zip(*(want[w][4] for w in full)))
        got = tree.search(q[full], 10, floor, floor_id)
        assert [list(zip(s.tolist(), i.tolist())) for s, i in got] == [want[w][:5] for w in full]


VECTORS = "vec_id long, embedding array<float>, score string"


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "block_queries": 5, "max_pivots": 4}])
def test_top_k_with_odd_rows(spark, options):
    rng = np.random.default_rng(1)
    rows = [(i, [float(v) for v in rng.normal(0, 0.2, 6)], "x") for i in range(150)]
    rows += [(i, [0.25] * 6, "copy") for i in range(200, 280)]
    odd = [(300, None, ""), (320, [1.0] * 5 + [float("nan")], ""), (340, [1.0, None] + [1.0] * 4, ""), (360, [float("inf")] * 6, ""), (None, [1.0] * 6, ""), (400, [1.0, 2.0], ""), (401, [3.0, 1.0], ""), (401, [3.0, 1.0], "")]
    got = topk.top_k(spark.createDataFrame(rows + odd, VECTORS), **options).collect()
    ids = np.array([r[0] for r in rows])
    x = np.floor(64 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    by_query = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by_query.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert by_query.pop(400) == [(64 * 64 * 5, 401)]
    assert by_query == {int(i): best(ids, x, v, 20, int(i)) for i, v in zip(ids, x) if i % 20 == 0}


def test_top_k_with_large_values(spark):
    """Scores up to the largest long are exact; vectors whose squared length is beyond it take no part."""
    side = 2.0**31.5 / 64 / 2  # four of these: squared length just below 2**63
    rows = [(0, [side] * 3 + [0.0]), (1, [side * 0.9, side, 0.0, 0.0]), (2, [-side, side, side, 0.0]), (3, [1e9] * 4), (20, [1e300, 0.0, 0.0, 0.0]), (40, [1.0, 0.0, 0.0, 0.0]), (5, [0.0] * 4)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    x = {i: [int(np.floor(64 * c)) for c in v] for i, v in rows if i not in (3, 20)}
    want = {q: sorted(((sum(a * b for a, b in zip(x[q], x[i])), i) for i in x if i != q), key=lambda r: (-r[0], r[1])) for q in (0, 40)}
    assert max(s for s, _ in want[0]) > 2**53
    assert {q: [(r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in (0, 40)} == want
    assert {r.query_id for r in got} == {0, 40}


def test_top_k_beyond_doubles(spark):
    """Whole scores near 2**60 that a double can't tell apart, over many pages and shards, with ties."""
    rng = random.Random(4)
    drawn = [(rng.randint(-40, 40), rng.randint(-40, 40)) for _ in range(3000)]
    vectors = {i: [2**29 + a, 2**29 - a, 2**29 + b, 2**29 - b] for i, (a, b) in enumerate(drawn)}  # scores differ by less than 2**14
    vectors |= {3000 + i: vectors[7 * i] for i in range(60)}  # ties across shards
    scores = lambda q: sorted(((sum(a * b for a, b in zip(vectors[q], v)), i) for i, v in vectors.items() if i != q), key=lambda r: (-r[0], r[1]))[:20]
    asked = [i for i in vectors if i % 20 == 0]
    want = {q: scores(q) for q in asked}
    assert min(s for s, _ in want[0]) > 2**59 and len({float(s) for s, _ in want[0]}) < len({s for s, _ in want[0]})
    rows = [(i, [c / 64 for c in v]) for i, v in vectors.items()]
    got = {}
    for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=256, page=32).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.score, r.vec_id)
    assert {q: [x[n] for n in sorted(x)] for q, x in got.items()} == want


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS)).count() == 0
    assert topk.top_k(spark.createDataFrame([(20, [1.0], "")], VECTORS)).count() == 0


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
@settings(max_examples=200, deadline=None)
def test_packing_round_trip(values):
    for v in (values, sorted(values)):
        assert unpack(pack(np.array(v, np.int64))).tolist() == v
    h = np.array([v % 2**48 for v in values], np.uint64)
    assert from_low_bytes(low_bytes(h, 6), 6).tolist() == h.tolist()


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(9)
    texts = [b"".join(rng.choice([b"ab", b"\x00", "é".encode(), b"long" * 40, b"longer" * 60, b" ", b"\n", b"\t "]) for _ in range(rng.randint(0, 200))) for _ in range(40)]
    whole = substring.WordHasher().texts(texts)
    assert [len(w) for w in whole] == [len(t.split()) for t in texts]
    seen: dict[bytes, tuple] = {}
    for t, w in zip(texts, whole):
        for word, h in zip(t.split(), w.tolist()):
            assert seen.setdefault(word, tuple(h)) == tuple(h)
    assert len({h[0] for h in seen.values()}) == len({h[1] for h in seen.values()}) == len(seen)
    monkeypatch.setattr(substring.WordHasher, "part", 50)
    assert [w.tolist() for w in substring.WordHasher().texts(texts)] == [w.tolist() for w in whole]


def thue_morse(n):
    word = "ab"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def test_words_that_collide_in_plain_polynomials(spark):
    a = thue_morse(4096)
    b, rest = a.translate(str.maketrans("ab", "ba")), " ".join(f"r{i}" for i in range(12))
    docs = [(1, f"{a} {rest}"), (2, f"{b} {rest}"), (3, f"{b} {rest}")]
    assert sorted(tuple(r) for r in substring.remove_repeats(spark.createDataFrame(docs, DOC)).collect()) == sorted(brute.repeats(docs))
    assert brute.repeats(docs)[2][2] == 13


def test_repeated_word_patterns_collide_nowhere():
    """Windows that differ by swapped words at many places."""
    hasher, seen = substring.WordHasher(), {}
    for bits in range(1 << 13):
        h = hasher.texts([b" ".join(b"x" if bits >> i & 1 else b"y" for i in range(13))])[0]
        key = int(substring._rolled(np.ascontiguousarray(h[:, 0]), 13)[0]), int(substring._rolled(np.ascontiguousarray(h[:, 1]), 13, 1)[0])
        assert seen.setdefault(key, bits) == bits
    assert len({k[0] for k in seen}) == len({k[1] for k in seen}) == 1 << 13


def repeat_docs(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(13, 60))] for _ in range(6)]
    docs = []
    for i in range(120):
        text: list[str] = []
        for _ in range(rng.randint(0, 5)):
            text += [rng.choice(words) for _ in range(rng.randint(0, 30))] + (rng.choice(passages)[rng.randint(0, 9) :] if rng.random() < 0.6 else [])
        docs.append((i * 7 % 120, rng.choice([" ", "\n", "\t ", "  "]).join(text)))
    return [*docs, (500, docs[3][1]), (501, "a b c " * 30), (502, "x " + "a b c " * 9), (503, None), (504, ""), (505, "é\u00a0ü " * 14), (506, "é\u00a0ü " * 13)]


@pytest.mark.parametrize(("batch", "fan_out"), [(50, 64), (10**6, 2), (50, 1)])
def test_repeats_equal_brute_force(spark, batch, fan_out, monkeypatch):
    monkeypatch.setattr(substring, "FAN_OUT", fan_out)
    monkeypatch.setattr(substring, "BATCH_ENTRIES", batch)
    monkeypatch.setattr(substring, "AUTOMATON_WINDOWS", 16)
    docs = repeat_docs(4)
    df = spark.createDataFrame([(*r, 1, b"z") for r in docs], DOC + ", crc int, found binary").repartition(3)
    got = substring.remove_repeats(df, with_text=True)
    assert sorted(tuple(r)[:4] for r in got.collect()) == sorted(brute.repeats(docs))
    assert {r.doc_id: brute.sha(r.kept_text) for r in got.collect()} == {r[0]: r[3] for r in brute.repeats(docs)}


def test_repeats_without_order(spark):
    line = "w " * 20
    got = substring.remove_repeats(spark.createDataFrame([(None, line), (5, line), (5, "w " * 30), (3, "w " * 13), (3, "w " * 13)], DOC))
    assert sorted((str(r.doc_id), r.n_words, r.n_removed) for r in got.collect()) == [("3", 13, 0), ("3", 13, 0), ("5", 20, 20), ("5", 30, 30), ("None", 20, 0)]
    assert substring.remove_repeats(spark.createDataFrame([], DOC)).count() == 0


def plain_fingerprint(text):
    words = (text or "").translate(brute.LOWER)
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(docs, radius=4):
    fps = {d: plain_fingerprint(t) for d, t in docs}
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    ids = sorted(fps)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {(d, f"{fps[d]:016x}", root(d)) for d in fps}


@pytest.mark.parametrize(("max_shard", "blocks"), [(2048, None), (2, None), (2048, 7), (2048, 8)])
def test_simhash_equals_brute_force(spark, max_shard, blocks):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows += [(1000 + i, rows[i][1] + f" extra{i % 2}") for i in range(60)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a B")]
    df = spark.createDataFrame([(*r, "q") for r in rows], DOC + ", fp string")
    assert {tuple(r) for r in simhash.near_duplicates(df, max_shard=max_shard, blocks=blocks).collect()} == linked(rows)


def test_blocks_follow_the_number_of_nodes():
    assert [simhash.blocks_for(n, 4) for n in (0, 10**6, 10**8, 10**10, 10**12)] == [6, 6, 7, 8, 8]
    assert simhash.blocks_for(10**12, 1) > 1


def test_tables_go_once_nothing_reads_them(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    at = Path(shared_dir(spark))
    before = set(at.iterdir()) if at.exists() else set()
    found = components(links)
    assert len(set(at.iterdir()) - before) == 1
    assert found.where("component <> 0").count() == 0
    release(found)
    assert set(at.iterdir()) == before


def test_simhash_with_odd_rows(spark):
    df = spark.createDataFrame([(None, "x y"), (4, "x y"), (4, "x y"), (None, "only here")], DOC)
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(0, 2**64 - 1), st.integers(0, 20))
@settings(max_examples=150, deadline=None)
def test_bk_tree(values, q, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.insert(v)
    assert sorted(tree.within(q, radius)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= radius]


def test_near_copies_stay_once_and_clean_ones_stay(spark):
    rng = random.Random(2)
    text = lambda: [f"word{rng.randrange(3000)}" for _ in range(200)]
    docs = [(i, text()) for i in range(40)]
    copies = []
    for i in range(10):
        other = list(docs[i][1])
        other[rng.randrange(200)] = "changed"
        copies.append((100 + i, other))
    rows = [(d, " ".join(w)) for d, w in docs + copies] + [(200, None), (201, ""), (201, "")]
    kept = sorted(r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, DOC)).collect())
    assert kept == [*range(40), 200]


def test_short_near_copies_are_found(spark):
    """One word replaced at the end of texts of few words: shingle similarity (n - 5) / (n - 3), found whatever the length."""
    rng, rows, want = random.Random(4), [], []
    for n in (13, 15, 20, 27, 40):
        for _ in range(60):
            words = [f"w{rng.randrange(10**6)}" if rng.random() < 0.7 else f"longword{rng.randrange(10**6)}" for _ in range(n)]
            want.append(len(rows))
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join([*words[:-1], "changed"]))]
    lengths = {i: len(t.split()) for i, t in rows}
    hit = {n: 0 for n in lengths.values()}
    for r in simhash.near_copies(spark.createDataFrame(rows, DOC)).collect():
        hit[lengths[r.doc_id]] += r.doc_id % 2 and r.component_id == r.doc_id - 1
    assert all(hit[n] == 60 for n in (27, 40)), hit
    assert sum(hit.values()) >= 0.8 * len(want), hit


def test_near_copies_are_the_pairs_of_shingle_similarity(spark):
    """Copies with 1 to 9 words replaced, around the limit: components equal those of brute force, also in several parts."""
    rng, rows = random.Random(9), []
    for _ in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([30, 60, 120]))]
        for _ in range(5):
            other = list(words)
            for at in rng.sample(range(len(other)), rng.randrange(10)):
                other[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(other)))
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    up = {i: i for i in sets}
    for i in sets:
        for j in range(i - i % 5, i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = up[i], up[j]
                up = {k: min(a, b) if r in (a, b) else r for k, r in up.items()}
    assert len(set(up.values())) not in (40, 200)
    docs = spark.createDataFrame(rows, DOC)
    for options in ({}, {"max_docs": 2}):
        assert {r.doc_id: r.component_id for r in simhash.near_copies(docs, **options).collect()} == up


def test_stars_need_no_round_of_components(spark, monkeypatch):
    """Links that are stars already are written once; before, a whole round was spent to see that nothing changes."""
    from roadweave.llm import components as module

    written, own = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: written.append(1) or own(df))
    stars = [(i, 0) for i in range(1, 50)] + [(i, 100) for i in range(101, 120)]
    assert dict(map(tuple, components(spark.createDataFrame(stars, "u long, v long")).collect())) == {u: v for u, v in stars} | {0: 0, 100: 100}
    assert len(written) == 1
    chain = components(spark.createDataFrame([(i, i + 1) for i in range(30)], "u long, v long"))
    assert {r["component"] for r in chain.collect()} == {0} and chain.count() == 31


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(5, 5)]
    up = {}
    find = lambda a: a if up.setdefault(a, a) == a else find(up[a])
    for a, b in pairs:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = dict(map(tuple, components(spark.createDataFrame(pairs, "u long, v long")).collect()))
    assert got == {a: find(a) for a in up if a != 5 or any(5 in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([(None, 1)], "u long, v long").where(F.col("u").isNotNull())).count() == 0


def test_near_copies_come_from_fingerprints_too(spark):
    # a passage said often decides the fingerprint, but counts once in the set of shingles: no band is shared at a similarity of 0.4 but by chance
    said, rng = " ".join(f"word{i}" for i in range(40)), np.random.default_rng(3)
    rows = [(i, " ".join([said] * 200 + [f"own{v}" for v in rng.integers(0, 10**9, 20)])) for i in range(6)] + [(9, "quite another text of some words that nobody else has")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.component_id for r in simhash.near_duplicates(docs).where("doc_id < 9").collect()} == {0}
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs, similarity=0.4).collect()}
    assert got == {**dict.fromkeys(range(6), 0), 9: 9}
    assert {r.doc_id for r in simhash.drop_near_duplicates(docs, similarity=0.4).collect()} == {0, 9}
    assert simhash.drop_near_duplicates(docs, similarity=0.9).count() == 7  # the exact check decides
