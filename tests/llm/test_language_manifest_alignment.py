from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from roadweave.llm import alignment, language, manifest
from roadweave.llm.oracles import ORACLE

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FILES = {"vocabulary_a": public_tokenizers.path("byte_bpe_50k.json"), "model_b": public_tokenizers.path("piece_bpe_32k.model")}


def same_rows(got, expected):
    mark = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((v is not None, v) for v in r))
    assert mark(got) == mark(expected)


# Manifest


def h(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row)


def tree_of(nodes, fan):
    """(root, levels) of digests in order."""
    levels = []
    while len(nodes) > 1:
        levels.append(nodes)
        nodes = [h(nodes[i : i + fan]) for i in range(0, len(nodes), fan)]
    return nodes[0], levels


def plain_manifest(rows, fan=16):
    """rows: (doc_id, text, lang, source, n_chars)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    by_source = defaultdict(list)
    for d, t, la, s, n in rows:
        leaf = leaf_of((d, s, la, n, t))
        touched = d is not None and t is not None and zlib.crc32(str(d).encode()) % 5 == 0
        by_source[s].append((d, leaf, leaf_of((d, s, la, n, t.translate(lower))) if touched else leaf))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree_of([r[1] for r in by_source[s]], fan) for s in sources}
    root, upper = tree_of([trees[s][0] for s in sources], fan) if sources else ("", [])
    out = []
    for at, s in enumerate(sources):
        for i, (d, leaf, tampered) in enumerate(by_source[s]):
            siblings, node = [], tampered
            for place, levels in ((i, trees[s][1]), (at, upper)):
                for level in levels:
                    lo = place // fan * fan
                    run = level[lo : lo + fan]
                    siblings += run[: place - lo] + run[place - lo + 1 :]
                    node = h(run[: place - lo] + [node] + run[place - lo + 1 :])
                    place //= fan
            out.append((d, leaf, trees[s][0], root, h(siblings), node, node == root))
    return out


def many(n, sources, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"Text {i} é {'X' * (i % 7)}", "en", rng.choice(sources), i % 50) for i in range(n)]
    return rows + [(None, "No Id", None, sources[0], None), (7, None, None, None, None), (8, "", "", "", 0), (8, "", "", "", 0), (9, "Ä" * 5000, "de", "alone", 1)]


@pytest.mark.parametrize(("n", "fan", "sources"), [(0, 16, ["a"]), (600, 16, ["big"] * 6 + ["b", "c", "ü", "zz"]), (400, 3, [f"s{i % 9 * (i % 4)}" for i in range(20)]), (40, 2, ["one"])])
def test_manifest_equals_plain_trees(spark, n, fan, sources):
    rows = many(n, sources) if n else []
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit("x")).repartition(5)
    same_rows(manifest.manifest(docs, fan=fan).collect(), plain_manifest(rows, fan))


def test_manifest_of_one_source_and_one_row(spark):
    for rows in ([(5, "Only", "en", "s", 4)], [(i, "T", "en", "s", 1) for i in range(40)], [(None, None, None, None, None)]):
        same_rows(manifest.manifest(spark.createDataFrame(rows, DOCS)).collect(), plain_manifest(rows))


@pytest.mark.parametrize(("fan", "levels"), [(2, 1), (2, 3), (3, 2), (16, 1), (16, 3)])
def test_manifest_by_supersteps_of_any_height(spark, fan, levels):
    """Blocks of one to three levels of runs, some with their last run or block not full; null keys, ids and rows that come again many times."""
    rows = many(300, ["big"] * 8 + ["b", "c"]) + [(11, "Again", "en", "big", 5)] * 40 + [(None, "Again", "en", None, 5)] * 20
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    same_rows(manifest.manifest(docs, fan=fan, levels=levels).collect(), plain_manifest(rows, fan))


def test_manifest_lowers_ascii_letters_only(spark):
    texts = [None, "", " ", "ABC xyz 09 []{}@`", "ÄÖÜ A", "é Z", "K Å İ I", "ΑΣ Σ", "DŽ Ⅷ Ⓐ Q", "😀 B", "\x00A\x7fZ", "中文 C", "A" * 3000, "É" + "A" * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(manifest.lowered("t")).collect()]
    assert got == [t and t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for t in texts]
    plan = df.select(manifest.lowered("t").alias("low"))._jdf.queryExecution().optimizedPlan().toString()
    assert "lower(t" in plan and "translate(t" in plan


def test_manifest_sorts_in_ranges_and_leaves_the_session_as_it_was(spark):
    key, rows = "spark.sql.execution.rangeExchange.sampleSizePerPartition", [(None if i % 9 == 0 else i % 50, None if i % 7 == 0 else bytes([i % 5 * 60]), bytes([i % 200])) for i in range(2000)]
    leaves = spark.createDataFrame(rows, "id long, source binary, leaf binary").withColumn("tampered", F.lit(None).cast("binary"))
    for before in (None, "50"):
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
        ordered = manifest._ordered(leaves.repartition(3), 4)
        assert spark.conf.get(key, None) == before
        parts = [p for p in ordered.map(lambda r: (r[0], r[1], r[2])).glom().collect() if p]
        by = lambda r: ((r[1] is not None, r[1] or b""), (r[0] is not None, r[0] or 0), r[2])
        assert len(parts) == 4 and [r for p in parts for r in p] == sorted(rows, key=by)
    spark.conf.unset(key)


def test_manifest_sends_one_path_for_each_block(spark):
    """Not for each run; and a superstep further up has fewer partitions, as it has fewer nodes."""
    n, fan, span = 1000, 2, 8
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    blocks = spark.sparkContext.parallelize([((0, p), (n, leaves[p * span : p * span + span])) for p in range(-(-n // span))]).partitionBy(16)
    tree = manifest.Tree(blocks, manifest._depth(n, span), fan, span, 16)
    assert [x.getNumPartitions() for x in tree.levels] == tree.parts == [16, 4, 1, 1]
    ((_, (_, root)),) = tree.tops().collect()
    assert root.hex() == tree_of([x.hex() for x in leaves], fan)[0]
    paths = dict(tree.down(tree.tops().mapValues(lambda top: (top[0], ((), top[1], top[1])))).collect())
    assert sorted(paths) == [(0, p) for p in range(-(-n // span))]
    assert {len(steps) for steps, _, _ in paths.values()} == {7}  # ten levels of runs, three of them in the block itself
    for place in (0, 7, 124):
        found = list(manifest._verified(n, [(i, x, None) for i, x in enumerate(leaves[place * span : place * span + span])], paths[0, place], fan, span))
        assert all(r[5] == root.hex() and r[6] for r in found)


def test_manifest_equals_its_sql_and_finds_tampering(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    expected = con.sql(ORACLE["op12_merkle_manifest"]).fetchall()
    got = manifest.manifest(spark.read.parquet(f"{DATA}/documents.parquet")).collect()
    same_rows(got, expected)
    touched = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert touched and not any(r.verified for r in touched) and all(r.verified for r in got if r not in touched)


# Alignment


def whole_alignment(rows):
    """Both tokenizers over whole texts."""
    pair = alignment.Pair(**FILES)
    docs, counts = [], Counter()
    for d, t in rows:
        aligned = None
        if t:
            a, b = pair.a.encode(" " + t, add_special_tokens=False).ids, pair.b.encode(t)
            raw = (" " + t).encode()
            if b"".join(pair.bytes_a[i] for i in a) == raw == b"".join(pair.bytes_b[i] for i in b):
                ends_a, ends_b = (np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
                at_a, at_b = {e: i for i, e in enumerate(ends_a)}, {e: i for i, e in enumerate(ends_b)}
                common = sorted(set(at_a) & set(at_b))
                groups, i, j = [], 0, 0
                for e in common:
                    groups.append(",".join(map(str, a[i : at_a[e] + 1])) + "|" + ",".join(map(str, b[j : at_b[e] + 1])))
                    i, j = at_a[e] + 1, at_b[e] + 1
                links = [(a[at_a[e]], b[at_b[e]]) for e in common]
                aligned = (a, b, groups, links)
                counts.update(links)
        docs.append((d, aligned))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    for d, x in docs:
        if x is None:
            yield d, 0, 0, 0, 0, 0, 0, ""
        else:
            a, b, groups, links = x
            yield d, len(a), len(b), len(groups), len(links), sum(counts[k] == top[k[1]] for k in links), sum(counts[k] for k in links), h([";".join(groups)])


ODD_TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "a   b  ", "\n", "a\n b", "a \n b", "x▁y", "▁", "plain x▁ words the of", "<s> </s> <unk> <0x0A> <|endoftext|>", "don't we'll I'm", "\x00 \x01 a", "﻿ a ​ b​ c",
    "᠎ x᠎ y", "a  b   c  d  e", "\x1c a\x1d b\x85 c", "é ́ é ﬁ ２ Ⅷ", "日本 語 テキスト", "🙂 🙃🙂  👩‍👩‍👧", "the of the of the", "1 22 333  4,444.5", "x" * 3000, " " * 700 + "y" + " " * 300, "tab\tand\rreturn \r\n mixed", "a" + " \t" * 5 + "b", "¨ x¨ y",
]


@pytest.mark.parametrize(("block_chars", "max_sent"), [(16_000_000, 4_000_000), (500, 10)])
def test_alignment_equals_whole_texts(spark, block_chars, max_sent):
    rng = random.Random(5)
    alphabet = ["the", "of", " ", "  ", "\n", ".", "é", "▁", "ing", "Q", "7", "\t", "日", "'s", " ", "​", "-", "wor"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))).replace("▁", "▁" if rng.random() < 0.2 else "x") for _ in range(120)]
    rows = list(enumerate(ODD_TEXTS + made)) + [(None, "no id"), (3, "again the of"), (3, "again the of")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").union(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(60)).withColumn("seg", F.lit(1)).withColumn("block", F.lit(2))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same_rows(alignment.align_tokenizers(docs, **FILES, block_chars=block_chars, max_sent=max_sent).collect(), whole_alignment(rows))


def test_alignment_of_empty_and_tokenless_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.align_tokenizers(none, **FILES).collect() == []
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "▁")], "doc_id long, text string")
    same_rows(alignment.align_tokenizers(docs, **FILES).collect(), [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2, 3)])


def test_cuts_are_verified_from_the_vocabularies():
    pair = alignment.Pair(**FILES)
    assert pair.cuttable
    pieces = [pair.b.id_to_piece(i) for i in range(pair.b.get_piece_size())]
    assert pair._pieces_open_with_space(pieces) and not pair._pieces_open_with_space([*pieces, "a▁b"])
    assert alignment.segments("a b  c\n d ") == ["a", "b", " c\n d "]
    assert alignment.segments("a b", cuttable=False) == ["a b"]


# Language


WORDS = {"aa": "the of and ing tion with", "bb": "der und ein sch nicht über", "cc": "le des qui eau été où", "dd": "эта или который не что"}


def texts_of(lang, n, rng, words=40):
    return [" ".join(rng.choice(WORDS[lang].split()) + rng.choice(WORDS[lang].split()) for _ in range(rng.randint(3, words))) for _ in range(n)]


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    model = language.ByteCNN(["a", "b", "c"], window=12, filters=3, embedding=4)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, y = rng.integers(0, 257, (7, model.length)), rng.integers(0, 3, 7)
    _, g = model.gradients(x, y)
    for name, w in model.weights.items():
        for at in [tuple(rng.integers(0, s) for s in w.shape) for _ in range(12)]:
            if name == "E" and at[0] == language.PAD:
                continue
            keep, eps = w[at], 1e-6
            w[at] = keep + eps
            up, _ = model.gradients(x, y)
            w[at] = keep - eps
            down, _ = model.gradients(x, y)
            w[at] = keep
            assert abs((up - down) / (2 * eps) - g[name][at]) < 1e-5


def test_windows_cover_whole_texts():
    texts = ["", "a", "x" * 64, "é" * 40, "word " * 1000]
    model = language.ByteCNN(["a", "b"])
    flat, starts, sizes = language._as_bytes(pa.array(texts))
    windows, text, own = language.windows_of(flat, starts, sizes, model.window, model.length, 10**6)
    for i, t in enumerate(texts):
        mine, raw = windows[text == i], t.encode()
        assert b"".join(bytes(w[:n].astype(np.uint8)) for w, n in zip(mine, own[text == i])) == raw
        for k, w in enumerate(mine):
            part = raw[k * 64 : k * 64 + model.length]
            assert bytes(w[: len(part)].astype(np.uint8)) == part and (w[len(part) :] == language.PAD).all()


def test_long_texts_are_scored_in_parts():
    model = language.ByteCNN(["a", "b", "c"])
    text = "abc def ghi. " * 200_000
    flat, starts, sizes = language._as_bytes(pa.array([text]))
    windows, _, own = language.windows_of(flat, starts, sizes, model.window, model.length, 10**9)
    whole = (model.probabilities(windows) * own[:, None]).sum(0) / own.sum()
    for texts in ([text], ["x y", text, None, "z"]):
        langs, score = language.predict(pa.array(texts, pa.string()), model)
        i = texts.index(text)
        assert langs[i] == model.languages[int(whole.argmax())] and abs(score[i] - whole.max()) < 1e-5


def test_languages_are_learned_and_cases_defined(spark):
    rng = random.Random(2)
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang in WORDS for t in texts_of(lang, 120, rng))]
    rows += [(10_000 + i, rows[0][1], "aa") for i in range(300)] + [(20_000, None, "aa"), (20_001, "", "bb"), (20_002, "12 34 !?", "cc"), (None, "the of and", None), (20_003, "und nicht der", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(0)).repartition(3)
    model = language.fit(docs)
    assert model.languages == sorted(WORDS)
    got = language.identify(docs, model).collect()
    assert len(got) == len(rows)
    truth = {d: lang for d, _, lang in rows}
    held = [r for r in got if r.held_out and r.doc_id < 10_000]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in (20_000, 20_001, 20_002)) and by_id[20_003].lang_pred == "bb"
    assert language.identify(docs.limit(0), model).collect() == []


def test_without_languages_to_learn(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, "other", None)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.identify(docs, language.fit(docs)).collect()} == {("und", 0.0)}
    one = spark.createDataFrame([(i, "some text", "xx") for i in range(9)] + [(99, "1 2", "xx")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(one, language.fit(one)).collect()}
    assert got[99] == ("und", 0.0) and got[0] == ("xx", 1.0)


def test_held_out_languages_of_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 100").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
