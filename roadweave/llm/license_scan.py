"""Operator 8: licence scans by an exact set-similarity join against notice templates.

Base: every place where a fixed phrase's words stand consecutively. Method: a window of at most
``max_ratio`` x ``|T|`` consecutive words, anywhere in the text and across line breaks, meets a
template T when it holds at least ``threshold`` of the template's distinct tokens. Tokens are ordered
by their frequency in the whole corpus, rarest first, and exact filters leave few texts to verify:

* prefix: a match must hold one of the template's first ``|T| - need + 1`` tokens;
* length: it must hold ``need`` known tokens at least;
* positional: from the first shared token on, both sides must still have ``need`` tokens.

The windows of a template are then slid over the places of its tokens, each place once.

The templates are a fixed small list, so they go to every task; documents are streamed without a
shuffle. The frequency pass returns one count for each template token, not for each corpus word.

Defined cases: null and empty texts have no words, counts 0, null positions, empty labels and
score 0; repeated rows answer alike; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import ASCII_LOWER, alnum_words

# Base phrases and notice templates, with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "You may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Licensed under a Creative Commons Attribution-NonCommercial International License"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Licensed under a Creative Commons Attribution-ShareAlike International License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]


def words_of(text: str | None) -> list[str]:
    return alnum_words((text or "").translate(ASCII_LOWER))


#: What ``words_of`` makes of a byte of UTF-8: a letter or digit in lower case, a space between words, or beyond ASCII the byte itself.
_WORD_BYTES = bytes(ord(words_of(chr(b))[0]) if words_of(chr(b)) else ord(" ") for b in range(128)) + bytes(range(128, 256))


def byte_words(text: bytes | None) -> list[bytes]:
    """``words_of`` for UTF-8, without a pattern: each byte is looked up and the text is split at spaces."""
    return (text or b"").translate(_WORD_BYTES).split()


def token_counts(docs: DataFrame, vocabulary: set[str], text_col: str) -> dict[str, int]:
    """Occurrences in the whole corpus of each template token; the result is as large as the vocabulary."""

    known = frozenset(t.encode() for t in vocabulary)

    def counted(batches):
        total: Counter = Counter()
        for b in batches:
            for t in b.column(0).cast(pa.binary()).to_pylist():
                total.update(filter(known.__contains__, byte_words(t)))
        yield pa.RecordBatch.from_arrays([pa.array([t.decode() for t in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["token", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return dict.fromkeys(vocabulary, 0) | {r["token"]: r["n"] for r in got.collect()}


class TemplateIndex:
    """Inverted prefix index of the templates under one global token order."""

    def __init__(self, counts: dict[str, int], templates, threshold: float, max_ratio: float):
        self.rank = {t: i for i, t in enumerate(sorted(counts, key=lambda t: (counts[t], t)))}
        self.templates, self.prefix = [], {}
        for k, (label, text) in enumerate(templates):
            tokens = sorted(set(words_of(text)), key=self.rank.__getitem__)
            need = math.ceil(threshold * len(tokens) - 1e-9)
            self.templates.append((label, frozenset(tokens), len(tokens), need, max_ratio * len(tokens)))
            for i, t in enumerate(tokens[: len(tokens) - need + 1]):
                self.prefix.setdefault(t, []).append((k, i))

    def candidates(self, words: list[str]) -> list[tuple[int, float]]:
        """(template, share of its tokens) of those that hold enough tokens anywhere in the words."""
        known = sorted({w for w in words if w in self.rank}, key=self.rank.__getitem__)
        tried, out = set(), []
        for j, token in enumerate(known):
            for k, i in self.prefix.get(token, ()):
                if k in tried:
                    continue
                tried.add(k)  # this is the first shared token: both sides are in one order
                _, tokens, size, need, _ = self.templates[k]
                if len(known) < need or min(size - i, len(known) - j) < need:
                    continue
                share = sum(w in tokens for w in known) / size
                if share * size >= need - 1e-9:
                    out.append((k, share))
        return out

    def scan(self, words: list[str], found: dict[str, float]) -> None:
        """Every window of the words."""
        for k, share in self.candidates(words):
            label, _, size, need, most = self.templates[k]
            best = share if len(words) <= most else self._best_window(k, words) / size
            if best * size >= need - 1e-9:
                found[label] = max(found.get(label, 0.0), best)

    def _best_window(self, k: int, words: list[str]) -> int:
        """Most distinct tokens of the template that one of its windows holds."""
        _, tokens, size, _, most = self.templates[k]
        places = [i for i, w in enumerate(words) if w in tokens]
        inside: Counter = Counter()
        best = first = distinct = 0
        for i in places:
            distinct += not inside[words[i]]
            inside[words[i]] += 1
            while i - places[first] >= most:
                gone = words[places[first]]
                inside[gone] -= 1
                distinct -= not inside[gone]
                first += 1
            best = max(best, distinct)
            if best == size:
                break
        return best


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES,
                  threshold: float = 0.9, max_ratio: float = 4.0) -> DataFrame:
    """One row per document: n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is the best containment met (1 for a base phrase, 0 when nothing was found).
    """
    vocabulary = {w for _, t in templates for w in words_of(t)}
    index = TemplateIndex(token_counts(docs, vocabulary, text_col), templates, threshold, max_ratio)
    kind = docs.schema[id_col].dataType.simpleString()
    prefix = frozenset(t.encode() for t in index.prefix)
    wanted = [(f" {phrase} ".encode(), label) for phrase, label in phrases.items()]

    def scanned(batches):
        for b in batches:
            rows = []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                words = byte_words(text)
                joined = b" %b " % b" ".join(words)
                places, base = [], set()
                for phrase, label in wanted:
                    at, last, place = joined.find(phrase), 0, 0
                    while at >= 0:
                        place, last = place + joined.count(b" ", last, at), at  # each byte is counted once
                        places.append(place)
                        base.add(label)
                        at = joined.find(phrase, at + 1)
                found: dict[str, float] = dict.fromkeys(base, 1.0)
                if not prefix.isdisjoint(words):
                    index.scan([w.decode() for w in words], found)
                rows.append((len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(found)), max(found.values(), default=0.0)))
            n, p, lo, hi, base_labels, labels, score = zip(*rows) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(x, pa.int64()) for x in (n, p, lo, hi)), pa.array(base_labels, pa.string()), pa.array(labels, pa.string()), pa.array(score, pa.float64())],
                names=["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
            )

    return (
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .mapInArrow(scanned, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
        .withColumnRenamed("id", id_col)
    )
