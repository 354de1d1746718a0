"""Plain brute-force versions of the contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_secrets(text):
    text = text or ""
    spans = []
    for m in re.finditer(r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[1]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def base_secret_row(text):
    spans = base_secrets(text)
    n = [sum(s[1] == k for s in spans) for k in range(3)]
    return (*n, sha(",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)))


def contamination(docs, items, window=10):
    """docs, items: lists of (id, text). Rows (id, n_words, n_hit, n_items, sha, contaminated)."""
    wins = {}
    for item, text in items:
        w = alnum(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            wins.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (got := wins.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    found |= got
        out.append((doc, len(w), len(hit), len(found), sha(",".join(sorted(str(i) for i in found if i is not None))), bool(hit)))
    return out


def repeats(docs, window=13):
    """docs: (id, text), ids not null and distinct. Rows (id, n_words, n_removed, sha)."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in docs}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, d), d)
    out = []
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out
