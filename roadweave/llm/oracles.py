"""DuckDB SQL for those queries of this subpackage that SQL can express, written from their definitions."""

from __future__ import annotations

from roadweave.llm.url_filter import RULES

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SPACE = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

TOP_K = """WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

REPEATS = f"""WITH d AS (SELECT doc_id, {SPACE} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
first AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN first USING (k) WHERE doc_id > least),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t FROM words ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)"""

CONTAMINATION = f"""WITH i AS (SELECT item_id, {ALNUM} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, z, array_to_string(w[i:i + z - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS z, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM i WHERE len(w) > 0)),
d AS (SELECT doc_id, {ALNUM} AS w FROM documents),
dw AS (SELECT doc_id, i, z, array_to_string(w[i:i + z - 1], ' ') AS k FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT z FROM iw))),
hit AS (SELECT doc_id, i, z, item_id FROM dw JOIN iw USING (k, z)),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + z)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _url_sql(depth: int = 3, most: int = 20, z: float = 1.96, strength: float = 4.0, purity: float = 0.5) -> str:
    fit = {r: f"(host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}')" for r in sorted(RULES, key=lambda r: (-len(r), r))}
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for r, c in fit.items()) + " END"
    known = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in RULES.items()) + " END"
    s = [f"s{i}" for i in range(1, depth + 1)]
    parts = [
        "u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages)",
        "h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u)",
        f"r AS (SELECT *, {rule} AS rule FROM h)",
        f"k AS (SELECT *, {known} AS known, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '*' ELSE x END) AS g FROM r)",
        f"t AS (SELECT page_id, host, path, rule, known, {', '.join(f'''coalesce(g[{i}], '') AS s{i}''' for i in range(1, depth))}, coalesce(array_to_string(g[{depth}:], '/'), '') AS s{depth} FROM k)",
        f"l0 AS (SELECT host, {', '.join(s)}, {', '.join(f'{c} AS g{c}' for c in s)}, count(*) FILTER (known = 'allow') AS a, count(known) AS n FROM t GROUP BY host, {', '.join(s)})",
    ]
    for i in range(1, depth + 1):
        parent = ", ".join(["host", *(f"gs{j}" for j in range(1, i))])
        parts.append(f"k{i} AS (SELECT {parent}, count(DISTINCT gs{i}) AS kids FROM l{i - 1} GROUP BY {parent})")
        parts.append(f"l{i} AS (SELECT l.* REPLACE (CASE WHEN kids > {most} AND gs{i} <> '' THEN '*' ELSE gs{i} END AS gs{i}) FROM (SELECT l{i - 1}.*, kids FROM l{i - 1} JOIN k{i} USING ({parent})) l)")
        parts[-1] = parts[-1].replace("l.* REPLACE", "l.* EXCLUDE (kids) REPLACE")
    parts.append(f"o0 AS (SELECT l.*, (sum(a) OVER () + 1.0) / (sum(n) OVER () + 2.0) AS up, sum(a) OVER () AS up_a, sum(n) OVER () AS up_n FROM l{depth} l)")
    for i in range(depth + 1):
        at = ", ".join(["host", *(f"gs{j}" for j in range(1, i + 1))])
        parts.append(f"n{i} AS (SELECT *, sum(a) OVER (PARTITION BY {at}) AS na, sum(n) OVER (PARTITION BY {at}) AS nn FROM o{i})")
        parts.append(f"p{i} AS (SELECT *, CASE WHEN nn = 0 OR up_n = 0 THEN false ELSE abs(na / nn - up_a / up_n) > {z} * sqrt(up_a / up_n * (1 - up_a / up_n) / nn) END AS apart FROM n{i})")
        parts.append(f"o{i + 1} AS (SELECT * EXCLUDE (na, nn, apart) REPLACE (CASE WHEN apart THEN (na + {strength} * up) / (nn + {strength}) ELSE up END AS up, CASE WHEN apart THEN na ELSE up_a END AS up_a, CASE WHEN apart THEN nn ELSE up_n END AS up_n) FROM p{i})")
    cte = ",\n".join(parts)
    return f"WITH {cte}\nSELECT page_id, t.host, path, rule, coalesce(known, CASE WHEN up < {purity} THEN 'block' ELSE 'allow' END) AS verdict FROM t JOIN o{depth + 1} o ON o.host = t.host AND {' AND '.join(f'o.{c} = t.{c}' for c in s)}"


def _manifest_sql(levels: int = 6, source_levels: int = 5, fan: int = 16) -> str:
    """Enough levels for fan ** levels rows of a source and fan ** source_levels sources; further ones change nothing."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: f"sha256({' || '.join([*(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars')), field(text)])})"
    crc = (
        "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), "
        "lambda acc, c: list_reduce([xor(acc, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384 ELSE 0 END))))"
    )
    parts = [
        f"l AS (SELECT doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS tampered FROM documents)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l)",
        "n0 AS (SELECT tree, i, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM a0)",
    ]

    def climb(k: int, nodes: str, runs: str, above: str) -> None:
        parts.append(f"{runs} AS (SELECT tree, i // {fan} AS i, list(d ORDER BY i) AS r, max(n) AS n FROM {nodes} GROUP BY tree, i // {fan})")
        parts.append(f"{above} AS (SELECT tree, i, CASE WHEN n = 1 THEN r[1] ELSE sha256(array_to_string(r, '')) END AS d, CAST(ceil(n / {fan}) AS BIGINT) AS n FROM {runs})")

    for k in range(levels):
        climb(k, f"n{k}", f"r{k}", f"n{k + 1}")
    parts.append(f"u0 AS (SELECT 0 AS tree, tree AS i, d, count(*) OVER () AS n FROM n{levels})")
    for k in range(source_levels):
        climb(k, f"u{k}", f"v{k}", f"u{k + 1}")
    parts.append("b0 AS (SELECT *, tampered AS f, '' AS proof FROM a0)")
    steps = [(f"r{k}", "r.tree = b.tree", "b.i", fan**k) for k in range(levels)] + [(f"v{k}", "true", "b.tree", fan**k) for k in range(source_levels)]
    for j, (runs, same, at, under) in enumerate(steps):
        slot = f"({at} // {under}) % {fan}"
        before, after = f"array_to_string(r.r[1:{slot}], '')", f"array_to_string(r.r[{slot} + 2:], '')"
        parts.append(
            f"b{j + 1} AS (SELECT b.* REPLACE (CASE WHEN r.n = 1 THEN b.f ELSE sha256({before} || b.f || {after}) END AS f, CASE WHEN r.n = 1 THEN b.proof ELSE b.proof || {before} || {after} END AS proof) "
            f"FROM b{j} b JOIN {runs} r ON {same} AND r.i = {at} // {under * fan})"
        )
    cte = ",\n".join(parts)
    return (
        f"WITH {cte}\nSELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.d AS verified "
        f"FROM b{len(steps)} b JOIN n{levels} s ON s.tree = b.tree CROSS JOIN u{source_levels} t"
    )


ORACLE = {
    "op1_exact_topk": TOP_K, "op2_substring_dedup": REPEATS, "op3_url_filters": _url_sql(), "op7_benchmark_decontamination": CONTAMINATION, "op12_merkle_manifest": _manifest_sql(),
}
