"""Operator 3: URL filters by a path-template tree, DataFrame functions only.

Rules decide the urls that they fit; those urls also are the labelled examples of the method:

1. Each path becomes a template: a segment with digits is variable, and so is a level that has more
   than ``max_children`` different values below one parent; variable segments turn into ``*``.
2. Templates hang in a tree (host, then one level per segment up to ``depth``; deeper segments fold
   into one). A branch whose share of allowed examples does not differ from that of its parent
   (two-proportion z-test below ``z``) is merged into it and takes the parent's purity.
3. Purity is smoothed toward the parent's with ``strength`` pseudo-examples; a template whose
   purity is below ``purity`` is rejected.

Everything but the last join works on templates counted before the shuffle, so a host that holds a
third of all urls stays a few counted rows. That last join brings the verdict back to the urls by
an ordinary shuffled join, whose large partitions adaptive execution splits.

Defined cases: a null url or one without ``://`` has an empty host and path and no rule, and is judged
as its own template; empty tables give no rows; repeated rows answer alike; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.llm.common import ascii_lower, cut

# Host and path prefix, with the verdict.
RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.locate("://", url) > 0
    rest = F.when(found, F.expr("substring(__url, locate('://', __url) + 3)"))
    host = ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule = verdict = None
    for r in sorted(rules, key=lambda r: (-len(r), r)):
        name, slash, prefix = r.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(slash + prefix)
        rule = F.when(fits, r) if rule is None else rule.when(fits, r)
        verdict = F.when(fits, rules[r]) if verdict is None else verdict.when(fits, rules[r])
    return (F.lit(None).cast("string") if rule is None else rule), (F.lit(None).cast("string") if verdict is None else verdict)


def _keys(depth: int) -> list[str]:
    return ["host", *(f"s{i}" for i in range(1, depth + 1))]


def with_templates(urls: DataFrame, depth: int) -> DataFrame:
    """Adds s1..sdepth: segments with digits are ``*`` already, absent ones are empty."""
    segments = F.filter(F.split("path", "/"), lambda x: x != "")
    general = F.transform(segments, lambda x: F.when(x.rlike("[0-9]"), "*").otherwise(x))
    out = urls.withColumn("__s", general)
    for i in range(1, depth):
        out = out.withColumn(f"s{i}", F.coalesce(F.get("__s", F.lit(i - 1)), F.lit("")))
    tail = F.concat_ws("/", F.slice("__s", F.lit(depth), F.greatest(F.size("__s"), F.lit(1))))
    return out.withColumn(f"s{depth}", tail).drop("__s")


def template_verdicts(urls: DataFrame, *, depth: int, max_children: int, z: float, strength: float, purity: float) -> DataFrame:
    """One row per raw template (host, s1..): its verdict. ``urls`` has host, s1.. and known (allow, block or null)."""
    keys = _keys(depth)
    leaf = urls.groupBy(*keys).agg(
        F.sum((F.col("known") == "allow").cast("long")).alias("a"), F.count("known").alias("n")
    ).select(*keys, F.coalesce("a", F.lit(0)).alias("a"), "n", *(F.col(k).alias(f"g_{k}") for k in keys))
    for i in range(1, depth + 1):  # wildcards level by level, as the children of a merged parent are counted together
        parent = ["g_host", *(f"g_s{j}" for j in range(1, i))]
        kids = leaf.groupBy(*parent).agg(F.countDistinct(f"g_s{i}").alias("kids")).where(F.col("kids") > max_children)
        leaf = leaf.join(kids, parent, "left").withColumn(f"g_s{i}", F.when(F.col("kids").isNotNull() & (F.col(f"g_s{i}") != ""), "*").otherwise(F.col(f"g_s{i}"))).drop("kids")
    leaf = cut(leaf)  # read once for each level below
    total = leaf.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()  # two numbers
    up_a, up_n = (F.lit(total[c]).cast("long") for c in ("a", "n"))
    out = leaf.withColumns({"up_a": up_a, "up_n": up_n, "up": (up_a + 1.0) / (up_n + 2.0)})
    for i in range(depth + 1):
        at = ["g_host", *(f"g_s{j}" for j in range(1, i + 1))]
        node = leaf.groupBy(*at).agg(F.sum("a").alias("node_a"), F.sum("n").alias("node_n"))
        pooled = F.col("up_a") / F.col("up_n")
        spread = F.sqrt(pooled * (1 - pooled) / F.col("node_n"))
        apart = F.when((F.col("node_n") == 0) | (F.col("up_n") == 0), F.lit(False)).otherwise(F.abs(F.col("node_a") / F.col("node_n") - pooled) > z * spread)
        own = (F.col("node_a") + strength * F.col("up")) / (F.col("node_n") + strength)
        out = out.join(node, at).withColumn("apart", apart).select(
            *keys, *(f"g_{k}" for k in keys),
            F.when(F.col("apart"), own).otherwise(F.col("up")).alias("up"),
            F.when(F.col("apart"), F.col("node_a")).otherwise(F.col("up_a")).alias("up_a"),
            F.when(F.col("apart"), F.col("node_n")).otherwise(F.col("up_n")).alias("up_n"),
        )
    return out.select(*keys, F.when(F.col("up") < purity, "block").otherwise("allow").alias("judged"), F.col("up").alias("purity"))


def filter_urls(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", rules: dict[str, str] = RULES, depth: int = 3,
                max_children: int = 20, z: float = 1.96, strength: float = 4.0, purity: float = 0.5) -> DataFrame:
    """One row per url: id, host, path, rule, verdict, purity (of its template)."""
    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"))
    host, path = host_and_path(F.col("__url"))
    rule, known = rule_of(F.col("host"), F.col("path"), rules)
    urls = with_templates(base.select("id", host.alias("host"), path.alias("path")).withColumn("rule", rule).withColumn("known", known), depth)
    verdicts = template_verdicts(urls, depth=depth, max_children=max_children, z=z, strength=strength, purity=purity)
    return urls.join(verdicts, _keys(depth), "left").select(
        F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("known", "judged").alias("verdict"), "purity"
    )
