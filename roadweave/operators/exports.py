"""Plain and tensor-like forms of nested graphs (columns nodes, edges as arrays of structs)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadweave.functions.scalars import safe_float
from roadweave.functions.vocabulary import EXPORT_EDGE_FEATURES, EXPORT_NODE_WIDTH
from roadweave.operators.graphs import build_edges, build_nodes

# Names under which an edge may give its ends, first match first.
SOURCE_NAMES = ["src_node", "source", "src", "from", "u", "sender", "src_id", "src_node_id", "src_track_id"]
TARGET_NAMES = ["dst_node", "target", "dst", "to", "v", "receiver", "dst_id", "dst_node_id", "dst_track_id"]


def _fields(df: DataFrame, column: str) -> list[str]:
    kind = df.schema[column].dataType
    return kind.elementType.fieldNames() if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else []


def _first_of(e: Column, have: list[str], names: list[str]) -> Column:
    found = [e[n].cast("int") for n in names if n in have]
    return F.coalesce(*found) if found else F.lit(None).cast("int")


def _features(node: Column, have: list[str]) -> Column:
    return F.slice(F.coalesce(node["features"], F.array().cast("array<double>")), 1, EXPORT_NODE_WIDTH) if "features" in have else F.array().cast("array<double>")


def plain_export(graphs: DataFrame) -> DataFrame:
    """Adds num_nodes, track_ids, x (12 wide), edge_index and edge_attr of the first valid edge only (twelve channels in export order, null as 0)."""
    nodes, edges = _fields(graphs, "nodes"), _fields(graphs, "edges")

    def one(e: Column) -> Column:
        attr = [F.coalesce(e[c].cast("double"), F.lit(0.0)) if c in edges else F.lit(0.0) for c in EXPORT_EDGE_FEATURES]
        return F.struct(_first_of(e, edges, SOURCE_NAMES).alias("s"), _first_of(e, edges, TARGET_NAMES).alias("d"), F.array(*attr).alias("f"))

    first = F.get(F.filter(F.transform("edges", one), lambda e: e["s"].isNotNull() & e["d"].isNotNull() & (e["s"] != e["d"])), F.lit(0))
    ids = F.array().cast("array<int>")
    out = graphs.withColumn("__e", first)
    return out.withColumns({
        "num_nodes": F.coalesce(F.col("num_nodes"), F.size("nodes")) if "num_nodes" in graphs.columns else F.size("nodes"),
        "track_ids": F.transform("nodes", lambda n: n["track_id"]), "x": F.transform("nodes", lambda n: _features(n, nodes)),
        "edge_index": F.when(F.col("__e").isNull(), F.array(ids, ids)).otherwise(F.array(F.array("__e.s"), F.array("__e.d"))),
        "edge_attr": F.when(F.col("__e").isNull(), F.array().cast("array<array<double>>")).otherwise(F.array("__e.f")),
    }).drop("__e")


def graph_tensors(graphs: DataFrame) -> DataFrame:
    """Adds x (12 wide), edge_index (pairs, 0-based; src, dst count from 1 where node numbers are absent) and edge_attr; edges without ends are skipped."""
    nodes, edges = _fields(graphs, "nodes"), _fields(graphs, "edges")

    def end(e: Column, name: str) -> Column:
        found = [e[f"{name}_node"].cast("int")] if f"{name}_node" in edges else []
        return F.coalesce(*found, *([e[name].cast("int") - 1] if name in edges else [F.lit(None).cast("int")]))

    def pair(e: Column) -> Column:
        whole = [e[f"{s}_node"].isNotNull() for s in ("src", "dst") if f"{s}_node" in edges]
        both = whole[0] & whole[1] if len(whole) == 2 else F.lit(False)
        old = lambda s: e[s].cast("int") - 1 if s in edges else F.lit(None).cast("int")
        s, d = (F.when(both, end(e, n)).otherwise(old(n)) for n in ("src", "dst"))
        return F.struct(s.alias("s"), d.alias("d"), (e["features"] if "features" in edges else F.array().cast("array<double>")).alias("f"))

    kept = F.filter(F.transform("edges", pair), lambda e: e["s"].isNotNull() & e["d"].isNotNull())
    return graphs.withColumn("__e", kept).withColumns({
        "x": F.transform("nodes", lambda n: _features(n, nodes)), "edge_index": F.transform("__e", lambda e: F.array(e["s"], e["d"])), "edge_attr": F.transform("__e", lambda e: e["f"])
    }).drop("__e")


def trim_edges(graphs: DataFrame) -> DataFrame:
    """One edge at most: the first with src <= dst and different ends, else the first of all; num_edges follows."""
    have = _fields(graphs, "edges")
    s, d = (lambda e: _first_of(e, have, ["source", "src"])), (lambda e: _first_of(e, have, ["target", "dst"]))
    good = F.filter("edges", lambda e: F.coalesce((s(e) != d(e)) & (s(e) <= d(e)), F.lit(False)))
    chosen = F.coalesce(F.get(good, F.lit(0)), F.get("edges", F.lit(0)))
    return graphs.withColumn("edges", F.filter(F.array(chosen), lambda e: e.isNotNull())).withColumn("num_edges", F.size("edges"))


def package_errors(tensors: DataFrame) -> DataFrame:
    """Rows of packaged tensors (x, edge_index, edge_attr, pos?) whose shapes disagree, with the reason."""
    width = F.size(F.get("x", F.lit(0)))
    checks = [
        (F.exists("x", lambda r: F.size(r) != width), "x rows differ in width"),
        (F.exists("edge_index", lambda r: F.size(r) != 2), "edge_index must hold pairs"),
        (F.size("edge_attr") != F.size("edge_index"), "edge_attr rows must equal the number of edges"),
    ]
    if "pos" in tensors.columns:
        checks += [(F.size("pos") != F.size("x"), "pos and x must have the same number of nodes"), (F.exists("pos", lambda r: F.size(r) != 2), "pos must be [num_nodes, 2]")]
    else:
        checks.append(((F.size("x") > 0) & (width < 2), "positions cannot be inferred from fewer than 2 columns"))
    reason = F.lit(None).cast("string")
    for bad, why in reversed(checks):
        reason = F.when(F.coalesce(bad, F.lit(False)), why).otherwise(reason)
    return tensors.withColumn("reason", reason).where("reason is not null")


def package(tensors: DataFrame) -> DataFrame:
    """Adds num_nodes and, where absent, pos from the first two channels."""
    out = tensors if "pos" in tensors.columns else tensors.withColumn("pos", F.transform("x", lambda r: F.slice(r, 1, 2)))
    return out.withColumn("num_nodes", F.size("x"))


def regraph(graphs: DataFrame, key: list[str], lossless: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) built anew from nested graphs with the default options, as ``regraph_nodes`` reads them."""
    nodes = regraph_nodes(graphs, key, lossless)
    return nodes, build_edges(nodes, key)


def regraph_nodes(graphs: DataFrame, key: list[str], lossless: bool = True) -> DataFrame:
    """Nodes built anew from nested graphs with the default options.

    Node structs without velocity fields take them from their features if lossless; else velocities
    and headings become 0.
    """
    have = _fields(graphs, "nodes")
    rows = graphs.select(*key, F.explode("nodes").alias("n"))
    has_features = "features" in have and lossless

    def of(name: str, at: int | None = None) -> Column:
        given = [safe_float(F.col("n")[name]) if name in have else None, F.get(F.col("n.features"), F.lit(at)) if has_features and at is not None else None]
        return F.coalesce(*(c for c in given if c is not None), F.lit(0.0))

    heading = of("heading") if "heading" in have else F.atan2(of("", 8), of("", 9)) if has_features else F.lit(0.0)
    track = [F.col("n.track_id").alias("track_id")] if "track_id" in have else []
    order = F.col("n.node_id") if "node_id" in have else F.lit(0)
    cls = F.coalesce(F.col("n.actor_class"), F.lit("other")) if "actor_class" in have else F.lit("other")
    actors = rows.select(*key, order.alias("__o"), *track, (of("x") if "x" in have else of("x_m")).alias("x_m"), (of("y") if "y" in have else of("y_m")).alias("y_m"),
                         of("vx", 2).alias("vx"), of("vy", 3).alias("vy"), of("ax", 5).alias("ax"), of("ay", 6).alias("ay"), heading.alias("heading_rad"), cls.alias("actor_class"))
    return build_nodes(actors, key, order_col="__o")
