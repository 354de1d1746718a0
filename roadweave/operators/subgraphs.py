"""Subgraphs and feature slices of the nodes and edges tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from roadweave.functions.scalars import class_index, require_columns
from roadweave.functions.vocabulary import ACTOR_CLASSES, EDGE_BLOCKS, EDGE_FEATURES, NODE_FEATURES, edge_feature_index, node_feature_dim, node_feature_index
from roadweave.operators.graphs import GraphConfig
from roadweave.operators.neighbours import neighbour_sums


def subgraph_by_mask(nodes: DataFrame, edges: DataFrame, key: list[str], keep: Column, keep_isolated_nodes: bool = True) -> tuple[DataFrame, DataFrame]:
    """Induced subgraph: kept nodes renumbered in node order, edges whose both ends are kept. Optionally only nodes with an edge."""
    kept = nodes.where(keep)
    if not keep_isolated_nodes:
        inside = _between(edges, kept.select(*key, F.col("node_id").alias("__id")), key)
        ends = inside.select(*key, F.explode(F.array("src", "dst")).alias("node_id")).distinct()
        kept = kept.join(ends, [*key, "node_id"], "left_semi")
    renumbered = kept.withColumn("__new", (F.row_number().over(Window.partitionBy(*key).orderBy("node_id")) - 1).cast("int"))
    ids = renumbered.select(*key, F.col("node_id").alias("__id"), "__new")
    out = edges
    for end in ("src", "dst"):
        out = out.join(ids.withColumnRenamed("__id", end), [*key, end]).withColumn(end, F.col("__new")).drop("__new")
    return renumbered.withColumn("node_id", F.col("__new")).drop("__new").select(*nodes.columns), out.select(*edges.columns)


def subgraph_degrees(nodes: DataFrame, key: list[str], keep: Column, config: GraphConfig = GraphConfig(), keep_isolated_nodes: bool = True) -> DataFrame:
    """The nodes that ``subgraph_by_mask`` gives for the edges of ``graphs.build_edges``, with ``degree``: how many of its edges leave a node, and as many come in.

    Only kept nodes meet, and no edge is listed.
    """
    kept = nodes.where(keep)
    degrees = neighbour_sums(kept, key, config).select(*key, "node_id", "degree")
    kept = kept.join(degrees, [*key, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    if not keep_isolated_nodes:
        kept = kept.where("degree > 0")
    return kept.withColumn("node_id", (F.row_number().over(Window.partitionBy(*key).orderBy("node_id")) - 1).cast("int"))


def _between(edges: DataFrame, ids: DataFrame, key: list[str]) -> DataFrame:
    for end in ("src", "dst"):
        edges = edges.join(ids.withColumnRenamed("__id", end), [*key, end], "left_semi")
    return edges


def subgraph_by_class(nodes: DataFrame, edges: DataFrame, key: list[str], target_class: int, keep_isolated_nodes: bool = True) -> tuple[DataFrame, DataFrame]:
    if "class_index" not in nodes.columns:
        raise AttributeError("nodes have no class_index")
    return subgraph_by_mask(nodes, edges, key, F.col("class_index") == target_class, keep_isolated_nodes)


def array_slice(column: str, first: int, width: int) -> Column:
    return F.slice(column, first + 1, width)


def node_base_features(column: str = "features") -> Column:
    return array_slice(column, 0, len(NODE_FEATURES))


def node_kinematic_features(column: str = "features") -> Column:
    """The first eight channels: places, velocities and accelerations."""
    return array_slice(column, 0, 8)


def node_heading_features(column: str = "features") -> Column:
    return array_slice(column, 8, 2)


def class_one_hot(column: str = "features", classes: list[str] | None = None) -> Column:
    return array_slice(column, len(NODE_FEATURES), len(ACTOR_CLASSES if classes is None else classes))


def named_features(names: list[str], column: str = "features", kind: str = "node") -> Column:
    """Channels by name; an unknown name is a KeyError that lists the valid ones."""
    at = node_feature_index if kind == "node" else edge_feature_index
    return F.array(*(F.get(F.col(column), F.lit(at(n))) for n in names))


def edge_block(block: str, column: str = "features") -> Column:
    """distance, kinematics, angles or risk channels of an edge."""
    return named_features(EDGE_BLOCKS[block], column, "edge")


def positions(nodes: DataFrame) -> Column:
    """``pos`` if the table has it, else the first two channels."""
    return F.col("pos") if "pos" in nodes.columns else array_slice("features", 0, 2)


def class_names(nodes: DataFrame, classes: list[str] | None = None) -> Column:
    """Names by class_index, or by the largest one-hot channel; ``other`` (or the last class) beyond the list."""
    classes = ACTOR_CLASSES if classes is None else classes
    hot = class_one_hot("features", classes)
    at = F.col("class_index") if "class_index" in nodes.columns else (F.array_position(hot, F.array_max(hot)) - 1).cast("int")
    return F.coalesce(F.get(F.array(*map(F.lit, classes)), at), F.lit("other" if "other" in classes else classes[-1]))


def with_node_features(nodes: DataFrame, values: dict[str, Column], column: str = "features") -> DataFrame:
    """Named channels replaced."""
    at = {node_feature_index(n): v for n, v in values.items()}
    new = [at.get(i, F.get(F.col(column), F.lit(i))) for i in range(len(NODE_FEATURES))]
    return nodes.withColumn(column, F.concat(F.array(*new), F.slice(F.col(column), len(NODE_FEATURES) + 1, F.size(column))))


def with_node_feature_block(nodes: DataFrame, names: list[str], block: Column, column: str = "features") -> DataFrame:
    """Named channels replaced by the values of an array column, in the order of the names; an array of another length fails the job."""
    found = F.size(block)
    checked = F.when(found == len(names), block).otherwise(F.raise_error(F.concat(F.lit("replacement block width "), F.coalesce(found.cast("string"), F.lit("null")), F.lit(f" is not {len(names)}"))).cast("array<double>"))
    return with_node_features(nodes.withColumn("__block", checked), {n: F.get("__block", F.lit(i)) for i, n in enumerate(names)}, column).drop("__block")


class LayoutWatch:
    """Counts what breaks the layout while a job runs over the tables: no pass of its own.

    Wrap the tables with ``nodes`` and ``edges``, run any action over what follows from them, then ask
    ``errors`` (reason -> rows) or ``check``, which raises. Missing columns raise at once.
    """

    def __init__(self, classes: list[str] | None = None, require_pos: bool = False, exact_width: bool = True):
        self.classes, self.require_pos, self.exact_width = classes, require_pos, exact_width
        self.seen: list[tuple[Observation, dict[str, str]]] = []

    def _watched(self, rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
        names = {f"e{i}": reason for i, reason in enumerate(rules)}
        self.seen.append((Observation(), names))
        return rows.observe(self.seen[-1][0], *(F.count(F.when(F.coalesce(bad, F.lit(True)), 1)).alias(n) for n, bad in zip(names, rules.values())))

    def nodes(self, rows: DataFrame) -> DataFrame:
        require_columns(rows, "features", *(["pos"] if self.require_pos else []))
        width = node_feature_dim(self.classes)
        rules = {f"node width is not {width}": F.size("features") != width} if self.exact_width else {f"node width is below {len(NODE_FEATURES)}": F.size("features") < len(NODE_FEATURES)}
        if "pos" in rows.columns:
            rules["pos has not two numbers"] = F.size("pos") != 2
        if "class_index" in rows.columns:
            rules["node without class index"] = F.col("class_index").isNull()
        return self._watched(rows, rules)

    def edges(self, rows: DataFrame) -> DataFrame:
        require_columns(rows, "src", "dst", "features")
        return self._watched(rows, {f"edge width is not {len(EDGE_FEATURES)}": F.size("features") != len(EDGE_FEATURES), "edge without ends": F.col("src").isNull() | F.col("dst").isNull()})

    def errors(self) -> dict[str, int]:
        """After an action: reasons with the number of rows they hold for."""
        return {reason: n for watch, names in self.seen for k, reason in names.items() if (n := watch.get[k])}

    def check(self) -> None:
        if found := self.errors():
            raise ValueError("; ".join(f"{reason}: {n} rows" for reason, n in sorted(found.items())))


def layout_errors(nodes: DataFrame, edges: DataFrame, key: list[str], classes: list[str] | None = None, exact_width: bool = False) -> DataFrame:
    """Rows that break the layout, each with its reason; none if all is well."""
    width = node_feature_dim(classes)
    bad = F.size("features") != width if exact_width else F.size("features") < len(NODE_FEATURES)
    what = f"node width is not {width}" if exact_width else f"node width is below {len(NODE_FEATURES)}"
    n = nodes.where(F.col("features").isNull() | bad).select(*key, F.col("node_id").cast("long").alias("at"), F.lit(what).alias("reason"))
    e = edges.where(F.col("features").isNull() | (F.size("features") != len(EDGE_FEATURES))).select(*key, F.col("src").cast("long").alias("at"), F.lit(f"edge width is not {len(EDGE_FEATURES)}").alias("reason"))
    return n.union(e)


def reclassified(nodes: DataFrame, classes: list[str]) -> DataFrame:
    return nodes.withColumn("class_index", class_index("actor_class", classes, strict=False))
