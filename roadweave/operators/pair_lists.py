"""Lists of near pairs, found and measured in numpy inside tasks, where pairs are many for each point.

Points are dealt by key and square cells twice as wide as their reach, and go to the four cells that they may
reach at most, so what is shuffled grows with the points, however many pairs there are. A pair is found in the home cell of one of its
points, looked for in windows along x, and leaves the task as a row of finished columns: a join would carry both
points through each pair, and its generated code for many columns is too long to be compiled.
Where the reach differs from point to point (speed-adaptive radii), a point belongs to the level of grids that is wide enough for it
and visits the wider ones that its key has: a pair is found on the level of its wider point, so no bound cuts it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadweave.functions.numbering import task_count
from roadweave.functions.scalars import most_square
from roadweave.functions.vocabulary import EDGE_FEATURES, ODD_EDGE_FEATURES

#: Points of one block and of one window of distances; its arrays stay in a core's cache. Pairs that are measured at once.
_ROWS, _COLUMNS, _PAIRS = 64, 4096, 1 << 16
#: The level of points whose reach is more than 2 ** 50 times the least one, or unknown: its only cell is the whole key.
TOP = 51


def radius_table(radii: dict[tuple[str, str], float], default: float) -> tuple[list[str], np.ndarray]:
    """(class names, radius of each pair of places): place 0 stands for classes without a radius of their own. A pair as it stands goes before its reverse."""
    names = sorted({c for pair in radii for c in pair})
    at = {c: i + 1 for i, c in enumerate(names)}
    out = np.full((len(names) + 1, len(names) + 1), float(default))
    for forward in (False, True):
        for (p, q), r in radii.items():
            out[(at[p], at[q]) if forward else (at[q], at[p])] = r
    return names, out


@dataclass(frozen=True)
class Near:
    """Which pairs are near: farther than ``least`` and up to (``strict``: closer than) their radius.

    ``radii`` by the places of two classes in ``names`` (0: others). ``scale`` times the greater speed of the two is added.
    """

    radii: np.ndarray
    names: list[str] = field(default_factory=list)
    strict: bool = False
    least: float | None = None
    scale: float = 0.0

    def squares(self) -> np.ndarray:
        return np.vectorize(lambda r: most_square(float(np.nextafter(r, 0.0)) if self.strict else r) if np.isfinite(r) else r)(self.radii)


class Unit:
    """Rows that meet in one cell, by x: columns as numbers (null: NaN) or as Arrow arrays, each made once."""

    def __init__(self, table: pa.Table):
        self.table = table.take(pa.array(np.argsort(table.column("__x").to_numpy(), kind="stable")))
        self._numbers: dict[str, np.ndarray] = {}
        self._arrays: dict[str, pa.Array] = {}

    def number(self, name: str) -> np.ndarray:
        if name not in self._numbers:
            self._numbers[name] = self.table.column(name).to_numpy()
        return self._numbers[name]

    def array(self, name: str) -> pa.Array:
        if name not in self._arrays:
            self._arrays[name] = self.table.column(name).combine_chunks()
        return self._arrays[name]

    def codes(self, name: str) -> np.ndarray:
        """Places of a text column's values in their order as bytes; null: -1."""
        if f"code {name}" not in self._numbers:
            coded = self.array(name).dictionary_encode()
            order = pc.sort_indices(coded.dictionary)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            at = coded.indices.fill_null(-1).to_numpy()
            self._numbers[f"code {name}"] = np.where(at < 0, -1, rank[at]) if len(rank) else np.full(len(at), -1)
        return self._numbers[f"code {name}"]


#: Columns of the pairs (a, b: rows of a unit, a's id smaller, with their distances); any number of batches.
Made = Callable[[Unit, np.ndarray, np.ndarray, np.ndarray], Iterator[list[pa.Array]]]


def _found(unit: Unit, near: Near, squares: np.ndarray, by_text: bool, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, distance) of the near pairs of these home rows (by x), in parts of about ``_PAIRS``."""
    x, y = unit.number("__x"), unit.number("__y")
    order = unit.codes("__id") if by_text else unit.number("__id")
    kind = unit.number("__kind") if near.names else None
    level, own, speed = (unit.number(c) if near.scale else None for c in ("__level", "__own", "__speed"))
    least, most = -1.0 if near.least is None else most_square(near.least), float(squares.max())
    if near.scale:
        top = level[0] == TOP
        reach = np.inf if top else float(near.radii.max()) * 2.0 ** int(level[0]) * (1 + 1e-9)
        most = reach * reach * (1 + 1e-9)
    else:
        reach = float(near.radii.max()) * (1 + 1e-9)
    waiting: list[tuple[np.ndarray, ...]] = []
    n = 0
    for i in range(0, len(home), _ROWS):
        block = home[i : i + _ROWS]
        bx, by = x[block][:, None], y[block][:, None]
        first, last = np.searchsorted(x, x[block[0]] - reach, "left"), np.searchsorted(x, x[block[-1]] + reach, "right")
        for s in range(first, last, _COLUMNS):
            e = min(last, s + _COLUMNS)
            square = np.subtract(x[None, s:e], bx)
            square *= square
            dy = np.subtract(y[None, s:e], by)
            dy *= dy
            square += dy
            at = np.flatnonzero(square <= most)
            if not len(at):
                continue
            p, q = np.divmod(at, e - s)
            square = square.ravel()[at]
            p, q = block[p], q + s
            if near.scale:
                # two rows of one level meet in both homes, others only in the home of the wider one
                keep = (order[p] < order[q]) | ((own[q] < own[p]) & (order[p] > order[q]))
                p, q, square = p[keep], q[keep], square[keep]
                turn = order[p] > order[q]
                p, q = np.where(turn, q, p), np.where(turn, p, q)
                radius = (near.radii[kind[p], kind[q]] if kind is not None else near.radii[0, 0]) + near.scale * np.maximum(speed[p], speed[q])
                dist = np.sqrt(square)
                keep = (dist < radius) if near.strict else (dist <= radius)
                keep &= square > least
            else:
                keep = order[p] < order[q]
                if near.least is not None:
                    keep &= square > least
                if kind is not None:
                    keep &= square <= squares[kind[p], kind[q]]
            p, q, square = p[keep], q[keep], square[keep]
            waiting.append((p, q, square))
            n += len(p)
            if n >= _PAIRS:
                p, q, square = (np.concatenate(v) for v in zip(*waiting))
                yield p, q, np.sqrt(square)
                waiting, n = [], 0
    if n:
        p, q, square = (np.concatenate(v) for v in zip(*waiting))
        yield p, q, np.sqrt(square)


def _all_home(unit: Unit) -> Iterator[np.ndarray]:
    yield np.flatnonzero(unit.number("__home"))


def list_pairs(points: DataFrame, key: list[str], near: Near, made: Made, schema: list[str], carry: list[str], id_col: str = "node_id", x_col: str = "x", y_col: str = "y", chunks: int = 0,
               groups: Callable[[Unit], Iterator[np.ndarray]] = _all_home) -> DataFrame:
    """(key, columns of ``schema``): what ``made`` gives for the near pairs of one key, each pair once. Rows without a key or a finite place are near nothing.

    ``points``: key, an id (a whole number or a text), places, the columns to carry, ``actor_class`` if the radius goes by class and ``speed`` if it is adaptive.
    ``chunks``: no grid; the rows of a key are at home in so many chunks by a hash, and all of them go to each.
    ``groups`` deals a unit's home rows into groups that are looked at one after the other, up to the first one with a pair.
    """
    if chunks and near.scale:
        raise ValueError("speed-adaptive radii are listed by grids")
    squares = near.squares()
    most = float(near.radii.max())
    kinds = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    by_text = kinds[id_col] == "string"
    widest = F.lit(max(most, 1e-6) * (1 + 1e-9))
    kind = [F.coalesce(F.array_position(F.array(*map(F.lit, near.names)), F.col("actor_class")), F.lit(0)).cast("int").alias("__kind")] if near.names else []
    speed = F.coalesce(F.col("speed").cast("double"), F.lit(float("-inf"))) if near.scale else None
    adaptive = [F.when(F.isnan(speed), F.lit(float("inf"))).otherwise(speed).alias("__speed")] if near.scale else []
    placed = points.select(*key, F.col(id_col).alias("__id"), F.col(x_col).cast("double").alias("__x"), F.col(y_col).cast("double").alias("__y"), *kind, *adaptive, *carry)
    for c in (*key, "__id"):
        placed = placed.where(F.col(c).isNotNull())
    placed = placed.where((F.abs("__x") < float("inf")) & (F.abs("__y") < float("inf")))
    level = F.lit(0)
    reach = widest
    if near.scale:
        wider = (F.lit(most) + F.lit(max(near.scale, 0.0)) * F.col("__speed")) / F.lit(max(most, 1e-6))
        own = F.when(wider <= 1.0, 0).when(wider <= 2.0**50, F.ceil(F.log2(wider)).cast("int")).otherwise(TOP)
        placed = placed.withColumn("__own", own)
        levels = placed.groupBy(*key).agg(F.collect_set("__own").alias("__levels"))  # a few dozen at most
        placed = placed.join(levels, key).withColumn("__level", F.explode(F.filter("__levels", lambda v: v >= F.col("__own")))).drop("__levels")
        level, reach = F.col("__level"), widest * F.pow(F.lit(2.0), F.col("__level"))
    whole = (level == TOP) if np.isfinite(most) else F.lit(True)
    cell = lambda c, by: F.when(whole, F.lit(0).cast("long")).otherwise(F.floor((F.col(c) + by * reach) / (2 * reach)))
    sent = placed if near.scale else placed.withColumn("__level", level)
    if chunks:
        sent = sent.withColumns({"__cx": F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))), "__cy": F.lit(0)})
    for c in "" if chunks else "xy":
        sent = sent.withColumn(f"__c{c}", F.explode(F.sequence(cell(f"__{c}", -1), cell(f"__{c}", 1))))
    home = F.col("__cx") == F.pmod(F.xxhash64("__id", "__x", "__y"), F.lit(chunks)) if chunks else (F.col("__cx") == cell("__x", 0)) & (F.col("__cy") == cell("__y", 0))
    sent = sent.withColumn("__home", home & (F.col("__own") == F.col("__level")) if near.scale else home)
    unit = [*key, "__level", "__cx", "__cy"]
    names = [*key, *(c.split()[0] for c in schema)]

    def measured(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if table.num_rows < 2 or not pc.any(table.column("__home")).as_py():
            return
        rows, marks = Unit(table), [table.column(k)[0] for k in key]
        with np.errstate(all="ignore"):
            for home in groups(rows):
                any_pair = False
                for p, q, dist in _found(rows, near, squares, by_text, home):
                    any_pair |= len(p) > 0
                    for columns in made(rows, p, q, dist):
                        if len(columns[0]):
                            yield pa.RecordBatch.from_arrays([*(pa.repeat(m, len(columns[0])) for m in marks), *columns], names=names)
                if any_pair:
                    break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            if not b.num_rows:
                continue
            marks = [b.column(c).to_numpy(zero_copy_only=False) for c in unit]
            change = (np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()
            for s, e in zip([0, *change], [*change, b.num_rows]):
                this = tuple(m[s] for m in marks)
                if this != now and held:
                    yield from measured(held)
                    held = []
                now = this
                held.append(b.slice(s, e - s))
        if held:
            yield from measured(held)

    met = sent.repartition(task_count(points), *unit).sortWithinPartitions(*unit)
    return met.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in key), *schema]))


def rounded(v: np.ndarray, digits: int | None) -> np.ndarray:
    """As ``scalars.round_digits``; unchanged without digits."""
    if digits is None:
        return v
    scaled = v * 10.0**digits
    whole = np.rint(scaled)
    rest = scaled - whole
    tie = np.flatnonzero(np.abs(rest) == 0.5)
    if len(tie):
        whole[tie] += np.where(rest[tie] * np.sign(scaled[tie]) == 0.5, np.sign(scaled[tie]), 0.0)
    whole /= 10.0**digits
    whole += 0.0
    large = ~(np.abs(v) < 1e300)
    return np.where(large, v, whole) if large.any() else whole


# Edges


def _edge_channel(rows: Unit, p: np.ndarray, q: np.ndarray, dist: np.ndarray, collision_radius: float, max_ttc: float) -> Callable[[str], np.ndarray]:
    """The channels of ``graphs.edge_channels`` by name, each made once; NaN for the class of nodes without one."""
    made = {"distance": dist}
    gap = lambda c: rows.number(c)[q] - rows.number(c)[p]
    turns = ("rel_heading_sin", "rel_heading_cos")

    def channel(name: str) -> np.ndarray:
        if name in made:
            return made[name]
        if name in ("dx", "dy"):
            out = gap(f"__{name[1]}")
        elif name in ("dvx", "dvy"):
            out = gap(name[1:])
        elif name == "relative_speed":
            out = np.hypot(channel("dvx"), channel("dvy"))
        elif name == "closing_speed":
            out = -(channel("dvx") * channel("dx") + channel("dvy") * channel("dy")) / dist  # edges are longer than 1e-8
        elif name in ("bearing_sin", "bearing_cos"):
            out = channel("dy" if name == "bearing_sin" else "dx") / dist
        elif name in turns:
            turn = gap("heading")
            turn = np.arctan2(np.sin(turn), np.cos(turn))
            made.update(zip(turns, (np.sin(turn), np.cos(turn))))
            return made[name]
        elif name == "ttc":
            dx, dy, dvx, dvy = map(channel, ("dx", "dy", "dvx", "dvy"))
            a, b, c = dvx * dvx + dvy * dvy, 2 * (dx * dvx + dy * dvy), dx * dx + dy * dy - collision_radius**2
            disc = b * b - 4 * a * c
            root = np.sqrt(np.maximum(disc, 0.0))
            low, high = (-b - root) / (2 * a), (-b + root) / (2 * a)
            fits = lambda t: np.where((t >= 0) & (t <= max_ttc), t, max_ttc)  # noqa: E731  none fits: the most
            out = np.where((a < 1e-8) | (disc < 0), max_ttc, np.minimum(fits(low), fits(high)))
        elif name == "same_class":
            one, two = rows.codes("actor_class")[p], rows.codes("actor_class")[q]
            out = np.where((one < 0) | (two < 0), np.nan, (one == two).astype(np.float64))
        else:
            out = rows.number("size_prior")[p if name == "size_src" else q]
        made[name] = out
        return out

    return channel


def _near_of(config) -> Near:
    names, radii = radius_table(config.radii if config.use_class_specific_radii else {}, config.radius)
    return Near(radii, names, least=1e-8, scale=float(config.velocity_radius_scale) if config.use_velocity_adaptive_radius else 0.0)


def list_edges(nodes: DataFrame, key: list[str], config, columns: list[str] = EDGE_FEATURES, digits: int | None = None) -> DataFrame:
    """(key, src, dst, direction, channels): the edges of ``graphs.build_edges`` with the channels asked for, rounded if digits are given.

    For nodes with finite numbers and a class, as ``graphs.build_nodes`` makes them.
    """
    near = _near_of(config)
    max_ttc = 10.0 if config.max_ttc is None else float(config.max_ttc)
    least_closing, directed, collision_radius = config.min_closing_speed, config.directed, config.collision_radius

    def made(rows: Unit, p: np.ndarray, q: np.ndarray, dist: np.ndarray) -> Iterator[list[pa.Array]]:
        if least_closing is not None:
            closing = _edge_channel(rows, p, q, dist, collision_radius, max_ttc)("closing_speed")
            keep = ~(closing < least_closing)
            p, q, dist = p[keep], q[keep], dist[keep]
        channel = _edge_channel(rows, p, q, dist, collision_radius, max_ttc)
        ids = [pa.array(rows.number("__id")[v]) for v in (p, q)]
        values = {c: rounded(channel(c), digits) for c in columns}
        arrays = {c: pa.array(v) for c, v in values.items()}
        yield [*ids, pa.repeat(pa.scalar(0, pa.int32()), len(p)), *arrays.values()]
        if directed:
            back = {"size_src": "size_dst", "size_dst": "size_src"}
            if {"size_src", "size_dst"} & {*columns}:
                arrays |= {c: arrays[c] if c in arrays else pa.array(rounded(channel(c), digits)) for c in back}
            yield [*ids[::-1], pa.repeat(pa.scalar(1, pa.int32()), len(p)), *(pa.array(0.0 - values[c]) if c in ODD_EDGE_FEATURES else arrays[back.get(c, c)] for c in columns)]

    carry = ["vx", "vy", "heading", "size_prior", "actor_class"] if set(columns) - {"distance", "dx", "dy", "bearing_sin", "bearing_cos"} or least_closing is not None else []
    node = nodes.schema["node_id"].dataType.simpleString()
    return list_pairs(nodes, key, near, made, [f"src {node}", f"dst {node}", "direction int", *(f"{c} double" for c in columns)], carry)


def edge_sums(nodes: DataFrame, key: list[str], config) -> DataFrame:
    """(key, m, src_sum, dst_sum): number of the undirected edges of each graph that has any, and sums of their smaller and larger nodes; edges are summed where they are found."""
    if config.min_closing_speed is not None:
        raise ValueError("edge sums serve graphs without a least closing speed")

    def made(rows: Unit, p: np.ndarray, q: np.ndarray, dist: np.ndarray) -> Iterator[list[pa.Array]]:
        if len(p):
            yield [pa.array([int(v)], pa.int64()) for v in (len(p), *(rows.number("__id")[w].astype(np.int64).sum() for w in (p, q)))]

    parts = list_pairs(nodes, key, _near_of(config), made, ["m long", "src_sum long", "dst_sum long"], [])
    return parts.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("m", "src_sum", "dst_sum")))


def _by_number(unit: Unit) -> Iterator[np.ndarray]:
    """Home rows from the smallest number on, in ever larger groups."""
    home = np.flatnonzero(unit.number("__home"))
    order, start, size = home[np.argsort(unit.number("__id")[home], kind="stable")], 0, _ROWS
    while start < len(order):
        yield np.sort(order[start : start + size])
        start, size = start + size, 2 * size


def first_pairs(nodes: DataFrame, key: list[str], config) -> DataFrame:
    """(key, src, dst) with the least near pair of each graph among them, at most one row of a cell if radii don't go by speed.

    There the nodes of a cell are looked at from the smallest number on, up to the first with a pair: not all pairs of a crowded cell are.
    """
    near = _near_of(config)

    def made(rows: Unit, p: np.ndarray, q: np.ndarray, dist: np.ndarray) -> Iterator[list[pa.Array]]:
        if len(p):
            src, dst = rows.number("__id")[p], rows.number("__id")[q]
            at = np.lexsort((dst, src))[:1]
            yield [pa.array(src[at]), pa.array(dst[at])]

    node = nodes.schema["node_id"].dataType.simpleString()
    return list_pairs(nodes, key, near, made, [f"src {node}", f"dst {node}"], [], groups=_all_home if near.scale else _by_number)


# Nearby tracks


def list_nearby(points: DataFrame, key: list[str], threshold: float, digits: int | None = None, chunks: int = 0) -> DataFrame:
    """(key, track_id_a, track_id_b, dist): points (key, track, x_m, y_m) strictly closer than the threshold, the smaller track first."""

    def made(rows: Unit, p: np.ndarray, q: np.ndarray, dist: np.ndarray) -> Iterator[list[pa.Array]]:
        yield [*(rows.array("__id").take(pa.array(v)) for v in (p, q)), pa.array(rounded(dist, digits))]

    return list_pairs(points, key, Near(np.array([[float(threshold)]]), strict=True), made, ["track_id_a string", "track_id_b string", "dist double"], [], "track", "x_m", "y_m", chunks)


#: Status of a time to collision, as ``scalars.ttc_constant_velocity`` names it without the separation.
STATUS = ["zero_relative_speed", "diverging_or_parallel", "no_collision", "collision_in_past_or_now", "collision_predicted"]


def list_ttc(points: DataFrame, key: list[str], threshold: float, min_distance: float = 1.5, digits: int | None = None) -> DataFrame:
    """As ``safety.frame_pair_ttc`` with plain statuses, for points (key, track, x_m, y_m, vx_mps, vy_mps), none missing."""

    def made(rows: Unit, p: np.ndarray, q: np.ndarray, dist: np.ndarray) -> Iterator[list[pa.Array]]:
        x, y, vx, vy = (rows.number(c) for c in ("__x", "__y", "vx_mps", "vy_mps"))
        dx, dy, dvx, dvy = (v[q] - v[p] for v in (x, y, vx, vy))
        a, dot = dvx * dvx + dvy * dvy, dx * dvx + dy * dvy
        b, c = 2 * dot, dx * dx + dy * dy - min_distance * min_distance
        disc = b * b - 4 * a * c
        root = np.sqrt(np.maximum(disc, 0.0))
        low, high = (-b - root) / (2 * a), (-b + root) / (2 * a)
        first = np.minimum(np.where(low > 0, low, np.inf), np.where(high > 0, high, np.inf))
        still, away, apart = a < 1e-12, -dot <= 0, disc < 0
        past = first == np.inf
        status = np.select([still, away, apart, past], [0, 1, 2, 3], 4)
        hit = status == 4
        time = np.where(hit, first, np.inf)
        near = -dot / a
        values = lambda v, none: pa.array(rounded(v, digits), mask=none)
        yield [
            *(rows.array("__id").take(pa.array(v)) for v in (p, q)), pa.array(rounded(dist, digits)), pa.array(rounded(time, digits)),
            *(values(at[p] + v[p] * first, ~hit) for at, v in ((x, vx), (y, vy))), pa.array(~(still | away)), pa.array(STATUS).take(pa.array(status)),
            values(np.hypot(dx + near * dvx, dy + near * dvy), status != 2), pa.array((time > 0) & (time <= 3)),
            pa.array(rounded(np.where(time <= 0, 1.0, np.where(time >= 5, 0.0, 1 - time / 5)), digits)),
        ]

    schema = ["track_id_a string", "track_id_b string", "dist double", "ttc_seconds double", "collision_x double", "collision_y double", "is_approaching boolean", "status string", "min_separation double", "is_critical boolean", "severity double"]
    return list_pairs(points, key, Near(np.array([[float(threshold)]]), strict=True), made, schema, ["vx_mps", "vy_mps"], "track", "x_m", "y_m")
