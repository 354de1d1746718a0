"""Closest approach of track pairs at any times, by a best-first search over bounding boxes.

A track's samples are kept as parts: its samples in one cell of a grid, at most ``PART`` of them, with
their bounding box. Parts of two tracks meet only in neighbouring cells and only if their boxes come within
the radius, so a row of the join stands for up to PART x PART pairs of samples. Inside, pieces of a few
dozen samples are searched in the order of their boxes' distance, until no box can hold a closer pair: a
spot that two long tracks share costs about their lengths, not the product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from roadweave.functions.scalars import distance
from roadweave.operators import track_blocks

#: Samples of a part, of a piece inside a part, and pairs of samples that are simply all computed.
PART, PIECE, FEW = 4096, 32, 256


def parts(samples: DataFrame, key: list[str], width: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, track, __cx, __cy, xs, ys, fs, carried arrays, box): samples (key, track, frame_idx, x_m, y_m) by cell, in the order of frames."""
    rank = F.row_number().over(Window.partitionBy(*key, "track").orderBy("frame_idx", "x_m", "y_m")) - 1
    placed = samples.withColumns({"__part": F.floor(rank / PART), "__cx": F.floor(F.col("x_m") / width), "__cy": F.floor(F.col("y_m") / width)})
    points = F.array_sort(F.collect_list(F.struct("frame_idx", "x_m", "y_m", *carry)))
    grouped = placed.groupBy(*key, "track", "__cx", "__cy", "__part").agg(points.alias("p"), *(f(c).alias(f"{n}_{c[0]}") for c in ("x_m", "y_m") for n, f in (("low", F.min), ("high", F.max))))
    box = F.struct("low_x", "high_x", "low_y", "high_y").alias("box")
    of = lambda name: F.transform("p", lambda s: s[name])
    return grouped.select(*key, "track", "__cx", "__cy", of("x_m").alias("xs"), of("y_m").alias("ys"), of("frame_idx").alias("fs"), *(of(c).alias(c) for c in carry), box)


def _gap(a: str, b: str, axis: str) -> Column:
    """Distance of two boxes along an axis."""
    return F.greatest(F.lit(0.0), F.col(f"{a}.low_{axis}") - F.col(f"{b}.high_{axis}"), F.col(f"{b}.low_{axis}") - F.col(f"{a}.high_{axis}"))


def _distance(dx: np.ndarray, dy: np.ndarray) -> np.ndarray:
    """As ``scalars.distance``."""
    return np.sqrt(dx * dx + dy * dy)


def closest(xa: np.ndarray, ya: np.ndarray, fa: np.ndarray, xb: np.ndarray, yb: np.ndarray, fb: np.ndarray, limit: float = np.inf) -> tuple[float, int, int] | None:
    """(distance, place in a, place in b) of the closest two points within the limit, ties by frames; None if there are none."""
    cut_a, cut_b = (np.argsort(_along(x, y), kind="stable") for x, y in ((xa, ya), (xb, yb)))
    boxes_a, boxes_b = _boxes(xa[cut_a], ya[cut_a]), _boxes(xb[cut_b], yb[cut_b])
    dx = np.maximum(0, np.maximum(boxes_a[:, None, 0] - boxes_b[None, :, 1], boxes_b[None, :, 0] - boxes_a[:, None, 1]))
    dy = np.maximum(0, np.maximum(boxes_a[:, None, 2] - boxes_b[None, :, 3], boxes_b[None, :, 2] - boxes_a[:, None, 3]))
    least = np.hypot(dx, dy)
    best: tuple | None = None
    for at in np.argsort(least, axis=None, kind="stable").tolist():
        i, j = divmod(at, least.shape[1])
        if least[i, j] * (1 - 1e-12) > (limit if best is None else best[0]):
            break
        a, b = cut_a[i * PIECE : (i + 1) * PIECE], cut_b[j * PIECE : (j + 1) * PIECE]
        d = np.hypot(xb[b][None] - xa[a][:, None], yb[b][None] - ya[a][:, None])
        close = min(d.min() * (1 + 1e-12), (limit if best is None else best[0]) * (1 + 1e-12))
        at_p, at_q = np.nonzero(d <= close)  # the last bit, which decides ties, is that of ``_distance``
        exact = _distance(xb[b[at_q]] - xa[a[at_p]], yb[b[at_q]] - ya[a[at_p]])
        for near, p, q in zip(exact.tolist(), at_p.tolist(), at_q.tolist()):
            found = (near, fa[a[p]], fb[b[q]], int(a[p]), int(b[q]))
            if near <= limit and (best is None or found[:3] < best[:3]):
                best = found
    return None if best is None else (best[0], best[3], best[4])


def _along(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places on a curve that keeps neighbours together (bits of both coordinates in turn)."""
    out = np.zeros(len(x), np.int64)
    scaled = [((v - v.min()) / max(float(np.ptp(v)), 1e-300) * 1023).astype(np.int64) for v in (x, y)]
    for bit in range(10):
        for k, v in enumerate(scaled):
            out |= ((v >> bit) & 1) << (2 * bit + k)
    return out


def _boxes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    starts = np.arange(0, len(x), PIECE)
    return np.column_stack([f.reduceat(v, starts) for v in (x, y) for f in (np.minimum, np.maximum)])


def _searcher(radius: float, keys: int):
    """Rows of two parts -> the closest pair of each within the radius. Columns: key, tracks, then xs, ys, fs of a and of b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [batch.column(keys + i) for i in range(6)]
            na, nb = (pc.list_value_length(lists[i]).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 3))
            flat = [x.flatten().to_numpy(zero_copy_only=False) for x in lists]
            at_a, at_b = np.cumsum(na) - na, np.cumsum(nb) - nb
            few = np.flatnonzero(na * nb <= FEW)
            # all pairs of samples of the small rows at once
            row = np.repeat(few, (na * nb)[few])
            nth = np.arange(len(row)) - np.repeat(np.cumsum((na * nb)[few]) - (na * nb)[few], (na * nb)[few])
            a, b = at_a[row] + nth // nb[row], at_b[row] + nth % nb[row]
            d = _distance(flat[3][b] - flat[0][a], flat[4][b] - flat[1][a])
            keep = d <= radius
            row, a, b, d = row[keep], a[keep], b[keep], d[keep]
            order = np.lexsort((flat[5][b], flat[2][a], d, row))
            order = order[np.append(True, row[order][1:] != row[order][:-1])] if len(order) else order
            found = [(row[order], a[order], b[order], d[order])]
            large = []
            for r in np.flatnonzero(na * nb > FEW).tolist():
                i, j = slice(at_a[r], at_a[r] + na[r]), slice(at_b[r], at_b[r] + nb[r])
                best = closest(flat[0][i], flat[1][i], flat[2][i], flat[3][j], flat[4][j], flat[5][j], radius)
                if best:
                    large.append((r, at_a[r] + best[1], at_b[r] + best[2], best[0]))
            if large:
                found.append(tuple(np.array(x) for x in zip(*large)))
            row, a, b, d = (np.concatenate(x) for x in zip(*found))
            row, a, b = row.astype(np.int64), a.astype(np.int64), b.astype(np.int64)
            kept = [batch.column(i).take(pa.array(row)) for i in range(keys)]
            values = [d, flat[2][a], flat[5][b], flat[0][a], flat[1][a], flat[3][b], flat[4][b]]
            yield pa.RecordBatch.from_arrays([*kept, *map(pa.array, values)], names=[*batch.schema.names[:keys], "dist", "fa", "fb", "xa", "ya", "xb", "yb"])

    return run


def closest_approach(samples: DataFrame, key: list[str], radius: float, wanted: DataFrame | None = None, blocks: int = 0, digits: int | None = None) -> DataFrame:
    """(key, track_id_a, track_id_b, dist, fa, fb, xa, ya, xb, yb): the closest samples of each pair of tracks that come within the radius (inclusive), ties by frames.

    ``samples``: key, track (string), frame_idx, x_m, y_m, without gaps. ``wanted`` (__a, __b) are the only pairs that may meet.
    ``blocks`` (without ``wanted``) deals tracks into so many blocks that meet two by two, so no rows of pairs are shuffled: for many
    tracks of moderate length, most of which meet (``track_blocks``); numbers are then rounded if ``digits`` are given.
    """
    if blocks:
        if wanted is not None:
            raise ValueError("blocks look at all pairs")
        return track_blocks.closest_rows(samples, key, radius, blocks, digits)
    names = [f"__k{i}" for i in range(len(key))]
    own = parts(samples, key, radius)
    side = lambda s: [*(F.col(k).alias(n) for k, n in zip(key, names)), F.col("track").alias(f"track_id_{s}"), "__cx", "__cy", *(F.col(c).alias(f"{c}_{s}") for c in ("xs", "ys", "fs", "box"))]
    one, two = own.select(*side("a")), own.select(*side("b"))
    around = F.array(*(F.lit(i) for i in (-1, 0, 1)))
    two = two.withColumn("__dx", F.explode(around)).withColumn("__dy", F.explode(around)).withColumns({"__cx": F.col("__cx") + F.col("__dx"), "__cy": F.col("__cy") + F.col("__dy")}).drop("__dx", "__dy")
    on = [*names, "__cx", "__cy"]
    if wanted is not None:
        one = one.join(wanted.withColumnRenamed("__a", "track_id_a"), "track_id_a")
        two = two.withColumn("__b", F.col("track_id_b"))
        on = [*on, "__b"]
    gaps = [_gap("box_a", "box_b", axis) for axis in "xy"]
    near = (F.col("track_id_a") < F.col("track_id_b")) & (gaps[0] * gaps[0] + gaps[1] * gaps[1] <= radius * radius * (1 + 1e-9))
    met = one.alias("l").join(two.alias("r"), [F.col(f"l.{n}") == F.col(f"r.{n}") for n in on] + [near])
    met = met.select(*(F.col(f"l.{n}").alias(n) for n in names), "track_id_a", "track_id_b", "xs_a", "ys_a", "fs_a", "xs_b", "ys_b", "fs_b")
    kinds = [f"{n} {samples.schema[k].dataType.simpleString()}" for k, n in zip(key, names)]
    frame = samples.schema["frame_idx"].dataType.simpleString()
    schema = ", ".join([*kinds, "track_id_a string, track_id_b string, dist double", f"fa {frame}, fb {frame}", "xa double, ya double, xb double, yb double"])
    found = met.mapInArrow(_searcher(float(radius), len(key) + 2), schema)
    values = ["dist", "fa", "fb", "xa", "ya", "xb", "yb"]
    best = found.groupBy(*names, "track_id_a", "track_id_b").agg(F.min(F.struct(*values)).alias("m"))
    return best.select(*(F.col(n).alias(k) for k, n in zip(key, names)), "track_id_a", "track_id_b", *(F.col(f"m.{v}").alias(v) for v in values))


def inside_zones(zones: DataFrame, samples: DataFrame, key: list[str], radius: float, track_col: str = "track", carry: tuple[str, ...] = ("t_sec",)) -> DataFrame:
    """Samples of a zone's track inside its circle: zones (key, track, conflict_x, conflict_y, ...) with frame_idx and the carried columns.

    Cells are as wide as a circle, so a circle touches four of them at most, and only the track's parts there are looked at.
    """
    width = 2.0 * radius
    own = parts(samples, key, width, carry)
    cells = lambda c: F.sequence(F.floor((F.col(c) - radius) / width), F.floor((F.col(c) + radius) / width))
    asked = zones.withColumn("__cx", F.explode(cells("conflict_x"))).withColumn("__cy", F.explode(cells("conflict_y")))
    met = asked.withColumnRenamed(track_col, "track").join(own.select(*key, "track", "__cx", "__cy", F.arrays_zip("fs", "xs", "ys", *carry).alias("p")), [*key, "track", "__cx", "__cy"])
    inside = F.filter("p", lambda s: distance(s["xs"] - F.col("conflict_x"), s["ys"] - F.col("conflict_y")) <= radius)
    out = met.withColumn("s", F.explode(inside))
    rest = [c for c in zones.columns if c not in (*key, track_col)]
    return out.select(*key, F.col("track").alias(track_col), *rest, F.col("s.fs").alias("frame_idx"), *(F.col(f"s.{c}").alias(c) for c in carry))
