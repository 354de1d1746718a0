"""Image to world coordinates by homographies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.operators.records import footpoint


@dataclass
class Homography:
    matrix: np.ndarray
    rms_error: float


def project(h: np.ndarray, x: Column, y: Column, strict: bool = True) -> tuple[Column, Column]:
    """Homogeneous projection; a denominator within 1e-8 of 0 is an error, or null if not strict."""
    row = lambda i: float(h[i][0]) * x + float(h[i][1]) * y + float(h[i][2])
    w = row(2)
    bad = F.raise_error(F.lit("projection divides by zero")).cast("double") if strict else F.lit(None).cast("double")
    of = lambda i: F.when(F.abs(w) <= 1e-8, bad).otherwise(row(i) / F.when(F.abs(w) > 1e-8, w))
    return of(0), of(1)


def image_points_to_world(points: DataFrame, h: np.ndarray, x_col: str = "x", y_col: str = "y", strict: bool = True) -> DataFrame:
    x, y = project(h, F.col(x_col), F.col(y_col), strict)
    return points.withColumns({"x_m": x, "y_m": y})


def world_to_image(points: DataFrame, h: np.ndarray, x_col: str = "x_m", y_col: str = "y_m", strict: bool = True) -> DataFrame:
    x, y = project(invert(h), F.col(x_col), F.col(y_col), strict)
    return points.withColumns({"image_x": x, "image_y": y})


def tracks_to_world(tracks: DataFrame, h: np.ndarray, strict: bool = True) -> DataFrame:
    """Adds image_x, image_y (foot point) and x_m, y_m."""
    placed = tracks.withColumn("__f", footpoint()).withColumns({"image_x": F.col("__f.x"), "image_y": F.col("__f.y")}).drop("__f")
    return image_points_to_world(placed, h, "image_x", "image_y", strict)


def invert(h: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.asarray(h, float))


def _normaliser(p: np.ndarray) -> np.ndarray:
    c = p.mean(0)
    s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(1)).mean(), 1e-12)
    return np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def _apply(h: np.ndarray, p: np.ndarray) -> np.ndarray:
    q = np.c_[p, np.ones(len(p))] @ h.T
    return q[:, :2] / q[:, 2:]


def fit_homography(image: list | np.ndarray, world: list | np.ndarray, steps: int = 20) -> Homography:
    """Least squares from at least four point pairs: normalised linear solution, then Gauss-Newton on the reprojection error."""
    p, q = np.asarray(image, float), np.asarray(world, float)
    if p.shape != q.shape or p.ndim != 2 or p.shape[1] != 2 or len(p) < 4:
        raise ValueError("at least 4 pairs of 2-D points of equal number are needed")
    tp, tq = _normaliser(p), _normaliser(q)
    u, v = _apply(tp, p), _apply(tq, q)
    rows = []
    for (x, y), (a, b) in zip(u, v):
        rows += [[x, y, 1, 0, 0, 0, -a * x, -a * y, -a], [0, 0, 0, x, y, 1, -b * x, -b * y, -b]]
    h = np.linalg.inv(tq) @ np.linalg.svd(np.array(rows))[2][-1].reshape(3, 3) @ tp
    h /= h[2, 2]
    if len(p) > 4:
        for _ in range(steps):
            w = p @ h[2, :2] + 1
            f = _apply(h, p)
            zero, one = np.zeros_like(w), np.ones_like(w)
            jx = np.c_[p / w[:, None], one / w, zero, zero, zero, -f[:, :1] * p / w[:, None]]
            jy = np.c_[zero, zero, zero, p / w[:, None], one / w, -f[:, 1:] * p / w[:, None]]
            step = np.linalg.lstsq(np.r_[jx, jy], np.r_[q[:, 0] - f[:, 0], q[:, 1] - f[:, 1]], rcond=None)[0]
            h = (h.ravel() + np.append(step, 0)).reshape(3, 3)
            if np.abs(step).max() < 1e-14 * np.abs(h).max():
                break
    return Homography(h, float(np.sqrt(((_apply(h, p) - q) ** 2).sum(1).mean())))


def _linear(n: np.ndarray) -> np.ndarray:
    """The least eigenvector of the 9 x 9 normal matrix from its sums over m m^T, a m m^T, b m m^T and (a^2 + b^2) m m^T."""
    one, by_a, by_b, by_both = (np.array([[t[0], t[1], t[2]], [t[1], t[3], t[4]], [t[2], t[4], t[5]]]) for t in np.reshape(n, (4, 6)))
    zero = np.zeros((3, 3))
    h = np.linalg.eigh(np.block([[one, zero, -by_a], [zero, one, -by_b], [-by_a, -by_b, by_both]]))[1][:, 0].reshape(3, 3)
    return h / h[2, 2]


def _step(points: DataFrame, fits: DataFrame) -> dict:
    """One Gauss-Newton step of every camera: its 8 x 8 normal matrix, right side and squared error are sums over the points."""
    h = lambda i: F.get("h", F.lit(i))
    x, y, w = F.col("u"), F.col("v"), F.col("w")
    rows = points.join(F.broadcast(fits), "camera").withColumn("w", h(6) * F.col("u") + h(7) * F.col("v") + h(8))  # one row for each camera
    rows = rows.withColumns({"fx": (h(0) * x + h(1) * y + h(2)) / w, "fy": (h(3) * x + h(4) * y + h(5)) / w})
    fx, fy, zero = F.col("fx"), F.col("fy"), F.lit(0.0)
    jx = [x / w, y / w, 1 / w, zero, zero, zero, -fx * x / w, -fx * y / w]
    jy = [zero, zero, zero, x / w, y / w, 1 / w, -fy * x / w, -fy * y / w]
    rx, ry = F.col("a") - fx, F.col("b") - fy
    at = [(i, j) for i in range(8) for j in range(i, 8)]
    sums = [*(jx[i] * jx[j] + jy[i] * jy[j] for i, j in at), *(p * rx + q * ry for p, q in zip(jx, jy)), rx * rx + ry * ry]
    out = {}
    for r in rows.groupBy("camera").agg(F.array(*map(F.sum, sums)).alias("s")).collect():  # one row for each camera
        m = np.zeros((8, 8))
        for (i, j), v in zip(at, r["s"]):
            m[i, j] = m[j, i] = v
        out[r["camera"]] = (np.linalg.lstsq(m, np.array(r["s"][36:44]), rcond=None)[0], r["s"][44])
    return out


def fit_homographies(points: DataFrame, camera_col: str = "camera", steps: int = 10) -> DataFrame:
    """(camera, h array of 9, rms_error) from columns image_x, image_y, world_x, world_y; cameras are fitted apart.

    Points stay where they are: the normalisers, the linear solution and each Gauss-Newton step come from
    sums over them, and only those matrices, a few dozen numbers for each camera, are solved on the driver.
    Points with a missing coordinate are left out; a camera with fewer than four is an error.
    """
    spark, kind = points.sparkSession, points.schema[camera_col].dataType.simpleString()
    names = {"u": "image_x", "v": "image_y", "a": "world_x", "b": "world_y"}
    rows = points.select(F.col(camera_col).alias("camera"), *(F.col(c).cast("double").alias(k) for k, c in names.items())).dropna(subset=list(names))
    moments = rows.groupBy("camera").agg(F.count("*").alias("n"), *(f(k).alias(f"{n}_{k}") for k in names for n, f in (("mean", F.avg), ("var", F.var_pop))))
    scales = {}
    for r in moments.collect():  # one row for each camera
        if r["n"] < 4:
            raise ValueError("at least 4 pairs of 2-D points of equal number are needed")
        side = lambda p, q: np.sqrt(2) / max(np.sqrt(r[f"var_{p}"] + r[f"var_{q}"]), 1e-12)  # noqa: B023, E731
        scales[r["camera"]] = (r["n"], *(np.array([[s, 0, -s * r[f"mean_{p}"]], [0, s, -s * r[f"mean_{q}"]], [0, 0, 1]]) for p, q in ("uv", "ab") for s in [side(p, q)]))
    if not scales:
        return spark.createDataFrame([], f"{camera_col} {kind}, h array<double>, rms_error double")
    parts = spark.createDataFrame([(c, [float(t[0, 0]) for t in ts], [float(t[i, 2]) for t in ts for i in (0, 1)]) for c, (_, *ts) in scales.items()], f"camera {kind}, s array<double>, o array<double>")
    scaled = rows.join(F.broadcast(parts), "camera").select("camera", *((F.col(k) * F.get("s", F.lit(i // 2)) + F.get("o", F.lit(i))).alias(k) for i, k in enumerate(names))).persist()
    try:
        x, y, a, b, one = F.col("u"), F.col("v"), F.col("a"), F.col("b"), F.lit(1.0)
        sums = [F.sum(f * m) for f in (one, a, b, a * a + b * b) for m in (x * x, x * y, x, y * y, y, one)]
        fits = {r["camera"]: _linear(np.array(r["s"])) for r in scaled.groupBy("camera").agg(F.array(*sums).alias("s")).collect()}
        for i in range(steps + 1):
            table = spark.createDataFrame([(c, h.ravel().tolist()) for c, h in fits.items()], f"camera {kind}, h array<double>")
            found = _step(scaled, table)
            moved = {c for c, (d, _) in found.items() if scales[c][0] > 4 and np.abs(d).max() >= 1e-14 * np.abs(fits[c]).max()}
            if i == steps or not moved:
                break
            fits = {c: (h.ravel() + np.append(found[c][0], 0)).reshape(3, 3) if c in moved else h for c, h in fits.items()}
    finally:
        scaled.unpersist()
    out = []
    for c, h in fits.items():
        n, tp, tq = scales[c]
        h = np.linalg.inv(tq) @ h @ tp
        out.append((c, (h / h[2, 2]).ravel().tolist(), float(np.sqrt(found[c][1] / n) / tq[0, 0])))
    return spark.createDataFrame(out, f"{camera_col} {kind}, h array<double>, rms_error double")
