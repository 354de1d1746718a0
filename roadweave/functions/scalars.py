"""Column builders: casts, classes, geometry, time to collision and severity. All stay in generated code."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadweave.functions.vocabulary import ACTOR_CLASSES, PAIR_RADII, SIZE_PRIORS

INF = float("inf")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(value: float | int | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def nan_to_null(c: Column | str) -> Column:
    c = col(c).cast("double")
    return F.when(~F.isnan(c), c)


def require_columns(df: DataFrame, *names: str) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"Missing columns: {missing}")


def safe_float(c: Column | str, default: float = 0.0) -> Column:
    """Number of any column; null, unparsable, NaN and infinite values give the default."""
    v = col(c).try_cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == INF), float(default)).otherwise(v)


def wrap_angle(theta: Column | str) -> Column:
    """Into (-pi, pi]."""
    return F.atan2(F.sin(col(theta)), F.cos(col(theta)))


def actor_class(*names: Column | str, classes: list[str] | None = None) -> Column:
    """First name that isn't null or empty, trimmed and lower-cased; ``other`` if none or outside the vocabulary."""
    found = F.lower(F.trim(F.coalesce(*(F.nullif(col(n), F.lit("")) for n in names), F.lit("other"))))
    return F.when(found.isin(ACTOR_CLASSES if classes is None else classes), found).otherwise("other")


def class_index(name: Column | str, classes: list[str] | None = None, strict: bool = True) -> Column:
    """Position in the vocabulary; unknown names go to ``other``. A vocabulary without it is an error (strict) or means the last class."""
    classes = ACTOR_CLASSES if classes is None else classes
    at = F.array_position(F.array(*map(F.lit, classes)), col(name)) - 1
    if "other" in classes:
        rest = F.lit(classes.index("other"))
    else:
        rest = F.raise_error(F.lit("class outside a vocabulary without 'other'")).cast("int") if strict else F.lit(len(classes) - 1)
    return F.when(at >= 0, at.cast("int")).otherwise(rest)


def one_hot(name: Column | str, classes: list[str] | None = None) -> Column:
    classes = ACTOR_CLASSES if classes is None else classes
    at = class_index(name, classes, strict=False)
    return F.array(*(F.when(at == i, 1.0).otherwise(0.0) for i in range(len(classes))))


def size_prior(name: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SIZE_PRIORS.items() for x in kv))
    return F.coalesce(table[col(name)], F.lit(SIZE_PRIORS["other"]))


def pair_radius(a: Column | str, b: Column | str, default: float, radii: dict[tuple[str, str], float] | None = None) -> Column:
    """Radius of (a, b), else of (b, a), else the default."""
    radii = PAIR_RADII if radii is None else radii
    if not radii:
        return F.lit(float(default))
    table = F.create_map(*(F.lit(x) for (p, q), r in radii.items() for x in (f"{p}|{q}", float(r))))
    return F.coalesce(table[F.concat_ws("|", col(a), col(b))], table[F.concat_ws("|", col(b), col(a))], F.lit(float(default)))


def distance(dx: Column | str, dy: Column | str) -> Column:
    """Root of the sum of squares. ``F.hypot`` rounds otherwise in the last bit, which decides ties of distances."""
    dx, dy = col(dx), col(dy)
    return F.sqrt(dx * dx + dy * dy)


def round_digits(c: Column | str, digits: int = 6) -> Column:
    """A double rounded half away from zero as DuckDB rounds, by a product and a division; zeros are positive.

    ``F.round`` goes by the text of each number, which costs more than all else of a pair or edge.
    """
    c = col(c).cast("double")
    scaled = c * F.lit(10.0**digits)
    whole, sign = F.rint(scaled), F.signum(scaled)
    tie = ((scaled - whole) * sign == 0.5).cast("double") * sign  # ``rint`` takes ties to the even side
    return F.when(F.abs(c) < 1e300, (whole + tie) / F.lit(10.0**digits) + 0.0).otherwise(c)


def most_square(r: float) -> float:
    """The greatest number whose root, as rounded, is at most r: squares can then be compared in place of distances."""
    t = r * r
    while np.sqrt(np.nextafter(t, np.inf)) <= r:
        t = np.nextafter(t, np.inf)
    while np.sqrt(t) > r:
        t = np.nextafter(t, 0.0)
    return float(t)


def closing_speed(dx, dy, dvx, dvy, distance) -> Column:
    """Speed at which a pair approaches; 0 for coinciding places."""
    dx, dy, dvx, dvy, distance = map(col, (dx, dy, dvx, dvy, distance))
    return F.when(distance <= 1e-8, 0.0).otherwise(-(dvx * dx + dvy * dy) / F.when(distance > 1e-8, distance))


def _roots(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    disc = b * b - 4 * a * c
    root = F.sqrt(F.greatest(disc, F.lit(0.0)))
    safe = F.when(a > 0, 2 * a)
    return disc, (-b - root) / safe, (-b + root) / safe


def ttc_simple(dx, dy, dvx, dvy, collision_radius: float = 1.5, max_ttc: float = 10.0) -> Column:
    """Least t in [0, max_ttc] at which the gap is the radius; else max_ttc."""
    dx, dy, dvx, dvy = map(col, (dx, dy, dvx, dvy))
    a, b, c = dvx * dvx + dvy * dvy, 2 * (dx * dvx + dy * dvy), dx * dx + dy * dy - collision_radius**2
    disc, low, high = _roots(a, b, c)
    fits = lambda t: F.when((t >= 0) & (t <= max_ttc), t)
    return F.when((a < 1e-8) | (disc < 0), max_ttc).otherwise(F.coalesce(F.least(fits(low), fits(high)), F.lit(float(max_ttc))))


def ttc_constant_velocity(x1, y1, vx1, vy1, x2, y2, vx2, vy2, min_distance: float | Column = 1.5, separation_in_status: bool = True) -> Column:
    """struct(ttc_seconds, collision_x, collision_y, is_approaching, status, min_separation); infinite if no collision is ahead.

    Without ``separation_in_status`` the status is plain ``no_collision``, so that no text is formatted for each pair.
    """
    x1, y1, vx1, vy1, x2, y2, vx2, vy2 = map(col, (x1, y1, vx1, vy1, x2, y2, vx2, vy2))
    dx, dy, dvx, dvy, gap = x2 - x1, y2 - y1, vx2 - vx1, vy2 - vy1, number(min_distance)
    a, dot = dvx * dvx + dvy * dvy, dx * dvx + dy * dvy
    disc, low, high = _roots(a, 2 * dot, dx * dx + dy * dy - gap * gap)
    ahead = lambda t: F.when(t > 0, t)
    first = F.least(ahead(low), ahead(high))
    near = -dot / F.when(a >= 1e-12, a)
    separation = F.hypot(dx + near * dvx, dy + near * dvy)
    still, away, apart = a < 1e-12, -dot <= 0, disc < 0
    status = (
        F.when(still, "zero_relative_speed").when(away, "diverging_or_parallel")
        .when(apart, F.format_string("no_collision_min_sep_%.3f", separation) if separation_in_status else F.lit("no_collision"))
        .when(first.isNull(), "collision_in_past_or_now").otherwise("collision_predicted")
    )
    hit = ~(still | away | apart) & first.isNotNull()
    return F.struct(
        F.when(hit, first).otherwise(INF).alias("ttc_seconds"),
        F.when(hit, x1 + vx1 * first).alias("collision_x"), F.when(hit, y1 + vy1 * first).alias("collision_y"),
        (~(still | away)).alias("is_approaching"), status.alias("status"), F.when(~(still | away) & apart, separation).alias("min_separation"),
    )


def ttc_is_critical(t: Column | str) -> Column:
    return (col(t) > 0) & (col(t) <= 3)


def pet_is_critical(t: Column | str) -> Column:
    return (col(t) >= 0) & (col(t) <= 3)


def severity(t: Column | str) -> Column:
    """1 at or below zero seconds, falling to 0 at five; 0 for infinite."""
    t = col(t)
    return F.when(t == INF, 0.0).when(t <= 0, 1.0).when(t >= 5, 0.0).otherwise(1 - t / 5)


def drac(closing, gap) -> Column:
    """Deceleration to avoid a crash (an addition): closing speed squared over twice the gap; 0 if not closing."""
    closing, gap = col(closing), col(gap)
    return F.when(closing <= 0, 0.0).otherwise(closing * closing / F.when(gap > 0, 2 * gap))


def sigmoid(x: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(x)))


def z_score(values: Column | str, mean: list[float] | Column | None, std: list[float] | Column | None) -> Column:
    """Arrays normalised position by position; a deviation below 1e-6 counts as 1. No statistics: unchanged."""
    if mean is None or std is None:
        return col(values)
    mean = mean if isinstance(mean, Column) else F.array(*(F.lit(float(m)) for m in mean))
    std = std if isinstance(std, Column) else F.array(*(F.lit(float(s)) for s in std))
    scale = F.transform(std, lambda s: F.when(s < 1e-6, 1.0).otherwise(s))
    return F.zip_with(F.zip_with(col(values), mean, lambda v, m: v - m), scale, lambda d, s: d / s)


def bbox_bottom_center(x1, y1, x2, y2) -> Column:
    return F.struct(((col(x1) + col(x2)) / 2).alias("x"), col(y2).cast("double").alias("y"))


def toy_ssm_value(n_frames: Column | str) -> Column:
    return F.greatest(F.lit(0.0), 5.0 - 0.5 * col(n_frames))
