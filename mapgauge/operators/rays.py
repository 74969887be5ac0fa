"""Camera-ray metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapgauge.functions.masks import ray_valid

#: Degrees up to which errors are integrated, by field-of-view domain.
THRESHOLDS = {"sfov": 15.0, "lfov": 20.0, "pano": 30.0}


def domain_threshold(domain: str) -> float:
    try:
        return THRESHOLDS[domain.lower()]
    except KeyError:
        raise ValueError(f"unknown domain {domain!r}; one of {', '.join(THRESHOLDS)}") from None


def fov_domain(height, width, fx, fy) -> Column:
    """sfov up to 90 degrees of diagonal field of view, pano from 160, lfov between."""
    x, y = width / (2 * fx), height / (2 * fy)
    fov = F.degrees(2 * F.atan(F.sqrt(x * x + y * y)))
    return F.when(fov <= 90, "sfov").when(fov >= 160, "pano").otherwise("lfov")


def angular_errors(px: DataFrame, sky: str | None = None) -> DataFrame:
    """img, angle in degrees between the unit directions, valid rays only."""
    g, p = ([F.col(s + c) for c in "xyz"] for s in "gp")
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cos = dot(g, p) / (F.sqrt(dot(g, g)) * F.sqrt(dot(p, p)))
    rows = px.where(ray_valid("gx", "gy", "gz", "px", "py", "pz"))
    rows = rows.where(~F.coalesce(F.col(sky), F.lit(False))) if sky else rows
    return rows.select("img", F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("angle"))


def rho_a(errors: DataFrame, threshold: float, steps: int = 100, keys: list[str] | None = None) -> DataFrame:
    """rho_a: area under share(angle <= t) for t in [0, threshold], over the threshold, by the trapezoid rule on `steps`
    intervals. Each pixel's share of the area is known from the first grid point that reaches it, so this is one average;
    the grid point is found by comparison with the grid's own values and not by division."""
    a, width = F.col("angle"), threshold / steps
    k = F.ceil(a / width)
    k = F.when((k - 1) * width >= a, k - 1).when(k * width < a, k + 1).otherwise(k)
    weight = F.when(a <= 0, 1.0).when(k <= steps, (steps - k + 0.5) / steps).otherwise(0.0)
    rows = errors if keys is not None else errors
    return rows.groupBy(*(keys if keys is not None else ["img"])).agg(F.avg(weight).alias("rho_a"))


def per_image(errors: DataFrame, threshold: float) -> DataFrame:
    """img, rho_a, mean_angle, median_angle."""
    stats = errors.groupBy("img").agg(F.avg("angle").alias("mean_angle"), F.percentile("angle", 0.5).alias("median_angle"))
    return stats.join(rho_a(errors, threshold), "img")


def angular_summary(errors: DataFrame, limits=(5, 10, 15, 20, 30)) -> DataFrame:
    """mean_angle and shares below the limits in per cent over all pixels."""
    return errors.agg(F.avg("angle").alias("mean_angle"), *[(F.avg(F.when(F.col("angle") < x, 1.0).otherwise(0.0)) * 100).alias(f"percent_below_{x}") for x in limits])
