"""Column arithmetic on pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optical densities of haematoxylin, eosin and DAB in red, green and blue.
STAINS = ((0.65, 0.70, 0.29), (0.07, 0.99, 0.11), (0.27, 0.57, 0.78))


def _inverse(m):
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    return (
        ((e * i - f * h) / det, (c * h - b * i) / det, (b * f - c * e) / det),
        ((f * g - d * i) / det, (a * i - c * g) / det, (c * d - a * f) / det),
        ((d * h - e * g) / det, (b * g - a * h) / det, (a * e - b * d) / det),
    )


def rgb_to_hed(r: Column, g: Column, b: Column) -> list[Column]:
    """Amounts of the three stains in a pixel with channels from 0 to 255; none is negative."""
    density = [F.ln(F.greatest(x / 255.0, F.lit(1e-6))) / F.ln(F.lit(1e-6)) for x in (r, g, b)]
    inverse = _inverse(STAINS)
    return [F.greatest(sum((density[k] * inverse[k][j] for k in range(3)), F.lit(0.0)), F.lit(0.0)) for j in range(3)]


def hed_to_rgb(h: Column, e: Column, d: Column) -> list[Column]:
    mixed = [sum((x * STAINS[k][j] for k, x in enumerate((h, e, d))), F.lit(0.0)) for j in range(3)]
    return [F.least(F.greatest(F.exp(m * F.ln(F.lit(1e-6))), F.lit(0.0)), F.lit(1.0)) * 255 for m in mixed]


def eosin_only(r: Column, g: Column, b: Column) -> list[Column]:
    return hed_to_rgb(F.lit(0.0), rgb_to_hed(r, g, b)[1], F.lit(0.0))


def near_white(r: Column, g: Column, b: Column, least: float = 230) -> Column:
    return (r + g + b) / 3 > least
