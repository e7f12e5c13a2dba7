"""Scores of single nodes and the colours of clusters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GREY = "#808080"


def life_score(significance: Column, access_count: Column, last_access: Column, as_of: int | Column) -> Column:
    """(2 accesses + 10 significance) / (hours since + 2) ** 1.8; a last access in the future counts as now."""
    as_of = F.lit(as_of) if isinstance(as_of, int) else as_of
    hours = F.greatest(as_of - last_access, F.lit(0)) / F.lit(3600.0)
    return (access_count * 2.0 + significance * 10.0) / F.pow(hours + 2.0, F.lit(1.8))


def bio_score(significance: Column, access_count: Column, life: Column) -> Column:
    return significance / F.lit(255.0) * 0.4 + F.least(life / 10.0, F.lit(1.0)) * 0.3 + F.least(access_count / F.lit(100.0), F.lit(1.0)) * 0.3


def label(content: Column, node: Column, most: int = 30) -> Column:
    return F.coalesce(F.substring(content, 1, most), F.concat(F.lit("Node "), node.cast("string")))


def hsl_colour(hue: Column, s: float = 0.75, light: float = 0.55) -> Column:
    """#RRGGBB; channels are cut, not rounded, and a hue of 360 or more keeps the last sector."""
    c = (1 - abs(2 * light - 1)) * s
    m = light - c / 2
    sector = F.floor(hue).cast("int")
    place = hue / 60.0
    x = F.lit(c) * (1 - F.abs(place - 2 * F.floor(place / 2.0) - 1))
    k = F.floor(sector / 60)
    zero, full = F.lit(0.0), F.lit(c)

    def pick(*of: Column) -> Column:
        out = F.when(k == 0, of[0])
        for i in range(1, 5):
            out = out.when(k == i, of[i])
        return out.otherwise(of[5])

    rgb = pick(full, x, zero, zero, x, full), pick(x, full, full, x, zero, zero), pick(zero, zero, x, full, full, x)
    return F.concat(F.lit("#"), *[F.lpad(F.hex(F.floor((v + m) * 255.0).cast("long")), 2, "0") for v in rgb])


def cluster_colour(cluster: Column, roots: Column) -> Column:
    return hsl_colour(cluster / F.greatest(roots, F.lit(1)) * 360.0)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    """#rrggbb of channels from 0 to 1, rounded to even."""
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(F.rint(v * 255.0).cast("long")), 2, "0")) for v in (r, g, b)])


def palette_colour(hue: Column, s: float = 0.75, light: float = 0.55) -> Column:
    """The colour of a hue from 0 to 1."""
    high = light + s - light * s if light > 0.5 else light * (1 + s)
    low = 2 * light - high

    def channel(h: Column) -> Column:
        h = h - F.floor(h)
        rising = F.lit(low) + (high - low) * h * 6.0
        falling = F.lit(low) + (high - low) * (F.lit(2 / 3) - h) * 6.0
        return F.when(h < 1 / 6, rising).when(h < 0.5, F.lit(high)).when(h < 2 / 3, falling).otherwise(F.lit(low))

    return hex_colour(channel(hue + 1 / 3), channel(hue), channel(hue - 1 / 3))
