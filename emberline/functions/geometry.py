"""Ellipses, rings and distances as Column expressions. Rings are arrays of struct (lat, lng)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M_PER_DEG = 111320.0
_RAD = math.pi / 180.0


def m_per_deg_lng(lat: Column) -> Column:
    return M_PER_DEG * F.cos(lat * _RAD)


def length_to_breadth(wind: Column) -> Column:
    return F.when(wind <= 0, 1.0).otherwise(1.0 + 8.729 * F.pow(1.0 - F.exp(-0.030 * F.greatest(wind, F.lit(0.0))), 2.155))


def eccentricity(lbr: Column) -> Column:
    return F.when(lbr <= 1, 0.0).otherwise(F.sqrt(F.greatest(1.0 - 1.0 / (lbr * lbr), F.lit(0.0))))


def back_ros(head: Column, lbr: Column) -> Column:
    return head / (lbr * lbr)


def flank_ros(head: Column, lbr: Column) -> Column:
    return head / lbr


def ellipse_area_ha(head: Column, lbr: Column, hours: Column) -> Column:
    """Area of a fire that has spread for ``hours`` at ``head`` m/min."""
    a = (head + back_ros(head, lbr)) * hours * 60.0 / 2.0
    return math.pi * a * (a / lbr) / 10000.0


def directional_slope(slope: Column, aspect: Column, bearing: Column) -> Column:
    """Factor on the rate of spread towards ``bearing``: up to 2 uphill, down to 0.7 downhill."""
    d = F.abs(bearing - aspect)
    d = F.when(d > 180.0, 360.0 - d).otherwise(d)
    c = F.cos(d * _RAD)
    most = F.least(F.exp(3.533 * F.pow(F.greatest(slope, F.lit(0.0)) / 100.0, 1.2)), F.lit(2.0))
    return F.when(slope < 1.0, 1.0).when(c > 0, 1.0 + (most - 1.0) * c).otherwise(1.0 - 0.3 * F.abs(c))


def spread_probability(angle: Column, bearing: Column, ros: Column, lbr: Column, cell_m: Column, dt: Column) -> Column:
    """Chance that fire crosses to the neighbour at ``angle`` within ``dt`` minutes."""
    d = F.pmod(angle - bearing, F.lit(360.0))
    d = F.when(d > 180.0, 360.0 - d).otherwise(d)
    toward = ros * F.pow(1.0 / (lbr * lbr), d / 180.0)
    return F.when(ros < 1e-10, 0.0).otherwise(F.least(F.lit(1.0), toward * dt / cell_m))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin((lat2 - lat1) * _RAD / 2.0), 2.0) + F.cos(lat1 * _RAD) * F.cos(lat2 * _RAD) * F.pow(F.sin((lng2 - lng1) * _RAD / 2.0), 2.0)
    return 2.0 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def circle(lat: Column, lng: Column, radius_m: Column, n: int = 12) -> Column:
    """A ring of n points, from north clockwise."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda i: F.struct((lat + radius_m * F.cos(i * (2.0 * math.pi / n)) / M_PER_DEG).alias("lat"), (lng + radius_m * F.sin(i * (2.0 * math.pi / n)) / m_per_deg_lng(lat)).alias("lng")),
    )


def _rotated(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def vertex_mean(ring: Column) -> Column:
    """(lat, lng) of the mean of the vertices; (0, 0) of an empty ring."""
    n = F.greatest(F.size(ring), F.lit(1))
    return F.struct((_sum(F.transform(ring, lambda p: p["lat"])) / n).alias("lat"), (_sum(F.transform(ring, lambda p: p["lng"])) / n).alias("lng"))


def area_ha(ring: Column) -> Column:
    """Area inside a ring, open or closed; degrees of longitude are scaled at the mean latitude. 0 with fewer than 3 points."""
    scale = m_per_deg_lng(vertex_mean(ring)["lat"])
    cross = F.zip_with(ring, _rotated(ring), lambda p, q: p["lng"] * q["lat"] - q["lng"] * p["lat"])
    return F.when(F.size(ring) < 3, 0.0).otherwise(F.abs(_sum(cross)) / 2.0 * M_PER_DEG * scale / 10000.0)


def length_km(ring: Column) -> Column:
    return _sum(F.zip_with(ring, _rotated(ring), lambda p, q: haversine_km(p["lat"], p["lng"], q["lat"], q["lng"])))


def closed(ring: Column) -> Column:
    """The ring with its first point again at the end."""
    return F.concat(ring, F.slice(ring, 1, 1))


def scaled(ring: Column, factor: Column, middle: Column | None = None) -> Column:
    """The ring, scaled about the mean of its vertices, which may be given as a column."""
    c = vertex_mean(ring) if middle is None else middle
    return F.transform(ring, lambda p: F.struct((c["lat"] + (p["lat"] - c["lat"]) * factor).alias("lat"), (c["lng"] + (p["lng"] - c["lng"]) * factor).alias("lng")))


def contains(ring: Column, lat: Column, lng: Column) -> Column:
    """Whether a point is inside a ring: an odd number of edges crosses the ray to the east."""
    crosses = F.zip_with(
        ring, _rotated(ring),
        lambda p, q: ((p["lat"] > lat) != (q["lat"] > lat)) & (lng < (q["lng"] - p["lng"]) * (lat - p["lat"]) / F.nullif(q["lat"] - p["lat"], F.lit(0.0)) + p["lng"]),
    )
    return F.size(F.filter(crosses, lambda c: c)) % 2 == 1


def ellipse_ring(lat: Column, lng: Column, head: Column, lbr: Column, bearing: Column, minutes: Column, n: int = 72) -> Column:
    """A closed ring of n + 1 points: the ellipse burned in ``minutes`` from one point, its rear focus."""
    a = (head + back_ros(head, lbr)) * minutes / 2.0
    b, ahead, turn = a / lbr, (head - back_ros(head, lbr)) * minutes / 2.0, bearing * _RAD

    def point(i: Column) -> Column:
        t = i * (2.0 * math.pi / n)
        along, across = ahead + a * F.cos(t), b * F.sin(t)
        north, east = along * F.cos(turn) - across * F.sin(turn), along * F.sin(turn) + across * F.cos(turn)
        return F.struct((lat + north / M_PER_DEG).alias("lat"), (lng + east / m_per_deg_lng(lat)).alias("lng"))

    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: point(F.pmod(i, F.lit(n))))


def ellipse_points(df: DataFrame, lat: float, lng: float, head: Column, lbr: Column, bearing: Column, minutes: float, n: int = 72) -> DataFrame:
    """df with a row for each point of ellipse_ring: i and the point's lat and lng. What a scenario's points share is computed once, and the table of angles is a constant."""
    own = {"__a": (head + back_ros(head, lbr)) * minutes / 2.0, "__ahead": (head - back_ros(head, lbr)) * minutes / 2.0, "__lbr": lbr, "__cos": F.cos(bearing * _RAD), "__sin": F.sin(bearing * _RAD)}
    angles = [F.lit(i % n).cast("int") * (2.0 * math.pi / n) for i in range(n + 1)]
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.cos(t).alias("u"), F.sin(t).alias("v")) for i, t in enumerate(angles)])
    # the rows are made by a generator, below which the shared columns stay
    x = df.select("*", *[c.alias(k) for k, c in own.items()]).select("*", F.explode(table).alias("__p"))
    along, across = F.col("__ahead") + F.col("__a") * F.col("__p.u"), F.col("__a") / F.col("__lbr") * F.col("__p.v")
    north, east = along * F.col("__cos") - across * F.col("__sin"), along * F.col("__sin") + across * F.col("__cos")
    return x.select(*df.columns, F.col("__p.i").alias("i"), (lat + north / M_PER_DEG).alias("lat"), (lng + east / m_per_deg_lng(F.lit(lat))).alias("lng"))


def geojson(ring: Column, properties: Column) -> Column:
    """A GeoJSON feature of the ring, closed once; an empty ring has no coordinates."""
    points = F.array_join(F.transform(closed(ring), lambda p: F.concat(F.lit("["), F.round(p["lng"], 6).cast("decimal(12,6)").cast("string"), F.lit(","), F.round(p["lat"], 6).cast("decimal(12,6)").cast("string"), F.lit("]"))), ",")
    body = F.when(F.size(ring) == 0, "[]").otherwise(F.concat(F.lit("[["), points, F.lit("]]")))
    return F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), body, F.lit('},"properties":'), properties, F.lit("}"))


def convex_hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull of (lat, lng) points, by the sides of consecutive turns along the sorted points."""
    points = sorted(set(points))
    if len(points) <= 2:
        return points
    halves = []
    for run in (points, points[::-1]):
        half: list[tuple[float, float]] = []
        for p in run:
            while len(half) > 1 and (half[-1][0] - half[-2][0]) * (p[1] - half[-2][1]) - (half[-1][1] - half[-2][1]) * (p[0] - half[-2][0]) <= 0:
                half.pop()
            half.append(p)
        halves += half[:-1]
    return halves
