"""Regions from vertex tables ``(region, part, ring, seq, x, y)``; the last vertex of a ring repeats the first.

Sides are joined by sorting both tables. Spark takes a table whose rows it cannot foresee, such as exploded corners and
cells, for as small as the file it comes from, and would send all of it through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def segments(boundaries: DataFrame, digits: int = 7) -> DataFrame:
    """The sides of all rings, ends in a fixed order, coordinates rounded."""
    w = Window.partitionBy("region", "part", "ring").orderBy("seq")
    ends = boundaries.select("region", "part", "ring", *[F.round(c, digits).alias(c) for c in ("x", "y")], *[F.round(F.lead(c).over(w), digits).alias(f"{c}2") for c in ("x", "y")])
    a, b = F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    return ends.where("x2 IS NOT NULL").select("region", "part", "ring", F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def noded(boundaries: DataFrame, digits: int = 7) -> DataFrame:
    """The sides of all rings, cut at every vertex of any ring that lies on them: ``(region, part, ring, a, b)``.

    After that, rings that meet do so in whole pieces and in ends of pieces, also where one side ends in the middle of
    another or covers a part of it. Sides are dealt to the grid cells that they pass, vertices to their own cell, and
    only those of one cell are compared. A vertex is on a side if it is within the rounding of it. Sides that cross
    are not cut: regions that overlap do not touch there. Sides of no length go.
    """
    sides = segments(boundaries, digits).where("a <> b")
    size = sides.agg(F.avg(F.greatest(F.abs(F.col("b.x") - F.col("a.x")), F.abs(F.col("b.y") - F.col("a.y"))))).first()[0]
    cell, near = float(size or 1.0), 10.0**-digits
    ax, ay, bx, by = F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y")
    columns = sides.withColumn("cx", F.explode(F.sequence(F.floor((ax - near) / cell), F.floor((bx + near) / cell))))  # a is the left end
    # what of the side lies in the column of cells
    slope = F.try_divide(by - ay, bx - ax)
    height = lambda x: F.coalesce(ay + slope * (F.least(F.greatest(x, ax), bx) - ax), ay)
    low, high = height(F.col("cx") * cell - near), F.when(bx - ax <= near, by).otherwise(height((F.col("cx") + 1) * cell + near))
    first, last = (F.floor((f(low, high) + d) / cell) for f, d in ((F.least, -near), (F.greatest, near)))
    celled = columns.withColumn("cy", F.explode(F.sequence(first, last)))
    points = sides.select(F.explode(F.array("a", "b")).alias("p")).distinct().withColumns({"cx": F.floor(F.col("p.x") / cell), "cy": F.floor(F.col("p.y") / cell)})
    along = ((F.col("p.x") - ax) * (bx - ax) + (F.col("p.y") - ay) * (by - ay)) / (F.pow(bx - ax, 2) + F.pow(by - ay, 2))
    off = F.hypot(F.col("p.x") - ax - F.col("t") * (bx - ax), F.col("p.y") - ay - F.col("t") * (by - ay))
    on = celled.join(points.hint("merge"), ["cx", "cy"]).where("p <> a AND p <> b").withColumn("t", along).where((F.col("t") > 0) & (F.col("t") < 1) & (off <= near))
    cuts = on.groupBy("a", "b").agg(F.sort_array(F.collect_set(F.struct("t", "p"))).alias("cuts"))  # the vertices on one side
    stops = F.concat(F.array("a"), F.transform(F.coalesce("cuts", F.array()), lambda c: c["p"]), F.array("b"))
    whole = sides.join(cuts.hint("merge"), ["a", "b"], "left").withColumn("stops", stops)
    pieces = F.explode(F.arrays_zip(F.slice("stops", F.lit(1), F.size("stops") - 1).alias("a"), F.slice("stops", F.lit(2), F.size("stops") - 1).alias("b")))
    return whole.select("region", "part", "ring", pieces.alias("s")).select("region", "part", "ring", F.least("s.a", "s.b").alias("a"), F.greatest("s.a", "s.b").alias("b"))


def dissolve(boundaries: DataFrame, digits: int = 7) -> DataFrame:
    """The outline of each region, in pieces: those that an odd number of its rings have. Parts may meet along parts of
    their sides."""
    return noded(boundaries, digits).groupBy("region", "a", "b").agg(F.count("*").alias("n")).where("n % 2 = 1").select("region", "a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))


def contacts(boundaries: DataFrame, digits: int = 7) -> DataFrame:
    """Pairs of regions whose boundaries meet, both directions: ``(src, dst, length)`` of the border that they share, 0 where they meet
    in points alone."""
    pieces = noded(boundaries, digits).select("region", "a", "b").distinct()
    other = pieces.withColumnRenamed("region", "other")
    length = F.hypot(F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"))
    along = pieces.join(other.hint("merge"), ["a", "b"]).where("region < other").select("region", "other", length.alias("length"))
    ends = pieces.select("region", F.explode(F.array("a", "b")).alias("p")).distinct()
    at = ends.join(ends.withColumnRenamed("region", "other").hint("merge"), "p").where("region < other").select("region", "other", F.lit(0.0).alias("length"))
    pairs = along.unionByName(at).groupBy("region", "other").agg(F.sum("length").alias("length"))
    return mirrored(pairs.select(F.col("region").alias("src"), F.col("other").alias("dst"), F.col("length").alias("w"))).withColumnRenamed("w", "length")


def touch_edges(boundaries: DataFrame, digits: int = 7) -> DataFrame:
    """Pairs of regions whose boundaries meet, in a border or in a point, both directions, weight 1."""
    return contacts(boundaries, digits).select("src", "dst", F.lit(1.0).alias("w"))


def mirrored(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def near_edges(boundaries: DataFrame, tol: float = 0.01) -> DataFrame:
    """Pairs of regions with sides at most ``2 * tol`` apart, as if both were widened by ``tol``.

    Sides are dealt to the grid cells that their box, widened by the tolerance, touches; only sides in one cell are
    compared."""
    reach = 2 * tol
    sides = segments(boundaries).select("region", F.col("a.x").alias("x1"), F.col("a.y").alias("y1"), F.col("b.x").alias("x2"), F.col("b.y").alias("y2"))
    size = sides.agg(F.avg(F.greatest(F.abs(F.col("x2") - F.col("x1")), F.abs(F.col("y2") - F.col("y1"))))).first()[0] or 0.0
    cell = max(reach, float(size)) or 1.0
    span = lambda a, b: F.sequence(F.floor((F.least(a, b) - reach) / cell), F.floor((F.greatest(a, b) + reach) / cell))
    celled = sides.withColumn("cx", F.explode(span(F.col("x1"), F.col("x2")))).withColumn("cy", F.explode(span(F.col("y1"), F.col("y2"))))
    other = celled.withColumnsRenamed({c: f"{c}_b" for c in ("region", "x1", "y1", "x2", "y2")})
    near = _apart([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"{c}_b") for c in ("x1", "y1", "x2", "y2")]) <= reach + 1e-12
    pairs = celled.join(other.hint("merge"), ["cx", "cy"]).where((F.col("region") < F.col("region_b")) & near).select("region", "region_b").distinct()
    return mirrored(pairs.select(F.col("region").alias("src"), F.col("region_b").alias("dst"), F.lit(1.0).alias("w")))


def _apart(p: list[Column], q: list[Column]) -> Column:
    """Distance of two segments: 0 where they cross, else the least of the ends' distances."""

    def to_side(x: Column, y: Column, s: list[Column]) -> Column:
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = F.coalesce(F.try_divide((x - s[0]) * dx + (y - s[1]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))
        return F.hypot(x - s[0] - t * dx, y - s[1] - t * dy)

    turn = lambda s, x, y: F.signum((s[2] - s[0]) * (y - s[1]) - (s[3] - s[1]) * (x - s[0]))
    cross = (turn(p, q[0], q[1]) * turn(p, q[2], q[3]) < 0) & (turn(q, p[0], p[1]) * turn(q, p[2], p[3]) < 0)
    return F.when(cross, F.lit(0.0)).otherwise(F.least(to_side(p[0], p[1], q), to_side(p[2], p[3], q), to_side(q[0], q[1], p), to_side(q[2], q[3], p)))


def centroids(boundaries: DataFrame) -> DataFrame:
    """Area centroid of each region; the winding of rings tells holes from parts."""
    w = Window.partitionBy("region", "part", "ring").orderBy("seq")
    sides = boundaries.select("region", "x", "y", F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2")).where("x2 IS NOT NULL")
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = sides.groupBy("region").agg(F.sum(cross).alias("a"), F.sum((F.col("x") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("sy"))
    return sums.select("region", F.try_divide("sx", F.col("a") * 3).alias("x"), F.try_divide("sy", F.col("a") * 3).alias("y"), F.abs(F.col("a") / 2).alias("area"))


def to_utm(lon: Column, lat: Column, zone: int = 43) -> tuple[Column, Column]:
    """Easting and northing in metres on the WGS 84 ellipsoid, by the series of the transverse Mercator projection."""
    a, e2, k = 6378137.0, 0.00669437999014, 0.9996  # fixed values: axis, squared eccentricity, scale
    ep2 = e2 / (1 - e2)
    phi, lam = F.radians(lat), F.radians(lon - F.lit(6.0 * zone - 183.0))
    n = a / F.sqrt(1 - e2 * F.pow(F.sin(phi), 2))
    t, c, u = F.pow(F.tan(phi), 2), ep2 * F.pow(F.cos(phi), 2), F.cos(phi) * lam
    m = a * (
        (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * phi - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * phi)
        + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * phi) - (35 * e2**3 / 3072) * F.sin(6 * phi)
    )
    east = 500000.0 + k * n * (u + (1 - t + c) * F.pow(u, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(u, 5) / 120)
    north = k * (m + n * F.tan(phi) * (u * u / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(u, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(u, 6) / 720))
    return east, north
