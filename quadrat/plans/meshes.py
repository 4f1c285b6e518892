"""Boundaries on a generated mesh: a wall of bricks, one for each customer, whose rows are shifted against each other."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.operators import features, geo
from quadrat.plans.panels import table
from quadrat.plans.registry import query as _query

R = features.rounded

#: Bricks of a row, and how far rows are shifted, four in turn: halves, quarters, and two rows alike, whose corners meet.
_WIDE, _SHIFTS = 40, (0.0, 0.5, 0.5, 0.25)

_WALL = f"""WITH wall AS (SELECT c_custkey AS region, c_nationkey AS owner, c_custkey % {_WIDE} + [{', '.join(f'{x}::DOUBLE' for x in _SHIFTS)}][(c_custkey // {_WIDE}) % 4 + 1] AS x, (c_custkey // {_WIDE})::DOUBLE AS y FROM customer),
 met AS (SELECT a.region AS src, b.region AS dst, a.owner AS src_owner, b.owner AS dst_owner, CASE WHEN a.y = b.y THEN 1.0::DOUBLE ELSE least(a.x, b.x) + 1 - greatest(a.x, b.x) END AS length
   FROM wall a JOIN wall b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND a.region <> b.region AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (abs(a.y - b.y) = 1 AND abs(a.x - b.x) <= 1)))"""


def _wall(s, d, region: str):
    """A vertex table of the bricks; ``region``: which column names the regions."""
    shift = F.element_at(F.array(*map(F.lit, _SHIFTS)), (F.floor(F.col("c_custkey") / _WIDE) % 4 + 1).cast("int"))
    corners = F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])]))
    rows = table(s, d, "customer").select(F.col(region).alias("region"), F.col("c_custkey").alias("part"), corners.alias("c"), (F.col("c_custkey") % _WIDE + shift).alias("x0"), F.floor(F.col("c_custkey") / _WIDE).alias("y0"))
    return rows.select("region", "part", F.lit(0).alias("ring"), F.col("c.seq").alias("seq"), (F.col("x0") + F.col("c.dx")).alias("x"), (F.col("y0") + F.col("c.dy")).alias("y"))


@_query(_WALL + " SELECT src, dst, round(length, 6) AS length FROM met")
def brick_contacts(s, d):
    """Which bricks meet, and the length of border that they share: half and quarter sides, and corners."""
    return R(geo.contacts(_wall(s, d, "c_custkey")))


@_query(_WALL + " SELECT owner AS region, round(4 * count(*) - coalesce((SELECT sum(length) FROM met WHERE src_owner = w.owner AND dst_owner = w.owner), 0), 6) AS outline FROM wall w GROUP BY owner")
def dissolved_outlines(s, d):
    """Bricks of one nation made one region each: the length of its outline."""
    return R(geo.dissolve(_wall(s, d, "c_nationkey")).groupBy("region").agg(F.sum(F.hypot(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("outline")))


@_query(_WALL + " SELECT DISTINCT src_owner AS src, dst_owner AS dst, 1.0::DOUBLE AS w FROM met WHERE src_owner <> dst_owner")
def dissolved_neighbours(s, d):
    """Nations whose bricks meet."""
    return geo.touch_edges(_wall(s, d, "c_nationkey"))


@_query(_WALL + " SELECT owner AS region, round(avg(x) + 0.5, 6) AS x, round(avg(y) + 0.5, 6) AS y, count(*)::DOUBLE AS area FROM wall GROUP BY owner")
def brick_centroids(s, d):
    return R(geo.centroids(_wall(s, d, "c_nationkey")))
