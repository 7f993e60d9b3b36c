"""Points in polygons that are a table.

Polygons come as edges (polygon, x1, y1, x2, y2: longitude and latitude in
degrees), of outer rings and holes alike: what an odd number of rings has inside
is inside. A ring over the date line goes on beyond 180 degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ring_edges(vertices: DataFrame, polygon: str, ring: str, order: str) -> DataFrame:
    """The edges of rings from their vertices (``lon``, ``lat``), each ring closed."""
    w = Window.partitionBy(polygon, ring).orderBy(order)
    whole = Window.partitionBy(polygon, ring).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole))
    return vertices.select(polygon, F.col("lon").alias("x1"), F.col("lat").alias("y1"), after("lon").alias("x2"), after("lat").alias("y2"))


def points_in_polygons(points: DataFrame, edges: DataFrame, point: str, polygon: str, size: float = 5.0) -> DataFrame:
    """``point`` and ``polygon`` of every point (lat, lon) inside a polygon.

    Cells of ``size`` degrees (a divisor of 360) are the index: a polygon is listed
    in the cells that it may cover, one span of columns a band of latitude, so that
    a point meets only the polygons of its cell, by an equi-join. An edge is listed
    in the bands that it crosses, and a pair of point and polygon meets those of
    its band, by another; the parity of those that a ray to the east crosses
    decides. No pair of points and polygons beyond the cells is formed. An edge
    belongs to the points on its west, and the lower end of it to it; rows with
    nulls take no part."""
    columns = round(360 / size)
    band, column = (lambda y: F.floor(y / size)), (lambda x: F.floor(x / size))
    slanted = edges.dropna(subset=[polygon, "x1", "y1", "x2", "y2"]).where("y1 <> y2")
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    crossed = slanted.withColumn("_band", F.explode(F.sequence(band(low), band(high))))
    span = crossed.groupBy(polygon, "_band").agg(F.min(F.least("x1", "x2")).alias("_west"), F.max(F.greatest("x1", "x2")).alias("_east"))
    cells = span.select(polygon, "_band", F.explode(F.sequence(column(F.col("_west")), column(F.col("_east")))).alias("_c"))
    # A turn says how many times round a listed column is from the point's own.
    cells = cells.select(polygon, "_band", F.pmod("_c", F.lit(columns)).alias("_column"), F.floor(F.col("_c") / columns).alias("_turn"))
    at = points.dropna(subset=["lat", "lon"]).select(point, "lat", F.pmod("lon", F.lit(360.0)).alias("_x"))
    at = at.withColumns({"_band": band(F.col("lat")), "_column": F.pmod(column(F.col("_x")), F.lit(columns))})
    maybe = at.join(cells, ["_band", "_column"]).withColumn("_x", F.col("_x") + 360.0 * F.col("_turn"))
    met = maybe.select(point, polygon, "_band", "_turn", "lat", "_x").join(crossed.select(polygon, "_band", "x1", "y1", "x2", "y2"), [polygon, "_band"])
    meets = ((F.col("y1") > F.col("lat")) != (F.col("y2") > F.col("lat"))) & (F.col("_x") < F.col("x1") + (F.col("lat") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    odd = met.groupBy(point, polygon, "_turn").agg((F.count_if(meets) % 2 == 1).alias("_in"))
    return odd.where("_in").select(point, polygon).distinct()
