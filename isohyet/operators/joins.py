"""Time-aware, spatial and alignment joins."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared

EARTH_KM = 6371.0088


def asof(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], direction: str = "backward", strict: bool = False) -> DataFrame:
    """Each left row with ``values`` of the nearest right row at or before it
    (``forward``: at or after; ``strict``: not at the same time).

    Both sides go through one shuffle on ``by`` and one sort: a union, and the
    last right value carried along, so no pairs are made. Of several right rows
    at one time the greatest by ``values`` counts.
    """
    back = direction == "backward"
    held, row = F.struct(*values), F.struct(*left.columns)
    kinds = right.select(held).schema[0].dataType, left.select(row).schema[0].dataType
    lefts = left.select(*by, on, F.lit(1).alias("_left"), row.alias("_row"), F.lit(None).cast(kinds[0]).alias("_held"))
    rights = right.select(*by, on, F.lit(0).alias("_left"), F.lit(None).cast(kinds[1]).alias("_row"), held.alias("_held"))
    both = lefts.unionByName(rights)
    # At equal times right rows come first, or last if equality does not count.
    tie = F.col("_left") if not strict else -F.col("_left")
    w = Window.partitionBy(*by).orderBy(F.col(on).asc() if back else F.col(on).desc(), tie, F.col("_held"))
    found = F.last("_held", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("_found", found).where("_left = 1")
    return out.select("_row.*", *[F.col("_found")[v].alias(v) for v in values])


def completed(df: DataFrame, keys: DataFrame, on: Sequence[str], fill: dict) -> DataFrame:
    """``keys`` (all combinations wanted) with the rows of ``df``, gaps filled."""
    return keys.join(df, list(on), "left").fillna(fill)


def days_between(df: DataFrame, by: Sequence[str], date: str) -> DataFrame:
    """Every day from the first to the last of each entity."""
    ends = df.groupBy(*by).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return ends.select(*by, F.explode(F.sequence("_a", "_b")).alias(date))


def in_intervals(points: DataFrame, intervals: DataFrame, by: Sequence[str], date: str, start: str, end: str) -> DataFrame:
    """Points inside an interval of their entity, each once. Days of intervals
    are listed, which makes an equi-join of the range join."""
    days = intervals.select(*by, F.explode(F.sequence(start, end)).alias(date)).distinct()
    return points.join(days, [*by, date], "left_semi")


def overlaps(a: DataFrame, b: DataFrame, by: Sequence[str], days: int = 8) -> DataFrame:
    """Pairs of intervals of dates (a_start, a_end), (b_start, b_end) of an
    entity that overlap, and the overlap's ends. Both are listed by blocks of
    ``days`` days, which are part of the key, so that an entity with very many
    intervals is split; a pair is kept in the block in which its overlap begins."""
    block = lambda d: F.floor(F.datediff(F.col(d), F.lit("1970-01-01").cast("date")) / days)
    a, b = (x.withColumn("_block", F.explode(F.sequence(block(f"{n}_start"), block(f"{n}_end")))) for x, n in ((a, "a"), (b, "b")))
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    pairs = a.join(b, [*by, "_block"]).withColumns({"start": start, "end": end}).where("start <= end")
    return pairs.where(F.col("_block") == block("start")).drop("_block")


def pairs_within(pairs: DataFrame, windows: DataFrame, by: Sequence[str], days: int) -> DataFrame:
    """Pairs of dates (first, last) of an entity that lie whole in a window
    (start, stop), ends included, once a window. Windows are listed by the blocks
    of ``days`` days that they touch; a pair is in the block of its first date."""
    block = lambda d: F.floor(F.datediff(F.col(d), F.lit("1970-01-01").cast("date")) / days)
    listed = windows.where("start <= stop").withColumn("_block", F.explode(F.sequence(block("start"), block("stop"))))
    found = pairs.withColumn("_block", block("first")).join(listed, [*by, "_block"])
    return found.where("first >= start and last <= stop").drop("_block")


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def nearest(points: DataFrame, sites: DataFrame, point_id: str, site_id: str, k: int) -> DataFrame:
    """The ``k`` nearest sites (slat, slon) of each point (lat, lon).

    Points at one place are looked up once, and of the sites at one place only
    the ``k`` first ids can be among the nearest. Places are dealt to cubes that
    cut the unit sphere, about ``k`` places of sites to a cube. A place looks up
    the cubes around its own; their edge doubles from round to round until no
    site outside them can be nearer than the k-th found, and only places that are
    still open go on. Every lookup is an equi-join on the cube, and every round
    is written to the shared folder."""
    here = Window.partitionBy("slat", "slon").orderBy(site_id)
    kept = shared(sites.select(site_id, "slat", "slon").withColumn("_r", F.row_number().over(here)).where(F.col("_r") <= k))
    depth = min(20, int(math.log2(max(1.0, kept.where("_r = 1").count() / (math.pi * k))) / 2))
    axes = {"_x": lambda lat, lon: F.cos(lat) * F.cos(lon), "_y": lambda lat, lon: F.cos(lat) * F.sin(lon), "_z": lambda lat, lon: F.sin(lat)}
    open_places, found = points.select("lat", "lon").distinct(), []
    while True:
        edge = 2.0 / 2**depth
        cube = lambda lat, lon: {a: F.floor((at(F.radians(lat), F.radians(lon)) + 1) / edge) for a, at in axes.items()}  # noqa: B023, E731
        cubes = open_places.withColumns(cube("lat", "lon"))
        for a in axes:
            cubes = cubes.withColumn(a, F.explode(F.array(*[F.col(a) + d for d in (-1, 0, 1)])))
        off = F.sqrt(sum(((F.col(a) + 0.5) * edge - 1) ** 2 for a in axes)) - 1
        rows = cubes.where(F.abs(off) < 0.87 * edge).join(kept.withColumns(cube("slat", "slon")), [*axes])
        rows = rows.select("lat", "lon", site_id, haversine(F.col("lat"), F.col("lon"), F.col("slat"), F.col("slon")).alias("km"))
        w = Window.partitionBy("lat", "lon").orderBy("km", site_id)
        best = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
        best = shared(best.groupBy("lat", "lon").agg(F.array_sort(F.collect_list(F.struct("km", site_id))).alias("_best")))
        if depth == 0:
            found.append(best)
            break
        # The nearest that anything outside the cubes can be, less what is rounded.
        bound = EARTH_KM * 2 * math.asin(edge / 2) * (1 - 1e-9)
        found.append(best.where((F.size("_best") >= k) & (F.element_at("_best", -1)["km"] < bound)))
        open_places = shared(open_places.join(found[-1], ["lat", "lon"], "left_anti"))
        if open_places.isEmpty():
            break
        depth -= 1
    # Rows that repeat a point share its ``k`` places.
    n = points.groupBy(point_id, "lat", "lon").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("_n"))
    out = n.join(reduce(DataFrame.unionByName, found), ["lat", "lon"])
    repeated = F.flatten(F.transform("_best", lambda x: F.array_repeat(x, F.col("_n"))))
    out = out.select(point_id, F.posexplode(F.slice(repeated, 1, k)).alias("_at", "_b"))
    return out.select(point_id, (F.col("_at") + 1).alias("place"), F.col(f"_b.{site_id}").alias(site_id), "_b.km")


def in_box(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inside a box, edges included; west > east crosses the date line."""
    inside = lon.between(west, east) if west <= east else (lon >= west) | (lon <= east)
    return lat.between(south, north) & inside


def in_ring(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Ray casting against a ring of (lon, lat) vertices."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if y1 == y2:
            continue
        at = F.lit(x1) + (lat - y1) * ((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(((lat >= y1) != (lat >= y2)) & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1


def bilinear(points: DataFrame, grid: DataFrame, step: float, value: str, on: Sequence[str] = ()) -> DataFrame:
    """Grid value at each point (lat, lon) from its four corners; null where a
    corner is missing. Grid coordinates are multiples of ``step``."""
    cell = points.withColumns({"_i": F.floor(F.col("lat") / step), "_j": F.floor(F.col("lon") / step)})
    cell = cell.withColumns({"_y": F.col("lat") / step - F.col("_i"), "_x": F.col("lon") / step - F.col("_j")})
    corners = [F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj")) for a in (0, 1) for b in (0, 1)]
    want = cell.withColumn("_c", F.explode(F.array(*corners))).withColumns({"_ci": F.col("_i") + F.col("_c.di"), "_cj": F.col("_j") + F.col("_c.dj")})
    have = grid.select(*on, F.round(F.col("lat") / step).cast("long").alias("_ci"), F.round(F.col("lon") / step).cast("long").alias("_cj"), F.col(value).alias("_v"))
    weight = F.when(F.col("_c.di") == 1, F.col("_y")).otherwise(1 - F.col("_y")) * F.when(F.col("_c.dj") == 1, F.col("_x")).otherwise(1 - F.col("_x"))
    out = want.join(have, [*on, "_ci", "_cj"], "left").groupBy(*points.columns).agg(F.when(F.count("_v") == 4, F.sum(weight * F.col("_v"))).alias(value))
    return out
