"""Controls attached to the place of an event.

The nearest of any number of sites or roads is found by bounds, not by all
pairs.  Sites, or the midpoints of short pieces of roads, are counted in cells
that are quartered on both sides wherever they hold many, so neither the globe
nor a city is one cell.  A place goes down the cells: each cell has a least
distance by its edges and a distance to one of its sites; what cannot beat the
best of the latter is left behind.  Only the sites of the last cells are
measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rallylens.operators.lookup import lookup_join
from rallylens.storage import settle

EARTH_RADIUS_KM = 6371.0
# Cells of 45 degrees; each level has a quarter of the width, down to about a kilometre.
TOP_DEGREES, LEVELS = 45.0, 7
# A cell with no more sites is not divided.
CELL_SITES = 32
# Roads are cut into pieces of about this length before they are put into cells.
PIECE_KM = 10.0
SPOT, CELL = ["latitude", "longitude"], ["level", "y", "x"]


def distance_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance (haversine)."""
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def on_globe(lat: Column, lon: Column) -> list[Column]:
    """Unit vector of a place."""
    return [F.cos(F.radians(lat)) * F.cos(F.radians(lon)), F.cos(F.radians(lat)) * F.sin(F.radians(lon)), F.sin(F.radians(lat))]


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def dot(a: list[Column], b: list[Column]) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def segment_distance_km(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance to the shorter great-circle arc between two places."""
    p, a, b = on_globe(lat, lon), on_globe(lat1, lon1), on_globe(lat2, lon2)
    n = cross(a, b)
    length = F.sqrt(dot(n, n))
    beside = (length > 1e-12) & (dot(cross(n, a), p) >= 0) & (dot(cross(b, n), p) >= 0)
    off = F.asin(F.least(F.lit(1.0), F.abs(dot(p, n) / F.greatest(length, F.lit(1e-300)))))
    ends = F.least(distance_km(lat, lon, lat1, lon1), distance_km(lat, lon, lat2, lon2))
    return F.when(beside, F.lit(EARTH_RADIUS_KM) * off).otherwise(ends)


def cell_of(lat: Column, lon: Column, level: Column) -> list[Column]:
    """Row and column of the cell of a level."""
    size = F.lit(TOP_DEGREES) / F.pow(F.lit(4.0), level)
    y = F.least(F.floor((lat + 90) / size), F.floor(F.lit(180.0) / size) - 1)
    return [y.cast("long").alias("y"), F.pmod(F.floor((lon + 180) / size), F.lit(360.0) / size).cast("long").alias("x")]


def box_of(level: Column, y: Column, x: Column) -> list[Column]:
    """South and north edge, middle meridian and half width of a cell, in degrees."""
    size = F.lit(TOP_DEGREES) / F.pow(F.lit(4.0), level)
    return [(y * size - 90).alias("south"), ((y + 1) * size - 90).alias("north"), ((x + F.lit(0.5)) * size - 180).alias("middle"), (size / 2).alias("half")]


def least_km(lat: Column, lon: Column, south: Column, north: Column, middle: Column, half: Column) -> Column:
    """No point of a cell is nearer to a place than this."""
    away = F.abs(F.pmod(lon - middle + 540, F.lit(360.0)) - 180) - half
    above = F.greatest(south - lat, lat - north, F.lit(0.0))
    beside, phi = F.cos(F.radians(away)), F.radians(lat)

    def near(at: Column) -> Column:
        return F.sin(phi) * F.sin(F.radians(at)) + F.cos(phi) * F.cos(F.radians(at)) * beside

    turning = F.degrees(F.atan2(F.sin(phi), F.cos(phi) * beside))  # where the nearest meridian comes closest
    most = F.greatest(near(south), near(north), F.when(turning.between(south, north), near(turning)).otherwise(-1.0))
    angle = F.when(away <= 0, F.radians(above)).otherwise(F.acos(F.least(F.lit(1.0), most)))
    return F.lit(EARTH_RADIUS_KM) * angle - F.lit(1e-3)


def cells_of(sites: DataFrame, levels: int = LEVELS) -> DataFrame:
    """level, y, x, n, an example and the largest reach of every cell down to the undivided ones.

    ``sites``: s_lat, s_lon, reach (km that a site extends around its point).
    """
    fine = sites.groupBy(*cell_of(F.col("s_lat"), F.col("s_lon"), F.lit(levels - 1))).agg(
        F.count("*").alias("n"), F.min(F.struct("s_lat", "s_lon")).alias("e"), F.max("reach").alias("reach")
    )
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    up = F.pow(F.lit(4.0), F.lit(levels - 1) - F.col("level"))
    each = fine.select(level.alias("level"), F.col("y").alias("yy"), F.col("x").alias("xx"), "n", "e", "reach")
    each = each.select("level", F.floor(F.col("yy") / up).alias("y"), F.floor(F.col("xx") / up).alias("x"), "n", "e", "reach")
    cells = each.groupBy(*CELL).agg(F.sum("n").alias("n"), F.min("e").alias("e"), F.max("reach").alias("reach"))
    whole = (F.col("n") <= CELL_SITES) | (F.col("level") == levels - 1)
    return settle(cells.select("*", whole.alias("whole"), *box_of(*[F.col(c) for c in CELL])))


def nearest(spots: DataFrame, sites: DataFrame, distance: Column, name: str) -> DataFrame:
    """latitude, longitude and the least ``distance`` to any site, for distinct spots."""
    cells = cells_of(sites)
    divided = cells.agg(F.max(F.when(~F.col("whole"), F.col("level") + 1))).first()[0]
    levels = divided or 0
    last = cells.where("whole").select(*CELL)
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level")
    placed = sites.select("*", level).select("*", *cell_of(F.col("s_lat"), F.col("s_lon"), F.col("level")))
    placed = placed.join(last, CELL)

    example = distance_km(F.col("latitude"), F.col("longitude"), F.col("e.s_lat"), F.col("e.s_lon"))
    floor = least_km(*[F.col(c) for c in (*SPOT, "south", "north", "middle", "half")]) - F.col("reach")
    top = spots.select(*SPOT, F.lit(0).alias("level"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))).alias("c"))
    open_ = top.select(*SPOT, "level", F.floor(F.col("c") / 8).alias("y"), (F.col("c") % 8).alias("x"))

    def child(c: Column) -> Column:
        y, x = F.col("y") * 4 + F.floor(c / 4), F.col("x") * 4 + c % 4
        return F.struct((F.col("level") + 1).alias("level"), y.alias("y"), x.alias("x"))

    children = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")), child)
    for at in range(levels + 1):
        met = open_.join(cells, CELL).select(*SPOT, *CELL, "whole", floor.alias("least"), example.alias("most"))
        best = met.withColumn("best", F.min("most").over(W.partitionBy(*SPOT))).where(F.col("least") <= F.col("best"))
        if at < levels:
            open_ = best.select(*SPOT, F.inline(F.when(F.col("whole"), F.array(F.struct(*CELL))).otherwise(children)))
    return settle(best.join(placed, CELL).groupBy(*SPOT).agg(F.min(distance).alias(name)))


def located(df: DataFrame, lat: str, lon: str, to_lat: str, to_lon: str) -> DataFrame:
    """Rows with both coordinates, the latitude on the globe."""
    told = df.withColumns({to_lat: F.col(lat).cast("double"), to_lon: F.col(lon).cast("double")})
    return told.where(F.col(to_lat).between(-90, 90) & F.col(to_lon).isNotNull() & ~F.isnan(to_lon) & (F.abs(to_lon) < float("inf")))


def with_nearest(events: DataFrame, sites: DataFrame, distance: Column, name: str) -> DataFrame:
    spots = located(events.select(*[F.col(c).cast("double").alias(c) for c in SPOT]).distinct(), *SPOT, *SPOT)
    return lookup_join(events, nearest(spots, sites, distance, name), SPOT, "left")


def nearest_site_distance(events: DataFrame, sites: DataFrame, name: str = "distance_km") -> DataFrame:
    """Distance to the nearest of any number of sites (latitude, longitude).

    Distinct places are searched.  Null without coordinates, beyond a pole, or
    without sites; sites without coordinates are none.
    """
    points = located(sites.select("latitude", "longitude"), *SPOT, "s_lat", "s_lon").select("s_lat", "s_lon").distinct()
    here = distance_km(F.col("latitude"), F.col("longitude"), F.col("s_lat"), F.col("s_lon"))
    return with_nearest(events, points.withColumn("reach", F.lit(0.0)), here, name)


def road_pieces(segments: DataFrame) -> DataFrame:
    """Segments (lat1, lon1, lat2, lon2) with s_lat, s_lon, reach: the middles of their pieces."""
    ends = ["lat1", "lon1", "lat2", "lon2"]
    whole = located(located(segments.select(*ends), "lat1", "lon1", "lat1", "lon1"), "lat2", "lon2", "lat2", "lon2").distinct()
    long = whole.withColumn("km", distance_km(*[F.col(c) for c in ends]))
    many = F.greatest(F.ceil(F.col("km") / PIECE_KM), F.lit(1))
    each = long.withColumn("m", many).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))))
    part, angle = (F.col("i") - F.lit(0.5)) / F.col("m"), F.col("km") / EARTH_RADIUS_KM
    a, b = on_globe(F.col("lat1"), F.col("lon1")), on_globe(F.col("lat2"), F.col("lon2"))
    near, far = F.sin((1 - part) * angle), F.sin(part * angle)
    v = [F.when(angle > 1e-9, near * x + far * y).otherwise(x) for x, y in zip(a, b, strict=True)]
    middle = each.withColumns({f"v{i}": x for i, x in enumerate(v)})
    s_lat = F.degrees(F.atan2(F.col("v2"), F.sqrt(F.col("v0") * F.col("v0") + F.col("v1") * F.col("v1"))))
    s_lon = F.degrees(F.atan2(F.col("v1"), F.col("v0")))
    return middle.select(*ends, s_lat.alias("s_lat"), s_lon.alias("s_lon"), (F.col("km") / F.col("m") / 2 + 1e-3).alias("reach"))


def nearest_road_distance(events: DataFrame, segments: DataFrame, name: str = "distance_km") -> DataFrame:
    """Distance to the nearest of any number of road segments (lat1, lon1, lat2, lon2).

    Segments are great-circle arcs, cut into short pieces for the search and
    measured whole.  Null without coordinates, beyond a pole, or without roads;
    segments that lack a coordinate are none.
    """
    here = segment_distance_km(*[F.col(c) for c in (*SPOT, "lat1", "lon1", "lat2", "lon2")])
    return with_nearest(events, settle(road_pieces(segments)), here, name)


def region_class(df: DataFrame, regions: DataFrame, code: str, missing: str = "unclassified") -> DataFrame:
    """Class of the region (columns ``code``, ``region_class``)."""
    joined = lookup_join(df, regions.select(code, "region_class"), code, "left")
    return joined.withColumn("region_class", F.coalesce(F.col("region_class"), F.lit(missing)))
