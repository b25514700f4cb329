"""Geometry on the sphere and on a local plane, as column functions. All angles in degrees, lengths in metres."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS = 6371008.8
METRES_PER_DEGREE = 111320.0  # of the planar functions
TILE_SIDE = 256


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Haversine distance."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_RADIUS * F.asin(F.sqrt(h))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    turn, p, q = F.radians(lon2 - lon1), F.radians(lat1), F.radians(lat2)
    east = F.sin(turn) * F.cos(q)
    north = F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(turn)
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def destination(lat: Column, lon: Column, heading: Column, distance: Column) -> Column:
    """The point at ``distance`` in direction ``heading``: struct of lat and lon, lon in [-180, 180)."""
    arc, direction, p = distance / EARTH_RADIUS, F.radians(heading), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(arc) + F.cos(p) * F.sin(arc) * F.cos(direction))
    turn = F.atan2(F.sin(direction) * F.sin(arc) * F.cos(p), F.cos(arc) - F.sin(p) * F.sin(q))
    return F.struct(F.degrees(q).alias("lat"), (F.pmod(F.degrees(F.radians(lon) + turn) + 540, F.lit(360.0)) - 180).alias("lon"))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the plane that touches the first point."""
    return F.hypot((lat2 - lat1) * METRES_PER_DEGREE, (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(lat1)))


def point_to_segment(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance of a point to a segment, on the plane that touches the point."""
    width = METRES_PER_DEGREE * F.cos(F.radians(lat))
    ax, ay = (lon1 - lon) * width, (lat1 - lat) * METRES_PER_DEGREE
    dx, dy = (lon2 - lon1) * width, (lat2 - lat1) * METRES_PER_DEGREE
    square = dx * dx + dy * dy
    along = F.when(square > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / square))).otherwise(0.0)
    return F.hypot(ax + along * dx, ay + along * dy)


def box(lat: Column, lon: Column, radius: Column) -> Column:
    """The box around a disc: struct of south, west, north and east."""
    high = radius / METRES_PER_DEGREE
    wide = radius / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(lat)), F.lit(0.01)))
    return F.struct((lat - high).alias("south"), (lon - wide).alias("west"), (lat + high).alias("north"), (lon + wide).alias("east"))


def inside(lat: Column, lon: Column, of: Column) -> Column:
    """Whether a point lies in a box."""
    return lat.between(of["south"], of["north"]) & lon.between(of["west"], of["east"])


def cell(lat: Column, lon: Column, side: float) -> tuple[Column, Column]:
    """Row and column of the grid cell of ``side`` metres that holds a point."""
    row = F.floor(lat * METRES_PER_DEGREE / side)
    return row, F.floor(lon * METRES_PER_DEGREE * F.cos(F.radians(lat)) / side)


def degree_cell(lat: Column, lon: Column, side: float) -> tuple[Column, Column]:
    """Row and column of the grid cell of ``side`` degrees that holds a point."""
    return F.floor(lat / side), F.floor(lon / side)


def world_pixel(lat: Column, lon: Column, zoom: int) -> tuple[Column, Column]:
    """Web-Mercator pixel coordinates x and y in the whole world at ``zoom``."""
    side = float(TILE_SIDE << zoom)
    p = F.radians(lat)
    return (lon + 180) / 360 * side, (1 - F.log(F.tan(p) + 1 / F.cos(p)) / F.lit(3.141592653589793)) / 2 * side


def terrain_metres(red: Column, green: Column, blue: Column) -> Column:
    """Altitude that a terrain pixel encodes."""
    return red * 256 + green + blue / 256 - 32768


def slope_class(percent: Column) -> Column:
    """Five classes of slope; a bound belongs to the lower class."""
    bounds = (("steep_down", -8.0), ("down", -3.0), ("flat", 3.0), ("up", 8.0))
    out = F.when(percent <= bounds[0][1], bounds[0][0])
    for name, upper in bounds[1:]:
        out = out.when(percent <= upper, name)
    return out.when(percent.isNotNull(), "steep_up")
