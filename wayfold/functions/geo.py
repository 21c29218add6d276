"""Geodesy as Column expressions: everything stays inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8
MAX_LAT = 85.05112878


def to_e7(degrees: Column) -> Column:
    """Degrees to integer ten-millionths, halves away from zero."""
    return F.round(degrees * 1e7).cast("long")


def to_degrees(e7: Column) -> Column:
    return e7 / F.lit(1e7)


def valid(lat: Column, lon: Column) -> Column:
    """Finite and on the globe."""
    return ~F.isnan(lat) & ~F.isnan(lon) & lat.between(-90, 90) & lon.between(-180, 180)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # abs() takes the place of a clamp, which greatest() and least() would also apply to nulls.
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.abs(1 - a)))


def haversine_asin_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres by the arc sine, whose argument never exceeds 1."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))


def mercator_x(lon: Column) -> Column:
    """World x in [0, 1)."""
    x = (lon + 180) / 360
    return x - F.floor(x)


def mercator_y(lat: Column) -> Column:
    """World y; latitude clamped to the square map."""
    clamped = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return F.lit(0.5) - F.asinh(F.tan(F.radians(clamped))) / F.lit(2 * 3.141592653589793)


def mercator_lon(x: Column) -> Column:
    """Degrees of a world x."""
    return x * 360 - 180


def mercator_lat(y: Column) -> Column:
    """Degrees of a world y."""
    return F.degrees(F.atan(F.sinh((F.lit(0.5) - y) * F.lit(2 * 3.141592653589793))))


def tile_key(zoom: Column, x: Column, y: Column) -> Column:
    """Zoom, column and row of a tile in one long: 6, 29 and 29 bits."""
    return F.shiftleft(zoom.cast("long"), 58).bitwiseOR(F.shiftleft(x.cast("long"), 29)).bitwiseOR(y.cast("long"))


def tile_of_key(key: Column) -> tuple[Column, Column, Column]:
    """(zoom, x, y) of a tile's key."""
    low = F.lit((1 << 29) - 1)
    return F.shiftrightunsigned(key, 58).cast("int"), F.shiftright(key, 29).bitwiseAND(low).cast("int"), key.bitwiseAND(low).cast("int")


def tile(world: Column, zoom: Column) -> Column:
    """The tile number of a world coordinate."""
    n = F.pow(F.lit(2.0), zoom)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor(world * n))).cast("int")


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, 0 to 360."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def signed_turn_deg(before: Column, after: Column) -> Column:
    """Turn from one bearing to the next, in (-180, 180]."""
    turn = F.pmod(after - before, F.lit(360.0))
    return F.when(turn > 180, turn - 360).otherwise(turn)


def heading_difference_deg(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360 - d)


def heading_blend_deg(current: Column, target: Column, alpha: Column) -> Column:
    """From one heading towards another by the shorter way."""
    turn = F.pmod(target, F.lit(360.0)) - F.pmod(current, F.lit(360.0))
    turn = F.when(turn > 180, turn - 360).when(turn < -180, turn + 360).otherwise(turn)
    return F.pmod(current + turn * alpha, F.lit(360.0))


def beside(lat: Column, lon: Column, heading: Column, metres: Column) -> tuple[Column, Column]:
    """The point so many metres to the right of a heading, on the local plane."""
    side = F.radians(heading + 90)
    per_degree = F.lit(EARTH_M * 3.141592653589793 / 180)
    shrink = F.cos(F.radians(lat))
    return lat + F.cos(side) * metres / per_degree, lon + F.sin(side) * metres / (per_degree * F.when(F.abs(shrink) > 1e-6, shrink).otherwise(1e-6))


def destination(lat: Column, lon: Column, bearing: Column, metres: Column) -> tuple[Column, Column]:
    """The point at a distance along a bearing; longitude wrapped."""
    r, b, p = metres / EARTH_M, F.radians(bearing), F.radians(lat)
    p2 = F.asin(F.sin(p) * F.cos(r) + F.cos(p) * F.sin(r) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(r) * F.cos(p), F.cos(r) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), F.pmod(F.degrees(l2) + 540, F.lit(360.0)) - 180


def projection_fraction(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column, at_lat: Column | None = None) -> Column:
    """Where the point falls on the segment a-b, 0 to 1, on the plane tangent at `at_lat` (the point's latitude unless given)."""
    k = F.cos(F.radians(lat if at_lat is None else at_lat))
    dx, dy = (b_lon - a_lon) * k, b_lat - a_lat
    px, py = (lon - a_lon) * k, lat - a_lat
    length2 = dx * dx + dy * dy
    return F.when(length2 <= 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (px * dx + py * dy) / length2)))


def quantize(world: Column, tile_no: Column, zoom: Column, buffer: float = 0.0) -> Column:
    """A world coordinate as 0..65535 inside its (buffered) tile."""
    local = world * F.pow(F.lit(2.0), zoom) - tile_no
    return F.greatest(F.lit(0.0), F.least(F.lit(65535.0), F.round((local + buffer) / (1 + 2 * buffer) * 65535))).cast("int")


def dequantize(value: Column, tile_no: Column, zoom: Column, buffer: float = 0.0) -> Column:
    """The world coordinate of a value inside its (buffered) tile."""
    return (tile_no + value / 65535.0 * (1 + 2 * buffer) - buffer) / F.pow(F.lit(2.0), zoom)


def grid_cell_e7(lat_span: Column, lon_span: Column, start: int = 100_000, most_cells: int = 2_000_000) -> Column:
    """The cell of a grid over such spans: the start size, doubled until there are at most so many cells."""
    sizes = F.array(*[F.lit(start << k) for k in range(20)])
    cells = lambda size: (F.floor(lat_span / size) + 1) * (F.floor(lon_span / size) + 1)
    return F.filter(sizes, lambda size: cells(size) <= most_cells)[0]
