"""Column expressions of the planning engine: coordinates, distances, keys, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean Earth radius, kilometres to a degree of latitude, fixed-point units to a degree.
EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.32
UNITS = 1e7
# Speeds by road class, km/h.
SPEEDS = {
    "motorway": 122.0,
    "motorway_link": 90.0,
    "trunk": 100.0,
    "trunk_link": 60.0,
    "primary": 58.0,
    "primary_link": 45.0,
    "secondary": 52.0,
    "secondary_link": 35.0,
    "tertiary": 51.0,
    "tertiary_link": 33.0,
    "unclassified": 40.0,
    "residential": 42.0,
}


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    half_lat, half_lon = (b - a) / 2.0, (F.radians(col(lon2)) - F.radians(col(lon1))) / 2.0
    chord = F.pow(F.sin(half_lat), 2.0) + F.cos(a) * F.cos(b) * F.pow(F.sin(half_lon), 2.0)
    return F.lit(2.0 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), chord)))


def degrees_apart(lat1, lon1, lat2, lon2) -> Column:
    """Euclidean distance in degrees."""
    return F.sqrt(F.pow(col(lat1) - col(lat2), 2.0) + F.pow(col(lon1) - col(lon2), 2.0))


def quantised(x) -> Column:
    """Degrees as fixed-point units, halves to even."""
    return F.bround(col(x) * UNITS).cast("long")


def dequantised(x) -> Column:
    return col(x) / UNITS


def sound_point(lat, lon) -> Column:
    """Neither coordinate is null, NaN or out of range."""
    return F.coalesce((F.abs(col(lat)) <= 90.0) & (F.abs(col(lon)) <= 180.0), F.lit(False))


def vertex(lat, lon) -> Column:
    """A coordinate as one value, struct(lat, lon)."""
    return F.struct(col(lat).cast("double").alias("lat"), col(lon).cast("double").alias("lon"))


def curve_place(lat, lon, bits: int = 30) -> Column:
    """A Morton code: the bits of both coordinates, interleaved, of a grid over the globe."""

    def spread(x: Column) -> Column:
        for shift in (16, 8, 4, 2, 1):
            every = sum(((1 << shift) - 1) << (2 * shift * i) for i in range(32 // shift))
            x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(every))
        return x

    cells = (1 << bits) - 1
    row = F.floor((col(lat) + 90.0) / 180.0 * cells).cast("long")
    column = F.floor((col(lon) + 180.0) / 360.0 * cells).cast("long")
    return F.shiftleft(spread(row), 1).bitwiseOR(spread(column))


def composed_label(label, zone, zone_size: int = 10000) -> Column:
    """A label that is unique over all zones, from one that is unique within a zone."""
    return col(label) + col(zone) * zone_size


def one_way(oneway, junction) -> Column:
    """`yes`, or a roundabout that says nothing; any other value is two-way."""
    return F.coalesce(col(oneway) == "yes", F.lit(False)) | (col(oneway).isNull() & F.coalesce(col(junction) == "roundabout", F.lit(False)))


def speed_kmh(highway, default_kmh: float | None = None) -> Column:
    """The class's speed; an unknown class raises unless default_kmh is given."""
    known = F.create_map(*[F.lit(x) for k, v in SPEEDS.items() for x in (k, v)])[col(highway)]
    other = F.raise_error(F.concat(F.lit("unknown road class "), F.coalesce(col(highway), F.lit("null")))).cast("double") if default_kmh is None else F.lit(float(default_kmh))
    return F.coalesce(known, other)


def drive_seconds(metres, kmh) -> Column:
    return col(metres) / (col(kmh) / 3600.0 * 1000.0)


def low_id(a, b) -> Column:
    return F.least(col(a), col(b))


def high_id(a, b) -> Column:
    return F.greatest(col(a), col(b))


def pair_text(a, b) -> Column:
    return F.concat_ws("_", low_id(a, b).cast("string"), high_id(a, b).cast("string"))


def shard_of(a, b, shards: int = 16) -> Column:
    """The cache shard of an unordered pair."""
    mixed = F.pmod(low_id(a, b) * F.lit(31).cast("long") + high_id(a, b) * F.lit(37).cast("long"), F.lit(1 << 32))
    return F.pmod(mixed, F.lit(shards).cast("long"))


def hours(seconds) -> Column:
    """Hours at two places, halves to even."""
    return F.bround(col(seconds) / 3600.0, 2)


def label_colour(rank) -> Column:
    """#rrggbb of a label's rank: golden-angle hues, even ranks pale, odd ones strong."""
    hue = F.pmod(col(rank) * F.lit(137.508), F.lit(360.0))
    even = F.pmod(col(rank), F.lit(2)) == 0
    light, full = F.when(even, 0.6).otherwise(0.35), F.when(even, 0.65).otherwise(0.9)
    chroma = (F.lit(1.0) - F.abs(light * 2.0 - 1.0)) * full
    middle = chroma * (F.lit(1.0) - F.abs(F.pmod(hue / 60.0, F.lit(2.0)) - 1.0))
    sector, zero = F.floor(hue / 60.0), F.lit(0.0)
    rgb = [(chroma, middle, zero), (middle, chroma, zero), (zero, chroma, middle), (zero, middle, chroma), (middle, zero, chroma), (chroma, zero, middle)]

    def channel(i: int) -> Column:
        value = F.when(sector == 0, rgb[0][i])
        for k in range(1, 6):
            value = value.when(sector == k, rgb[k][i])
        return F.lpad(F.lower(F.hex(F.bround((value + light - chroma / 2.0) * 255.0).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(1), channel(2))
