"""Road attributes: classes, speeds, profile costs, access and direction, as dimension tables and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Road class, its number, default km/h, TOURING and TRAIL multipliers.
CLASSES = (
    (0, "unknown", 40, 1.25, 1.30), (1, "motorway", 110, 2.50, 5.00), (2, "trunk", 90, 1.80, 3.00), (3, "primary", 80, 1.35, 2.00),
    (4, "secondary", 80, 1.10, 1.50), (5, "tertiary", 70, 1.00, 1.20), (6, "unclassified", 60, 1.00, 1.10), (7, "residential", 50, 1.10, 1.30),
    (8, "service", 30, 1.30, 1.15), (9, "living_street", 20, 1.20, 1.20), (10, "track", 25, 1.40, 1.00), (11, "path", 15, 1.70, 1.05), (12, "other", 40, 1.25, 1.30),
)
PROFILES = ("FASTEST", "TOURING", "TRAIL")
TOLL, FERRY, UNPAVED = 1, 2, 4
# Tag vocabularies.
DENIED = ("no", "private", "agricultural", "forestry")
PERMITTED = ("yes", "permissive", "designated", "destination", "customers")
SURFACES = {
    "paved": 1, "asphalt": 2, "concrete": 3, "paving_stones": 4, "sett": 4, "cobblestone": 4, "compacted": 5, "fine_gravel": 6,
    "gravel": 7, "pebblestone": 7, "dirt": 8, "earth": 8, "ground": 9, "grass": 9, "grass_paver": 9, "sand": 10, "mud": 11,
}
UNPAVED_FROM = 5  # compacted and all that follow but "other"


def dimension(spark: SparkSession) -> DataFrame:
    """(profile, road_class, default_kph, multiplier): 39 rows, a size fixed by the tables above."""
    rows = []
    for no, _, kph, touring, trail in CLASSES:
        fastest = {10: 1.35, 11: 1.50}.get(no, 1.0)
        rows += [("FASTEST", no, kph, fastest), ("TOURING", no, kph, touring), ("TRAIL", no, kph, trail)]
    return spark.createDataFrame(rows, "profile string, road_class int, default_kph int, multiplier double")


def speed_kph(max_speed: Column, default: Column) -> Column:
    """The posted speed, or the class's; within 5 and 130 km/h."""
    return F.greatest(F.lit(5), F.least(F.lit(130), F.when(max_speed > 0, max_speed).otherwise(default)))


def profile_factor(profile: Column, road_class: Column, multiplier: Column, unpaved: Column) -> Column:
    """What the profile makes of a road: its class's multiplier, then the surface rule."""
    return multiplier * (
        F.when((profile == "TOURING") & unpaved, 1.10)
        .when((profile == "TRAIL") & ~unpaved & ~road_class.isin(10, 11), 1.20)
        .when((profile == "FASTEST") & unpaved, 1.15)
        .otherwise(1.0)
    )


def edge_costs(edges: DataFrame, avoid_tolls: bool = False, avoid_ferries: bool = False) -> DataFrame:
    """Each edge under each profile: speed, seconds and weighted seconds; avoided edges are left out before the join."""
    mask = TOLL * avoid_tolls + FERRY * avoid_ferries
    allowed = edges.filter(F.col("flags").bitwiseAND(mask) == 0) if mask else edges
    rows = allowed.join(F.broadcast(dimension(edges.sparkSession)), "road_class")
    kph = speed_kph(F.col("max_speed_kph"), F.col("default_kph"))
    unpaved = F.col("flags").bitwiseAND(UNPAVED) != 0
    seconds = F.col("length_cm") / 100 / (kph / 3.6)
    return rows.withColumns({"speed_kph": kph, "seconds": seconds, "cost": seconds * profile_factor(F.col("profile"), F.col("road_class"), F.col("multiplier"), unpaved)})


def access_denied(tags: Column) -> Column:
    """The most specific access tag present decides."""
    return F.coalesce(F.coalesce(tags["motorcycle"], tags["motor_vehicle"], tags["vehicle"], tags["access"]).isin(*DENIED), F.lit(False))


def motor_permitted(tags: Column) -> Column:
    return F.coalesce(F.coalesce(tags["motorcycle"], tags["motor_vehicle"]).isin(*PERMITTED), F.lit(False))


def class_of_highway(highway: Column) -> Column:
    """The class number of a highway tag; links count as their class; 0 where the tag is no road."""
    base = F.regexp_replace(highway, "_link$", "")
    known = {name: no for no, name, *_ in CLASSES if no not in (0, 12)} | {"road": 6}
    return F.coalesce(F.create_map(*[F.lit(x) for pair in known.items() for x in pair])[base], F.lit(0))


def surface_of(tag: Column) -> Column:
    """The surface number of a tag: 0 without one, 12 where it is another."""
    return F.when(tag.isNull(), 0).otherwise(F.coalesce(F.create_map(*[F.lit(x) for pair in SURFACES.items() for x in pair])[tag], F.lit(12)))


def unpaved_surface(surface: Column) -> Column:
    return surface.between(UNPAVED_FROM, 11)


def max_speed_kph(tag: Column) -> Column:
    """The leading number of a maxspeed tag, miles taken to kilometres; 0 where there is none."""
    number = F.regexp_extract(tag, r"^\s*(\d+(?:\.\d+)?)", 1)
    value = F.when(number == "", 0.0).otherwise(F.try_to_number(number, F.lit("9999999.999")).cast("double"))
    return F.coalesce(F.round(F.when(tag.contains("mph"), value * 1.609344).otherwise(value)).cast("int"), F.lit(0))


def direction(tags: Column) -> Column:
    """'forward', 'backward' or 'both'; an explicit oneway tag wins over what the road implies."""
    oneway = tags["oneway"]
    implied = F.coalesce(tags["junction"].isin("roundabout", "circular"), F.lit(False)) | F.coalesce(tags["highway"].isin("motorway", "motorway_link"), F.lit(False))
    return (
        F.when(oneway.isin("yes", "true", "1"), "forward")
        .when(oneway.isin("-1", "reverse"), "backward")
        .when(oneway.isin("no", "false", "0"), "both")
        .when(implied, "forward")
        .otherwise("both")
    )


def visible(road_class: Column, zoom: Column) -> Column:
    """Whether a class of road is drawn at a zoom."""
    last = F.when(zoom <= 8, 2).when(zoom <= 10, 3).when(zoom <= 12, 5).otherwise(12)
    return (road_class >= 1) & (road_class <= last)


def owner_zoom(road_class: Column) -> Column:
    """The zoom whose tiles hold a road."""
    return F.when(road_class.between(1, 3), 10).when(road_class.between(4, 5), 12).otherwise(14)


def gateway_penalty_m(road_class: Column) -> Column:
    return F.when(road_class <= 3, 0).when(road_class == 4, 500).when(road_class == 5, 1200).otherwise(3000)
