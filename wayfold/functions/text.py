"""Text rules of place search and of spoken guidance."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝŸ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUYY"
# Place kinds with number and base rank.
PLACE_KINDS = (
    ("city", 1, 1000), ("town", 2, 850), ("village", 3, 700), ("hamlet", 4, 500), ("suburb", 5, 420), ("quarter", 6, 380),
    ("fuel", 7, 620), ("camp_site", 8, 560), ("viewpoint", 9, 480), ("motorcycle_shop", 10, 540),
)


def normalized(name: Column) -> Column:
    """Accents folded, lower case, every run of other characters one blank; null where nothing is left."""
    folded = F.lower(F.translate(F.regexp_replace(F.regexp_replace(name, "œ", "oe"), "Œ", "oe"), ACCENTED, PLAIN))
    clean = F.trim(F.regexp_replace(folded, "[^a-z0-9]+", " "))
    return F.when(clean != "", clean)


# Spoken instructions by manoeuvre.
SPOKEN = {
    "DEPART": "Demarrez", "CONTINUE": "Continuez tout droit", "SLIGHT_LEFT": "Legerement a gauche", "LEFT": "Tournez a gauche", "SHARP_LEFT": "Tournez fortement a gauche",
    "SLIGHT_RIGHT": "Legerement a droite", "RIGHT": "Tournez a droite", "SHARP_RIGHT": "Tournez fortement a droite", "UTURN": "Faites demi-tour", "ARRIVE": "Vous etes arrive",
}


def spoken(kind: Column, exit_no: Column) -> Column:
    """What is said for an instruction; a roundabout names its exit where that is known."""
    plain = F.create_map(*[F.lit(x) for pair in SPOKEN.items() for x in pair])
    roundabout = F.when(exit_no > 0, F.concat(F.lit("Au rond-point, prenez la sortie "), exit_no.cast("string"))).otherwise("Entrez dans le rond-point")
    return F.when(kind == "ROUNDABOUT", roundabout).otherwise(F.coalesce(plain[kind], F.lit("Continuez")))


def label_zoom(kind: Column) -> Column:
    """How far out a place's label shows: 1 (region) for cities, 2 for towns, 3 for villages and suburbs, 4 for all else."""
    return F.when(kind == 1, 1).when(kind == 2, 2).when(kind.isin(3, 5), 3).otherwise(4)


def place_kind(tags: Column) -> tuple[Column, Column]:
    """(kind, base rank) of a tagged node; null where it is no place. The place tag is asked first."""
    number = F.create_map(*[F.lit(x) for name, no, _ in PLACE_KINDS for x in (name, no)])
    rank = F.create_map(*[F.lit(x) for name, _, base in PLACE_KINDS for x in (name, base)])
    settled = F.when(tags["place"].isin("city", "town", "village", "hamlet", "suburb", "quarter"), tags["place"])
    name = F.coalesce(
        settled,
        F.when(tags["amenity"] == "fuel", "fuel"),
        F.when(tags["tourism"].isin("camp_site", "viewpoint"), tags["tourism"]),
        F.when(tags["shop"] == "motorcycle", "motorcycle_shop"),
    )
    return number[name], rank[name]


def lower_ascii(name: Column) -> Column:
    """A-Z in lower case, other letters as they are."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def match_class(name: Column, query: str) -> Column:
    """0 exact, 1 prefix, 2 contained; null where it doesn't match."""
    return F.when(name == query, 0).when(name.startswith(query), 1).when(name.contains(query), 2)


def population(tag: Column) -> Column:
    """Leading digits of a population tag, blanks, commas and dots skipped."""
    return F.coalesce(F.try_to_number(F.regexp_replace(F.regexp_extract(tag, r"^([0-9][0-9 ,.]*)", 1), "[ ,.]", ""), F.lit("9999999999999")).cast("long"), F.lit(0))


def place_rank(base: Column, inhabitants: Column) -> Column:
    """The base rank, plus 20 for each decade of inhabitants (180 at most) where the base is 700 or more."""
    decades = F.when(inhabitants > 0, F.length(inhabitants.cast("string")) - 1).otherwise(0)
    return F.when(base >= 700, base + F.least(F.lit(180), decades * 20)).otherwise(base)


def _tenths(x: Column) -> Column:
    """A number of 0 or more, rounded to tenths by its exact value, halves to even; Java's formats round the shortest decimal and halves up."""
    ten, low = x * 8 + x * 2, x * 2 - (x * 8 + x * 2 - x * 8)  # ten times x, and what that sum leaves out
    whole = F.floor(ten)
    over = ten - whole - 0.5
    n = whole + F.when((over > 0) | ((over == 0) & ((low > 0) | ((low == 0) & (whole % 2 == 1)))), 1).otherwise(0)
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def distance_text(metres: Column) -> Column:
    """Metres as they are spoken: tens, fifties, tenths of a kilometre, kilometres."""
    return (
        F.when(metres < 100, F.concat((F.floor((metres + 5) / 10) * 10).cast("string"), F.lit(" m")))
        .when(metres < 1000, F.concat((F.floor((metres + 25) / 50) * 50).cast("string"), F.lit(" m")))
        .when(metres < 10000, F.concat(_tenths(metres / 1000), F.lit(" km")))
        .otherwise(F.concat(F.rint(metres / 1000).cast("long").cast("string"), F.lit(" km")))
    )


def turn_name(turn: Column) -> Column:
    """The manoeuvre of a signed turn in degrees."""
    size = F.abs(turn)
    side = F.when(turn < 0, "LEFT").otherwise("RIGHT")
    return (
        F.when(size < 25, "CONTINUE")
        .when(size < 55, F.concat(F.lit("SLIGHT_"), side))
        .when(size < 120, side)
        .when(size < 165, F.concat(F.lit("SHARP_"), side))
        .otherwise("UTURN")
    )
