"""The regions of the map, their centres and which of them touch: small fixed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Regions in catalogue order, with the latitude and longitude of their centres.
REGIONS = (
    ("alsace", 48.25, 7.45), ("aquitaine", 44.65, -0.45), ("auvergne", 45.45, 3.10), ("basse-normandie", 49.00, -0.35), ("bourgogne", 47.05, 4.65),
    ("bretagne", 48.15, -2.85), ("centre", 47.45, 1.70), ("champagne-ardenne", 48.70, 4.35), ("corse", 42.15, 9.05), ("franche-comte", 47.10, 6.15),
    ("guadeloupe", 16.20, -61.55), ("guyane", 4.00, -53.00), ("haute-normandie", 49.45, 1.00), ("ile-de-france", 48.70, 2.50), ("languedoc-roussillon", 43.65, 3.25),
    ("limousin", 45.70, 1.65), ("lorraine", 48.65, 6.10), ("martinique", 14.65, -61.00), ("mayotte", -12.80, 45.15), ("midi-pyrenees", 43.75, 1.45),
    ("nord-pas-de-calais", 50.45, 2.50), ("pays-de-la-loire", 47.45, -0.80), ("picardie", 49.65, 2.75), ("poitou-charentes", 46.15, 0.20),
    ("provence-alpes-cote-d-azur", 43.90, 6.10), ("reunion", -21.15, 55.50), ("rhone-alpes", 45.45, 5.20),
)
# The neighbours of each region that come after it in this table.
NEIGHBOURS = {
    "alsace": "lorraine franche-comte",
    "aquitaine": "poitou-charentes limousin midi-pyrenees",
    "auvergne": "centre bourgogne rhone-alpes languedoc-roussillon midi-pyrenees limousin",
    "basse-normandie": "bretagne pays-de-la-loire centre haute-normandie",
    "bourgogne": "centre ile-de-france champagne-ardenne franche-comte rhone-alpes",
    "bretagne": "pays-de-la-loire",
    "centre": "pays-de-la-loire poitou-charentes limousin ile-de-france haute-normandie",
    "champagne-ardenne": "picardie ile-de-france lorraine franche-comte",
    "franche-comte": "lorraine rhone-alpes",
    "haute-normandie": "picardie ile-de-france",
    "ile-de-france": "picardie",
    "languedoc-roussillon": "midi-pyrenees rhone-alpes provence-alpes-cote-d-azur",
    "limousin": "poitou-charentes midi-pyrenees",
    "nord-pas-de-calais": "picardie",
    "pays-de-la-loire": "poitou-charentes",
    "provence-alpes-cote-d-azur": "rhone-alpes",
}
# Well-known cities and towns, in the order of their list: name, latitude, longitude, kind, rank, region.
CITIES = (
    ("Strasbourg", 48.5734, 7.7521, 1, 100, "alsace"), ("Mulhouse", 47.7508, 7.3359, 1, 85, "alsace"), ("Colmar", 48.0794, 7.3585, 2, 78, "alsace"), ("Bordeaux", 44.8378, -0.5792, 1, 100, "aquitaine"),
    ("Pau", 43.2951, -0.3708, 1, 86, "aquitaine"), ("Bayonne", 43.4929, -1.4748, 1, 84, "aquitaine"), ("Agen", 44.2030, 0.6160, 2, 76, "aquitaine"), ("Périgueux", 45.1840, 0.7211, 2, 76, "aquitaine"),
    ("Clermont-Ferrand", 45.7772, 3.0870, 1, 95, "auvergne"), ("Aurillac", 44.9309, 2.4449, 2, 72, "auvergne"), ("Moulins", 46.5657, 3.3334, 2, 72, "auvergne"),
    ("Caen", 49.1829, -0.3707, 1, 94, "basse-normandie"), ("Cherbourg-en-Cotentin", 49.6337, -1.6221, 1, 82, "basse-normandie"), ("Alençon", 48.4329, 0.0913, 2, 72, "basse-normandie"),
    ("Dijon", 47.3220, 5.0415, 1, 94, "bourgogne"), ("Auxerre", 47.7982, 3.5738, 2, 74, "bourgogne"), ("Nevers", 46.9896, 3.1590, 2, 72, "bourgogne"), ("Rennes", 48.1173, -1.6778, 1, 96, "bretagne"),
    ("Brest", 48.3904, -4.4861, 1, 90, "bretagne"), ("Quimper", 47.9960, -4.1025, 1, 80, "bretagne"), ("Vannes", 47.6582, -2.7608, 2, 78, "bretagne"), ("Orléans", 47.9030, 1.9093, 1, 90, "centre"),
    ("Tours", 47.3941, 0.6848, 1, 91, "centre"), ("Bourges", 47.0810, 2.3988, 1, 78, "centre"), ("Chartres", 48.4469, 1.4890, 2, 76, "centre"), ("Reims", 49.2583, 4.0317, 1, 94, "champagne-ardenne"),
    ("Troyes", 48.2973, 4.0744, 1, 82, "champagne-ardenne"), ("Charleville-Mézières", 49.7621, 4.7261, 2, 74, "champagne-ardenne"), ("Ajaccio", 41.9192, 8.7386, 1, 88, "corse"),
    ("Bastia", 42.6973, 9.4509, 1, 82, "corse"), ("Besançon", 47.2378, 6.0241, 1, 90, "franche-comte"), ("Belfort", 47.6397, 6.8638, 2, 76, "franche-comte"),
    ("Rouen", 49.4432, 1.0993, 1, 95, "haute-normandie"), ("Le Havre", 49.4944, 0.1079, 1, 92, "haute-normandie"), ("Évreux", 49.0241, 1.1508, 2, 74, "haute-normandie"),
    ("Paris", 48.8566, 2.3522, 1, 120, "ile-de-france"), ("Versailles", 48.8014, 2.1301, 1, 84, "ile-de-france"), ("Créteil", 48.7904, 2.4556, 1, 78, "ile-de-france"),
    ("Montpellier", 43.6108, 3.8767, 1, 98, "languedoc-roussillon"), ("Nîmes", 43.8367, 4.3601, 1, 90, "languedoc-roussillon"), ("Perpignan", 42.6887, 2.8948, 1, 86, "languedoc-roussillon"),
    ("Carcassonne", 43.2122, 2.3537, 1, 80, "languedoc-roussillon"), ("Limoges", 45.8336, 1.2611, 1, 90, "limousin"), ("Brive-la-Gaillarde", 45.1589, 1.5333, 1, 76, "limousin"),
    ("Guéret", 46.1719, 1.8717, 2, 68, "limousin"), ("Metz", 49.1193, 6.1757, 1, 92, "lorraine"), ("Nancy", 48.6921, 6.1844, 1, 92, "lorraine"), ("Épinal", 48.1742, 6.4494, 2, 72, "lorraine"),
    ("Toulouse", 43.6047, 1.4442, 1, 105, "midi-pyrenees"), ("Tarbes", 43.2329, 0.0781, 1, 76, "midi-pyrenees"), ("Albi", 43.9298, 2.1480, 1, 76, "midi-pyrenees"),
    ("Rodez", 44.3510, 2.5730, 2, 72, "midi-pyrenees"), ("Montauban", 44.0176, 1.3549, 1, 76, "midi-pyrenees"), ("Lille", 50.6292, 3.0573, 1, 100, "nord-pas-de-calais"),
    ("Douai", 50.3708, 3.0802, 1, 82, "nord-pas-de-calais"), ("Arras", 50.2910, 2.7775, 1, 80, "nord-pas-de-calais"), ("Lens", 50.4289, 2.8318, 1, 78, "nord-pas-de-calais"),
    ("Valenciennes", 50.3571, 3.5183, 1, 78, "nord-pas-de-calais"), ("Calais", 50.9513, 1.8587, 1, 80, "nord-pas-de-calais"), ("Dunkerque", 51.0344, 2.3768, 1, 80, "nord-pas-de-calais"),
    ("Nantes", 47.2184, -1.5536, 1, 100, "pays-de-la-loire"), ("Angers", 47.4784, -0.5632, 1, 90, "pays-de-la-loire"), ("Le Mans", 48.0061, 0.1996, 1, 88, "pays-de-la-loire"),
    ("Laval", 48.0706, -0.7734, 1, 74, "pays-de-la-loire"), ("Amiens", 49.8941, 2.2958, 1, 92, "picardie"), ("Beauvais", 49.4295, 2.0807, 1, 78, "picardie"),
    ("Compiègne", 49.4179, 2.8261, 2, 74, "picardie"), ("Saint-Quentin", 49.8489, 3.2876, 1, 76, "picardie"), ("Poitiers", 46.5802, 0.3404, 1, 88, "poitou-charentes"),
    ("La Rochelle", 46.1603, -1.1511, 1, 86, "poitou-charentes"), ("Angoulême", 45.6484, 0.1562, 1, 78, "poitou-charentes"), ("Niort", 46.3237, -0.4588, 1, 76, "poitou-charentes"),
    ("Marseille", 43.2965, 5.3698, 1, 110, "provence-alpes-cote-d-azur"), ("Nice", 43.7102, 7.2620, 1, 102, "provence-alpes-cote-d-azur"),
    ("Toulon", 43.1242, 5.9280, 1, 90, "provence-alpes-cote-d-azur"), ("Aix-en-Provence", 43.5297, 5.4474, 1, 88, "provence-alpes-cote-d-azur"),
    ("Avignon", 43.9493, 4.8055, 1, 86, "provence-alpes-cote-d-azur"), ("Lyon", 45.7640, 4.8357, 1, 108, "rhone-alpes"), ("Grenoble", 45.1885, 5.7245, 1, 94, "rhone-alpes"),
    ("Saint-Étienne", 45.4397, 4.3872, 1, 90, "rhone-alpes"), ("Annecy", 45.8992, 6.1294, 1, 84, "rhone-alpes"), ("Chambéry", 45.5646, 5.9178, 1, 78, "rhone-alpes"),
    ("Valence", 44.9334, 4.8924, 1, 78, "rhone-alpes"), ("Pointe-à-Pitre", 16.2411, -61.5331, 1, 72, "guadeloupe"), ("Cayenne", 4.9224, -52.3135, 1, 80, "guyane"),
    ("Fort-de-France", 14.6161, -61.0588, 1, 80, "martinique"), ("Mamoudzou", -12.7806, 45.2278, 1, 76, "mayotte"), ("Saint-Denis de La Réunion", -20.8789, 55.4481, 1, 80, "reunion"),
)


def cities(spark: SparkSession) -> DataFrame:
    """(place_id, name, kind, rank, lat_e7, lon_e7, region): the list's places, numbered -1, -2 and so on."""
    rows = [(-1 - k, name, kind, rank, round(lat * 1e7), round(lon * 1e7), region) for k, (name, lat, lon, kind, rank, region) in enumerate(CITIES)]
    return spark.createDataFrame(rows, "place_id long, name string, kind int, rank int, lat_e7 long, lon_e7 long, region string")


def regions(spark: SparkSession) -> DataFrame:
    """(region_no, region, lat, lon): 27 rows."""
    return spark.createDataFrame([(k, *r) for k, r in enumerate(REGIONS)], "region_no int, region string, lat double, lon double")


def neighbours(spark: SparkSession) -> DataFrame:
    """(a, b): numbers of regions that touch, both ways."""
    no = {name: k for k, (name, _, _) in enumerate(REGIONS)}
    pairs = [(no[a], no[b]) for a, names in NEIGHBOURS.items() for b in names.split()]
    return spark.createDataFrame(pairs + [(b, a) for a, b in pairs], "a int, b int")
