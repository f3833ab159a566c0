"""Formats value by value."""

import datetime as dt

from pyspark.sql import functions as F

from listloom.functions import formats

NOW = "2024-05-10 12:00:00"
ADDRESSES = [
    ("12 BD VICTOR HUGO, 06000 NICE", "12 Boulevard Victor Hugo"), ("7 ET 9 rue papon", "7 et 9 Rue Papon"), ("37 - 39 av. de l'ariane", "37-39 Avenue de l’Ariane"),
    ("rue pie xii", "Rue Pie XII"), ("rue jean xiv", "Rue Jean XIV"), ("77BIS ch. des saint-pierre ,", "77bis Chemin des Saint-Pierre"), ("  ", "inconnu"), (None, "inconnu"),
]
DAYS = [
    (dt.datetime(2024, 5, 10, 1), "Aujourd'hui", "Dispo maintenant"), (dt.datetime(2024, 5, 9, 23), "Hier", "Dispo maintenant"), (dt.datetime(2024, 5, 13, 12), "lundi 13 mai", "Dispo maintenant"),
    (dt.datetime(2024, 8, 1), "jeudi 1 août", "Dispo 1 août"), (dt.datetime(2025, 2, 2), "dimanche 2 février", "Dispo 2 févr. 2025"), (None, None, None),
]


def test_addresses(spark):
    df = spark.createDataFrame(ADDRESSES, "a string, want string")
    assert [tuple(r) for r in df.select(formats.format_address(F.col("a")), "want").collect() if r[0] != r[1]] == []
    d = spark.createDataFrame([(" - vieux  port —", "Vieux Port"), ("le port", "le Port"), ("–", "inconnu"), (None, "inconnu")], "a string, want string")
    assert [tuple(r) for r in d.select(formats.format_district(F.col("a")), "want").collect() if r[0] != r[1]] == []


def test_days(spark):
    df = spark.createDataFrame([(d and d.isoformat(sep=" "), a, b) for d, a, b in DAYS], "d string, day string, free string").withColumn("d", F.col("d").cast("timestamp"))
    got = df.select(formats.format_day(F.col("d"), F.lit(NOW).cast("timestamp")), "day", formats.format_availability(F.col("d"), F.lit(NOW).cast("timestamp")), "free").collect()
    assert [tuple(r) for r in got if (r[0], r[2]) != (r[1], r[3])] == []


def test_small_ones(spark):
    one = spark.range(1).select(
        formats.format_rooms(F.lit(1)), formats.format_rooms(F.lit(3)), formats.format_rooms(F.lit(None).cast("int")), formats.format_duration(F.lit(7)),
        formats.format_time(F.lit(NOW).cast("timestamp")), formats.tel_link(F.lit("06 12.34")), formats.format_source_name(F.lit("old-town_flats"), {"x": "X"}), formats.format_source_name(F.lit("x"), {"x": "Ex"}),
    ).first()
    assert tuple(one) == ("1 pièce", "3 pièces", "inconnu", "7 min", "12:00", "tel:0612.34".replace(".", ""), "Old Town Flats", "Ex")
