"""Table-driven tests of the scalars, on own sentences."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from listloom.functions import geo, listing, parse, text
from listloom.operators import filters


def values(spark, f, inputs):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(inputs)], "k int, t string")
    return [r["v"] for r in df.select("k", f(F.col("t")).alias("v")).orderBy("k").collect()]


CASES = [
    (text.clean_text, [("a&nbsp;b  c\n", "a b c"), ("&amp;lt;", "&lt;"), (None, None)]),
    (text.clean_multiline, [("a \n\n\n\n b\n", "a\n\nb"), (" x ", "x")]),
    (text.comparable, [("Été à l'Île!", "ete a l ile"), ("œuf", "uf"), ("  ", "")]),
    (text.commune_fold, [("Aix-en-Provence", "aix en provence"), ("L’Isle", "l isle")]),
    (text.comparable_address, [("12 av. Foch", "12 avenue foch"), ("3, Bd de Brest", "3 boulevard de brest")]),
    (text.slugify, [("Beau T2 à Nîmes", "beau-t2-a-nimes")]),
    (lambda c: F.array_join(text.tokenize(c), " "), [("Le bel appartement pour les amis", "bel appartement amis")]),
    (text.parse_number, [("1 234,56", 1234.56), ("1.234", 1234.0), ("12.5", 12.5), ("1,234.5", 1234.5), ("x", None), ("3,", 3.0)]),
    (lambda c: text.extract_number(c, 10, 20), [("5 puis 12,5 et 15", 12.5), ("99", None)]),
    (lambda c: text.clamp_score(c.cast("double")), [("-3", 0), ("49.5", 50), ("140", 100), (None, 0), ("NaN", 0)]),
    (text.redact, [("bob@x.org token=abc", "[mail] token=[hidden]")]),
    (lambda c: parse.parse_price(c)["amount"], [("1 250,50 € CC", 1250.5), ("loyer 700 euros", 700.0), ("12 €", None), ("", None)]),
    (lambda c: parse.parse_price(c)["charges_included"], [("700 € CC", True), ("700 € HC", False), ("700 €", None), ("charges comprises 9 €", True)]),
    (parse.parse_charges, [("dont charges 60 €", 60.0), ("charges : 55,5 euros", 55.5), ("sans rien", None)]),
    (parse.parse_area, [("34,5 m²", 34.5), ("3 m2", None), ("120 m2", 120.0)]),
    (parse.parse_rooms, [("Beau T3 calme", 3), ("studio", 1), ("deux pièces", 2), ("4 pieces", 4), ("maison", None)]),
    (parse.parse_bedrooms, [("2 chambres", 2), ("trois chambres", 3), ("rien", None)]),
    (parse.parse_property_type, [("Parking box", "parking"), ("Villa", "house"), ("", "unknown"), ("péniche", "other"), ("T2", "apartment")]),
    (parse.parse_furnished, [("non meublé", False), ("meublée", True), ("calme", None)]),
    (parse.parse_flat_share, [("colocation possible", True), ("pas de colocation", False), ("seul", None)]),
    (parse.is_student_only, [("Résidence étudiante", True), ("famille", False)]),
    (parse.is_short_student_lease, [("bail étudiant 9 mois", True), ("9 mois", False)]),
    (parse.parse_dpe, [(" d ", "D"), ("DPE : C", "C"), ("classe énergie classe B", "B"), ("dpe vierge", None)]),
    (parse.parse_max_occupants, [("maximum 3 personnes", 3), ("2/3 personnes", 3), ("4 couchages", 4), ("pour 2 locataires", None), ("4 locataires au total", 4), ("idéal 3 colocataires", 3), ("21 personnes", None), ("x", None)]),
    (parse.parse_postal_code, [("à 06000 ici", "06000"), ("123456", None)]),
    (parse.parse_phone, [("tél 06.12.34.56.78", "+33612345678"), ("+33 6 12 34 56 78", "+33612345678"), ("12", None)]),
    (parse.parse_email, [("A@Ex.Org", "a@ex.org"), ("x", None)]),
    (lambda c: F.array_join(parse.extract_features(c), ","), [
        ("3e étage avec ascenseur et balcon", "floor:3,balcony,lift"), ("sans ascenseur", ""), ("proche parking", ""),
        ("parking de la résidence", ""), ("rdc, cave", "floor:0,cellar"), ("sans balcon mais beau balcon fermé", "balcony"),
    ]),
    (parse.extract_street_address, [("au 12 rue des Lilas, calme", "12 rue des Lilas"), ("loin", None)]),
    (parse.address_grade, [("12 rue X", 2), ("rue des Lilas", 1), ("centre", 0)]),
    (lambda c: parse.parse_requirements(c)["min_income"], [("revenus minimum 2400 euros", 2400.0), ("rien", None)]),
    (lambda c: F.array_join(parse.parse_requirements(c)["situations"], ","), [("CDI ou étudiants", "permanent,student"), ("x", "")]),
    (listing.canonical_district, [("au Vieux Port", "port"), ("proche gare", None), ("quartier gare", "gare"), ("x", None)]),
    (lambda c: listing.split_commune(c)["commune"], [("Aix-en-Provence centre", "aix en provence"), ("nulle part", None)]),
    (listing.title_case, [("RUE DE LA MER", "Rue de la Mer"), ("saint-denis", "Saint-Denis")]),
    (listing.format_phone, [("+33612345678", "06 12 34 56 78"), ("x", "x")]),
    (lambda c: listing.format_price(c.cast("double"), F.lit(True)), [("1234.4", "1 234 € CC"), (None, None)]),
    (lambda c: listing.format_area(c.cast("double")), [("34", "34 m²"), ("34.55", "34.6 m²")]),
    (lambda c: listing.format_age(c.cast("int")), [("30", "now"), ("120", "2 min"), ("7200", "2 h"), ("200000", "2 d")]),
    (listing.image_identity, [("https://A.org/p/1.jpg?w=2#x", "a.org/p/1.jpg"), ("no", None)]),
    (lambda c: listing.portal_label(c, {"a.org": "A"}), [("https://www.a.org/x", "A"), ("https://ba.org", None)]),
    (lambda c: F.array_join(listing.addresses_in(c), ","), [("Bob <B@x.org>, b@x.org, c@y.fr", "b@x.org,c@y.fr")]),
    (listing.charges_from_mentions, [("provision pour charges : 80 €", 80.0), ("provisions", None)]),
    (listing.short_reference, [("ab-12/3", "AB123"), ("--", None)]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalars(spark, case):
    f, pairs = CASES[case]
    assert values(spark, f, [a for a, _ in pairs]) == [b for _, b in pairs]


def test_dates(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    got = values(spark, lambda c: parse.parse_published_at(c, now), ["2024-03-02", "il y a 2 jours", "31/02/2024", "hier", "1/1/1999", "zut"])
    day = lambda *a: dt.datetime(*a)
    assert got == [day(2024, 3, 2), day(2024, 4, 29, 12), day(2024, 3, 2), day(2024, 4, 30, 12), None, None]
    today = F.lit("2024-05-01").cast("date")
    got = values(spark, lambda c: parse.parse_available_at(c, today), ["le 1er juin", "15 janvier", "dispo 02/09/2024", "libre de suite", "x", "20 avril"])
    assert got == [dt.date(2024, 6, 1), dt.date(2025, 1, 15), dt.date(2024, 9, 2), dt.date(2024, 5, 1), None, dt.date(2024, 4, 20)]
    got = values(spark, lambda c: listing.next_weekday_arrival(c.cast("date")), ["2024-05-03", "2024-05-05"])
    assert got == [dt.datetime(2024, 5, 6, 9), dt.datetime(2024, 5, 6, 9)]


def test_geography_and_lookups(spark):
    row = spark.range(1).select(
        geo.haversine_km(F.lit(48.8566), F.lit(2.3522), F.lit(45.764), F.lit(4.8357)).alias("km"),
        geo.estimated_minutes(F.lit(3.0), "walk").alias("walk"), geo.converted_minutes(F.lit(30), "transit", "bike").alias("bike"),
        geo.reference_rent(F.lit(7)).alias("rent"), listing.journey_minutes(F.array(F.lit(620), F.lit(900))).alias("j"),
        listing.channel(F.lit(None), F.lit("f"), F.lit("p")).alias("channel"), listing.most_recent(F.lit("2024-01-02"), F.lit("bad")).alias("d"),
        parse.same_street(F.lit("12 rue des Lilas"), F.lit("Rue des lilas")).alias("same"),
        parse.best_address(F.lit("centre"), F.lit("3 rue Haute")).alias("best"), parse.is_sale(F.lit("https://x/vente/1"), F.lit("")).alias("sale"),
    ).first()
    assert abs(row["km"] - 391.5) < 1 and row["walk"] == 52 and row["bike"] == 39 and row["rent"] == 19.73
    assert (row["j"], row["channel"], row["d"], row["same"], row["best"], row["sale"]) == (10, "form", dt.date(2024, 1, 2), True, "3 rue Haute", True)
    points = F.array(F.struct(F.lit("work").alias("label"), F.lit("transit").alias("mode"), F.lit(48.86).alias("lat"), F.lit(2.36).alias("lon")))
    known = F.create_map(F.lit("work"), F.lit(44))
    d = spark.range(1).select(geo.distances(F.lit(48.85), F.lit(2.35), points, known).alias("d")).first()["d"]
    assert d[0]["minutes"] == 44
    far = spark.range(1).select(filters.commute_exceeds(geo.distances(F.lit(48.85), F.lit(2.35), points, known), 40).alias("x")).first()["x"]
    assert far is True


def test_search_token_round_trip(spark):
    fields = F.struct(F.lit(900).alias("max_price"), F.lit("à côté").alias("city"))
    token = listing.search_token(fields)
    row = spark.range(1).select(token.alias("t"), listing.read_search_token(token, "max_price int, city string").alias("b")).first()
    assert row["b"].asDict() == {"max_price": 900, "city": "à côté"} and not set(row["t"]) & set("+/=")
    assert listing.search_token_of({"a": 1}) == "eyJhIjoxfQ"
    bad = spark.range(1).select(listing.read_search_token(F.lit("%%%"), "a int").alias("b")).first()["b"]
    assert bad is None or bad["a"] is None


def test_guards_plans_and_criteria(spark):
    now = F.lit("2024-05-01 12:00:00").cast("timestamp")
    early = F.lit("2024-05-01 11:30:00").cast("timestamp")
    row = spark.range(1).select(
        filters.plan_is_valid(F.lit("active"), now + F.expr("interval 1 day"), now).alias("ok"), filters.plan_is_valid(F.lit("ended"), now, now).alias("no"),
        filters.due(F.lit("hourly"), early, now).alias("h"), filters.due(F.lit("each"), early, now).alias("e"), filters.due(F.lit("daily"), F.lit(None).cast("timestamp"), now).alias("d"),
        filters.first_failure((F.lit(True), "a"), (F.lit(None).cast("boolean"), "b"), (F.lit(False), "c")).alias("f"),
    ).first()
    assert (row["ok"], row["no"], row["h"], row["e"], row["d"], row["f"]) == (True, False, False, True, True, "b")
    base = filters.Criteria(max_price=1000.0)
    assert filters.Criteria(min_price=5, max_price=2).checked(base) is base
    assert filters.Criteria(max_price=7.0).checked(base).max_price == 7.0
    assert filters.Criteria(max_price="x").checked(base) is base
    assert listing.describe_search(filters.Criteria(max_price=900, min_area=20, city="arles")) == "up to 900, from 20 m2, arles"
