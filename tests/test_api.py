"""Routes and registered functions on small tables."""

import datetime as dt

from pyspark.sql import functions as F

from listloom import api
from listloom.functions.register import register
from listloom.operators import filters

T = dt.datetime(2024, 5, 1)


def tables(spark):
    listings = spark.createDataFrame(
        [(1, 700.0, 30.0, "arles", "apartment", "active", "q1", T), (2, None, 20.0, "arles", "studio", "active", "q1", T),
         (3, 900.0, 40.0, "arles", "parking", "active", "q2", T), (4, 650.0, None, "brest", "apartment", "inactive", None, T)],
        "id int, price double, area double, city string, property_type string, lifecycle string, district string, first_seen timestamp",
    )
    state = spark.createDataFrame(
        [(1, 7, True, False, False, "new", T), (2, 7, False, True, False, None, None), (1, 8, True, True, True, "new", None)],
        "id int, user_id int, viewed boolean, favorite boolean, archived boolean, tracking string, notified_at timestamp",
    )
    score = spark.createDataFrame([(1, 7, 90, 50, 50, 10, True), (2, 7, 80, 90, 90, 0, True), (3, 7, 9, 9, 9, 9, False)],
                                  "id int, user_id int, match int, opportunity int, visit int, risk int, matches boolean")
    return listings, state, score


def test_lists_and_stats(spark):
    listings, state, score = tables(spark)
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(api.list_listings(listings, city="arles", mode="price")) == [1, 2]
    mine = api.list_listings(listings, state, score, 7)
    assert ids(mine) == [2, 1] and ids(api.list_listings(listings, state, score, 7, limit=1, offset=1)) == [1]
    assert ids(api.list_listings(listings, state, score, 7, filters.Criteria(max_price=600.0))) == [2]
    assert ids(api.list_listings(listings, state, score, 8)) == []
    row = api.stats(listings, state, score, 7).first()
    assert (row["listings"], row["matching"], row["active"], row["viewed"], row["favorite"]) == (4, 2, 3, 1, 1)
    assert [tuple(r) for r in api.list_districts(listings).collect()] == [("q1", 2), ("q2", 1)]
    assert [(r["id"], r["unread"]) for r in api.list_alerts(state, F.lit(T), 7).collect()] == [(1, False)]


def test_details_contacts_and_agencies(spark):
    listings, state, _ = tables(spark)
    ads = spark.createDataFrame([(1, "a", "x", "active", T), (1, "b", "x", "active", T), (2, "a", "y", "inactive", T)],
                                "listing_id int, source_id string, agency string, lifecycle string, last_seen timestamp")
    assert [o["source_id"] for o in api.listing_detail(listings, ads, 1).first()["occurrences"]] == ["a", "b"]
    assert api.listing_detail(listings, ads, 3).first()["occurrences"] is None
    assert [tuple(r)[:3] for r in api.list_agencies(ads).collect()] == [("x", 1, "a,b")]
    assert [r["id"] for r in api.agency_listings(listings, ads, "y").collect()] == [2]
    old = spark.createDataFrame([(7, 1, T, 0)], "user_id int, listing_id int, at timestamp, follow_up int")
    new = spark.createDataFrame([(7, 1, T), (7, 2, T)], "user_id int, listing_id int, at timestamp")
    assert sorted((r["listing_id"], r["follow_up"]) for r in api.add_contact(old, new).collect()) == [(1, 0), (1, 1), (2, 0)]
    changes = spark.createDataFrame([(1, 7, None, T + dt.timedelta(1)), (9, 7, True, T)], "id int, user_id int, favorite boolean, notified_at timestamp")
    got = {(r["id"], r["user_id"]): r for r in api.patch_state(state, changes).collect()}
    assert got[1, 7]["favorite"] is False and got[1, 7]["notified_at"] == T and got[9, 7]["favorite"] is True and len(got) == 4


def test_registered_functions(spark):
    register(spark)
    row = spark.sql("SELECT decode_entities('a&eacute;&#65;&amp;amp;') AS d, fold_text('Crème &amp; ŒUFS—Été') AS f, fold_text(NULL) AS n").first()
    assert (row["d"], row["f"], row["n"]) == ("aéA&amp;", "creme ufs ete", None)
    page = '<a href="u1"><b>T2</b> 700 €</a><a href="u2">more</a><a class="x" href="u3">900 eur</a>'
    assert [tuple(r) for r in spark.sql(f"SELECT * FROM mail_cards('{page}')").collect()] == [("u1", "T2 700 €"), ("u3", "900 eur")]
