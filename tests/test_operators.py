"""Operators on small tables, against brute force where order matters."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from listloom.operators import affinity, entities, filters, lists, schedule, scoring, timelines
from listloom.sources import normalize, pages, registry
from listloom.streaming import events as streams


def occurrences(n=60, seed=1):
    rng = random.Random(seed)
    maybe = lambda v, p=0.15: None if rng.random() < p else v
    rows = []
    for i in range(n):
        k = rng.randint(0, n // 6)
        rows.append((
            i, f"s{rng.randint(0, 2)}", maybe("arles"), maybe("13200"), maybe(600.0 + 10 * k + rng.choice([0, 0, 0, 20])), maybe(30.0 + k + rng.choice([0, 0.25])),
            maybe(1 + k % 3), maybe(f"+3360000{k:04d}", 0.4), maybe(f"u{k}@x", 0.5), maybe(f"a{k % 4}"), maybe("q1"), ["bel", "appart", f"t{k}"],
        ))
    return rows


SCHEMA = "id long, source_id string, city string, postal_code string, price double, area double, rooms int, phone string, email string, agency string, district string, title_tokens array<string>"


def test_clusters_against_brute_force(spark):
    rows = occurrences()
    df = entities.prepared(spark.createDataFrame(rows, SCHEMA), relays=("s1",))
    scored = entities.verdicts(entities.candidate_pairs(df), df).cache()
    # What passes the vetoes inside the block join is what the scores of all pairs leave.
    assert sorted(entities.matches(df).collect()) == sorted(scored.filter("verdict <> 'distinct'").collect())
    got = {r["id"]: r["cluster"] for r in entities.constrained_clusters(df, scored).collect()}
    info = {r[0]: r for r in rows}

    def conflict(a, b):
        a, b = info[a], info[b]
        if a[1] != b[1] or (a[1] == "s1" and None not in (a[9], b[9]) and a[9] != b[9]):
            return False
        if None not in (a[4], b[4]) and abs(a[4] - b[4]) > 0.5:
            return True
        if None in (a[5], b[5]) or abs(a[5] - b[5]) < 0.005:
            return False
        fits = lambda x, y: x == int(x) and x in (int(y), int(y + 0.5))
        return not (fits(a[5], b[5]) or fits(b[5], a[5]))

    cluster = {i: {i} for i in info}
    links = sorted((-r["score"], r["left_id"], r["right_id"]) for r in scored.filter("verdict = 'duplicate'").collect())
    for _, a, b in links:
        x, y = cluster[a], cluster[b]
        if x is not y and not any(conflict(i, j) for i in x for j in y):
            x |= y
            for i in y:
                cluster[i] = x
    assert got == {i: min(c) for i, c in cluster.items()}
    pairs = {(r["left_id"], r["right_id"]) for r in scored.filter("verdict = 'ambiguous'").collect()}
    by_cluster = {r["cluster"]: r["pairs"] for r in entities.ambiguous_by_cluster(entities.constrained_clusters(df, scored), scored).collect()}
    assert {(p["left_id"], p["right_id"]) for own in by_cluster.values() for p in own} == pairs
    assert all(got[p["left_id"]] == c for c, own in by_cluster.items() for p in own)
    more = {r["cluster"] for r in entities.constrained_clusters(df, scored, merge_ambiguous=True).collect()}
    assert len(more) < len(set(got.values()))
    assert len(set(got.values())) < len(rows)


def test_blocks_of_200_and_201(spark):
    rows = [(i, "s", None, None, None, None, None, "+331" if i < 200 else "+332", None, None, None, []) for i in range(401)]
    df = entities.prepared(spark.createDataFrame(rows, SCHEMA))
    assert [tuple(r) for r in entities.skipped_blocks(df).collect()] == [("tel:+332", 201)]
    assert {r["key"] for r in entities.blocks(df).select("key").distinct().collect()} == {"tel:+331"}
    assert entities.candidate_pairs(df).count() == 200 * 199 // 2


def test_merge_keeps_provenance(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    rows = [
        ("g", 1, "a", 700.0, 30.0, None, "arles", None, None, None, None, "+331", None, "inactive", t(3), t(4)),
        ("g", 2, "b", 705.0, 30.01, 2, None, None, None, True, "x", None, "m@x", "active", t(2), t(9)),
        ("g", 3, "b", 760.0, 30.0, 2, None, None, None, None, None, None, None, "active", t(1), t(2)),
        ("g", 4, "c", None, None, 3, None, "13200", None, None, None, None, None, "possiblyInactive", t(5), t(6)),
    ]
    schema = "group_id string, id long, source_id string, price double, area double, rooms int, city string, postal_code string, district string, furnished boolean, agency string, phone string, email string, lifecycle string, first_seen timestamp, last_seen timestamp"
    m = entities.merge_groups(spark.createDataFrame(rows, schema)).first()
    assert m["price"]["value"] == 705.0 and m["price"]["source_id"] == "b" and [c["value"] for c in m["price"]["conflicts"]] == [700.0] and [c["value"] for c in m["area"]["conflicts"]] == [30.0]
    assert m["rooms"]["value"] == 2 and [c["value"] for c in m["rooms"]["conflicts"]] == [3]
    assert (m["id"], m["lifecycle"], m["phone"], m["email"], m["provided_by"]) == (3, "active", "+331", "m@x", ["a", "b"])
    assert m["city"]["value"] == "arles" and m["district"]["value"] is None


def test_survival_edges(spark):
    def curve(rows):
        df = spark.createDataFrame(rows, "days double, ended boolean")
        return [(r["day"], r["at_risk"], round(r["share"], 6)) for r in timelines.survival_curve(df).orderBy("day").collect()], df

    assert curve([])[0] == []
    assert curve([(3.0, False), (5.0, False)])[0] == []
    got, df = curve([(1.0, True), (1.0, True), (2.0, False), (4.0, True), (-1.0, True), (float("nan"), True), (None, True)])
    assert got == [(1.0, 4, 0.5), (4.0, 1, 0.0)]
    s = timelines.survival_summary(df, timelines.survival_curve(df)).first()
    assert (s["median"], s["horizon"], s["completed"], s["censored"], s["at_risk_3"], s["alive_3"], s["alive_7"]) == (1.0, 4.0, 3, 1, 1, 0.5, None)


@pytest.mark.parametrize(
    ("old", "new", "kind"),
    [((9, 1, None), (8, 1, None), "price-drop"), ((None, 1, None), (8, 1, None), "price-rise"), ((9, 1, None), (9, 2, None), "area"),
     ((9, 1, None), (9, 1, "2024-01-01"), "availability"), ((9, 1, None), (8, 2, None), "multiple"), ((9, 1, None), (9, 1, None), None)],
)
def test_change_kinds(spark, old, new, kind):
    c = [F.lit(v).cast(t) for a, b in zip(old, new) for v, t in ((a, "string"), (b, "string"))]
    assert spark.range(1).select(timelines.change_kind(c[0].cast("double"), c[1].cast("double"), c[2], c[3], c[4], c[5]).alias("k")).first()["k"] == kind


def test_absence_and_ladder(spark):
    ok = lambda k, s: spark.range(1).select(timelines.absence_is_believable(F.lit(k), F.lit(s)).alias("x")).first()["x"]
    assert [ok(9, 1), ok(10, 4), ok(10, 5), ok(3, 0)] == [True, False, True, False]
    runs = [spark.range(1).select(timelines.missing_ladder(F.lit(n), F.lit("active")).alias("x")).first()["x"] for n in (1, 2, 3)]
    assert runs == ["active", "possiblyInactive", "inactive"]


def test_schedule_prefers_the_starving(spark):
    rows = [("a", 60, 10.0, 720.0, 0.0, True, 0, True, False, 0, None, 2), ("b", 60, 10.0, 720.0, 3.0, True, 0, True, False, 0, 0, 9),
            ("c", 60, 10.0, 720.0, 1.0, True, 0, True, False, 0, 920, 1), ("d", 60, 10.0, 720.0, 1.0, True, 2, True, False, 0, 900, 1),
            ("e", 60, 10.0, 720.0, 1.0, True, 0, False, False, 0, 0, 1), ("f", 60, 10.0, 720.0, 1.0, True, 0, True, True, 0, 0, 1)]
    schema = "source_id string, interval int, least double, most double, average_new double, succeeded boolean, errors int, enabled boolean, blocked boolean, cooldown_until int, last_run int, priority int"
    got = schedule.plan(schedule.decisions(spark.createDataFrame(rows, schema), F.lit(1000)), 2).orderBy("place").collect()
    assert [(r["source_id"], r["selected"]) for r in got] == [("b", True), ("c", True), ("a", False)]


def test_page_bounds_and_unknown_modes(spark):
    df = spark.range(600).select("id", F.lit(None).cast("double").alias("price"), (F.col("id") % 7).alias("priority"), F.lit(0).alias("first_seen"))
    assert lists.page(df, lists.order("price"), 9999).count() == 500 and lists.page(df, lists.order("zzz"), -3, -9).count() == 1
    assert lists.page(df, lists.order("price")).first()["id"] == 0
    assert [str(c) for c in lists.order("closest", anonymous=True)] == [str(c) for c in lists.order("recent")]


def test_three_filter_policies_on_unknowns(spark):
    df = spark.createDataFrame([(1, None, None, None, None, None, "unknown", None, None, False, None)],
                               "id int, price double, area double, rooms int, max_occupants int, property_type string, landlord string, flat_share boolean, furnished boolean, student_only boolean, district string")
    df = df.withColumns({"commute": F.lit(None).cast("int"), "available_at": F.lit(None).cast("timestamp"), "city": F.lit("arles")})
    keeps = lambda c: df.filter(c).count() == 1
    c = filters.Criteria(max_price=900.0, min_area=10.0, city="arles")
    assert keeps(filters.live_numbers(c)) and not keeps(filters.quick_filters(max_price=900)) and keeps(filters.quick_filters(occupants=2))
    assert not keeps(scoring.near_miss(c))
    t = filters.Traits
    assert keeps(filters.trait_conditions(t(flat_share="none", student="none", landlord="private", furnished="no", max_commute=3, available_by="2024-01-01", districts=("q",))))
    assert not keeps(filters.trait_conditions(t(landlord="agency"))) and not keeps(filters.trait_conditions(t(districts=("q",), unknown_district=False)))


def test_affinity_needs_two_liked(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "id int, f string")
    acted = lambda r: spark.createDataFrame(r, "id int, favorite boolean, tracking string, viewed boolean, archived boolean")
    one = affinity.affinities(rows, acted([(1, True, None, False, False)]), F.array("f"))
    assert {r["affinity"] for r in one.collect()} == {0.0}
    two = affinity.affinities(rows, acted([(1, True, None, True, False), (2, False, "visited", False, False), (3, False, "rejected", False, False)]), F.array("f"))
    assert {r["id"]: r["affinity"] for r in two.collect()} == {1: 1.0, 2: 1.0, 3: 0.0}


PAGE = """<html lang="fr"><head><title>Deux pièces</title><script type="application/ld+json">{"@graph":[{"@type":"Offer","name":"n","price":"700"},{"@type":"Place"}]}</script>
<script type="application/ld+json">{broken</script></head><body><p>Un<br>deux</p><a href="/x">y</a></body></html>"""


def test_pages_json_ld_and_sitemaps(spark):
    df = spark.createDataFrame([(1, "http://h.org/p/a?q=1", PAGE), (2, "u", ""), (3, None, None)], "page_id long, url string, html string")
    assert [(r["page_id"], r["type"], r["price"]) for r in pages.json_ld(df).collect()] == [(1, "Offer", "700"), (1, "Place", None)]
    assert [r["href"] for r in pages.links(df).collect()] == ["/x"]
    assert df.select(pages.lined_text(F.lit("<p>Un<br>deux</p><b>x</b> y")).alias("t")).first()["t"].strip() == "Un\ndeux\nx y"
    xml = spark.createDataFrame([("<urlset><url><loc> http://a/arles/1 </loc><lastmod>2024-02-01</lastmod></url><url><loc>http://a/arles/2</loc><lastmod>2024-03-01</lastmod></url>"
                                  "<url><loc>http://a/brest/3</loc><lastmod>2024-03-01</lastmod></url></urlset><sitemap><loc>s1</loc></sitemap>",)], "xml string")  # fmt: skip
    entries = pages.sitemap(xml)
    assert entries.count() == 3 and [r["loc"] for r in pages.sitemap_index(xml).collect()] == ["s1"]
    known = spark.createDataFrame([("http://a/arles/1",)], "loc string")
    confirmed, visit = pages.crawl_candidates(entries, known, "2024-01-15", 5, ["arles"])
    assert [r["loc"] for r in confirmed.collect()] == ["http://a/arles/1"] and [r["loc"] for r in visit.collect()] == ["http://a/arles/2"]


def test_mails_links_and_images(spark):
    import base64

    wrapped = base64.urlsafe_b64encode(b"https://real.org/ad/7?x=1").decode().rstrip("=")
    mail = f'<a href="https://t.org/r?url=https%3A%2F%2Fp.org%2F1">T2 700 €</a><a href="https://t.org/{wrapped}">T3 900 €</a><a href="#">plus</a><a href="https://p.org/1?y">T2 700 € bis</a>'
    cards = pages.mail_cards(spark.createDataFrame([(1, mail), (2, None)], "mail_id int, html string")).orderBy("ref").collect()
    assert [(r["ref"], r["text"]) for r in cards] == [("https://p.org/1", "T2 700 €"), ("https://real.org/ad/7", "T3 900 €")]
    one = spark.range(1).select(
        pages.recipient_token(F.lit("alerts+abc123@x.org")).alias("t"), pages.recipient_token(F.lit("bob@x.org")).alias("n"),
        pages.proxied_image(F.array(*[F.lit(wrapped[k : k + 5]) for k in range(0, len(wrapped), 5)])).alias("i"), pages.proxied_image(F.array(F.lit("AAAA"))).alias("bad"),
    ).first()
    assert (one["t"], one["n"], one["i"], one["bad"]) == ("abc123", None, "https://real.org/ad/7?x=1", None)
    names = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    assert [r["name"] for r in pages.unknown_names(names("Agence du Port", "Neuve Immo"), names("Du Port")).collect()] == ["Neuve Immo"]


def test_normalize_and_registry(spark):
    rows = [("7", "Appartement T2 meublé", "Bel appart, 2 pièces 34,5 m², balcon. 12 rue Haute. DPE C. Tél 06 12 34 56 78", "720 € CC", "https://x/location/7"),
            ("8", "Maison à vendre", "", "100 €", "https://x/vente/8"), ("9", None, "x", "1", None)]
    raw = lambda s: s.createDataFrame(rows, "source_ref string, title string, description string, price_text string, source_url string")
    r = registry.Registry()
    r.add(registry.Source("one", "portal", "html", read=raw))
    r.add(registry.Source("two", "portal", "api", enabled=False, read=raw))
    with pytest.raises(ValueError, match="twice"):
        r.add(registry.Source("one", "portal", "html"))
    assert [s.source_id for s in r.enabled()] == ["one"] and r.table(spark).count() == 2 and r.get("two").method == "api"
    got = normalize.normalize(r.collect(spark, ["one"]), F.lit("2024-05-01 12:00:00").cast("timestamp"), "agency").collect()
    assert len(got) == 1
    g = got[0]
    assert (g["id"], g["price"], g["charges_included"], g["area"], g["rooms"], g["furnished"], g["dpe"], g["phone"], g["landlord"], g["property_type"]) == (
        "one:7", 720.0, True, 34.5, 2, True, "C", "+33612345678", "agency", "apartment")
    assert g["features"] == ["balcony"] and g["address"].startswith("12 rue Haute")


def test_snapshots_lookups_and_memory(spark, tmp_path):
    df = spark.createDataFrame([(1, "k"), (2, "m"), (3, None), (4, "z")], "id int, key string")
    assert registry.write_snapshot(df, str(tmp_path), 3).endswith("v=00000003") and registry.read_snapshot(spark, str(tmp_path), 3).count() == 4
    cache = spark.createDataFrame([("k", 1.5), ("m", None)], "key string, lat double")
    found, missing = registry.with_lookup(df, cache, "key", "lat")
    assert {r["id"]: r["lat"] for r in found.collect()} == {1: 1.5, 2: None, 3: None, 4: None} and [r["key"] for r in missing.collect()] == ["z"]
    memory = spark.createDataFrame([(1, "old"), (3, "kept")], "id int, key string")
    assert {r["id"]: r["key"] for r in registry.filled_from_memory(df, memory, "id", ["key"]).collect()}[3] == "kept"
    assert [r["id"] for r in registry.vanished(df, df.filter("id > 2"), "id", 1).collect()] == [1]
    links = spark.createDataFrame([(1, 9), (2, 9), (2, 8)], "orphan int, successor int")
    assert [tuple(r) for r in registry.absorbed(links.select("orphan").distinct(), links).collect()] == [(1, 9)]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=17 * i), i % 3, "error" if i % 4 == 0 else "view") for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    df.write.parquet(f"{tmp_path}/events.parquet")
    stream = streams.stream(spark, f"{tmp_path}/events.parquet", df.schema)
    live = streams.run_to_table(streams.tumbling(stream, "2 hours", late="1 day"), "complete")
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(live) == key(streams.tumbling(df, "2 hours"))
    states = {r["user_id"]: r["health"] for r in streams.health_states(spark, stream).collect()}
    last = {u: max(r for r in rows if r[2] == u)[3] for u in range(3)}
    assert {u: s != "healthy" for u, s in states.items()} == {u: k == "error" for u, k in last.items()}


def test_cohort_drops_stock(spark):
    t = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    rows = [("g0", "s", t(0), t(9), "inactive"), ("g1", "s", t(5), t(9), "inactive"), ("g2", "s", t(6), t(8), "active"), ("g2", "s", t(7), t(10), "inactive"), ("g3", "one", t(5), t(6), "active")]
    rows += [(f"b{k}", "s", t(12), t(13), "active") for k in range(4)]
    df = spark.createDataFrame(rows, "group_id string, source_id string, first_seen timestamp, last_seen timestamp, lifecycle string")
    got = {r["group_id"]: (r["days"], r["ended"]) for r in timelines.cohort(df, ["one"], 3).collect()}
    assert got == {"g1": (4.0, True), "g2": (4.0, False)}
