"""Prefix joins, positions and landed mail against plain code."""

import datetime as dt
import math
import random
from email.message import EmailMessage

from pyspark.sql import functions as F

from listloom.operators import nearby
from listloom.sources import mail


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))


def test_near_positions_against_all_pairs(spark):
    rng = random.Random(4)
    spots = [(43.7, 7.26), (0.0, 179.9995), (-0.001, -179.9995), (89.99, 10.0), (-89.995, -170.0), (60.0, 0.0)]
    points = [(k, la + rng.uniform(-0.02, 0.02) * (abs(la) < 89), lo + rng.uniform(-0.02, 0.02)) for k, (la, lo) in enumerate(rng.choice(spots) for _ in range(250))]
    points += [(900 + k, 89.9999, rng.uniform(-180, 180)) for k in range(12)] + [(950, 43.7, 7.26), (951, 43.7, 7.26), (952, None, 1.0), (953, 1.0, None)]
    df = spark.createDataFrame(points, "id long, latitude double, longitude double")
    first = {}
    for i, la, lo in points:
        if la is not None and lo is not None:
            first.setdefault((la, lo), i)
    at = sorted((i, p) for p, i in first.items())
    for most in (0.08, 0.5, 3.0):
        expected = {(i, j) for n, (i, p) in enumerate(at) for j, q in at[n + 1 :] if km(p, q) <= most}
        got = nearby.near_positions(df, most, split=5).collect()
        assert {(r["a"], r["b"]) for r in got} == expected and len(got) == len(expected)
    assert len(expected) > 300


def test_energy_labels_against_all_pairs(spark):
    rng = random.Random(6)
    streets = ["Rue Haute", "rue haut", "Rue", "Rue de la Paix", "rue de la", "Av. du Port"]
    ours = [(k, rng.choice([f"{rng.randint(1, 3)} {rng.choice(streets)}", rng.choice(streets), None]), rng.choice([30.0, 31.5, 40.0, None])) for k in range(80)]
    theirs = [(f"{rng.randint(1, 3)} {rng.choice(streets)}{rng.choice(['', ' 06000 Nice'])}", rng.choice([29.0, 33.0, 41.0, None]), rng.choice("ABH")) for _ in range(25)]

    def fold(x):
        return " ".join("".join(c if c.isalnum() else " " for c in x.lower()).split())

    import re

    expected = {}
    for i, address, area in ours:
        a = fold(address or "")
        number = re.match(r"\d+(?= |$)", a)
        labels = set()
        for other, measured, label in theirs:
            b = fold(other)
            same = number and re.match(r"\d+(?= |$)", b).group() == number.group()
            if same and None not in (area, measured) and label in "AB" and abs(area - measured) <= 2 and (b.startswith(a) or a.startswith(re.sub(r" \d{5}( .*)?$", "", b))):
                labels.add(label)
        if len(labels) == 1:
            expected[i] = labels.pop()
    got = nearby.energy_labels(spark.createDataFrame(ours, "id long, address string, area double"), spark.createDataFrame(theirs, "address string, area double, label string"))
    assert {r["id"]: r["label"] for r in got.collect()} == expected and len(set(expected.values())) == 2


def test_mail_against_the_library_and_damaged_mail(spark):
    files = []
    for k, (sender, day) in enumerate([("a@ads.test", 20), ("A@ADS.TEST", 1), ("b@else.test", 20), ("x@ads.test", None)]):
        m = EmailMessage()
        m["From"], m["To"], m["Subject"] = f"Éva <{sender}>", "me@in.test, you@in.test", "Loyer à 500 €"
        if day:
            m["Date"] = dt.datetime(2024, 5, day, 9, tzinfo=dt.timezone.utc)
        m.set_content("texte brut")
        m.add_alternative("<p>éàü €</p>", subtype="html")
        m.add_attachment(b"\x00\x01", maintype="application", subtype="octet-stream", filename="x.html")
        files.append((f"f{k}", m.as_bytes()))
    files += [("empty", b""), ("null", None), ("charset", b"From: z@ads.test\r\nContent-Type: text/html; charset=klingon\r\n\r\n<p>a</p>"), ("cut", b"From: c@ads.test\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Ty")]
    df = spark.createDataFrame(files, "path string, content binary")
    got = {r["path"]: r for r in mail.landed_mails(df, ("@ads.test",), dt.datetime(2024, 5, 10, tzinfo=dt.timezone.utc)).collect()}
    assert set(got) == {"f0", "f3", "charset", "cut"}
    assert got["f0"]["body"].strip() == "<p>éàü €</p>" and got["f0"]["subject"] == "Loyer à 500 €" and got["f0"]["recipients"] == ["me@in.test", "you@in.test"]
    assert got["charset"]["body"].strip() == "<p>a</p>" and got["f3"]["sent"] is None
    assert {r["path"] for r in mail.landed_mails(df).filter(F.col("reason").isNotNull()).collect()} == {"empty", "null"}
