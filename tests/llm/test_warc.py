"""Archives against a plain reading of the rules, with many shards and files."""

import base64
import gzip
import hashlib
import os

from listloom.llm import warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    groups = {}
    for page_id, _, html in rows:
        groups.setdefault(html or "", []).append(page_id)
    out = []
    for html, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        seen = False
        for i in sorted(ids, key=lambda i: (i is not None, i or 0)):
            response = i == top and not seen
            seen |= response
            kind, whom = ("response", None) if response else ("revisit", top)
            out.append((i, len(html.encode()), digest(html), kind, whom))
    return sorted(out, key=repr)


def written(spark, rows, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = warc.archive_path(spark)
    manifest = warc.write_warc(df, path, **options)
    return path, manifest, warc.read_warc(spark, path)


def test_many_shards_and_rolled_files(spark):
    rows = [(i * 7 % 501, f"http://h/{i}", "same" if i % 3 == 0 else f"page é {i} " * (i % 40)) for i in range(500)]
    path, manifest, back = written(spark, rows, shard_bytes=40_000, roll_bytes=2_000)
    files = manifest.collect()
    assert len(files) > 20 and len({f["name"] for f in files}) == len(files)
    assert max(f["file"] for f in files) > 0 and max(f["shard"] for f in files) > 2
    got = back.collect()
    assert all(r["sound"] for r in got)
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keep) for r in got), key=repr) == expected(rows)
    assert {r["page_id"]: r["payload"].decode() for r in got if r["record_type"] == "response"} == {
        i: h for i, _, h in rows if (h != "same" or i == max(a for a, _, b in rows if b == "same"))
        and i == max(a for a, _, b in rows if b == h)
    }


def test_files_depend_on_rows_alone(spark):
    rows = [(i, f"u{i}", f"body {i} " * 30) for i in range(200)]
    a = written(spark, rows, shard_bytes=20_000, roll_bytes=3_000)[1].collect()
    b = written(spark, rows[::-1], shard_bytes=20_000, roll_bytes=3_000)[1].collect()
    key = lambda m: sorted((f["name"], f["bytes"], f["sha1"]) for f in m)
    assert key(a) == key(b)


def test_spans_cut_by_prefix_sums_hold_the_same_records(spark):
    rows = [(i * 7 % 301, f"u{i}", f"body {i} " * (1 + i % 30)) for i in range(300)] + [(None, "n", "x"), (12, "again", "y")]
    path, manifest, back = written(spark, rows, shard_bytes=6_000, roll_bytes=2_000, spans=4)
    files = manifest.collect()
    assert max(f["shard"] for f in files) > 20
    known = lambda i: -1 if i is None else i
    spans = sorted((f["shard"], f["file"], known(f["first_id"]), known(f["last_id"])) for f in files)
    assert all(a[3] <= b[2] if a[0] == b[0] else a[3] < b[2] for a, b in zip(spans, spans[1:]))
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keep) for r in back.collect()), key=repr) == expected(rows)
    again = written(spark, rows[::-1], shard_bytes=6_000, roll_bytes=2_000, spans=4)[1].collect()
    key = lambda m: sorted((f["name"], f["bytes"], f["sha1"]) for f in m)
    assert key(files) == key(again)
    # What was written under temporary names is gone.
    assert not os.path.exists(f"{path.removeprefix('file://')}/_temporary")


def test_ranges_and_plain_gzip(spark):
    rows = [(i, "u", f"b{i}") for i in range(50)]
    path, manifest, _ = written(spark, rows, shard_bytes=8_000)
    spans = sorted((f["shard"], f["first_id"], f["last_id"]) for f in manifest.collect())
    assert all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    name = manifest.first()["name"]
    text = gzip.open(f"{path.removeprefix('file://')}/{name}").read()
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n")


def test_nulls_empty_ties_and_clashing_columns(spark):
    rows = [(None, None, None), (5, None, ""), (5, "u", ""), (9, "a\r\nb", "x"), (9, "a", "x"), (2, "u", "x")]
    _, _, back = written(spark, rows)
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[k] for k in keep) for r in back.collect()), key=repr) == expected(rows)
    df = spark.createDataFrame([(1, "u", "h", 3, "s")], "page_id long, url string, html string, shard int, sha string")
    path = warc.archive_path(spark)
    assert warc.write_warc(df, path).count() == 1
    path = warc.archive_path(spark)
    assert warc.write_warc(df.limit(0), path).count() == 0
    assert warc.read_warc(spark, path).count() == 0
