import hashlib
import struct
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from listloom.llm import media_ogg as ogg
from listloom.llm import queries


def slow_checksum(data):
    c = 0
    for b in data:
        c ^= b << 24
        for _ in range(8):
            c = ((c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
    return c


@settings(max_examples=100, deadline=None)
@given(st.binary(max_size=400))
def test_checksum_is_the_bitwise_one(data):
    assert ogg.page_checksum(data) == slow_checksum(data)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1400), min_size=1, max_size=12), st.integers(1, 9))
def test_packets_survive_pages_of_any_size(sizes, segments):
    packets = [bytes([k % 251]) * n for k, n in enumerate(sizes)]
    granules = [sum(sizes[: k + 1]) for k in range(len(sizes))]
    a = ogg.paginate(7, b"head", packets, granules, segments)
    b = ogg.paginate(9, b"other", packets[::-1], granules)
    streams, damaged = ogg.demultiplex(ogg.multiplex([a, b]))
    assert damaged == 0 and [s.holes for s in streams.values()] == [0, 0]
    assert streams[7].packets == [b"head", *packets] and streams[9].packets == [b"other", *packets[::-1]]
    assert streams[7].ended and streams[7].granules[-1] == sum(sizes)
    times = ogg.packet_times(streams[7], 1)
    assert [t[1] for t in times] == granules


def test_damage_is_counted_and_others_survive():
    packets = [bytes([k]) * 600 for k in range(40)]
    pages = ogg.paginate(1, b"h", packets, [600 * (k + 1) for k in range(40)], 6)
    raw = [ogg.write_page(p) for p in pages]
    broken = bytearray(raw[5])
    broken[60] ^= 1
    streams, damaged = ogg.demultiplex(b"junk" + b"".join([*raw[:5], bytes(broken), *raw[6:]]))
    assert damaged == 2 and streams[1].holes >= 1
    assert all(p in packets for p in streams[1].packets[1:]) and len(streams[1].packets) == 1 + 40 - 2
    assert ogg.decode_media(None)[0] == b"" and ogg.decode_media(b"no ogg")[2].startswith("streams=0")


def test_round_trip_of_texts(spark):
    texts = ["", None, "a", "é" * 288, "x" * 576, "word " * 60_000, "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumnRenamed("zz", "media")
    got = {r["doc_id"]: r for r in ogg.read_media(ogg.store_payloads(df)).collect()}
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        want = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(got[k]["payload"]) == want and got[k]["n_bytes"] == len(raw)
        assert "damaged=0;holes=0" in got[k]["feature"]
    assert got[2]["media"] == got[6]["media"] and got[2]["feature"] == got[6]["feature"]
    assert ogg.store_payloads(df.limit(0)).count() == 0


def test_query_digests(spark, tmp_path):
    rows = [(1, "héllo", 5), (2, None, 6), (3, "y" * 1000, 7)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op7_ogg_media(spark, str(tmp_path)).collect():
        raw = ({1: "héllo", 2: "", 3: "y" * 1000}[r["doc_id"]]).encode()
        want = ogg.padded(raw)
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(want))
        assert r["payload_sha256"] == hashlib.sha256(want).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(want[-32:])
    assert struct.calcsize("<4sBBqIIIB") == 27
