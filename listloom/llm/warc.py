"""Deterministic sharded WARC archives.

Pages are range-sorted by id over shards whose bounds are exact weighted cut points, so shards depend on the rows alone.
The driver looks for the bounds of at most ``MOST_CUTS`` spans; inside a span prefix sums over its ids cut the shards. There
are at most ``MOST_SHARDS`` shards, which grow with a larger archive, so their bounds are a table of a few megabytes at most.
A shard's task writes its records in order, each a gzip member of its own, and rolls to a new file once the compressed
size is reached. Headers and digests are regenerated from the payload. Files get temporary names; a manifest of the
attempt that Spark accepted is staged, then each listed file is renamed, and last the manifest itself is written: what
no manifest names was never committed, and the folder of temporary names, with what lost executors and repeated tasks left
in it, goes last.

Among records with equal payloads the one with the largest page_id is the response; smaller ones are revisits of it.

Defined cases: null html is an empty payload; a null page_id sorts first, counts as smaller than any id and is written
as ``none``; rows that repeat id and payload give one response and further revisits of that id; an empty table gives a
manifest without files; other columns are left alone.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listloom.session import ship

from .common import MOST_CUTS, drop_path, stage, stage_path, weighted_cuts

SHARD_BYTES = 64 << 20
ROLL_BYTES = 16 << 20
MOST_SHARDS = 1 << 20
DATE = "2024-01-01T00:00:00Z"
URN = "urn:listloom:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
OFFSET = 1 << 61  # ids are moved by this, so that cut points see non-negative keys

MANIFEST = "shard int, file int, name string, bytes long, records long, sha1 string, first_id long, last_id long"


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(
    page_id: int | None, again: int, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() if revisit else head.encode() + payload
    name = "none" if page_id is None else str(page_id)
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{name}{f':{again}' if again else ''}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
    ]
    if revisit:
        whom = "none" if refers_to is None else str(refers_to)
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{whom}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)  # no time and no name in the header
    return packer.compress(data) + packer.flush()


def span_column(page_id: Column, cuts: list[int]) -> Column:
    """Span of an id: the number of cut points below it. Null ids are in span 0."""
    if not cuts:
        return F.lit(0)
    bounds = F.array(*[F.lit(c - OFFSET) for c in cuts])
    return F.when(page_id.isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b < page_id)))


def shard_bounds(keys: DataFrame, shard_bytes: int, spans: int = MOST_CUTS) -> tuple[list[int], DataFrame | None, int]:
    """(cut points of the spans, staged table of what cuts each span, shards) for ``keys(page_id, w)``. The table has one
    row a span: its first shard and the last ids of all its shards but the last; none where spans are shards."""
    total = keys.agg(F.sum("w")).first()[0] or 0
    shards = max(1, min(MOST_SHARDS, -(-total // shard_bytes)))
    cuts: list[int] = []
    top = min(shards, spans)
    if top > 1:
        shifted = keys.select(
            F.lit(0).alias("node"), (F.coalesce("page_id", F.lit(-OFFSET)) + F.lit(OFFSET)).alias("key"), "w"
        )
        targets = {0: [total * k / top for k in range(1, top)]}
        cuts = sorted(set(weighted_cuts(shifted, "node", "key", "w", targets)[0]))
    if top == shards:
        return cuts, None, len(cuts) + 1
    size = total / shards
    # Equal ids end at the same sum, so they share a shard.
    upto = Window.partitionBy("span").orderBy(F.col("page_id").asc_nulls_first()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    inner = keys.withColumn("span", span_column(F.col("page_id"), cuts)).select(
        "span", "page_id", F.floor((F.sum("w").over(upto) - 1) / F.lit(size)).alias("inner")
    )
    last = inner.groupBy("span", "inner").agg(F.max("page_id").alias("last"))
    by_span = last.groupBy("span").agg(F.array_sort(F.collect_list("last")).alias("ends"))
    before = Window.orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    table = stage(
        by_span.select(
            "span",
            F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).cast("int").alias("first"),
            F.slice("ends", 1, F.greatest(F.lit(0), F.size("ends") - 1)).alias("ends"),
        ),
        "warc-bounds",
    )
    return cuts, table, table.agg(F.max(F.col("first") + F.size("ends")) + 1).first()[0]


def with_shard(rows: DataFrame, cuts: list[int], table: DataFrame | None) -> DataFrame:
    """``rows(page_id, ...)`` with their shard. The table has at most ``MOST_CUTS`` rows and ``MOST_SHARDS`` ids."""
    if table is None:
        return rows.withColumn("shard", span_column(F.col("page_id"), cuts))
    spanned = rows.withColumn("span", span_column(F.col("page_id"), cuts)).join(F.broadcast(table), "span")
    below = F.when(F.col("page_id").isNull(), 0).otherwise(F.size(F.filter("ends", lambda b: b < F.col("page_id"))))
    return spanned.withColumn("shard", F.col("first") + below).drop("span", "first", "ends")


def ordered_records(pages: DataFrame, shard_bytes: int = SHARD_BYTES, spans: int = MOST_CUTS) -> DataFrame:
    """Rows of (shard, page_id, sha, kind, response_id, url, html), one partition a shard, in writing order.

    A key row (kind 0) stands before the pages it decides on, so the html moves once and no join touches it.
    """
    html = F.coalesce(pages["html"].cast("string"), F.lit(""))
    keys = stage(
        pages.select(
            pages["page_id"].cast("long").alias("page_id"),
            F.sha1(html).alias("sha"),
            (F.octet_length(html) + 600).cast("long").alias("w"),
        ),
        "warc-keys",
    )
    cuts, table, shards = shard_bounds(keys, shard_bytes, spans)
    responses = keys.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    # Only groups of several records need a decision. Staged, so that the join stands alone and Spark can split the rows
    # of a payload with very many copies.
    shared = stage(responses.filter("n > 1").drop("n"), "warc-shared")
    decisions = keys.select("page_id", "sha").join(shared, "sha").distinct()
    rows = decisions.select(
        "page_id",
        "sha",
        F.lit(0).alias("kind"),
        "response_id",
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("html"),
    ).unionByName(
        pages.select(
            pages["page_id"].cast("long").alias("page_id"),
            F.sha1(html).alias("sha"),
            F.lit(1).alias("kind"),
            F.lit(None).cast("long").alias("response_id"),
            pages["url"].cast("string").alias("url"),
            html.alias("html"),
        )
    )
    return with_shard(rows, cuts, table).repartitionById(shards, F.col("shard")).sortWithinPartitions(
        "shard", F.col("page_id").asc_nulls_first(), "sha", "kind", F.col("url").asc_nulls_first()
    )


def _writer(path: str, roll_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(path)
        done: list[tuple] = []
        out = digest = None
        shard, number, size, records = None, 0, 0, 0
        name, first, last = "", None, None
        decided: tuple = ()
        response_id, seen, again = None, 0, 0
        previous: tuple | None = None

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((shard, number, name, size, records, digest.hexdigest(), first, last))
                out = None

        for batch in batches:
            for row in batch.to_pylist():
                key = (row["shard"], row["page_id"], row["sha"])
                if row["kind"] == 0:
                    decided, response_id = key, row["response_id"]
                    continue
                seen = seen + 1 if key == previous else 0
                again = again + 1 if previous is not None and key[:2] == previous[:2] else 0
                previous = key
                # Without a decision the payload stands alone.
                is_response = decided != key or (row["page_id"] == response_id and seen == 0)
                payload = row["html"].encode()
                data = gzip_member(
                    record_bytes(
                        row["page_id"],
                        again,
                        row["url"],
                        payload,
                        base64.b32encode(bytes.fromhex(row["sha"])).decode(),
                        response_id,
                        not is_response,
                    ),
                    level,
                )
                if out is not None and (row["shard"] != shard or size >= roll_bytes):
                    close()
                if out is None:
                    number = number + 1 if row["shard"] == shard else 0
                    shard, size, records, first = row["shard"], 0, 0, row["page_id"]
                    digest = hashlib.sha1()
                    name = f"{shard:06d}-{number:05d}-{uuid.uuid4().hex}"
                    fs.create_dir(f"{root}/_temporary", recursive=True)
                    out = fs.open_output_stream(f"{root}/_temporary/{name}", compression=None)
                out.write(data)
                digest.update(data)
                size, records, last = size + len(data), records + 1, row["page_id"]
        close()
        columns = list(zip(*done)) if done else [[] for _ in range(8)]
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in MANIFEST.split(", ")]
        )

    return run


def _commit(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        fs, root = _file_system(path)
        for batch in batches:
            names = []
            for row in batch.to_pylist():
                final = f"{row['shard']:06d}-{row['file']:05d}.warc.gz"
                # A repeated task finds its earlier rename done; no name is taken twice.
                old, new = fs.get_file_info([f"{root}/_temporary/{row['name']}", f"{root}/{final}"])
                if old.type != pafs.FileType.NotFound:
                    if new.type != pafs.FileType.NotFound:
                        raise FileExistsError(final)
                    fs.move(f"{root}/_temporary/{row['name']}", f"{root}/{final}")
                elif new.size != row["bytes"]:
                    raise FileNotFoundError(final)
                names.append(final)
            yield batch.set_column(batch.schema.get_field_index("name"), "name", pa.array(names, pa.string()))

    return run


def write_warc(
    pages: DataFrame,
    path: str,
    shard_bytes: int = SHARD_BYTES,
    roll_bytes: int = ROLL_BYTES,
    level: int = 6,
    spans: int = MOST_CUTS,
) -> DataFrame:
    """Write ``pages(page_id, url, html)`` under the shared folder ``path``; returns the committed manifest."""
    spark = pages.sparkSession
    found = stage(ordered_records(pages, shard_bytes, spans).mapInArrow(_writer(path, roll_bytes, level), MANIFEST), "warc")
    named = found.mapInArrow(_commit(path), MANIFEST)
    named.write.parquet(f"{path}/manifest.parquet")
    drop_path(spark, f"{path}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest.parquet")


def _members(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """Content of each gzip member of a stream."""
    unzip, parts, rest = zlib.decompressobj(31), [], b""
    while True:
        data = rest or stream.read(chunk)
        rest = b""
        if not data:
            break
        parts.append(unzip.decompress(data))
        if unzip.eof:
            yield b"".join(parts)
            rest = unzip.unused_data
            unzip, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the archive ends inside a record")


def parse_record(data: bytes) -> dict:
    """Headers, payload and whether the block digest holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))

    def number(urn: str | None) -> int | None:
        text = (urn or "").strip("<>").removeprefix(URN).split(":")[0]
        return int(text) if text not in ("", "none") else None

    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    whole = fields["WARC-Type"] != "revisit"
    return {
        "page_id": number(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": digest,
        "refers_to": number(fields.get("WARC-Refers-To")),
        "payload": payload if whole else None,
        "sound": fields["WARC-Block-Digest"] == "sha1:" + base32_sha1(block)
        and (not whole or (digest == base32_sha1(payload) and length == len(payload))),
    }


_RECORD = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()),
        ("refers_to", pa.int64()),
        ("payload", pa.binary()),
        ("sound", pa.bool_()),
    ]
)
RECORD = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary, sound boolean"
)


def _reader(path: str, payloads: bool, batch_rows: int = 1000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows: list[dict] = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in _members(stream):
                        rows.append(parse_record(data))
                        if not payloads:
                            rows[-1]["payload"] = None
                        if len(rows) >= batch_rows:
                            yield pa.RecordBatch.from_pylist(rows, _RECORD)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return run


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of every committed archive under ``path``; ``sound`` tells whether its digests hold."""
    ship(spark)
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/manifest.parquet")
    # One file a task where there are few; beyond that, files are dealt by a hash of their names.
    files = max(1, manifest.count())
    if files <= 4096:
        row = F.row_number().over(Window.orderBy("name")) - 1
        spread = manifest.select("name", row.alias("k")).repartitionById(files, F.col("k"))
    else:
        spread = manifest.select("name").repartition("name")
    return spread.select("name").mapInArrow(_reader(path, payloads), RECORD)


def archive_path(spark: SparkSession) -> str:
    return stage_path(spark, "archives")
