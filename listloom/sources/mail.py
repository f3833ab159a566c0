"""Landed mail: messages as binary files to one row each, with the standard library's MIME reader inside Arrow tasks.

Senders and age are told by the headers alone, so a message that is not wanted is never decoded. The body is the first
HTML part, else the first text part; attachments are no bodies. Recipients are the addresses of all headers that name
any. A message that cannot be read gives a row with its ``reason``; so does one without a body.
"""

from __future__ import annotations

import datetime as dt
from email import message_from_bytes, policy
from email.parser import BytesHeaderParser
from email.utils import getaddresses, parsedate_to_datetime

import pyarrow as pa
from pyspark.sql import DataFrame

from listloom.session import ship

RECIPIENTS = ("to", "cc", "delivered-to", "x-original-to", "x-forwarded-to", "envelope-to")
SCHEMA = "path string, sender string, subject string, sent timestamp, recipients array<string>, body string, reason string"
_TYPES = pa.schema([
    ("path", pa.string()), ("sender", pa.string()), ("subject", pa.string()), ("sent", pa.timestamp("us", "UTC")), ("recipients", pa.list_(pa.string())),
    ("body", pa.string()), ("reason", pa.string()),
])


def _address(headers, name: str) -> list[str]:
    found = [a.lower() for _, a in getaddresses([str(v) for v in headers.get_all(name, [])]) if "@" in a]
    return list(dict.fromkeys(found))


def _body(content: bytes) -> str:
    message = message_from_bytes(content, policy=policy.default)
    part = message.get_body(preferencelist=("html", "plain"))
    if part is None:
        return ""
    try:
        return part.get_content()
    except LookupError:  # a charset that nobody knows
        return part.get_payload(decode=True).decode("utf-8", "replace")


def read_message(path: str, content: bytes | None, senders: tuple[str, ...], since: dt.datetime | None) -> dict | None:
    """One message as a row; null where its sender or date is not wanted."""
    row = dict.fromkeys(_TYPES.names) | {"path": path, "recipients": []}
    try:
        headers = BytesHeaderParser(policy=policy.default).parsebytes(content or b"")
        row["sender"] = (_address(headers, "from") or [None])[0]
        if senders and not any(s in (row["sender"] or "") for s in senders):
            return None
        try:
            sent = parsedate_to_datetime(str(headers["date"])) if headers["date"] else None
        except ValueError:
            sent = None
        row["sent"] = sent if sent is None or sent.tzinfo else sent.replace(tzinfo=dt.timezone.utc)
        if since is not None and row["sent"] is not None and row["sent"] < since:
            return None
        row["subject"] = None if headers["subject"] is None else str(headers["subject"])
        row["recipients"] = list(dict.fromkeys(a for name in RECIPIENTS for a in _address(headers, name)))
        body = _body(content or b"")
        row["body"], row["reason"] = (body, None) if body.strip() else (None, "no body")
    except Exception as error:  # noqa: BLE001 - the reader raises many kinds on damaged mail
        row["body"], row["reason"] = None, f"damaged: {type(error).__name__}"
    return row


def landed_mails(files: DataFrame, senders: tuple[str, ...] = (), since: dt.datetime | None = None) -> DataFrame:
    """Rows of ``files(path, content)``, as ``spark.read.format("binaryFile")`` gives them: messages whose sender holds one
    of ``senders`` and that are not older than ``since`` (an unknown date is kept)."""
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = read_message(batch.column("path")[i].as_py(), batch.column("content")[i].as_py(), senders, since)
                if row is not None:
                    yield pa.RecordBatch.from_pylist([row], schema=_TYPES)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
