"""``spark.read.format("listing_source")`` and ``readStream``: landed runs of sources as a Spark data source.

A run is a folder ``run=<number>`` with a folder ``source_id=<id>`` for each source, of files with one JSON object a line.
``kind`` says what a line is: ``listing`` (with its raw fields), ``confirmed`` and ``rented`` (a ref that is alive, or let),
``warning`` and ``stop`` (with ``message``). A file is a partition; equality and IN filters on the source and comparisons
of the run choose files before any is read. The stream's offset is the last run: a batch is the files of the runs since,
and a restart reads none again.

Lines that cannot be read give a row of the kind ``broken`` with the line as its message, and absent fields are null.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from listloom.session import ship

from .normalize import RAW

FIELDS = tuple(c for c in RAW if c not in ("source_id",))
SCHEMA = "run bigint, source_id string, kind string, message string, " + ", ".join(f"{c} string" for c in FIELDS)
_PLACE = re.compile(r"/run=(\d+)/source_id=([^/]+)/[^/_.][^/]*$")
_BATCH = 4096


@dataclass
class LandedFile(InputPartition):
    uri: str
    run: int
    source_id: str


def _landed(uri: str) -> list[LandedFile]:
    """Every landed file, from its name alone."""
    from urllib.parse import unquote

    from pyarrow import fs

    place, path = fs.FileSystem.from_uri(uri)
    found = []
    for info in place.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)):
        named = _PLACE.search(info.path) if info.type == fs.FileType.File else None
        if named:
            found.append(LandedFile(info.path, int(named[1]), unquote(named[2])))
    return sorted(found, key=lambda f: (f.run, f.source_id, f.uri))


def _rows(part: LandedFile, root: str):
    """Arrow batches of one file, a few thousand lines at a time."""
    from pyarrow import fs

    place, _ = fs.FileSystem.from_uri(root)
    names = ["run", "source_id", "kind", "message", *FIELDS]
    types = [pa.int64(), *[pa.string()] * (len(names) - 1)]

    def row(line: str) -> list:
        try:
            said = json.loads(line)
            if not isinstance(said, dict):
                raise ValueError("not an object")
        except ValueError:
            said = {"kind": "broken", "message": line}
        text = lambda c: None if said.get(c) is None else str(said[c])
        return [part.run, part.source_id, text("kind") or "listing", text("message"), *[text(c) for c in FIELDS]]

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    import io

    with io.TextIOWrapper(place.open_input_stream(part.uri), encoding="utf-8", errors="replace") as lines:
        waiting = []
        for line in lines:
            if line.strip():
                waiting.append(row(line.rstrip("\n")))
            if len(waiting) == _BATCH:
                yield batch(waiting)
                waiting = []
        if waiting:
            yield batch(waiting)


class ListingReader(DataSourceReader):
    def __init__(self, root: str):
        self.root, self.tests = root, []

    def pushFilters(self, filters):
        """Filters of the source and the run are done by choosing files; the others stay with Spark."""
        compare = {GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and column in ("source_id", "run"):
                self.tests.append((column, lambda a, b=f.value: a == b))
            elif isinstance(f, In) and column in ("source_id", "run"):
                self.tests.append((column, lambda a, b=tuple(f.value): a in b))
            elif type(f) in compare and column == "run":
                self.tests.append((column, lambda a, b=f.value, c=compare[type(f)]: c(a, b)))
            else:
                yield f

    def partitions(self):
        return [p for p in _landed(self.root) if all(test(getattr(p, c)) for c, test in self.tests)]

    def read(self, partition):
        # Without a file there is one partition of nothing.
        return _rows(partition, self.root) if partition is not None else iter(())


class ListingStream(DataSourceStreamReader):
    def __init__(self, root: str):
        self.root = root

    def initialOffset(self):
        return {"run": -1}

    def latestOffset(self):
        return {"run": max((p.run for p in _landed(self.root)), default=-1)}

    def partitions(self, start, end):
        return [p for p in _landed(self.root) if start["run"] < p.run <= end["run"]]

    def read(self, partition):
        return _rows(partition, self.root)

    def commit(self, end):
        pass


class ListingSource(DataSource):
    @classmethod
    def name(cls):
        return "listing_source"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options["path"])

    def streamReader(self, schema):
        return ListingStream(self.options["path"])


def register(spark: SparkSession) -> None:
    """Make the source known to a session; files are chosen by pushed filters."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ListingSource)


def land(lines: DataFrame, path: str) -> None:
    """``lines(run, source_id, ...)``: further columns become the JSON objects of the run's files."""
    said = F.to_json(F.struct(*[c for c in lines.columns if c not in ("run", "source_id")]))
    lines.select("run", "source_id", said.alias("value")).write.partitionBy("run", "source_id").mode("append").text(path)


def run_results(landed: DataFrame) -> DataFrame:
    """(run, source_id, listings, confirmed, rented_refs, warnings, stop): what each run of a source came to; without a
    stop line a run was cut off."""
    n = lambda kind: F.count(F.when(F.col("kind") == kind, 1))
    refs = F.array_sort(F.collect_set(F.when(F.col("kind") == "rented", F.col("source_ref"))))
    return landed.groupBy("run", "source_id").agg(
        n("listing").alias("listings"), n("confirmed").alias("confirmed"), refs.alias("rented_refs"), (n("warning") + n("broken")).alias("warnings"),
        F.coalesce(F.max(F.when(F.col("kind") == "stop", F.col("message"))), F.lit("cut off")).alias("stop"),
    )
