"""The landed runs as a data source: batch, stream, restart and pushed filters."""

import os

from listloom.session import shared_folder
from listloom.sources import listing_source as ls


def lines(runs, sources=("a", "b c", "d")):
    return [(r, s, "listing", None, f"{r}{s}{k}", f"title {k}") for r in runs for s in sources for k in range(3)] + [(runs[0], "a", "stop", "budget", None, None)]


COLUMNS = "run long, source_id string, kind string, message string, source_ref string, title string"
NAMES = ("run", "source_id", "kind", "message", "source_ref", "title")


def read(df):
    return sorted((tuple(r) for r in df.select(*NAMES).collect()), key=repr)


def test_batch_and_stream_give_the_same_and_a_restart_reads_nothing_again(spark):
    ls.register(spark)
    place = shared_folder(spark, "landed")
    ls.land(spark.createDataFrame(lines([0, 1]), COLUMNS), place)
    batch = spark.read.format("listing_source").load(place)
    assert read(batch) == sorted(lines([0, 1]), key=repr)
    out = shared_folder(spark, "out")

    def run():
        seen = []
        stream = spark.readStream.format("listing_source").load(place)
        q = stream.writeStream.foreachBatch(lambda df, n: seen.extend(read(df))).option("checkpointLocation", out).trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(seen, key=repr)

    assert run() == read(batch)
    assert run() == []
    ls.land(spark.createDataFrame(lines([2]), COLUMNS), place)
    assert run() == sorted(lines([2]), key=repr)
    results = {(r["run"], r["source_id"]): (r["listings"], r["stop"]) for r in ls.run_results(spark.read.format("listing_source").load(place)).collect()}
    assert results[0, "a"] == (3, "budget") and results[1, "a"] == (3, "cut off")


def test_filters_choose_files_and_broken_lines_are_rows(spark, tmp_path):
    folder = tmp_path / "run=3" / "source_id=x"
    os.makedirs(folder)
    (folder / "part").write_text('{"source_ref": 1, "title": null}\n\nnot json\n[1]\n{"kind": "rented", "source_ref": "r"}\n')
    os.makedirs(tmp_path / "run=4" / "source_id=y")
    (tmp_path / "run=4" / "source_id=y" / "part").write_text('{"source_ref": "z"}\n')
    place = f"file://{tmp_path}"
    ls.register(spark)
    df = spark.read.format("listing_source").load(place)
    assert read(df.filter("source_id = 'x'")) == sorted([
        (3, "x", "listing", None, "1", None), (3, "x", "broken", "not json", None, None), (3, "x", "broken", "[1]", None, None), (3, "x", "rented", None, "r", None),
    ], key=repr)
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = ls.ListingReader(place)
    left = list(reader.pushFilters([EqualTo(("source_id",), "x"), GreaterThan(("run",), 2), IsNotNull(("run",)), EqualTo(("kind",), "rented")]))
    assert [type(f) for f in left] == [IsNotNull, EqualTo] and [p.source_id for p in reader.partitions()] == ["x"]
    other = ls.ListingReader(place)
    assert list(other.pushFilters([In(("run",), (4, 9))])) == [] and [p.run for p in other.partitions()] == [4]
    assert df.filter("run = 7").count() == 0 and spark.read.format("listing_source").load(f"{place}/nothing").count() == 0
