"""Source descriptors, their registry, snapshot tables and lookups."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """What a source is and how often it may be asked. ``read`` returns raw listings."""

    source_id: str
    kind: str  # portal | agencyNetwork | localAgency | aggregator
    method: str  # html | sitemap | api | mail
    priority: int = 2
    interval: int = 60
    least: int = 10
    most: int = 720
    enabled: bool = True
    relays: bool = False
    one_shot: bool = False
    manual_only: bool = False
    operator: str | None = None
    landlord: str | None = None
    read: Callable[[SparkSession], DataFrame] | None = None


class Registry:
    """Sources by id; an id is taken once."""

    def __init__(self) -> None:
        self._sources: dict[str, Source] = {}

    def add(self, source: Source) -> Source:
        if source.source_id in self._sources:
            raise ValueError(f"source {source.source_id} is registered twice")
        self._sources[source.source_id] = source
        return source

    def get(self, source_id: str) -> Source:
        return self._sources[source_id]

    def all(self) -> list[Source]:
        return list(self._sources.values())

    def enabled(self) -> list[Source]:
        return [s for s in self.all() if s.enabled]

    def table(self, spark: SparkSession) -> DataFrame:
        """Descriptors as a small table to join with."""
        rows = [{k: v for k, v in asdict(s).items() if k != "read"} for s in self.all()]
        schema = (
            "source_id string, kind string, method string, priority int, interval int, least int, most int, enabled boolean, "
            "relays boolean, one_shot boolean, manual_only boolean, operator string, landlord string"
        )
        return spark.createDataFrame(rows, schema)

    def collect(self, spark: SparkSession, chosen: list[str]) -> DataFrame:
        """Raw listings of the chosen sources, each with its id."""
        out = None
        for s in chosen:
            own = self.get(s).read(spark).withColumn("source_id", F.lit(s))
            out = own if out is None else out.unionByName(own, allowMissingColumns=True)
        return out


def write_snapshot(df: DataFrame, path: str, version: int, partition: str | None = None) -> str:
    """A snapshot is a versioned folder; readers take the version they are told, so a failed write is never seen."""
    target = f"{path}/v={version:08d}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(target)
    return target


def read_snapshot(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.parquet(f"{path}/v={version:08d}")


def with_lookup(df: DataFrame, cache: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with the cached value, keys to fetch): a cached null is an answer and is not fetched again."""
    marked = cache.select(F.col(key), F.col(value).alias(f"_{value}"), F.lit(True).alias("_hit"))
    joined = df.join(marked, key, "left")
    missing = joined.filter("_hit is null").select(key).filter(F.col(key).isNotNull()).distinct()
    return joined.withColumnRenamed(f"_{value}", value).drop("_hit"), missing


def filled_from_memory(fresh: DataFrame, memory: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Each unknown field takes what was remembered."""
    old = memory.select(F.col(key), *[F.col(c).alias(f"_m_{c}") for c in fields])
    joined = fresh.join(old, key, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in fields}).drop(*[f"_m_{c}" for c in fields])


def vanished(known: DataFrame, seen: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Known refs that were not seen, a few at a time in key order."""
    return known.join(seen.select(key), key, "left_anti").orderBy(key).limit(most)


def absorbed(orphans: DataFrame, links: DataFrame) -> DataFrame:
    """(orphan, successor) where exactly one successor exists."""
    one = links.join(orphans, "orphan", "left_semi").groupBy("orphan").agg(F.collect_set("successor").alias("s"))
    return one.filter(F.size("s") == 1).select("orphan", F.col("s")[0].alias("successor"))
