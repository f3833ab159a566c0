"""Event-time operators, the same for batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from listloom.session import shared_folder


def tumbling(events: DataFrame, size: str, late: str | None = None) -> DataFrame:
    """Counts by window and type; ``late`` sets the watermark that a stream needs."""
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    return df.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("start"), "event_type", "n"
    )


def stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A folder of Parquet files, or one file, as a stream; local time stamps become instants for the watermark."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        raw = reader.parquet(path)
    else:
        folder, _, name = path.rpartition("/")
        raw = reader.option("pathGlobFilter", name).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def run_to_table(df: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now (available now) and return its rows, as a table in the shared folder. A batch
    that is repeated writes its own part again; complete output replaces the part before it."""
    path = shared_folder(df.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/{'all' if mode == 'complete' else number}")

    q = (
        df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", True).parquet(f"{path}/rows")


def deduplicated(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The first event of each user and type within a day of event time."""
    df = stream(spark, path, schema).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return run_to_table(df.select("user_id", "event_type"))


def health_states(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A stateful machine: each user's run of errors and its health (SCH-04 over a stream)."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key, batches, state: GroupState):
        errors = state.get[0] if state.exists else 0
        for pdf in batches:
            for kind in pdf.sort_values(["ts", "event_id"])["event_type"]:
                errors = errors + 1 if kind == "error" else 0
        state.update((errors,))
        yield pd.DataFrame({"user_id": [key[0]], "errors": [errors], "health": ["blocked" if errors >= 2 else "degraded" if errors else "healthy"]})

    out = df.groupBy("user_id").applyInPandasWithState(
        step, "user_id long, errors int, health string", "errors int", "update", GroupStateTimeout.NoTimeout
    )
    return run_to_table(out, "update")
