"""The frontier's clockwork as streams: politeness per host, stream dedup, micro-batch sinks.

Time comes with the rows, so that a replayed stream gives the same answer.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import StructType

from loam.runtime import shared_dir

COOLDOWN_SECONDS = 2


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """A folder of Parquet files, or a file, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


def distinct_urls(links: DataFrame, column: str = "url") -> DataFrame:
    """Each url of a stream once, ever; the state is the set of urls seen."""
    return links.dropDuplicates([column])


def polite_dispatch(requests: DataFrame, host: str = "host", at: str = "at", seconds: int = COOLDOWN_SECONDS) -> DataFrame:
    """host, at, dispatched of a stream of requests: a host is not asked again within its cool-down.

    State is one time a host.  Requests of one micro-batch are taken in order of time; one that comes while
    its host cools is not dispatched.
    """
    gap = pd.Timedelta(seconds=seconds)

    def step(key, frames, state):
        rows = pd.concat(list(frames)).sort_values("at")
        until = pd.Timestamp(state.get[0]) if state.exists else None
        said = []
        for t in rows["at"]:
            go = until is None or t >= until
            if go:
                until = t + gap
            said.append(go)
        state.update((until.to_pydatetime(),))
        yield pd.DataFrame({"host": [key[0]] * len(rows), "at": rows["at"].values, "dispatched": said})

    shaped = requests.select(F.col(host).cast("string").alias("host"), F.col(at).alias("at")).where("host IS NOT NULL AND at IS NOT NULL")
    return shaped.groupBy("host").applyInPandasWithState(step, "host string, at timestamp, dispatched boolean", "until timestamp", "append", GroupStateTimeout.NoTimeout)


def to_table(stream: DataFrame, path: str, checkpoint: str, partition: Callable[[DataFrame], DataFrame] = lambda df: df, seconds: int | None = None):
    """Appends each micro-batch to a Parquet table, once even if a batch is tried again: a batch owns its folder.

    With seconds the query runs on, a batch every so often; without, it ends when what is there is done.
    """

    def write(batch: DataFrame, number: int) -> None:
        partition(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def drained(stream: DataFrame) -> DataFrame:
    """All that the stream has now, as a table in the shared folder."""
    spark = stream.sparkSession
    root = shared_dir(spark)
    to_table(stream, f"{root}/rows", f"{root}/log").awaitTermination()
    return spark.read.schema(stream.schema).option("basePath", f"{root}/rows").parquet(f"{root}/rows").drop("batch")
