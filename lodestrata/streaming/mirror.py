"""A local mirror of a remote volume: attaching, fetching on demand with retries, and the request loop as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators.store import ALL_ZERO, REAL, UNKNOWN

OK, KNOWN, NETWORK = "ok", "known", "network"


def attach(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The local map (slot, state) after one read of the remote one: only chunks known to be all zero are taken over."""
    r = remote.select("slot", F.col("state").alias("_remote"))
    return local.join(r, "slot", "left").select("slot", F.when((F.col("state") == UNKNOWN) & (F.col("_remote") == ALL_ZERO), ALL_ZERO).otherwise(F.col("state")).alias("state"))


def ensure(requests: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """(slot, status, state): what asking for each slot comes to. remote has ok, false for a fetch that fails.

    Slots whose state is known need no fetch. A fetch that works makes a slot real; one that fails leaves it unknown.
    """
    asked = requests.select("slot").distinct().join(local, "slot", "left").withColumn("state", F.coalesce("state", F.lit(UNKNOWN)))
    out = asked.join(remote.select("slot", "ok"), "slot", "left")
    known = F.col("state") != UNKNOWN
    status = F.when(known, KNOWN).when(F.col("ok"), OK).otherwise(NETWORK)
    return out.select("slot", status.alias("status"), F.when(known, F.col("state")).when(F.col("ok"), REAL).otherwise(UNKNOWN).alias("state"))


def merged(local: DataFrame, fetched: DataFrame) -> DataFrame:
    """The local map with what fetches found."""
    f = fetched.select("slot", F.col("state").alias("_new"))
    return local.join(f, "slot", "full").select("slot", F.coalesce("_new", "state").alias("state"))


def counters(ensured: DataFrame) -> DataFrame:
    """(status, n)."""
    return ensured.groupBy("status").agg(F.count("*").alias("n"))


def with_retry(requests: DataFrame, local: DataFrame, tries: list[DataFrame]) -> DataFrame:
    """The map after several tries: slots whose fetch failed are asked for again at the next."""
    for remote in tries:
        found = ensure(requests, local, remote)
        local = merged(local, found)
        requests = found.where(F.col("status") == NETWORK).select("slot")
    return local


STATE = "first_tick long, asked long"
SEEN = "key long, tick long, hit boolean, asked long"


def request_loop(requests: DataFrame) -> DataFrame:
    """A stream of requests (tick, key) to (key, tick, hit, asked), one row a key and tick: what one tick misses, later ones hit.

    State is a row a key: the tick that first asked, and how often it was asked for.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        counts = pd.concat([b[["tick"]] for b in batches]).groupby("tick").size().sort_index()
        first, asked = state.get if state.exists else (int(counts.index[0]), 0)
        rows = []
        for tick, n in counts.items():
            asked += int(n)
            rows.append((key[0], int(tick), bool(tick > first), asked))
        state.update((first, asked))
        yield pd.DataFrame(rows, columns=["key", "tick", "hit", "asked"])

    return requests.groupBy("key").applyInPandasWithState(step, SEEN, STATE, "append", "NoTimeout")


def run_to_end(stream: DataFrame, name: str, folder: str) -> DataFrame:
    """Runs a stream over what is there now and returns the rows it made."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-at").trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/{name}")


def mirror_batches(stream: DataFrame, folder: str, remote: DataFrame) -> DataFrame:
    """Feeds a stream of slots through ensure batch by batch, and returns the local map at the end. Each batch writes a map of its own, so a repeated batch changes nothing."""
    spark: SparkSession = stream.sparkSession

    def take(batch: DataFrame, number: int) -> None:
        local = spark.createDataFrame([], "slot long, state int") if number == 0 else batch.sparkSession.read.schema("slot long, state int").parquet(f"{folder}/map-{number - 1}")
        fetched = ensure(batch, local, remote)
        merged(local, fetched).select(F.col("slot").cast("long"), F.col("state").cast("int")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/map-{number}")
        last.append(number)

    last: list[int] = []
    q = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/mirror-at").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("slot long, state int").parquet(f"{folder}/map-{last[-1]}") if last else spark.createDataFrame([], "slot long, state int")
