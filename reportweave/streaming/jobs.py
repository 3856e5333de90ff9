"""Streams: latest state of an action log, by a grouping and by a state of its own for each mapping, windowed progress with late rows dropped, incremental pair updates."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.operators.durable import shared_dir


def run_to_end(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Runs a stream over all that is there now, batch by batch, and ends."""
    q = df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's Parquet files as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 4).parquet(sf_dir)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that all machines share."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def latest_state(actions: DataFrame) -> DataFrame:
    """Per mapping the action with the greatest (ts, action_id) so far."""
    return actions.groupBy("mapping_id").agg(F.max(F.struct("ts", "action_id", "action")).alias("x"), F.count("*").alias("n"))


#: Of one mapping: its latest action, how many there were, and the ids (with microseconds) that can still come again.
_STATE = "ts long, action_id long, action string, n long, ids array<long>, times array<long>"


def action_states(actions: DataFrame, remember: timedelta = timedelta(days=365)) -> DataFrame:
    """(mapping_id, ts, action_id, action, n) in update mode: a mapping's latest action by (ts, action_id), however late others come, and how many there were.

    An id that comes again isn't counted again. Ids are remembered while their action is at most `remember` older than the mapping's latest one; an
    action that comes when it is older than that can't be told from a repetition and is left out. So a state holds one mapping's ids of that time, however long the
    stream runs. Actions: mapping_id, action_id, ts, action; rows without one of the first three are left out.
    """
    keep = int(remember.total_seconds() * 1e6)

    def fold(key, frames, state):
        ts, last, action, n, known = None, None, None, 0, {}
        if state.exists:
            ts, last, action, n, ids, times = state.get
            known = dict(zip(ids, times))
        before = n
        for frame in frames:
            for number, at, kind in zip(frame["action_id"].tolist(), frame["us"].tolist(), frame["action"]):
                if number in known or (ts is not None and at < ts - keep):
                    continue
                known[number] = at
                n += 1
                if ts is None or (ts, last) < (at, number):
                    ts, last, action = at, number, kind
        if n > before:
            known = {i: t for i, t in known.items() if t >= ts - keep}
            state.update((ts, last, action, n, list(known), list(known.values())))
            yield pd.DataFrame({"mapping_id": [key[0]], "us": [ts], "action_id": [last], "action": [action], "n": [n]})

    whole = actions.filter("mapping_id is not null and action_id is not null and ts is not null")
    rows = whole.select(F.col("mapping_id").cast("long"), F.col("action_id").cast("long"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "action")
    out = rows.groupBy("mapping_id").applyInPandasWithState(fold, "mapping_id long, us long, action_id long, action string, n long", _STATE, "update", "NoTimeout")
    return out.select("mapping_id", F.timestamp_micros("us").alias("ts"), "action_id", "action", "n")


def progress_windows(events: DataFrame, size: str = "1 day", lateness: str = "7 days") -> DataFrame:
    """Events by kind and window of event time; rows later than the watermark are dropped, repeated ids count once."""
    once = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def collect_updates(spark: SparkSession, df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The final rows of an update-mode stream: every batch is appended with its number, the last one of a key holds."""
    out, checkpoint = shared_path(spark, name), shared_path(spark, f"{name}-log")
    run_to_end(df, lambda batch, n: batch.withColumn("_batch", F.lit(n)).write.mode("append").parquet(out), checkpoint)
    rows = spark.read.parquet(out)
    value = F.struct("_batch", *[c for c in df.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), value["_batch"]).alias("x")).select(*keys, "x.*")


def incremental_update(pairs: DataFrame, items: DataFrame, changed: DataFrame, deleted: DataFrame, score: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pairs(a, b, score), kept from the run before, after reports changed or went: touched pairs are dropped, those of changed reports scored anew.

    score makes (a, b, score) of the pairs with a side in changed; the result equals a full run.
    """
    touched = changed.select("report_id").unionByName(deleted.select("report_id")).distinct()
    rest = pairs.join(touched.withColumnRenamed("report_id", "a"), "a", "left_anti").join(touched.withColumnRenamed("report_id", "b"), "b", "left_anti")
    return rest.select("a", "b", "score").unionByName(score(changed))


def detect_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(report_id, layer, change) by fingerprints of layers: added, removed or changed."""
    j = old.withColumnRenamed("hash", "h0").join(new.withColumnRenamed("hash", "h1"), ["report_id", "layer"], "full_outer")
    change = F.when(F.col("h0").isNull(), "added").when(F.col("h1").isNull(), "removed").when(F.col("h0") != F.col("h1"), "changed")
    return j.select("report_id", "layer", change.alias("change")).filter("change is not null")
