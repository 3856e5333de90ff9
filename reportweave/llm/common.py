"""Shared folder handling, null-safe keys and small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.operators.durable import materialize, shared_dir  # noqa: F401


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_key(c: Column) -> Column:
    """64-bit hash of a text; null counts as empty."""
    return F.xxhash64(F.coalesce(c, F.lit("")))


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Equi-join condition under which a null key equals a null key."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def gathered_sum(docs: DataFrame, add: Callable[[np.ndarray, pa.Array], None], size: int, chunk: int = 4096) -> np.ndarray:
    """The sum over all tasks of a table of `size` numbers; add(table, texts) counts a batch of texts into a task's table.

    Each task sends its table once, in chunks that are zero nowhere throughout; they are added up in two levels of
    groups, the first of which splits the tasks over 64 slots. The driver receives `size` numbers.
    """

    def partial(batches):
        table, part = np.zeros(size), 0
        for batch in batches:
            if batch.num_rows:
                part = batch.column("part")[0].as_py()
                add(table, batch.column("text"))
        rows = table.reshape(-1, chunk)
        some = np.flatnonzero(np.abs(rows).sum(1))
        yield pa.RecordBatch.from_pydict({"chunk": pa.array(some, pa.int32()), "slot": pa.array([part % 64] * len(some), pa.int32()), "sums": pa.array([rows[i].astype(np.float32).tobytes() for i in some], pa.binary())})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(chunk)
        for x in pdf["sums"]:
            out += np.frombuffer(x, np.float32)
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1], "slot": pdf["slot"].iloc[:1], "sums": [out.astype(np.float32).tobytes()]})

    kind = "chunk int, slot int, sums binary"
    parts = docs.select(F.spark_partition_id().alias("part"), "text").mapInArrow(partial, kind)
    table = np.zeros((size // chunk, chunk), np.float32)
    for r in parts.groupBy("chunk", "slot").applyInPandas(total, kind).groupBy("chunk").applyInPandas(total, kind).collect():
        table[r["chunk"]] = np.frombuffer(r["sums"], np.float32)
    return table.reshape(-1)
