"""Pairs and clusters of an estate kept up to date batch by batch, from a stream of what reports gained and which of them went.

The store is a folder of logs: each batch appends what it touched, never what it left alone, and is committed by a row in the ledger, written
last. Reads see committed batches only, so a batch that broke off leaves nothing visible and is written anew, and one that
comes again after it was committed changes nothing. `compacted` folds the logs into one generation.

items    (report_id, item)      of reports that aren't gone
touched  (report_id, gone)      reports whose items changed, and those that went, for good
pairs    (a, b, score)          valid if neither side was touched in a later batch
members  (node, root)           clusters of pairs at a threshold; valid if the root's cluster wasn't rebuilt in a later batch
rebuilt  (root)                 clusters that were taken apart or merged
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.operators.components import connected_components
from reportweave.operators.durable import materialize, remove

LOGS = {
    "items": "report_id long, item string",
    "touched": "report_id long, gone boolean",
    "pairs": "a long, b long, score double",
    "members": "node long, root long",
    "rebuilt": "root long",
}
_LEDGER = "batch long, generation int"
_FIRST = -1


@dataclass
class ClusterStore:
    """An estate's store at path. score(report_ids, items) gives (a, b, score), a < b, of the pairs with a side in report_ids; pairs from
    `threshold` on make clusters."""

    spark: SparkSession
    path: str
    score: Callable[[DataFrame, DataFrame], DataFrame]
    threshold: float

    def __post_init__(self) -> None:
        self._seen: tuple[list[int], int] | None = None  # the ledger, while a batch is applied
        self.spark.createDataFrame([(_FIRST, 0)], _LEDGER).coalesce(1).write.mode("ignore").parquet(f"{self.path}/ledger")
        for name, schema in LOGS.items():
            self._write(self.spark.createDataFrame([], schema), self._folder(name, 0, _FIRST), "ignore")

    @staticmethod
    def _write(df: DataFrame, folder: str, mode: str = "overwrite") -> None:
        df.write.mode(mode).parquet(folder)

    def _commit(self, batches: list[int], generation: int) -> None:
        """One file, so all of it is seen or nothing."""
        self.spark.createDataFrame([(b, generation) for b in batches], _LEDGER).coalesce(1).write.mode("append").parquet(f"{self.path}/ledger")

    def _folder(self, name: str, generation: int, batch: int) -> str:
        return f"{self.path}/{name}/generation={generation}/batch={batch}"

    def committed(self) -> tuple[list[int], int]:
        """Batches of the newest generation, and that generation."""
        rows = self.spark.read.schema(_LEDGER).parquet(f"{self.path}/ledger").collect()
        generation = max(r["generation"] for r in rows)
        return sorted(r["batch"] for r in rows if r["generation"] == generation), generation

    def _log(self, name: str) -> DataFrame:
        batches, generation = self._seen or self.committed()
        log = self.spark.read.schema(f"{LOGS[name]}, batch long").parquet(f"{self.path}/{name}/generation={generation}")
        return log.filter(F.col("batch").isin(batches))

    def items(self) -> DataFrame:
        gone = self._log("touched").filter("gone").select("report_id").distinct()
        return self._log("items").select("report_id", "item").join(gone, "report_id", "left_anti")

    def pairs(self) -> DataFrame:
        last = self._log("touched").groupBy("report_id").agg(F.max("batch").alias("last"))
        now = self._log("pairs")
        for side in "ab":
            now = now.join(last.withColumnsRenamed({"report_id": side, "last": f"last_{side}"}), side, "left").filter(f"last_{side} is null or batch >= last_{side}")
        return now.select("a", "b", "score")

    def clusters(self) -> DataFrame:
        last = self._log("rebuilt").groupBy("root").agg(F.max("batch").alias("last"))
        return self._log("members").join(last, "root", "left").filter("last is null or batch >= last").select("node", "root")

    def apply(self, batch: int, added: DataFrame, gone: DataFrame) -> bool:
        """Applies added(report_id, item) and gone(report_id). Returns whether it did; a batch in the ledger is left alone."""
        batches, generation = self.committed()
        if batch in batches:
            return False
        self._seen = batches, generation
        try:
            self._apply(batch, generation, added, gone)
        finally:
            self._seen = None
        self._commit([batch], generation)
        return True

    def _apply(self, batch: int, generation: int, added: DataFrame, gone: DataFrame) -> None:
        folder = lambda name: self._folder(name, generation, batch)
        read = lambda name: self.spark.read.schema(LOGS[name]).parquet(folder(name))
        dead = self._log("touched").filter("gone").select("report_id")
        gone = gone.select("report_id").filter("report_id is not null").distinct().join(dead, "report_id", "left_anti")
        files: list[str] = []
        gone = materialize(gone, "gone", files)
        fresh = added.select("report_id", "item").filter("report_id is not null and item is not null").distinct()
        fresh = fresh.join(dead.unionByName(gone).distinct(), "report_id", "left_anti").join(self._log("items").select("report_id", "item"), ["report_id", "item"], "left_anti")
        self._write(fresh, folder("items"))
        changed = read("items").select("report_id").distinct()
        self._write(changed.withColumn("gone", F.lit(False)).unionByName(gone.withColumn("gone", F.lit(True))), folder("touched"))
        touched = read("touched").select("report_id").distinct()
        items = self.items().join(gone, "report_id", "left_anti").unionByName(read("items"))
        self._write(self.score(changed, items), folder("pairs"))
        self._recluster(touched, read("pairs").filter(F.col("score") >= self.threshold).select("a", "b"), folder, files)
        remove(self.spark, files)

    def _recluster(self, touched: DataFrame, new: DataFrame, folder: Callable[[str], str], files: list[str]) -> None:
        """Clusters with a touched node are taken apart and found again. Others that a new edge reaches count as one node, their root."""
        members = self.clusters()
        apart = materialize(members.join(touched.select(F.col("report_id").alias("node")), "node", "left_semi").select("root").distinct(), "apart", files)
        inside = members.join(apart, "root", "left_semi").select("node")
        kept = self.pairs().filter(F.col("score") >= self.threshold).join(inside.withColumnRenamed("node", "a"), "a", "left_semi")
        for side in "ab":
            kept = kept.join(touched.select(F.col("report_id").alias(side)), side, "left_anti")
        whole = members.join(apart, "root", "left_anti")
        edges = new
        for side in "ab":
            named = whole.select(F.col("node").alias(side), F.col("root").alias("known"))
            edges = edges.join(named, side, "left").withColumn(side, F.coalesce("known", side)).drop("known")
        found = materialize(connected_components(kept.select("a", "b").unionByName(edges.select("a", "b"))), "found", files)
        moved = whole.withColumnRenamed("root", "was").join(found.withColumnRenamed("node", "was"), "was").filter("was <> root")  # its root stood for the cluster
        moved = materialize(moved, "moved", files)
        self._write(found.join(whole, "node", "left_anti").unionByName(moved.select("node", "root")), folder("members"))
        self._write(apart.unionByName(moved.select(F.col("was").alias("root")).distinct()), folder("rebuilt"))

    def compacted(self) -> None:
        """Writes what holds now as a new generation, which one ledger row makes visible together with all its batches."""
        batches, generation = self.committed()
        gone = self._log("touched").filter("gone").select("report_id", "gone").distinct()
        now = {"items": self.items(), "touched": gone, "pairs": self.pairs(), "members": self.clusters(), "rebuilt": self._log("rebuilt").limit(0).select("root")}
        for name, df in now.items():
            self._write(df, self._folder(name, generation + 1, _FIRST))
        self._commit(batches, generation + 1)
