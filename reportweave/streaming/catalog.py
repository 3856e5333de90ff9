"""A catalog of pages and their parts that streams write into: what comes anew replaces a page's parts, and only those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportweave.operators.durable import materialize, remove, without_shuffle_files
from reportweave.sources.adapters import latest
from reportweave.streaming.jobs import run_to_end

PARTS = "page_id long, kind string, pos int, value string, bucket int"


def page_parts(pages: DataFrame) -> DataFrame:
    """(page_id, kind, pos, value): of each page the page itself with its url, its title, links and headings, in their order. pages: page_id, url, html."""
    found = lambda pattern: F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(pattern), F.lit(1))
    kinds = {
        "page": F.array("url"),
        "title": F.slice(found(r"(?is)<title>(.*?)</title>"), 1, 1),
        "link": found(r'(?i)<a\s+href="([^"]*)"'),
        "heading": found(r"(?is)<h[1-6]>(.*?)</h[1-6]>"),
    }
    each = F.array(*[F.struct(F.lit(kind).alias("kind"), values.alias("values")) for kind, values in kinds.items()])
    return pages.select("page_id", F.explode(each).alias("x")).select("page_id", "x.kind", F.posexplode("x.values").alias("pos", "value"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def replace_parts(pages: DataFrame, path: str, buckets: int = 64) -> None:
    """Replaces the parts of these pages in the catalog at path, which is partitioned by a hash of page_id into `buckets` (the same at every call).

    Only partitions with one of the pages are read and written. A page's own row is among its parts, so that one that has lost all others
    still replaces them, and no partition to be overwritten is empty. The same pages once more change nothing. Pages without an id are left out.
    """
    spark = pages.sparkSession
    bucket = F.pmod(F.xxhash64("page_id"), F.lit(buckets)).cast("int").alias("bucket")
    files: list[str] = []
    fresh = materialize(page_parts(pages.filter("page_id is not null")).select("page_id", "kind", "pos", "value", bucket), "parts-new", files)
    merged = fresh
    if _exists(spark, path):
        touched = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]  # at most `buckets`
        old = spark.read.schema(PARTS).parquet(path).filter(F.col("bucket").isin(touched))
        kept = old.join(fresh.select("page_id").distinct(), "page_id", "left_anti").select(fresh.columns)
        merged = materialize(kept.unionByName(fresh), "parts-merged", files)  # a table can't be overwritten while it is read
    with without_shuffle_files(spark):
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    remove(spark, files)


def ingest_pages(spark: SparkSession, landing: str, path: str, checkpoint: str, buckets: int = 64) -> None:
    """Takes the Parquet files of pages that have come to a folder since the last call into the catalog. Of a page that comes several times at once the newest file's row counts."""
    stream = spark.readStream.schema("page_id long, url string, html string").option("maxFilesPerTrigger", 64).parquet(landing)
    stamped = stream.select("page_id", "url", "html", F.col("_metadata.file_modification_time").alias("came"), F.col("_metadata.file_path").alias("file"))
    newest = lambda batch: latest(batch, ["page_id"], F.desc("came"), F.desc("file"), F.desc("html"), F.desc("url")).select("page_id", "url", "html")
    run_to_end(stamped, lambda batch, _: replace_parts(newest(batch), path, buckets), checkpoint)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PARTS).parquet(path).drop("bucket")
