"""Workbook files to catalog rows, and the catalog as partitioned tables."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, kind string, payload string, error string"


def scan_estate(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, mtime, content) of all workbook files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{twb,twbx}").load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def _plain(name: str | None) -> str:
    return (name or "").strip("[]")


def _sides(relation: ET.Element) -> list[str]:
    return [_plain(re.split(r"\]\.\[", e.get("op") or "")[-1]) for e in relation.iter("expression") if (e.get("op") or "").startswith("[")]


def _rows(root: ET.Element) -> Iterator[tuple[str, dict]]:
    """(kind, payload) of the parts of one workbook."""
    for source in root.iterfind("./datasources/datasource"):
        caption = source.get("caption") or source.get("name") or ""
        yield "datasource", {"name": source.get("name"), "caption": caption}
        for r in source.iter("relation"):
            if r.get("type") == "table":
                yield "table", {"datasource": caption, "name": _plain(r.get("name")), "table": r.get("table")}
            tables, sides = [t for t in r.iterfind("relation")], _sides(r)
            if r.get("type") == "join" and len(tables) >= 2 and len(sides) >= 2:
                yield "join", {"datasource": caption, "join_type": r.get("join") or "inner", "left_table": tables[0].get("name"), "right_table": tables[1].get("name"), "left_column": sides[0], "right_column": sides[1]}
        for m in source.iter("metadata-record"):
            if m.get("class") == "column":
                yield "column_table", {"datasource": caption, "column": _plain(m.findtext("local-name")), "table": _plain(m.findtext("parent-name"))}
        names = {c.get("name"): c.get("caption") or _plain(c.get("name")) for c in source.iterfind("column")}
        for c in source.iterfind("column"):
            calc = c.find("calculation")
            entry = {"datasource": caption, "name": names[c.get("name")], "datatype": c.get("datatype")}
            if calc is not None and calc.get("formula"):
                formula = re.sub(r"\[[^\]]+\]", lambda m: f"[{names.get(m[0], m[0][1:-1])}]", calc.get("formula"))
                yield "calc", entry | {"formula": formula}
            else:
                yield "column", entry
    for sheet in root.iterfind("./worksheets/worksheet"):
        mark = sheet.find(".//mark")
        yield "worksheet", {"name": sheet.get("name"), "rows": sheet.findtext(".//rows") or "", "cols": sheet.findtext(".//cols") or "", "mark": mark.get("class") if mark is not None else None}
    for board in root.iterfind("./dashboards/dashboard"):
        yield "dashboard", {"name": board.get("name"), "worksheets": sorted({z.get("name") for z in board.iter("zone") if z.get("name")})}


def _parse(path: str, content: bytes) -> list[tuple]:
    try:
        if path.lower().endswith(".twbx"):
            with zipfile.ZipFile(io.BytesIO(content)) as z:
                content = z.read(next(n for n in z.namelist() if n.lower().endswith(".twb")))
        return [(path, kind, json.dumps(payload), None) for kind, payload in _rows(ET.fromstring(content))]
    except Exception as e:  # one bad file is a row of its own and doesn't stop the batch
        return [(path, "error", None, f"{type(e).__name__}: {e}")]


def extract_workbooks(files: DataFrame) -> DataFrame:
    """(path, kind, payload, error): the parts of each file as JSON by kind; a file that can't be read has kind 'error'."""

    def run(frames):
        for pdf in frames:
            rows = [r for p, c in zip(pdf["path"], pdf["content"]) for r in _parse(p, bytes(c))]
            yield pd.DataFrame(rows, columns=["path", "kind", "payload", "error"])

    return files.select("path", "content").mapInPandas(run, ROWS)


def of_kind(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """The parts of one kind with typed columns."""
    return rows.filter(F.col("kind") == kind).select("path", F.from_json("payload", schema).alias("x")).select("path", "x.*")


def resolve_table(refs: DataFrame, known: DataFrame) -> DataFrame:
    """refs(column, hint) with the table: from known(column, table), else the hint unless it names a connection."""
    reserved = F.lower("hint").rlike(r"^(excel-direct|federated|sqlproxy|parameters)")
    return refs.join(known.groupBy("column").agg(F.min("table").alias("known")), "column", "left").select("column", F.coalesce("known", F.when(~reserved, F.col("hint"))).alias("table"))


def write_catalog(rows: DataFrame, path: str) -> None:
    """Replaces the parts of the files in rows, and only theirs, in the catalog at path."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("path").parquet(path)


def stream_ingest(spark: SparkSession, source: str, catalog: str, checkpoint: str) -> None:
    """Takes in the workbook files that have come to a folder since the last call."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{twb,twbx}").load(source)
    q = files.writeStream.foreachBatch(lambda batch, _: write_catalog(extract_workbooks(batch), catalog)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
