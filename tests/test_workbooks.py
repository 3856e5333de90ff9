"""Workbook files become catalog rows; a bad file doesn't stop the batch; taking in again replaces."""

import zipfile

from pyspark.sql import functions as F

from reportweave.sources import workbooks as B

XML = """<workbook><datasources><datasource name="ds" caption="Sales"><connection><relation type="join" join="left">
<clause><expression op="="><expression op="[a].[id]"/><expression op="[b].[ref]"/></expression></clause>
<relation type="table" name="a" table="[dbo].[a]"/><relation type="table" name="b" table="[dbo].[b]"/></relation>
<metadata-records><metadata-record class="column"><local-name>[paid]</local-name><parent-name>[a]</parent-name></metadata-record></metadata-records></connection>
<column name="[paid]" caption="Paid" datatype="real"/><column name="[Calculation_1]" caption="Total" datatype="real"><calculation formula="SUM([paid])"/></column>
</datasource></datasources><worksheets><worksheet name="Sheet 1"><table><panes><pane><mark class="Bar"/></pane></panes><rows>[x]</rows><cols/></table></worksheet></worksheets>
<dashboards><dashboard name="Main"><zones><zone name="Sheet 1"/></zones></dashboard></dashboards></workbook>"""


def test_extract(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "one.twb").write_text(XML)
    (tmp_path / "in" / "bad.twb").write_text("<workbook")
    with zipfile.ZipFile(tmp_path / "in" / "two.twbx", "w") as z:
        z.writestr("x/two.twb", XML)
    rows = B.extract_workbooks(B.scan_estate(spark, str(tmp_path / "in"))).cache()
    kinds = {(r["kind"], r["n"]) for r in rows.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds == {("datasource", 2), ("table", 4), ("join", 2), ("column_table", 2), ("column", 2), ("calc", 2), ("worksheet", 2), ("dashboard", 2), ("error", 1)}
    assert {r["formula"] for r in B.of_kind(rows, "calc", "name string, formula string").collect()} == {"SUM([Paid])"}
    join = B.of_kind(rows, "join", "left_table string, right_table string, left_column string, right_column string, join_type string").first()
    assert (join["left_table"], join["right_table"], join["left_column"], join["right_column"], join["join_type"]) == ("a", "b", "id", "ref", "left")
    catalog = str(tmp_path / "catalog")
    B.stream_ingest(spark, str(tmp_path / "in"), catalog, str(tmp_path / "log"))
    before = spark.read.parquet(catalog).count()
    B.write_catalog(rows.filter("kind = 'dashboard'"), catalog)
    assert spark.read.parquet(catalog).filter("path like '%one.twb'").count() == 1
    assert spark.read.parquet(catalog).count() == 3 and before == rows.count()


def test_resolve_table(spark):
    refs = spark.createDataFrame([("a", "t9"), ("b", "federated.1x"), ("c", "t3")], "column string, hint string")
    known = spark.createDataFrame([("a", "t1")], "column string, table string")
    assert {tuple(r) for r in B.resolve_table(refs, known).collect()} == {("a", "t1"), ("b", None), ("c", "t3")}
