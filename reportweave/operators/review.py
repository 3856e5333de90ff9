"""Governance: quality flags, decisions, verdicts, risk and advice rules, human review with its audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reportweave.sources.adapters import latest

ACCEPTED = ["auto_accepted", "human_accepted", "promoted"]


def flag_ambiguous(m: DataFrame, scores: str, gap: float = 0.05) -> DataFrame:
    """Mappings of middling confidence whose two best candidates are closer than gap."""
    s = F.sort_array(F.col(scores), asc=False)
    return m.filter(F.col("confidence").between(0.5, 0.8) & (F.size(s) >= 2) & (F.abs(F.get(s, 0) - F.get(s, 1)) < gap)).select("mapping_id", F.lit("ambiguous_match").alias("type"), F.lit("Medium").alias("severity"))


def flag_weak(m: DataFrame) -> DataFrame:
    none = (F.coalesce(F.size("lineage"), F.lit(0)) <= 0) & (F.coalesce("definition", F.lit("")) == "")
    return m.filter(none).select("mapping_id", F.lit("weak_evidence").alias("type"), F.lit("Low").alias("severity"))


def flag_low(m: DataFrame) -> DataFrame:
    return m.filter(F.coalesce("confidence", F.lit(0.0)) < 0.5).select("mapping_id", F.lit("low_confidence").alias("type"), F.lit("High").alias("severity"))


def flag_missing(dash: DataFrame) -> DataFrame:
    kinds = F.array_compact(F.array(F.when(F.col("sector").isNull(), "sector"), F.when(F.col("subdomain").isNull(), "subdomain")))
    return dash.select("report", F.explode(kinds).alias("missing"))


def duplicate_mappings(m: DataFrame) -> DataFrame:
    """(report, canonical, worksheets): metrics that several worksheets of one report map to."""
    return m.filter("canonical is not null").groupBy("report", "canonical").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("ws")).alias("sheets")).filter("n > 1")


def mapping_conflicts(m: DataFrame) -> DataFrame:
    """(kpi, canonical, others): one name that maps to different metrics. Sets are aggregated, not joined pairwise."""
    per = m.filter("canonical is not null").select("kpi", "canonical").distinct()
    all_ = per.groupBy("kpi").agg(F.array_sort(F.collect_set("canonical")).alias("ids")).filter(F.size("ids") > 1)
    return per.join(all_, "kpi").select("kpi", "canonical", F.array_except("ids", F.array("canonical")).alias("others"))


def decide(mapping_type: Column, confidence: Column, status: Column, any_high: Column, auto: float = 0.95) -> Column:
    base = F.when(mapping_type.isin("exact", "alias") | (confidence >= auto), "AUTO_APPROVE").otherwise("REQUIRES_HUMAN_REVIEW")
    return F.when(status == "not_found", "NEW_KPI_REQUIRED").when(any_high, "REQUIRES_HUMAN_REVIEW").otherwise(base)


def verdicts(decided: DataFrame) -> DataFrame:
    """One row a report: counts of decisions and the overall verdict. decided: report, decision, warnings."""
    n = lambda x: F.count_if(F.col("decision") == x)
    g = decided.groupBy("report").agg(F.count("*").alias("total"), n("AUTO_APPROVE").alias("approved"), n("REQUIRES_HUMAN_REVIEW").alias("review"), n("NEW_KPI_REQUIRED").alias("new"), F.sum("warnings").alias("warnings"))
    return g.withColumn("verdict", F.when((F.col("review") > 0) | (F.col("new") > 0) | (F.col("warnings") > 0), "REQUIRES_HUMAN_REVIEW").otherwise("AUTO_APPROVE"))


def risk_rules(dash: DataFrame) -> DataFrame:
    """(report, rule_id, risk_type, severity) by counts of worksheets and calculated fields."""
    ws, calcs = F.col("worksheets"), F.col("calcs")
    row = lambda rule, kind, severity: F.struct(F.lit(rule).alias("rule_id"), F.lit(kind).alias("risk_type"), F.lit(severity).alias("severity"))
    hit = F.array_compact(
        F.array(
            F.when(ws > 12, row("GOV-R001", "High Complexity", "High")).when(ws > 6, row("GOV-R001", "Medium Complexity", "Medium")),
            F.when(calcs > 30, row("GOV-R002", "Heavy Calculation Overhead", "High")).when(calcs > 15, row("GOV-R002", "Calculation Overlap", "Medium")),
            F.when(ws == 0, row("GOV-R003", "Empty Dashboard", "Medium")),
            F.when((calcs == 0) & (ws > 3), row("GOV-R004", "Raw Data Exposure", "Low")),
        )
    )
    none = F.array(row("GOV-R000", "Low Risk Profile", "Low"))
    return dash.select("report", F.explode(F.when(F.size(hit) > 0, hit).otherwise(none)).alias("x")).select("report", "x.*")


def advice(dash: DataFrame) -> DataFrame:
    """(report, depth, advice) from the same counts."""
    ws, calcs = F.col("worksheets"), F.col("calcs")
    high = (ws > 12) | (calcs > 30)
    tips = F.array_compact(F.array(F.when(calcs > 20, "publish calculated fields"), F.when(ws > 12, F.concat(F.lit("split into "), F.floor(ws / 6).cast("string"))), F.when(high, "assign a steward")))
    text = F.when(F.size(tips) > 0, F.array_join(tips, "; ")).otherwise("within thresholds")
    return dash.select("report", F.when((calcs > 30) | (ws > 15), "deep").otherwise("standard").alias("depth"), text.alias("advice"))


def apply_actions(m: DataFrame, actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mappings after the actions, audit rows). Actions apply in the order of ts; the last one decides.

    m: mapping_id, status, canonical. actions: mapping_id, action_id, ts, action, target (of a reassignment).
    """
    status = F.when(F.col("action") == "reject", "human_rejected").otherwise("human_accepted")
    w = W.partitionBy("mapping_id").orderBy("ts", "action_id")
    steps = actions.join(m.select("mapping_id", F.col("status").alias("was"), F.col("canonical").alias("had")), "mapping_id").withColumn("now", status)
    had = F.last(F.when(F.col("action") == "reassign", F.col("target")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    steps = steps.withColumn("was", F.coalesce(F.lag("now").over(w), "was")).withColumn("had", F.coalesce(had, "had"))
    change = lambda field, old, new: F.struct(F.lit(field).alias("field"), old.alias("old"), new.alias("new"))
    moved = (F.col("action") == "reassign") & (F.col("had") != F.col("target"))
    audit = steps.select("mapping_id", "action_id", "ts", F.explode(F.array_compact(F.array(change("status", F.col("was"), F.col("now")), F.when(moved, change("canonical", F.col("had"), F.col("target")))))).alias("x")).select("mapping_id", "action_id", "ts", "x.*")
    last = steps.groupBy("mapping_id").agg(F.max_by("now", F.struct("ts", "action_id")).alias("now"), F.max_by("target", F.when(F.col("action") == "reassign", F.struct("ts", "action_id"))).alias("to"))
    after = m.join(last, "mapping_id", "left").select("mapping_id", F.coalesce("now", "status").alias("status"), F.coalesce("to", "canonical").alias("canonical"))
    return after, audit


def promote(m: DataFrame, bank: DataFrame, chosen: DataFrame) -> DataFrame:
    """bank with a new row for each chosen mapping that was not found: name, subdomain; one for equal ones."""
    new = m.join(chosen, "mapping_id", "left_semi").filter("status = 'not_found'").groupBy(F.col("kpi").alias("name"), "subdomain").agg(F.min("mapping_id").alias("kpi_id"))
    fresh = new.join(bank, ["name", "subdomain"], "left_anti")
    return bank.select("kpi_id", "name", "subdomain").unionByName(fresh.select(-F.col("kpi_id").alias("kpi_id"), "name", "subdomain").toDF("kpi_id", "name", "subdomain"))


def fill_lineage(bank: DataFrame, accepted: DataFrame) -> DataFrame:
    """bank(kpi_id, lineage) whose empty lineages take that of the first accepted mapping(kpi_id, lineage, resolved_at)."""
    first = accepted.filter(F.size("lineage") > 0).groupBy("kpi_id").agg(F.min_by("lineage", "resolved_at").alias("first"))
    return bank.join(first, "kpi_id", "left").select("kpi_id", F.when(F.size("lineage") > 0, F.col("lineage")).otherwise(F.coalesce("first", "lineage")).alias("lineage"))


def upsert_bank(bank: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bank after changes, conflicts). Names are unique in a subdomain; a change to another row's name is a conflict, and a change with a new kpi_id is inserted."""
    clash = changes.join(bank.select(F.col("kpi_id").alias("other"), "name", "subdomain"), ["name", "subdomain"]).filter("other <> kpi_id").groupBy("kpi_id").agg(F.min("other").alias("other"))
    good = latest(changes.join(clash, "kpi_id", "left_anti"), ["name", "subdomain"], "kpi_id")
    kept = bank.select("kpi_id", "name", "subdomain").join(good, "kpi_id", "left_anti")
    return kept.unionByName(good.select("kpi_id", "name", "subdomain")), clash


def upsert_mappings(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key of both."""
    return latest(old.unionByName(new), keys, F.desc(version))


def search_bank(bank: DataFrame, text: str) -> DataFrame:
    """Bank rows with text in name, subdomain or an alias."""
    t = text.lower()
    return bank.filter(F.lower("name").contains(t) | F.lower("subdomain").contains(t) | F.exists("aliases", lambda a: F.lower(a).contains(t)))


def filter_mappings(m: DataFrame, text: str = "", band: str = "") -> DataFrame:
    bands = {"high": F.col("confidence") >= 0.8, "medium": (F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8), "low": F.col("confidence") < 0.5}
    return m.filter(F.lower("kpi").contains(text.lower()) & bands.get(band, F.lit(True)))


def scope_queue(dash: DataFrame) -> DataFrame:
    """Reports whose scope is not settled."""
    return dash.filter("sector is null or subdomain is null").select("report", F.coalesce("sector", F.lit("insurance")).alias("sector"), F.coalesce("subdomain", F.lit("pending_scope")).alias("subdomain"))
