"""Text normalisers as Columns. Rules are data: ordered (pattern, replacement) steps, folded into one expression."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# The patterns that the results depend on, in the order in which they apply.
METRIC_NAME = [
    (r"(?i)\s*\|.*?\(Table\s*-.*?\).*$", ""),
    (r"(?i)\s*\|\s*(Old|New)\b.*$", ""),
    (r"(?i)^(Rank|Performance\s+Level)\s*\|\s*", ""),
    (r"(?i)^Top\s+\w+\s*[-–]\s*", ""),
    (r"\s+[ba]$", ""),
    (r"(?i)\s+by\s+\w[\w\s]*$", ""),
]
CLEAN_TEXT = [
    (r"(?i)\s*\(Table\s*-\s*[^\)]+\)", ""),
    (r"\s*\([^\)]+\)", ""),
    (r"![0-9]+", ""),
    (r"(?i)\b(avg|sum|min|max|count|attr)\b", ""),
    (r"[^a-zA-Z0-9\s]", " "),
    (r"\s+", " "),
]
BASE_METRIC = [
    (r"(?i)\b(by|per)\b.*$", ""),
    (r"^\s+|\s+$", ""),
    (r"(?i)\blevel\b", ""),
    (r"^\s+|\s+$", ""),
    (r"(?i)\baging\b", ""),
    (r"^\s+|\s+$", ""),
    (r"\s+", " "),
]
ABBREVIATIONS = [
    (r"\bno\.?\s+of\b", "number of"),
    (r"\baccnt\s+exec\b", "account executive"),
    (r"\boppty\b", "opportunity"),
    (r"\bmeetings\b", "meeting"),
    (r"\binvoices\b", "invoice"),
    (r"\bavg\.?\b", "average"),
    (r"\bopportunities\b", "opportunity"),
]
#: What a metric's name loses once each, in this order, on the way to the metric that several reports share; fixed values.
SHARED_METRIC = [
    r"\blevel\b",
    r"\baging\b",
    r"\b(variance from|rank of|percentage change in|total|change from previous year|year-over-year change in|% hit target for|claims|states|national|regions|region|state)\b",
]
WORKSHEET_NAME = [
    (r"(?i)^(kpi\s*-\s*|kpi:\s*|sheet\s*|table\s*-\s*)", ""),
    (r"[^a-zA-Z0-9\s]", ""),
    (r"\s+", " "),
]
FORMULA_TEXT = [(r"[\[\]\"']", ""), (r"\s+", " ")]
LABEL = [(r"_", " "), (r"[()\[\]{}]", " "), (r"\s*&\s*", " & "), (r"\s+", " ")]
ALNUM = [(r"[^a-z0-9]", "")]
AGGREGATES = r"(?i)\b(SUM|AVG|AVERAGE|COUNT|COUNTD|MIN|MAX|MEDIAN|ATTR|STDEV|VAR|PCT)\s*\(\s*([^)]+)\s*\)"
AGGREGATE_PHRASES = [
    ("average ", "AVG"), ("avg ", "AVG"), ("sum of ", "SUM"), ("total ", "SUM"), ("count of ", "COUNT"), ("number of ", "COUNT"),
    ("distinct count", "COUNTD"), ("median ", "MEDIAN"), ("maximum ", "MAX"), ("max ", "MAX"), ("minimum ", "MIN"), ("min ", "MIN"),
]
FIELD_REF = r"\[([^\]]+)\]"


def fold(c: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        c = F.regexp_replace(c, pattern, to)
    return c


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_metric_name(c: Column) -> Column:
    return trim_ws(fold(trim_ws(c), METRIC_NAME))


def clean_text(c: Column) -> Column:
    return F.lower(trim_ws(fold(c, CLEAN_TEXT)))


def base_metric(c: Column) -> Column:
    return F.lower(trim_ws(fold(c, BASE_METRIC)))


def expand_abbreviations(c: Column) -> Column:
    return trim_ws(fold(trim_ws(F.lower(c)), ABBREVIATIONS))


def shared_metric(c: Column) -> Column:
    """The metric that a name is about: abbreviations spelled out, without its grain, and without the first of each of SHARED_METRIC."""
    out = trim_ws(F.regexp_replace(expand_abbreviations(c), r"\b(by|per)\b.*$", ""))
    for phrase in SHARED_METRIC:
        out = trim_ws(F.regexp_replace(out, f"(?s)^(.*?){phrase}", "$1"))
    return trim_ws(F.regexp_replace(out, r"\s+", " "))


def clean_worksheet_name(c: Column) -> Column:
    return F.lower(trim_ws(fold(c, WORKSHEET_NAME)))


def virtual_aliases(name: Column, worksheet: Column) -> Column:
    """Sorted distinct names under which a metric may also be known, given the sheet it stands on."""
    ws = clean_worksheet_name(worksheet)
    name = F.lower(name)
    three = lambda ws, name: F.when(F.length(ws) > 3, F.array(ws, F.concat_ws(" ", ws, name), F.concat_ws(" by ", name, ws)))
    parts = F.filter(F.transform(F.filter(F.split(worksheet, r"[|\-/]", -1), lambda p: trim_ws(p) != ""), lambda p: clean_worksheet_name(trim_ws(p))), lambda p: F.length(p) > 2)
    four = lambda p: F.when(F.size(p) > 1, F.array(*[F.concat_ws(by, F.get(p, i), F.get(p, 1 - i)) for by in (" ", " by ") for i in (0, 1)]))
    none = F.array().cast("array<string>")
    # sheet, name and parts are bound to a variable: written into each alias they would be cleaned anew for each
    bound = F.transform(F.array(F.struct(ws.alias("ws"), name.alias("name"), parts.alias("parts"))), lambda s: F.concat(F.coalesce(three(s["ws"], s["name"]), none), F.coalesce(four(s["parts"]), none)))
    return F.array_sort(F.array_distinct(bound[0]))


def formula_tokens(c: Column) -> Column:
    """A formula's tokens in order of the alphabet, for comparison without regard to order."""
    plain = trim_ws(fold(F.lower(F.coalesce(c, F.lit(""))), FORMULA_TEXT))
    return F.array_join(F.array_sort(F.split(plain, " ")), " ")


def label(c: Column) -> Column:
    return trim_ws(fold(F.lower(trim_ws(c)), LABEL))


def alnum_key(c: Column) -> Column:
    return fold(F.lower(c), ALNUM)


def strip_table_suffix(c: Column) -> Column:
    return F.trim(F.substring_index(c, " (Table - ", 1))


def normalize_agg(c: Column) -> Column:
    up = F.upper(F.when(F.coalesce(c, F.lit("")) == "", "UNKNOWN").otherwise(c))
    return F.when(up == "AVERAGE", "AVG").when(up == "CNT", "COUNT").otherwise(up)


def infer_agg(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    call = F.regexp_extract(text, AGGREGATES, 1)
    out = F.lit("UNKNOWN")
    for phrase, agg in reversed(AGGREGATE_PHRASES):
        out = F.when(F.lower(text).contains(phrase), agg).otherwise(out)
    return F.when(call != "", normalize_agg(call)).otherwise(out)


def field_refs(formula: Column) -> Column:
    """Sorted distinct names in square brackets."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(formula, F.lit("")), F.lit(FIELD_REF), F.lit(1)), lambda x: trim_ws(x))))


def split_list(c: Column) -> Column:
    """A list column written as JSON, or with the first of ',', '|' and ';' that occurs in it."""
    text = F.trim(F.coalesce(c, F.lit("")))
    parts = F.when(text.startswith("["), F.from_json(text, "array<string>"))
    for sep in (",", r"\|", ";"):
        parts = F.coalesce(parts, F.when(text.contains(sep[-1]), F.split(text, sep)))
    parts = F.coalesce(parts, F.array(text))
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def json_list(c: Column) -> Column:
    return F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))


def ragged_list(c: Column, path: str = "$") -> Column:
    """The value at a path of a JSON text as strings, whatever its shape: an array's elements, a single value, of an object its JSON. [] for null, for what isn't there and for what isn't JSON.

    Elements that are null stay; nested arrays and objects are JSON texts.
    """
    v = F.try_variant_get(F.try_parse_json(c), path, "variant")
    nested = F.try_variant_get(v, "$", "array<variant>")
    items = F.transform(nested, lambda x: F.try_variant_get(x, "$", "string"))
    return F.coalesce(items, F.array_compact(F.array(F.try_variant_get(v, "$", "string"))), F.array().cast("array<string>"))


def fallback_lineage(table: Column, column: Column, explicit: Column, required: Column) -> Column:
    """Explicit lineage, else required fields, else table.column, else column."""
    some = lambda a: F.when(F.size(a) > 0, a)
    full = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    t, c = full(table), full(column)
    return F.coalesce(some(split_list(explicit)), some(split_list(required)), F.when(t.isNotNull() & c.isNotNull(), F.array(F.concat_ws(".", t, c))), F.when(c.isNotNull(), F.array(c)), F.array().cast("array<string>"))


def match_key(name: Column, lineage: Column, agg: Column, sector: Column, subdomain: Column, version: str = "v1") -> Column:
    """SHA-256 key under which a match is remembered; unknown aggregations share one key."""
    up = F.upper(F.coalesce(agg, F.lit("")))
    kind = F.when(up.isin("UNKNOWN", "NONE"), "").otherwise(up)
    quoted = F.transform(F.array_sort(F.coalesce(lineage, F.array().cast("array<string>"))), lambda x: F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"')))
    listed = F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))
    return F.sha2(F.concat(F.lower(F.trim(F.coalesce(name, F.lit("")))), listed, kind, F.coalesce(sector, F.lit("")), F.coalesce(subdomain, F.lit("")), F.lit(version)), 256)


def split_granularity(c: Column) -> Column:
    """struct(metric, level): 'x by y' is metric x at 'Y Level', anything else at 'Overall Level'."""
    name = F.regexp_replace(c, r"(?i)\bavg\.?\b", "Average")
    pattern = r"(?i)^(.*?)\s+(?:by|per)\s+(.*)$"
    hit = name.rlike(pattern)
    level = F.concat(F.initcap(F.lower(trim_ws(F.regexp_extract(name, pattern, 2)))), F.lit(" Level"))
    return F.struct(F.when(hit, trim_ws(F.regexp_extract(name, pattern, 1))).otherwise(trim_ws(name)).alias("metric"), F.when(hit, level).otherwise(F.lit("Overall Level")).alias("level"))


def embedding_text(name: Column, definition: Column, worksheet: Column, dimensions: Column, filters: Column, lineage: Column) -> Column:
    """What is embedded for a metric; parts that are null or empty are left out."""
    some = lambda a, before: F.when(F.size(a) > 0, F.concat(F.lit(before), F.array_join(a, ", ")))
    return F.concat_ws(" ", name, F.when(definition != "", definition), F.when(worksheet != "", F.concat(F.lit("displayed on worksheet "), worksheet)), some(dimensions, "broken down by "), some(filters, "filtered by "), F.when(F.size(lineage) > 0, F.array_join(lineage, " ")))


def fenced_json(c: Column, schema: str) -> Column:
    """The JSON value in a text that may be fenced as Markdown code; null if there is none."""
    return F.from_json(F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")), schema)


def parse_reply(c: Column, missing: Column | None = None) -> Column:
    """A judge's reply: the outermost braces, typed; an empty or null id is a rejection with a confidence of .79 at most. missing stands for scores that aren't given (0)."""
    missing = F.lit(0.0) if missing is None else missing
    fields = F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), "matched_kpi_id string, similarity_score double, confidence_score double, rationale string")
    kpi = F.when(F.trim(F.coalesce(fields["matched_kpi_id"], F.lit(""))).isin("", "null", "None"), F.lit(None).cast("string")).otherwise(F.trim(fields["matched_kpi_id"]))
    conf = F.coalesce(fields["confidence_score"], missing)
    return F.struct(kpi.alias("matched_kpi_id"), F.coalesce(fields["similarity_score"], missing).alias("similarity_score"), F.when(kpi.isNull(), F.least(conf, F.lit(0.79))).otherwise(conf).alias("confidence_score"))


def lev_ratio(a: Column, b: Column) -> Column:
    """(longer - distance) / longer; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise((longer - F.levenshtein(a, b)) / longer)


def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)], dtype=float)


def seq_ratio(a: Column, b: Column) -> Column:
    """Matching-block ratio of two texts (not symmetric). For pairs that other conditions have narrowed down."""
    return F.pandas_udf(_ratios, "double")(a, b)


def register(spark: SparkSession) -> None:
    """Makes seq_ratio known to SQL."""
    spark.udf.register("seq_ratio", F.pandas_udf(_ratios, "double"))


def seq_ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of seq_ratio from the lengths alone."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2 * F.least(F.length(a), F.length(b)) / total)
