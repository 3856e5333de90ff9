"""Scopes of the bank: sector and subdomain, from labels in any spelling. Lookups are literal maps inside one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reportweave.functions import text as X

# The sectors, their subdomains, and the spellings that lead to them.
SECTORS = {
    "insurance": ["marketing", "distribution", "actuarial_and_risk", "underwriting", "claims_litigation", "service_and_operations", "cx_and_digital"],
    "banking": ["retail", "corporate", "risk", "shared"],
    "finance": ["accounting", "treasury", "fp_and_a", "shared"],
    "operational": ["supply_chain", "hr", "it_ops", "shared"],
}
SPELLINGS = {
    "marketing": ["marketing"],
    "distribution": ["distribution", "distiribution"],
    "actuarial_and_risk": ["actuarial_and_risk", "actuarial & risk", "actuarial and risk", "acturial & risk", "acutrial & risk", "acturial and risk", "actuarial", "actuarial risk"],
    "underwriting": ["underwriting", "underwrite", "uw"],
    "claims_litigation": ["claims_litigation", "claims litigation", "claims & litigation", "claims and litigation", "claimns_ligtation", "claims", "litigation"],
    "service_and_operations": ["service_and_operations", "service & operations", "service and operations", "service operations", "service_operations", "shared"],
    "cx_and_digital": ["cx_and_digital", "cx & digital", "cx and digital", "cx digital", "cx&digital", "cx & diigtal", "cx diigtal", "customer experience", "customer experience & digital", "digital", "digital cx"],
}
LEGACY = {
    "claims & risk": "claims_litigation", "claims and risk": "claims_litigation", "customer service": "service_and_operations", "new business ops": "underwriting",
    "sales & pipeline": "marketing", "sales and pipeline": "marketing", "product level performance": "actuarial_and_risk", "product-level performance": "actuarial_and_risk",
    "marketing": "marketing", "distribution": "distribution", "actuarial & risk": "actuarial_and_risk", "claims_litigation": "claims_litigation",
    "service & operations": "service_and_operations", "cx & digital": "cx_and_digital", "cx and digital": "cx_and_digital",
}
DEFAULT_SECTOR, DEFAULT_SUBDOMAIN = "insurance", "service_and_operations"

#: Every spelling with its subdomain, and every sector/subdomain that is allowed.
ALIASES = {spelling: key for key, spellings in SPELLINGS.items() for spelling in spellings}
ALLOWED = [f"{sector}/{sub}" for sector, subs in SECTORS.items() for sub in subs]


def _look_up(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_subdomain(raw: Column) -> Column:
    """The subdomain that a label names: by its spelling, by the spelling with underscores, or because it is one; else null."""
    key = X.label(raw)
    under = F.replace(F.replace(key, F.lit(" & "), F.lit("_and_")), F.lit(" "), F.lit("_"))
    known = F.when(under.isin(sorted({s for subs in SECTORS.values() for s in subs})), under)
    return F.when(raw != "", F.coalesce(_look_up(ALIASES, key), _look_up(ALIASES, under), known))


def valid_sector(raw: Column) -> Column:
    s = F.lower(F.trim(raw))
    return F.when(s.isin(list(SECTORS)), s)


def valid_subdomain(sector: Column, raw: Column) -> Column:
    """The subdomain that raw names, if the sector has it."""
    sub = F.coalesce(canonical_subdomain(raw), F.lower(F.trim(raw)))
    return F.when((raw != "") & F.concat_ws("/", sector, sub).isin(ALLOWED) & sector.isNotNull(), sub)


def resolve_scope(sector: Column, subdomain: Column, legacy: Column) -> Column:
    """struct(sector, subdomain): what is valid, else what the legacy domain suggests, else the defaults."""
    given = valid_sector(sector)
    hint = F.coalesce(_look_up(LEGACY, F.lower(F.trim(legacy))), canonical_subdomain(legacy))
    sec = F.coalesce(given, F.lit(DEFAULT_SECTOR))
    sub = F.when(given.isNotNull(), valid_subdomain(given, subdomain)).when(legacy != "", hint)
    return F.struct(sec.alias("sector"), F.coalesce(sub, valid_subdomain(sec, subdomain), F.lit(DEFAULT_SUBDOMAIN)).alias("subdomain"))


def scope_from_list(applicability: Column) -> Column:
    """The first part of a list (split at , | ;) that names a subdomain of the default sector, else the default."""
    parts = F.filter(F.transform(F.split(applicability, r"[,|;]"), lambda p: F.trim(p)), lambda p: p != "")
    subs = F.filter(F.transform(parts, canonical_subdomain), lambda s: s.isin(SECTORS[DEFAULT_SECTOR]))
    return F.coalesce(F.get(subs, 0), F.lit(DEFAULT_SUBDOMAIN))
