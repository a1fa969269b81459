"""Rule tables: ordered pattern lists turned into ``when`` chains."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import text

# Commission labels and the model each one names.
COMMISSION_MODELS = {
    "revenue share": "revenue_share",
    "revenue sharing": "revenue_share",
    "cpl": "cpl",
    "cost per lead": "cpl",
    "cpa": "cpa",
    "cost per acquisition": "cpa",
    "cost per action": "cpa",
    "cpc": "cpc",
    "cost per click": "cpc",
}

# Wording that names a commission model inside free text.
COMMISSION_WORDING = {
    "Revenue Share": r"\b(?:rev(?:enue)? share|revenue sharing)\b",
    "CPL": r"\b(?:cpl|cost per lead)\b",
    "CPA": r"\b(?:cpa|cost per (?:acquisition|action))\b",
    "CPC": r"\b(?:cpc|cost per click)\b",
}

# Relationship labels of the marketplace.
RELATIONSHIPS = {
    "available": "available",
    "not applied": "available",
    "applied": "applied",
    "pending": "applied",
    "application pending": "applied",
    "approved": "approved",
    "joined": "approved",
    "rejected": "rejected",
    "application declined": "rejected",
    "unknown": "unknown",
}

# Category wording in order of precedence, and the group it belongs to.
CATEGORY_GROUPS = [
    ("project|task|team|hr|human resource", "Run your business"),
    ("crm|sales|lead|customer", "Grow your business"),
    ("automat|workflow|integration", "Work smarter"),
    ("market|seo|content|social", "Grow your business"),
    ("account|financ|invoice|billing|payroll", "Run your business"),
    ("productiv|note|calendar|document", "Work smarter"),
    ("communicat|collaborat|meeting|chat|video confer", "Work smarter"),
    ("design|creat|image|video|website", "Create & manage"),
]
DEFAULT_GROUP = "Create & manage"

# Words that make a form label a legal one.
LEGAL_WORDS = (
    r"\b(agree|accept|terms|conditions|privacy|consent|certify|attest|authorize|authorise"
    r"|legally|represent and warrant|acknowledge)\b"
)
TERMS_WORDS = r"\b(terms|privacy|agreement|conditions)\b"

# Form labels in order of precedence, and the question each one asks.
SEMANTIC_LABELS = [
    ("BUSINESS_NAME", "^(business|company|organization|organisation) name$"),
    (
        "BUSINESS_DESCRIPTION",
        "^(describe your (business|company|organization|organisation)|business description)$"
        r"|^what does your (business|company|organization|organisation) do\??$",
    ),
    (
        "COUNTRY",
        r"^country$|^country\/region$|^country of residence$|^select (?:a )?country$",
    ),
    ("LOCATION", "^(business )?location$|^city and (state|country)$"),
    ("WEBSITE", "^(company |business )?website( url)?$|^website$|^your website$"),
    ("LINKEDIN_URL", "^(company |your )?linkedin( profile)?( url)?$"),
    ("PARTNER_TYPE", "^(partner|partnership) type$|^type of partner$"),
    ("PROMOTIONAL_MODEL", "^(business|promotional|promotion) model$"),
    ("PROMOTIONAL_METHODS", "^promotional methods?$|^promotion methods?$"),
    ("PROMOTIONAL_CHANNELS", "^promotional channels?$|^promotion channels?$"),
    (
        "PROMOTIONAL_PLAN",
        r"^how do you plan to promote(?: .+)?\??$|^describe your promotional plan$"
        "|^promotion plan$",
    ),
    (
        "PRIMARY_PROMOTIONAL_METHOD",
        r"^what is your primary promotional method\??$|^primary promotional method$"
        "|^primary promotion method$",
    ),
    ("INDUSTRIES", "^(business )?industr(y|ies)$|^industry focus$"),
    ("CUSTOMER_SEGMENTS", "^(target )?customer segments?$|^customer types?$"),
    ("BUSINESS_IDENTITY", "^business identity$|^legal business type$"),
    (
        "PREFERRED_COMMISSION_STRUCTURE",
        "^preferred commission structure$|^commission structure preference$",
    ),
    (
        "RESELLER_DISTRIBUTOR",
        r"^are you a reseller or distributor\??$|^reseller\/distributor status$",
    ),
    (
        "AGENCY_CLIENT_MANAGEMENT",
        r"^if you selected agency\/consultancy above, do you plan to maintain a relationship with "
        r"your clients by managing their .+ account or selling additional services\??$"
        r"|^do you manage client accounts\??$",
    ),
    (
        "LEGACY_AFFILIATE_EMAIL",
        "^if you were a member of our legacy affiliate program, please provide the email address "
        "associated with your .+ affiliate account$|^legacy affiliate (account )?email$",
    ),
    (
        "SUPPORT_RESOURCES",
        r"^how can we best support your promotional efforts\?.*$"
        r"|^what (support|resources) (?:would you like|do you need)\??$|^support resources$",
    ),
    ("AUDIENCE_DESCRIPTION", "^describe your audience$|^audience description$"),
    (
        "AUDIENCE_GEOGRAPHY",
        r"^audience (location|geography)$|^where is your audience located\??$",
    ),
    ("AUDIENCE_SIZE", r"^(estimated )?audience size$|^how large is your audience\??$"),
    ("TRAFFIC", "^(monthly )?(website )?traffic$|^monthly (visits|visitors)$"),
    ("REVENUE", "^(annual|monthly) revenue$|^revenue range$"),
]


def looked_up(c: Column, entries: dict[str, str], otherwise: str) -> Column:
    """Exact lookup in a small fixed table."""
    flat = [F.lit(x) for pair in entries.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*flat), c), F.lit(otherwise))


def first_rule(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Outcome of the first ``(outcome, pattern)`` found in ``c``; null when none is."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for outcome, pattern in rules:
        chain = chain.when(c.rlike(pattern), F.lit(outcome))
    return chain


def commission_model(model: Column, wording: Column) -> Column:
    """Model named by an explicit label; percentages and prose name none."""
    return looked_up(text.norm_name(F.coalesce(model, wording)), COMMISSION_MODELS, "unknown")


def commission_label(c: Column) -> Column:
    """The one model label worded in free text; null for none or several."""
    spoken = F.lower(c)
    labels = F.array(
        *[F.when(spoken.rlike(p), F.lit(label)) for label, p in COMMISSION_WORDING.items()]
    )
    said = F.filter(labels, lambda x: x.isNotNull())
    return F.when(F.size(said) == 1, F.try_element_at(said, F.lit(1)))


def relationship_state(c: Column) -> Column:
    return looked_up(text.norm_name(c), RELATIONSHIPS, "unknown")


FORMERLY = r"(?i)^(.+?)\s+\(formerly\s+(.+?)\)$"
BY_VENDOR = r"(?i)^(.+?)\s+by\s+(.+)$"


def split_display_name(c: Column) -> Column:
    """Struct ``(product, former_name, vendor)`` read from "X (formerly Y)" or "X by Y"."""
    renamed, family = c.rlike(FORMERLY), c.rlike(BY_VENDOR)
    product = (
        F.when(renamed, F.regexp_extract(c, FORMERLY, 1))
        .when(family, F.regexp_extract(c, BY_VENDOR, 1))
        .otherwise(c)
    )
    return F.struct(
        text.strip(product).alias("product"),
        F.when(renamed, text.strip(F.regexp_extract(c, FORMERLY, 2))).alias("former_name"),
        F.when(family, text.strip(F.regexp_extract(c, BY_VENDOR, 2))).alias("vendor"),
    )


def category_group(name: Column) -> Column:
    ordered = [(group, f"(?i){pattern}") for pattern, group in CATEGORY_GROUPS]
    return F.coalesce(first_rule(name, ordered), F.lit(DEFAULT_GROUP))


def legal_label(c: Column) -> Column:
    return F.coalesce(c.rlike(f"(?i){LEGAL_WORDS}"), F.lit(False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    Branches of a ``when`` chain would otherwise each compute it again.
    """
    return F.get(F.transform(F.array(value), use), 0)


def semantic_label(c: Column) -> Column:
    """Question a form label asks; legal wording is tried last."""
    plain = F.trim(
        F.regexp_replace(F.regexp_replace(F.lower(c), "[*:]+$", ""), f"{text.SPACE}+", " ")
    )
    legal = F.when(c.rlike(f"(?i){TERMS_WORDS}"), F.lit("TERMS_ACCEPTANCE")).otherwise(
        F.lit("LEGAL_ATTESTATION")
    )
    asked = once(plain, lambda label: first_rule(label, SEMANTIC_LABELS))
    return F.coalesce(asked, F.when(legal_label(c), legal))


# Legacy product and category states and the editorial state of each.
SOFTWARE_STATES = {"published": "published", "archived": "archived", "candidate": "in_review"}
CATEGORY_STATES = {"published": "published", "archived": "archived", "active": "in_review"}


def map_legacy_status(status: Column, kind: str = "software") -> Column:
    states = {"software": SOFTWARE_STATES, "category": CATEGORY_STATES}[kind]
    return looked_up(F.lower(F.coalesce(status.cast("string"), F.lit(""))), states, "draft")


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules a row breaks. A rule that evaluates to null is not broken."""
    marks = [F.when(~held, F.lit(name)) for name, held in rules.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def exactly_n_set(columns: list[Column], n: int) -> Column:
    """True when exactly ``n`` of the columns carry a value."""
    return count_set(columns) == n


def count_set(columns: list[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c.isNotNull().cast("int")
    return total


def valid_at(at: Column, valid_from: Column, valid_until: Column) -> Column:
    """Half-open window; an open end is a null."""
    return (valid_from.isNull() | (valid_from <= at)) & (valid_until.isNull() | (valid_until > at))
