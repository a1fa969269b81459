"""Tag and attribute extraction from raw HTML, all of it regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import text

# Entities that are decoded, ampersand first.
ENTITIES = [("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">")]

ATTRIBUTE = r"""([:\w-]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""

# Wording that rules an image out as a product's own mark.
REJECTED_WORDS = [
    "advert",
    "award",
    "badge",
    "banner",
    "certification",
    "client",
    "customer",
    "facebook",
    "featured",
    "hero",
    "instagram",
    "illustration",
    "open-graph",
    "open_graph",
    "og-image",
    "og_image",
    "ogimage",
    "ogthumb",
    "opengraph",
    "overlay",
    "partner",
    "pixel",
    "promo",
    "review",
    "screenshot",
    "salesforce",
    "seo",
    "social",
    "social-share",
    "testimonial",
    "tracking",
    "trustpilot",
    "youtube",
]

# Words too general to identify a product.
GENERIC_WORDS = [
    "app",
    "cloud",
    "company",
    "global",
    "inc",
    "india",
    "labs",
    "online",
    "platform",
    "software",
    "solutions",
    "technologies",
    "technology",
    "tool",
]


def decode_entities(c: Column) -> Column:
    for entity, character in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(character))
    return c


def tags(html: Column, name: str) -> Column:
    """All opening tags of one element, as written."""
    return F.regexp_extract_all(html, F.lit(rf"(?i)<{name}\b[^>]*>"), F.lit(0))


def html_attrs(tag: Column) -> Column:
    """Attributes of one tag as ``array<struct<key, value>>``, in the order written."""
    names = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(1))
    values = F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(2))

    def pair(name: Column, value: Column) -> Column:
        quoted = value.rlike("""^".*"$|^'.*'$""")
        bare = F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
        return F.struct(F.lower(name).alias("key"), decode_entities(bare).alias("value"))

    return F.zip_with(names, values, pair)


def attribute(attrs: Column, name: str) -> Column:
    """Value of one attribute, the last if it repeats; null if absent.

    ``attrs`` should be a stored column of ``html_attrs``.
    """
    return F.try_element_at(F.filter(attrs, lambda p: p["key"] == name), F.lit(-1))["value"]


def rejected_asset(c: Column) -> Column:
    return F.lower(c).rlike("|".join(REJECTED_WORDS))


def significant_words(c: Column) -> Column:
    return F.filter(
        F.split(F.lower(c), "[^a-z0-9]+"),
        lambda w: (F.length(w) >= 3) & ~w.isin(*GENERIC_WORDS),
    )


def names_identity(searchable: Column, identity: Column) -> Column:
    """The squashed identity (four characters or more) or its only significant word occurs."""
    squashed = text.squash(identity)
    words = significant_words(identity)
    whole = (F.length(squashed) >= 4) & F.contains(text.squash(searchable), squashed)
    single = (F.size(words) == 1) & F.contains(
        F.lower(searchable), F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("\x00"))
    )
    return F.coalesce(whole, F.lit(False)) | F.coalesce(single, F.lit(False))


def file_name(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]+([^?#]*)", 1)
    encoded = F.regexp_extract(path, "([^/]*)$", 1)
    return F.coalesce(F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B"))), encoded)


def identity_signal(url: Column, evidence: Column, identity: Column) -> Column:
    """Identity named by the file name or the evidence next to it."""
    return names_identity(F.concat_ws(" ", file_name(url), evidence), identity)
