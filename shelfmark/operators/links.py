"""Affiliate links: eligibility, the best link of a product, and the link valid at an instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import text, url
from shelfmark.functions.keys import hashed_id, legacy_source_key
from shelfmark.functions.rules import valid_at
from shelfmark.operators.keyed import best_at, left_lookup
from shelfmark.operators.versions import new_rows, not_exists_or


def verified_link() -> Column:
    """Active and verified, whatever the time."""
    return (
        (F.col("status") == "active")
        & (F.col("verification_status") == "verified")
        & F.col("verified_at").isNotNull()
    )


def eligible_links(links: DataFrame, at: Column) -> DataFrame:
    """Basic rule: verified and valid at the instant."""
    return links.filter(verified_link() & valid_at(at, F.col("valid_from"), F.col("valid_until")))


def strictly_eligible_links(links: DataFrame, programs: DataFrame, at: Column) -> DataFrame:
    """Outbound rule: also an active, verified program and a destination fit for a redirect."""
    sound = programs.filter(
        (F.lower(F.trim("status")) == "active")
        & (F.col("verification_status") == "verified")
        & (F.col("verified_at") <= at)
    ).select(F.col("affiliate_id").alias("affiliate_program_id"), "software_id")
    fit = (F.col("verified_at") <= at) & url.outbound_url_ok(F.col("destination_url"))
    return eligible_links(links, at).filter(fit).join(
        sound, ["affiliate_program_id", "software_id"], "left_semi"
    )


def top_link(links: DataFrame) -> DataFrame:
    """Per product the link of highest priority, ties to the lowest id."""
    rest = [c for c in links.columns if c != "software_id"]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("priority"), F.col("affiliate_link_id")))
    return links.groupBy("software_id").agg(best.alias("_best")).select("software_id", "_best.*")


def resolve_link(
    software: DataFrame, links: DataFrame, programs: DataFrame, at: Column, strict: bool = True
) -> DataFrame:
    """Where a visitor of each published product is sent: its best link, else its own site.

    Products with neither are left out. ``strict=False`` applies the basic link rule.
    """
    eligible = strictly_eligible_links(links, programs, at) if strict else eligible_links(links, at)
    best = top_link(eligible).select("software_id", "affiliate_link_id", "destination_url")
    site = F.when(url.outbound_url_ok(F.col("website_url")), F.col("website_url"))
    return (
        software.filter(F.col("publication_status") == "published")
        .select("software_id", "website_url")
        .join(best, "software_id", "left")
        .select(
            "software_id",
            "affiliate_link_id",
            F.coalesce("destination_url", site).alias("outbound_url"),
        )
        .filter(F.col("outbound_url").isNotNull())
    )


def link_at(
    points: DataFrame, point_id: Sequence[str], links: DataFrame, unit: str = "microsecond", outer: bool = False
) -> DataFrame:
    """The best verified link of ``points.software_id`` valid at ``points.at``; with ``outer`` all points."""
    return best_at(
        points,
        ["software_id"],
        "at",
        point_id,
        links.filter(verified_link()),
        ["software_id"],
        "valid_from",
        "valid_until",
        [-F.col("priority"), F.col("affiliate_link_id")],
        ["affiliate_link_id"],
        unit,
        outer,
    )


def backfill_links(programs: DataFrame, existing: DataFrame) -> DataFrame:
    """New links for active programs with an http(s) URL that no existing link covers.

    A link is covered by its source key, or by product and canonical URL.
    """
    address = F.trim(F.coalesce("affiliate_url", F.lit("")))
    active = F.lower(F.coalesce(F.col("status").cast("string"), F.lit(""))) == "active"
    prepared = programs.filter(active & address.rlike("(?i)^https?://")).select(
        "software_id",
        "affiliate_program_id",
        F.trim("affiliate_url").alias("destination_url"),
        url.canon_url_text(F.col("affiliate_url")).alias("canonical_destination_url"),
        legacy_source_key(F.col("affiliate_program_id")).alias("legacy_source_key"),
        F.lit(100).alias("priority"),
        F.lit("active").alias("status"),
        F.lit("pending").alias("verification_status"),
    )
    fresh = not_exists_or(
        prepared, existing, ["legacy_source_key"], ["software_id", "canonical_destination_url"]
    )
    return new_rows(existing, fresh, ["legacy_source_key"], ["affiliate_program_id"])


def canonical_vendors(software: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vendors named in product text, one per canonical name, and products with their vendor id.

    The spelling of the product with the lowest id names the vendor.
    """
    named = software.filter(~text.is_blank(F.col("vendor"))).withColumn(
        "canonical_name", text.norm_space(F.col("vendor"))
    )
    vendors = (
        named.groupBy("canonical_name")
        .agg(F.min_by(text.squeeze(F.col("vendor")), "software_id").alias("vendor_name"))
        .withColumn("vendor_id", hashed_id("V-", F.col("canonical_name")))
        .withColumn(
            "slug",
            F.concat(
                F.coalesce(
                    F.nullif(text.slug_text(F.col("vendor_name")), F.lit("")), F.lit("vendor")
                ),
                F.lit("--"),
                F.lower(F.replace("vendor_id", F.lit("V-"), F.lit(""))),
            ),
        )
    )
    linked = left_lookup(
        software.withColumn("canonical_name", text.norm_space(F.col("vendor"))),
        vendors.select(F.col("canonical_name").alias("_key"), "vendor_id"),
        F.col("canonical_name"),
        "software_id",
    )
    return vendors, linked
