"""Stable keys, digests and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfmark.functions import text, url


def provider_key(provider: Column, object_type: Column, external_id: Column) -> Column:
    """JSON triple naming a provider's object; null when any part is unusable.

    Provider and type are normalised, the id keeps its case.
    """
    shape = "^[a-z0-9][a-z0-9_-]*$"
    left, middle, right = text.norm_slug(provider), text.norm_slug(object_type), text.strip(external_id)
    usable = left.rlike(shape) & middle.rlike(shape) & (right != "")
    return F.when(usable, F.to_json(F.array(left, middle, right)))


def stable_id(slug: Column) -> Column:
    """Product id derived from the slug alone, so reruns agree."""
    return F.concat(F.lit("PF-"), F.substring(F.sha2(slug, 256), 1, 24))


def hashed_id(prefix: str, *parts: Column) -> Column:
    """Id of a natural key, in place of a random one."""
    joined = F.concat_ws("\x1f", *parts)
    return F.concat(F.lit(prefix), F.substring(F.sha2(joined, 256), 1, 24))


def legacy_source_key(identifier: Column) -> Column:
    return F.concat(F.lit("affiliate_program:"), text.hex_text(identifier))


def fingerprint(
    network: Column,
    external_program_id: Column,
    program_url: Column,
    domains: Column,
    product_name: Column,
    program_name: Column,
    vendor_name: Column,
) -> Column:
    """Struct ``(value, basis)`` naming a marketplace program.

    The first usable basis decides: external id, program URL, sorted domains, names.
    Null without a network or without any basis.
    """
    net = text.norm_name(network)
    external = F.coalesce(text.strip(external_program_id), F.lit(""))
    site = url.canon_http_url(program_url)
    listed = url.standard_all(
        F.transform(F.coalesce(domains, F.array().cast("array<string>")), url.with_https)
    )
    hosts = F.array_sort(
        F.array_distinct(
            F.filter(
                F.transform(listed, lambda d: url.norm_domain(d, "discovery", plain=True)),
                lambda d: d.isNotNull(),
            )
        )
    )
    names = [text.norm_name(n) for n in (product_name, program_name, vendor_name)]
    labels = ("product-name", "program-name", "vendor-name")
    named = F.concat_ws("|", *[F.concat(F.lit(f"{k}:"), n) for k, n in zip(labels, names)])

    def tagged(basis: str, value: Column) -> Column:
        return F.struct(
            F.concat(net, F.lit(f"|{basis}:"), value).alias("value"),
            F.lit(basis).alias("basis"),
        )

    return F.when(
        net != "",
        F.when(external != "", tagged("external-program-id", external))
        .when(site.isNotNull(), tagged("program-url", site))
        .when(F.size(hosts) > 0, tagged("domain", F.array_join(hosts, ",")))
        .when(F.concat(*names) != "", tagged("names", named)),
    )
