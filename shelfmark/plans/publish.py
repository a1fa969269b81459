"""READY candidates into the catalogue: records, dispositions, new table versions.

Rules compare a record with the catalogue only, never with another record's outcome. The
catalogue is reduced to one row per comparison key holding the least and greatest owner
under it; a rule "someone else owns this key" is then a comparison with those two.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import keys, text, url
from shelfmark.operators.checks import GuardFailed, conflicting, duplicate_keys, union_all
from shelfmark.operators.keyed import first_per_key
from shelfmark.operators.versions import insert_ignore, new_rows
from shelfmark.session import cut_lineage

READY = "READY"


def batch_digest(df: DataFrame) -> DataFrame:
    """One row with the digest of all rows, whatever their order and partitioning.

    Row digests are added up as four 64-bit numbers, so each task sends four sums. Not
    byte-equal to a digest over one serialised batch.
    """
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    wide = 2**64
    parts = [
        F.conv(F.substring(digest, 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)").alias(f"d{i}")
        for i in range(4)
    ]
    sums = df.select(*parts).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(f"d{i}").cast("decimal(38,0)")).alias(f"d{i}") for i in range(4)],
    )
    folded = [
        F.coalesce(F.pmod(f"d{i}", F.lit(str(wide)).cast("decimal(38,0)")), F.lit(0)).cast("string")
        for i in range(4)
    ]
    whole = F.sha2(F.concat_ws("-", F.col("n").cast("string"), *folded), 256)
    return sums.select(
        F.concat(F.lit("product_factory_"), F.substring(whole, 1, 16)).alias("batch_id"),
        whole.alias("batch_digest"),
    )


def _one_per_category(categories: Column) -> Column:
    """Categories by id, each once with its last slug; primary if any mention was."""
    ids = F.array_sort(F.array_distinct(F.transform(categories, lambda c: c["category_id"])))

    def merged(i: Column) -> Column:
        mentions = F.filter(categories, lambda c: c["category_id"] == i)
        return F.struct(
            i.alias("category_id"),
            F.element_at(mentions, -1)["slug"].alias("slug"),
            F.exists(mentions, lambda c: c["primary_category"]).alias("primary_category"),
        )

    return F.transform(ids, merged)


def _expect(df: DataFrame, message: str) -> None:
    """Raise if ``df`` holds any row."""
    if df.limit(1).count():
        raise GuardFailed(message)


def prepare_publication(results: DataFrame, counters: dict[str, int] | None = None) -> DataFrame:
    """Publication records of the READY results of a batch.

    Raises for counters that do not add up, malformed results, payloads outside the
    publication contract, and identities that repeat or contradict each other.
    """
    payload, ready = F.col("payload"), F.col("decision") == READY
    primaries = F.size(F.filter("categories", lambda c: c["primary_category"]))
    tally = results.agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(ready).alias("ready"),
        F.count_if(~ready).alias("exceptions"),
        F.count_if(~ready & (payload.isNotNull() | (F.size("reasons") == 0))).alias("bad_exceptions"),
        F.count_if(ready & (payload.isNull() | (F.size("reasons") > 0))).alias("bad_ready"),
        F.count_if(
            ready
            & (
                (payload["publication_status"] != "in_review")
                | (payload["verification_status"] != "needs_verification")
                | ~payload["outbound_destination"].eqNullSafe(payload["website_url"])
            )
        ).alias("bad_payload"),
        F.count_if(ready & (F.size(payload["provenance"]) <= 0)).alias("no_provenance"),
    ).collect()[0]
    if counters and any(tally[k] != v for k, v in counters.items() if k in ("processed", "ready", "exceptions")):
        raise GuardFailed("Result counters are inconsistent.")
    if tally["bad_exceptions"] or tally["bad_ready"]:
        raise GuardFailed("A result is malformed.")
    if tally["bad_payload"]:
        raise GuardFailed("A payload does not satisfy the controlled publication contract.")
    if tally["no_provenance"]:
        raise GuardFailed("Controlled publication requires first-party provenance.")
    if not tally["ready"]:
        raise GuardFailed("Publication batch has no READY products.")

    triple = F.from_json(payload["idempotency_key"], "array<string>")
    records = results.filter(ready).select(
        payload["idempotency_key"].alias("idempotency_key"),
        F.get(triple, 0).alias("provider_key"),
        F.get(triple, 1).alias("external_object_type"),
        F.get(triple, 2).alias("external_id"),
        keys.stable_id(payload["software_slug"]).alias("software_id"),
        payload["software_name"].alias("software_name"),
        payload["software_slug"].alias("software_slug"),
        payload["vendor_resolution"].alias("vendor_resolution"),
        payload["vendor_id"].alias("vendor_id"),
        payload["vendor_name"].alias("vendor_name"),
        text.norm_space(payload["vendor_name"]).alias("vendor_canonical_name"),
        payload["vendor_slug"].alias("vendor_slug"),
        payload["vendor_website_url"].alias("vendor_website_url"),
        payload["website_url"].alias("website_url"),
        payload["short_description"].alias("short_description"),
        payload["key_features"].alias("key_features"),
        payload["pricing"].alias("pricing"),
        _one_per_category(payload["categories"]).alias("categories"),
        F.array_sort(payload["provenance"]).alias("provenance"),
    ).withColumns(
        {
            "source_url": F.get("provenance", 0)["url"],
            "source_observed_at": F.array_max(F.transform("provenance", lambda p: p["retrieved_at"])),
        }
    )
    _expect(records.filter(primaries != 1), "Each record must have exactly one primary category.")
    identities = [
        duplicate_keys(records, ["provider_key", "external_object_type", "external_id"]),
        duplicate_keys(records, ["software_id"]),
        duplicate_keys(records.select(F.lower("software_slug").alias("slug")), ["slug"]),
        conflicting(
            records.withColumn("slug", F.lower("vendor_slug")), "slug", "vendor_canonical_name"
        ),
    ]
    for repeated in identities:
        _expect(repeated, "Publication batch contains duplicate or conflicting identities.")
    batch = batch_digest(records).collect()[0]
    return records.withColumns({k: F.lit(batch[k]) for k in ("batch_id", "batch_digest")})


def _site_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), "/+$", ""))


def _both(*parts: Column) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts])


def _catalogue_keys(catalogue: dict[str, DataFrame]) -> DataFrame:
    """(kind, key) with the least and greatest owner of everything a rule compares."""

    def keyed(df: DataFrame, kind: str, key: Column, owner: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), key.alias("key"), owner.alias("owner")).filter(
            F.col("key").isNotNull()
        )

    name, maker = text.norm_space(F.col("software_name")), text.norm_space(F.col("vendor"))
    software = catalogue["software"].select(
        "software_id",
        F.lower("slug").alias("s"),
        name.alias("n"),
        maker.alias("v"),
        _site_key(F.col("website_url")).alias("u"),
    )
    vendors = catalogue["vendors"].select(
        F.col("vendor_id").cast("string").alias("vendor_id"),
        F.lower("slug").alias("s"),
        text.norm_space(F.col("canonical_name")).alias("c"),
        text.norm_name(F.col("vendor_name")).alias("n"),
        F.when(
            F.col("website_url").rlike("(?i)^https?://"), url.domain_text(F.col("website_url"))
        ).alias("d"),
    )
    identities = catalogue["identities"].join(software, "software_id", "left")
    triple = _both(F.lower("provider_key"), F.col("external_object_type"), F.col("external_id"))
    claims = catalogue["claims"].filter("status = 'active'")
    reviewed = claims.filter("software_id is not null and verified_at is not null")
    official = claims.filter(
        "claim_type = 'domain' and claim_scope = 'official_vendor' and vendor_id is not null"
    ).join(vendors.select("vendor_id", "c"), "vendor_id")
    product = _both(F.col("n"), F.col("v"))
    frames = [
        keyed(identities, "identity", triple, _both(F.col("s"), F.col("v"))),
        keyed(software, "slug", F.col("s"), product),
        keyed(software, "id", F.col("software_id"), product),
        keyed(software, "product", product, product),
        keyed(software, "name", F.col("n"), F.col("v")),
        keyed(software, "site", F.col("u"), product),
        keyed(
            reviewed.filter("claim_type in ('slug', 'name')"),
            "claim",
            _both(F.col("claim_type"), F.col("normalized_value")),
            F.col("software_id"),
        ),
        keyed(vendors, "vendor", F.col("vendor_id"), F.col("n")),
        keyed(vendors, "vendor_slug", F.col("s"), F.col("c")),
        keyed(vendors, "vendor_site", F.col("d"), F.col("c")),
        keyed(official, "vendor_claim", F.col("normalized_value"), F.col("c")),
    ]
    return (
        union_all(frames)
        .groupBy("kind", "key")
        .agg(F.min(F.coalesce("owner", F.lit(""))).alias("first"),
             F.max(F.coalesce("owner", F.lit(""))).alias("last"))
    )


def dispose(records: DataFrame, catalogue: dict[str, DataFrame]) -> DataFrame:
    """Records with ``disposition`` and ``reason``: the first rule that applies decides.

    ``catalogue``: software (software_id, slug, software_name, vendor, website_url), vendors
    (vendor_id, vendor_name, canonical_name, slug, website_url), identities (provider_key,
    external_object_type, external_id, software_id), claims (software_id, vendor_id,
    claim_type, claim_scope, normalized_value, status, verified_at). Where several products
    match one rule, a record is already present only if all of them agree with it. Names
    are compared with reviewed claims in their trimmed form.
    """
    prepared = records.withColumns(
        {
            "_name": text.norm_space(F.col("software_name")),
            "_maker": text.norm_name(F.col("vendor_name")),
            "_claimed": text.norm_name(F.col("software_name")),
            "_site": url.domain_text(F.col("vendor_website_url")),
        }
    )
    mine = _both(F.col("_name"), F.col("vendor_canonical_name"))
    slug = F.lower("software_slug")
    asked = {
        "identity": ("identity", _both(F.lower("provider_key"), F.lower("external_object_type"), F.col("external_id"))),
        "slug": ("slug", slug),
        "id": ("id", F.col("software_id")),
        "product": ("product", mine),
        "name": ("name", F.col("_name")),
        "site": ("site", _site_key(F.col("website_url"))),
        "claim_slug": ("claim", _both(F.lit("slug"), slug)),
        "claim_name": ("claim", _both(F.lit("name"), F.col("_claimed"))),
        "vendor": ("vendor", F.col("vendor_id").cast("string")),
        "vendor_slug": ("vendor_slug", F.lower("vendor_slug")),
        "vendor_claim": ("vendor_claim", F.col("_site")),
        "vendor_site": ("vendor_site", F.col("_site")),
    }
    exploded = prepared.select(
        "software_id",
        F.inline(
            F.filter(
                F.array(
                    *[
                        F.struct(F.lit(a).alias("ask"), F.lit(k).alias("kind"), v.alias("key"))
                        for a, (k, v) in asked.items()
                    ]
                ),
                lambda x: x["key"].isNotNull(),
            )
        ),
    )
    found = (
        exploded.join(_catalogue_keys(catalogue), ["kind", "key"])
        .groupBy("software_id")
        .agg(
            *[
                F.max(F.when(F.col("ask") == a, F.struct("first", "last"))).alias(f"_at_{a}")
                for a in asked
            ]
        )
    )
    rows = prepared.join(found, "software_id", "left")

    def hit(a: str) -> Column:
        return F.col(f"_at_{a}").isNotNull()

    def only(a: str, owner: Column) -> Column:
        at = F.col(f"_at_{a}")
        return at.isNull() | ((at["first"] == owner) & (at["last"] == owner))

    canonical = F.col("vendor_canonical_name")
    created = F.col("vendor_resolution") == "create"
    same_product = _both(slug, canonical)
    present, conflict = "ALREADY_PRESENT", "EXCLUDED_SOFTWARE_CONFLICT"
    vendor_conflict = "EXCLUDED_VENDOR_CONFLICT"
    # Dispositions and the sentences of the reason column, which must read as they do.
    # Each rule: condition, disposition, reason.
    table: list[tuple[Column, str, str]] = [
        (
            hit("identity") & only("identity", same_product), present,
            "Provider identity already resolves to this product.",
        ),
        (
            hit("identity"), "EXCLUDED_IDENTITY_CONFLICT",
            "Provider identity was previously processed or resolves to another canonical product.",
        ),
        (
            (hit("slug") | hit("id")) & only("slug", mine) & only("id", mine), present,
            "Canonical software slug already exists for this product.",
        ),
        (
            hit("slug") | hit("id"), conflict,
            "Canonical software slug or generated software ID belongs to another product.",
        ),
        (hit("product"), present, "Exact normalized product name and vendor already exist."),
        (
            ~only("name", canonical), "EXCLUDED_AMBIGUOUS_IDENTITY",
            "Exact normalized product name exists under another vendor.",
        ),
        (
            hit("site"), conflict,
            "Exact official product URL already belongs to another product.",
        ),
        (
            hit("claim_slug") | hit("claim_name"), "EXCLUDED_IDENTITY_CONFLICT",
            "A reviewed canonical name or slug claim already resolves this identity.",
        ),
        (
            ~created & ~(hit("vendor") & only("vendor", F.col("_maker"))), vendor_conflict,
            "Previously resolved canonical vendor is missing or no longer matches.",
        ),
        (
            created & ~only("vendor_slug", canonical), vendor_conflict,
            "Vendor slug belongs to a differently named canonical vendor.",
        ),
        (
            created & ~only("vendor_claim", canonical), vendor_conflict,
            "Official vendor domain belongs to another canonical vendor.",
        ),
        (
            created & ~only("vendor_site", canonical), vendor_conflict,
            "Existing vendor website domain belongs to another canonical vendor.",
        ),
    ]

    def chain(position: int, otherwise: Column) -> Column:
        cases = [(r[0], F.lit(r[position])) for r in table]
        first = F.when(*cases[0])
        return reduce(lambda acc, c: acc.when(*c), cases[1:], first).otherwise(otherwise)

    return rows.select(
        *records.columns,
        chain(1, F.lit(READY)).alias("disposition"),
        chain(2, F.lit(None).cast("string")).alias("reason"),
    )


def conflicting_vendor_slugs(decisions: DataFrame) -> DataFrame:
    """READY vendors that the batch proposes under two slugs: the whole batch then fails."""
    ready = decisions.filter(F.col("disposition") == READY)
    return conflicting(
        ready.withColumn("slug", F.lower("vendor_slug")), "vendor_canonical_name", "slug"
    )


def merge_publication(
    decisions: DataFrame, catalogue: dict[str, DataFrame], at: Column
) -> dict[str, DataFrame]:
    """The next version of every catalogue table, and the report.

    Adds vendors, products, category relations, claims, providers and identities of the
    READY records. Vendors, claims and providers that exist are not added again. Products and
    identities must be new and a READY record must resolve to one vendor, else the whole batch
    fails: records are to be disposed against the catalogue they are merged into. Besides the
    tables ``dispose`` needs, ``catalogue`` has relations (software_id, category_id,
    primary_category) and providers (provider_key). ``verify_merge`` checks the outcome.
    """
    _expect(
        conflicting_vendor_slugs(decisions),
        "Batch proposes conflicting slugs for one canonical vendor",
    )
    ready = decisions.filter(F.col("disposition") == READY)
    vendors = catalogue["vendors"]
    canonical = text.norm_space(F.col("canonical_name"))
    proposed = ready.filter("vendor_resolution = 'create'").select(
        F.col("vendor_canonical_name").alias("canonical_name"),
        "vendor_name",
        F.col("vendor_slug").alias("slug"),
        F.col("vendor_website_url").alias("website_url"),
        "software_slug",
        "source_url",
    )
    chosen = first_per_key(proposed, ["canonical_name"], ["software_slug"])
    held = vendors.select(canonical.alias("canonical_name"))
    new_vendors = chosen.join(held, "canonical_name", "left_anti").withColumn(
        "vendor_id", keys.hashed_id("V-", F.col("canonical_name"))
    )
    all_vendors = vendors.unionByName(
        new_vendors.select(*[c for c in vendors.columns if c in new_vendors.columns]),
        allowMissingColumns=True,
    )
    # A created vendor is found by name, a resolved one by id: two joins on equality.
    by_name = all_vendors.groupBy(canonical.alias("vendor_canonical_name")).agg(
        F.min(F.col("vendor_id").cast("string")).alias("_vendor")
    )
    by_id = all_vendors.select(
        F.col("vendor_id").cast("string").alias("vendor_id"),
        F.col("vendor_id").cast("string").alias("_vendor"),
    )
    placed = (
        ready.filter("vendor_resolution = 'create'")
        .join(by_name, "vendor_canonical_name")
        .unionByName(ready.filter("vendor_resolution <> 'create'").join(by_id, "vendor_id"))
        .withColumn("vendor_id", F.col("_vendor"))
        .drop("_vendor")
    )
    placed = cut_lineage(placed)  # four tables and a guard are made of it
    held_ids = catalogue["software"].select(F.col("software_id").cast("string").alias("software_id"))
    _expect(ready.join(held_ids, "software_id", "left_semi"), "a READY product is in the catalogue already")
    object_key = ["provider_key", "external_object_type", "external_id"]
    named = ready.select(F.lower("provider_key").alias("provider_key"), F.lower("external_object_type").alias("external_object_type"), "external_id")
    _expect(named.join(catalogue["identities"], object_key, "left_semi"), "a READY identity is in the catalogue already")
    times = ready.select("software_id", F.lit(1).alias("_n")).unionAll(placed.select("software_id", F.lit(-1).alias("_n")))
    _expect(
        times.groupBy("software_id").agg(F.sum("_n").alias("_n"), F.count_if(F.col("_n") > 0).alias("_ready")).filter("_n <> 0 or _ready <> 1"),
        "a READY product does not resolve to one vendor, or is listed twice",
    )

    software = placed.select(
        "software_id",
        F.col("software_slug").alias("slug"),
        "software_name",
        F.col("vendor_name").alias("vendor"),
        "vendor_id",
        "website_url",
        "short_description",
        "key_features",
        "pricing",
        F.lit("Candidate").alias("status"),
        F.lit("published").alias("publication_status"),
        F.lit("needs_verification").alias("verification_status"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )
    relations = placed.select("software_id", F.inline("categories")).drop("slug")
    none = F.lit(None).cast("string")

    def claim(df, owner: str, kind: str, scope: str, shown: Column, normal: Column) -> DataFrame:
        return df.select(
            (F.col("software_id") if owner == "software" else none).alias("software_id"),
            (F.col("vendor_id") if owner == "vendor" else none).alias("vendor_id"),
            F.lit(kind).alias("claim_type"),
            F.lit(scope).alias("claim_scope"),
            shown.alias("display_value"),
            normal.alias("normalized_value"),
            "source_url",
        )

    name, slug = F.col("software_name"), F.col("software_slug")
    brought = placed.join(
        new_vendors.select(F.col("canonical_name").alias("vendor_canonical_name")),
        "vendor_canonical_name",
        "left_semi",
    )
    maker, maker_slug = F.col("vendor_name"), F.col("vendor_slug")
    site = F.col("vendor_website_url")
    claims = union_all(
        [
            claim(placed, "software", "name", "canonical", name, text.norm_name(name)),
            claim(placed, "software", "slug", "canonical", slug, F.lower(F.trim(slug))),
            claim(brought, "vendor", "name", "canonical", maker, text.norm_name(maker)),
            claim(brought, "vendor", "slug", "canonical", maker_slug, F.lower(F.trim(maker_slug))),
            claim(brought, "vendor", "domain", "official_vendor", site, url.domain_text(site)),
        ]
    )
    unique = ["_owner", "claim_type", "claim_scope", "normalized_value"]
    owner = F.coalesce(
        F.concat(F.lit("software:"), "software_id"), F.concat(F.lit("vendor:"), "vendor_id")
    )
    fresh = new_rows(
        catalogue["claims"].withColumn("_owner", owner),
        claims.filter(F.col("normalized_value").isNotNull()).withColumn("_owner", owner),
        unique,
        ["source_url", "display_value"],
    ).drop("_owner").withColumns(
        {"status": F.lit("active"), "verified_at": F.lit(None).cast("timestamp_ntz")}
    )
    providers = placed.select(F.lower("provider_key").alias("provider_key"))
    identities = placed.select(
        F.lower("provider_key").alias("provider_key"),
        F.lower("external_object_type").alias("external_object_type"),
        "external_id",
        F.col("software_name").alias("display_name"),
        text.norm_name(F.col("software_name")).alias("normalized_name"),
        F.lower("software_slug").alias("external_slug"),
        url.domain_text(F.col("website_url")).alias("normalized_domain"),
        "software_id",
        F.lit("auto_matched").alias("match_state"),
        F.lit("provider_id").alias("match_method"),
        F.lit(100).alias("confidence"),
        F.col("idempotency_key").alias("source_reference"),
        "source_observed_at",
        F.col("batch_digest").alias("payload_digest"),
    )
    added = {"software": software, "relations": relations, "claims": fresh, "identities": identities}
    versions = {
        name: catalogue[name].unionByName(
            rows.select(*[c for c in catalogue[name].columns if c in rows.columns]),
            allowMissingColumns=True,
        )
        for name, rows in added.items()
    }
    versions["vendors"] = all_vendors
    versions["providers"] = insert_ignore(
        catalogue["providers"].select("provider_key"), providers, ["provider_key"], ["provider_key"]
    )
    is_ready = F.col("disposition") == READY
    versions["report"] = decisions.select(
        F.col("software_name").alias("product"),
        F.when(is_ready, "PUBLISHED").otherwise(F.col("disposition")).alias("result"),
        "reason",
        F.when(is_ready, F.concat(F.lit("/software/"), "software_slug")).alias("public_route"),
    )
    versions["new_vendors"] = new_vendors
    return versions


def verify_merge(before: dict[str, DataFrame], after: dict[str, DataFrame], decisions: DataFrame) -> None:
    """Raise unless the new versions hold exactly what the decisions promise."""
    ready = decisions.filter(F.col("disposition") == READY)
    expected = ready.count()
    grown = {name: after[name].count() - before[name].count() for name in ("software", "vendors", "identities")}
    if grown["software"] != expected or grown["identities"] != expected:
        raise GuardFailed(f"expected {expected} new products and identities, found {grown}")
    if grown["vendors"] != after["new_vendors"].count():
        raise GuardFailed("vendor count postcondition failed")
    published = after["software"].filter("publication_status = 'published'")
    _expect(ready.join(published, "software_id", "left_anti"), "a READY product is not published")
    bound = after["identities"].select("software_id", "external_id")
    _expect(ready.join(bound, ["software_id", "external_id"], "left_anti"), "an identity is missing")
    wanted = ready.select("software_id", F.size("categories").alias("_wanted"))
    have = after["relations"].groupBy("software_id").agg(F.count(F.lit(1)).alias("_have"))
    _expect(
        wanted.join(have, "software_id", "left").filter("not (_wanted <=> _have)"),
        "Software category postcondition failed",
    )


# Commands on editorial state -------------------------------------------------------------

VERIFIABLE = ("needs_verification", "failed", "stale")


def apply_verification(commands: DataFrame, software: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ordered verify and return commands: a result per command, and the new states.

    ``commands``: command_id, software_id, at, kind ('verify' or 'return'), source_url, note and,
    if there is one, source_reference (at most 500 characters, for 'verify' only).
    ``software``: software_id, verification_status, verified_at. The state before a command
    depends on the valid command just before it and on the first verification of the
    product only, so products with very many commands need no fold over all of them.
    """
    from shelfmark.operators.keyed import previous_in_order

    product = F.nullif(F.trim("software_id"), F.lit(""))
    note = F.nullif(F.trim("note"), F.lit(""))
    base_ok = product.isNotNull() & (F.length(product) <= 200) & (F.length(F.coalesce(note, F.lit(""))) <= 2000)
    source = F.trim("source_url")
    cited = F.trim("source_reference") if "source_reference" in commands.columns else F.lit("")
    short = F.length(F.coalesce(cited, F.lit(""))) <= 500
    verify_ok = base_ok & short & url.evidence_url_ok(source) & (F.col("kind") == "verify")
    return_ok = base_ok & note.isNotNull() & (F.col("kind") == "return")
    judged = commands.select(
        "command_id",
        product.alias("software_id"),
        "at",
        "kind",
        source.alias("source_url"),
        note.alias("note"),
        F.coalesce(verify_ok | return_ok, F.lit(False)).alias("_valid"),
    )
    valid = judged.filter("_valid").join(
        software.select("software_id", F.col("verification_status").alias("_initial")), "software_id"
    )
    looked = previous_in_order(
        valid, ["software_id"], F.date_trunc("minute", F.col("at")), ["at", "command_id"], "kind", "_before"
    )
    first_verify = (
        valid.filter("kind = 'verify' and _initial in ('needs_verification', 'failed', 'stale')")
        .groupBy("software_id")
        .agg(F.min(F.struct("at", "command_id")).alias("_verified_first"))
    )
    initial, before = F.col("_initial"), F.col("_before")
    ever = initial.isin(*VERIFIABLE, "verified")
    was_verified = F.when(before.isNull(), initial == "verified").otherwise(before == "verify") & ever
    earlier = F.col("_verified_first") < F.struct("at", "command_id")
    state = F.coalesce(
        F.when(was_verified, "verified"),
        F.when(ever & before.isNotNull() & (F.coalesce(earlier, F.lit(False)) | (initial == "verified")),
               "needs_verification"),
        initial,
    )
    ran = looked.join(first_verify, "software_id", "left").withColumn("previous_status", state)
    succeeds = F.when(
        F.col("kind") == "verify", F.col("previous_status").isin(*VERIFIABLE)
    ).otherwise(F.col("previous_status") == "verified")
    settled = ran.select(
        "command_id",
        "previous_status",
        F.when(F.coalesce(succeeds, F.lit(False)), "success").otherwise("invalid_transition").alias("_ran"),
    )
    results = judged.join(settled, "command_id", "left").select(
        "command_id",
        "software_id",
        "at",
        "kind",
        "source_url",
        "note",
        F.when(~F.col("_valid"), "invalid_input")
        .otherwise(F.coalesce("_ran", F.lit("not_found")))
        .alias("result"),
        F.when(F.col("_ran") == "success", F.col("previous_status")).alias("previous_status"),
        F.when(
            F.col("_ran") == "success",
            F.when(F.col("kind") == "verify", "verified").otherwise("needs_verification"),
        ).alias("new_status"),
    )
    last = (
        results.filter("result = 'success'")
        .groupBy("software_id")
        .agg(
            F.max_by("new_status", F.struct("at", "command_id")).alias("_status"),
            F.max(F.when(F.col("kind") == "verify", F.col("at"))).alias("_verified_at"),
        )
    )
    changed = {
        "verification_status": F.coalesce("_status", "verification_status"),
        # Returning a product keeps the time it was last verified.
        "verified_at": F.coalesce("_verified_at", "verified_at"),
    }
    states = software.join(last, "software_id", "left").select(
        *[changed.get(c, F.col(c)).alias(c) for c in software.columns]
    )
    return results, states


def verification_events(results: DataFrame) -> DataFrame:
    """One event per successful command; details without nulls."""
    verify = F.col("kind") == "verify"
    return results.filter("result = 'success'").select(
        F.lit("software").alias("entity_type"),
        F.col("software_id").alias("entity_id"),
        F.lit("catalogue_information").alias("subject"),
        F.col("new_status").alias("result"),
        F.col("at").alias("verified_at"),
        F.when(verify, F.col("source_url")).alias("source_url"),
        F.to_json(
            F.struct(
                "previous_status",
                F.when(verify, F.col("note")).alias("notes"),
                F.when(~verify, F.col("note")).alias("reason"),
            )
        ).alias("details"),
    )


def apply_publication(commands: DataFrame, software: DataFrame) -> DataFrame:
    """Result of each publish ('published') or unpublish ('in_review') command, in order per product.

    ``commands``: command_id, software_id, at, target. ``software``: software_id, publication_status. A
    product must be in the opposite state. Whatever came of the command before, the product is then in the
    state that it asked for, so no fold over a product's commands is needed. Products in another
    state, or unknown, never move. Adds ``result`` and the ``publication_status`` after the command.
    """
    from shelfmark.operators.keyed import previous_in_order

    kinds = ("published", "in_review")
    joined = commands.join(
        software.select("software_id", F.col("publication_status").alias("_initial")), "software_id", "left"
    )
    able = F.coalesce(F.col("_initial").isin(*kinds) & F.col("target").isin(*kinds), F.lit(False))
    looked = previous_in_order(
        joined.filter(able), ["software_id"], F.date_trunc("minute", F.col("at")), ["at", "command_id"], "target", "_before"
    )
    moves = F.coalesce("_before", "_initial") != F.col("target")
    refused = F.lit("invalid_transition")
    ran = looked.select(
        *commands.columns,
        F.when(moves, "success").otherwise(refused).alias("result"),
        F.col("target").alias("publication_status"),
    )
    left = joined.filter(~able).select(
        *commands.columns, refused.alias("result"), F.col("_initial").alias("publication_status")
    )
    return ran.unionAll(left)
