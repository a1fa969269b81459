import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfmark.operators.checks import GuardFailed
from shelfmark.plans import publish
from test_gate import candidate, run

RECORD = (
    "idempotency_key string, provider_key string, external_object_type string, external_id string, "
    "software_id string, software_name string, software_slug string, vendor_resolution string, "
    "vendor_id string, vendor_name string, vendor_canonical_name string, vendor_slug string, "
    "vendor_website_url string, website_url string, short_description string, key_features string, "
    "pricing string, categories array<struct<category_id: string, slug: string, "
    "primary_category: boolean>>, provenance array<struct<url: string, retrieved_at: string, "
    "source_type: string>>, source_url string, source_observed_at string, batch_id string, "
    "batch_digest string"
)


def record(name, **changes):
    slug = name.lower().replace(" ", "-")
    base = {
        "idempotency_key": f'["web","product","{slug}"]', "provider_key": "Web",
        "external_object_type": "Product", "external_id": slug, "software_id": f"PF-{slug}",
        "software_name": name, "software_slug": slug, "vendor_resolution": "create",
        "vendor_id": None, "vendor_name": f"{name} Inc", "vendor_canonical_name": f"{name} inc".lower(),
        "vendor_slug": f"{slug}-inc", "vendor_website_url": f"https://{slug}.example",
        "website_url": f"https://{slug}.example/app", "short_description": "d", "key_features": "k",
        "pricing": None, "categories": [("c1", "c-1", True), ("c2", "c-2", False)],
        "provenance": [(f"https://{slug}.example", "2026-01-01T00:00:00Z", "official_product")],
        "source_url": f"https://{slug}.example", "source_observed_at": "2026-01-01T00:00:00Z",
        "batch_id": "b", "batch_digest": "x",
    }
    return tuple((base | changes).values())


def catalogue(spark):
    return {
        "software": spark.createDataFrame(
            [
                ("S1", "known", "Known", "Known Inc", "v1", "https://known.example/", "published"),
                ("S2", "taken", "Someone", "Else", None, "https://TAKEN.example/app", "published"),
                ("S3", "twin-other", "Twin", "Other Maker", None, "https://t.example", "in_review"),
                ("S4", "kept-slug", "Same  Name", "same NAME inc", None, None, "in_review"),
            ],
            "software_id string, slug string, software_name string, vendor string, vendor_id string, "
            "website_url string, publication_status string",
        ),
        "vendors": spark.createDataFrame(
            [
                ("v1", "Known Inc.", "known inc", "known-inc", "https://known.example"),
                ("v2", "Slug Owner", "slug owner", "borrowed-slug", None),
                ("v3", "Site Owner", "site owner", "site-owner", "https://www.owned.example/x"),
                ("v4", "Claimer", "claimer", "claimer", None),
            ],
            "vendor_id string, vendor_name string, canonical_name string, slug string, website_url string",
        ),
        "identities": spark.createDataFrame(
            [("web", "product", "idone", "S1"), ("web", "product", "idtwo", "S1"),
             ("web", "product", "idnull", None)],
            "provider_key string, external_object_type string, external_id string, software_id string",
        ),
        "claims": spark.createDataFrame(
            [
                ("S1", None, "name", "canonical", "claimed name", "active", dt.datetime(2026, 1, 1)),
                ("S1", None, "slug", "canonical", "claimedslug", "active", dt.datetime(2026, 1, 1)),
                ("S1", None, "slug", "canonical", "unreviewed", "active", None),
                (None, "v4", "domain", "official_vendor", "claimed.example", "active", None),
            ],
            "software_id string, vendor_id string, claim_type string, claim_scope string, "
            "normalized_value string, status string, verified_at timestamp_ntz",
        ),
        "relations": spark.createDataFrame(
            [("S1", "c1", True)], "software_id string, category_id string, primary_category boolean"
        ),
        "providers": spark.createDataFrame([("other",)], "provider_key string"),
    }


CASES = {
    "Fresh One": ({}, "READY"),
    "Known": ({"external_id": "idone", "vendor_canonical_name": "known inc"}, "ALREADY_PRESENT"),
    "Stolen Id": ({"external_id": "idtwo"}, "EXCLUDED_IDENTITY_CONFLICT"),
    "Gone Id": ({"external_id": "idnull"}, "EXCLUDED_IDENTITY_CONFLICT"),
    "Taken": ({}, "EXCLUDED_SOFTWARE_CONFLICT"),
    "By Id": ({"software_id": "S2"}, "EXCLUDED_SOFTWARE_CONFLICT"),
    "Same Name": ({"software_slug": "another"}, "ALREADY_PRESENT"),
    "same  NAME ": (
        {"software_slug": "kept-slug", "vendor_canonical_name": "same name inc"}, "ALREADY_PRESENT",
    ),
    "Twin": ({}, "EXCLUDED_AMBIGUOUS_IDENTITY"),
    "Url Clash": ({"website_url": "https://taken.example/app//"}, "EXCLUDED_SOFTWARE_CONFLICT"),
    "Claimed & Name!": ({"software_slug": "x1"}, "READY"),
    "Claimed Name!": ({"software_slug": "x2"}, "EXCLUDED_IDENTITY_CONFLICT"),
    "ClaimedSlug": ({}, "EXCLUDED_IDENTITY_CONFLICT"),
    "Unreviewed": ({}, "READY"),
    "Old Vendor": (
        {"vendor_resolution": "existing", "vendor_id": "v1", "vendor_name": "KNOWN-inc"}, "READY",
    ),
    "Renamed Vendor": (
        {"vendor_resolution": "existing", "vendor_id": "v1"}, "EXCLUDED_VENDOR_CONFLICT",
    ),
    "Lost Vendor": (
        {"vendor_resolution": "existing", "vendor_id": "v9"}, "EXCLUDED_VENDOR_CONFLICT",
    ),
    "Slug Vendor": ({"vendor_slug": "Borrowed-Slug"}, "EXCLUDED_VENDOR_CONFLICT"),
    "Claim Vendor": (
        {"vendor_website_url": "https://www.claimed.example"}, "EXCLUDED_VENDOR_CONFLICT",
    ),
    "Site Vendor": ({"vendor_website_url": "https://owned.example"}, "EXCLUDED_VENDOR_CONFLICT"),
}


def records(spark):
    return spark.createDataFrame([record(n, **c) for n, (c, _) in CASES.items()], RECORD)


@pytest.fixture(scope="module")
def decided(spark):
    return publish.dispose(records(spark), catalogue(spark)).cache()


def test_dispositions(decided):
    got = {r["software_name"]: r["disposition"] for r in decided.collect()}
    assert got == {n: d for n, (_, d) in CASES.items()}


def test_merge_grows_tables_and_reruns_change_nothing(spark, decided):
    before = catalogue(spark)
    after = publish.merge_publication(decided, before, F.lit("2026-01-02"))
    publish.verify_merge(before, after, decided)
    ready = {n for n, (_, d) in CASES.items() if d == "READY"}
    report = {r["product"]: r["result"] for r in after["report"].collect()}
    assert {n for n, r in report.items() if r == "PUBLISHED"} == ready
    new = after["software"].filter("software_id like 'PF-%'").collect()
    assert {r["software_name"] for r in new} == ready
    assert {r["publication_status"] for r in new} == {"published"}
    owner = {r["software_name"]: r["vendor_id"] for r in new}
    assert owner["Old Vendor"] == "v1" and owner["Fresh One"].startswith("V-")
    assert sorted(r["provider_key"] for r in after["providers"].collect()) == ["other", "web"]
    again = publish.dispose(records(spark), after)
    assert again.filter("disposition = 'READY'").count() == 0
    with pytest.raises(GuardFailed, match="in the catalogue already"):
        publish.merge_publication(decided, after, F.lit("2026-01-03"))


def test_two_slugs_for_one_vendor_fail_the_batch(spark):
    rows = [
        record("A1", vendor_canonical_name="one", vendor_slug="one"),
        record("A2", vendor_canonical_name="one", vendor_slug="uno"),
    ]
    decided = publish.dispose(spark.createDataFrame(rows, RECORD), catalogue(spark))
    with pytest.raises(GuardFailed, match="conflicting slugs"):
        publish.merge_publication(decided, catalogue(spark), F.lit("x"))


def test_prepared_records(spark):
    _, results = run(spark, [candidate()])
    rows = publish.prepare_publication(results, {"processed": 1, "ready": 1, "exceptions": 0}).collect()
    assert rows[0]["software_id"].startswith("PF-") and len(rows[0]["software_id"]) == 27
    assert rows[0]["vendor_canonical_name"] == "pinewood ltd."
    assert rows[0]["batch_id"] == "product_factory_" + rows[0]["batch_digest"][:16]
    assert rows[0]["source_observed_at"] == "2026-09-09T12:00:00Z"
    with pytest.raises(GuardFailed, match="counters"):
        publish.prepare_publication(results, {"processed": 2})
    other = candidate(
        source={"providerKey": "web", "externalObjectType": "product", "externalId": "two"}
    )
    _, twice = run(spark, [candidate(), other])
    with pytest.raises(GuardFailed, match="duplicate or conflicting"):
        publish.prepare_publication(twice)


def test_digest_ignores_order_and_sees_copies(spark):
    df = spark.range(1000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"))
    one = publish.batch_digest(df).collect()
    assert publish.batch_digest(df.orderBy("h").repartition(7)).collect() == one
    assert publish.batch_digest(df.union(df.limit(1))).collect() != one


def fold(initial, commands):
    """The commands one by one, as written down."""
    state, out = initial, []
    for kind in commands:
        if kind == "verify":
            ok = state in ("needs_verification", "failed", "stale")
        else:
            ok = state == "verified"
        out.append((ok, state if ok else None))
        if ok:
            state = "verified" if kind == "verify" else "needs_verification"
    return state, out


def test_verification_commands_agree_with_a_fold(spark):
    rng = random.Random(5)
    states = ["needs_verification", "failed", "stale", "verified", "pending", None]
    software, commands, expected, finals = [], [], {}, {}
    start = dt.datetime(2026, 1, 1)
    for p in range(60):
        name, initial = f"p{p}", states[p % len(states)]
        software.append((name, initial, None))
        kinds = [rng.choice(["verify", "return"]) for _ in range(rng.randrange(8))]
        finals[name], outcome = fold(initial, kinds)
        for i, kind in enumerate(kinds):
            at = start + dt.timedelta(hours=rng.choice([i * 9, i * 40]) + i)
            commands.append([f"{name}-{i}", name, start + dt.timedelta(hours=i * 9), kind])
            expected[f"{name}-{i}"] = outcome[i]
    rows = [(c, p, t, k, "https://a.example.com/x", "because") for c, p, t, k in commands]
    rows += [
        ("bad-url", "p0", start, "verify", "http://a.example.com", None),
        ("no-reason", "p0", start, "return", None, "  "),
        ("unknown", "zz", start, "return", None, "why"),
    ]
    results, after = publish.apply_verification(
        spark.createDataFrame(
            rows, "command_id string, software_id string, at timestamp_ntz, kind string, "
            "source_url string, note string",
        ),
        spark.createDataFrame(
            software, "software_id string, verification_status string, verified_at timestamp_ntz"
        ),
    )
    got = {r["command_id"]: r for r in results.collect()}
    assert [got[c]["result"] for c in ("bad-url", "no-reason", "unknown")] == [
        "invalid_input", "invalid_input", "not_found",
    ]
    for c, (ok, previous) in expected.items():
        assert got[c]["result"] == ("success" if ok else "invalid_transition"), c
        assert got[c]["previous_status"] == previous, c
    assert {r["software_id"]: r["verification_status"] for r in after.collect()} == finals
    events = publish.verification_events(results).collect()
    assert len(events) == sum(ok for ok, _ in expected.values())


def test_publication_commands_run_in_order(spark):
    commands = spark.createDataFrame(
        [(1, "a", 1, "published"), (2, "a", 2, "in_review"), (3, "a", 3, "in_review"), (4, "b", 1, "published"), (5, "c", 1, "published"), (6, "a", 4, "other")],
        "command_id int, software_id string, minute int, target string",
    ).select("command_id", "software_id", F.timestamp_seconds(F.col("minute") * 60).alias("at"), "target")
    software = spark.createDataFrame([("a", "in_review"), ("b", "draft")], "software_id string, publication_status string")
    got = {r.command_id: (r.result, r.publication_status) for r in publish.apply_publication(commands, software).collect()}
    refused = "invalid_transition"
    assert got == {
        1: ("success", "published"), 2: ("success", "in_review"), 3: (refused, "in_review"),
        4: (refused, "draft"), 5: (refused, None), 6: (refused, "in_review"),
    }


def test_a_long_source_reference_is_refused(spark):
    commands = spark.createDataFrame(
        [(i, "a", "verify", "https://a.example.com/", None, "x" * n) for i, n in ((1, 501), (2, 500))],
        "command_id int, software_id string, kind string, source_url string, note string, source_reference string",
    ).withColumn("at", F.timestamp_seconds(F.col("command_id")))
    software = spark.createDataFrame([("a", "stale")], "software_id string, verification_status string").withColumn("verified_at", F.lit(None).cast("timestamp"))
    results, _ = publish.apply_verification(commands, software)
    assert {r.command_id: r.result for r in results.collect()} == {1: "invalid_input", 2: "success"}
