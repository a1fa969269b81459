import json

import pytest

from shelfmark.functions import text
from shelfmark.plans import gate
from shelfmark.sources import captures

SITE = "https://pinewood.example/board"
TEXT = (
    "Pineboard is made by Pinewood Ltd. Arrange every task on a shared wall and hand over work "
    "without mail. Task planning keeps small teams in step. From 7 euro a month."
)
CONTEXT = {
    "software": [],
    "vendors": [],
    "categories": [
        {"id": "c-plan", "slug": "plan-tasks", "name": "Plan tasks"},
        {"id": "c-flow", "slug": "hand-over", "name": "Hand over"},
    ],
}


def cite(quote, site=SITE):
    return [{"sourceUrl": site, "quote": quote}]


def document(**changes):
    return {
        "url": SITE, "retrievedAt": "2026-09-09T12:00:00Z", "sourceType": "official_product",
        "httpStatus": 200, "content": TEXT,
    } | changes


def candidate(**changes):
    return {
        "source": {"providerKey": "web", "externalObjectType": "product", "externalId": "pine/board"},
        "productName": {"value": " Pineboard ", "citations": cite("Pineboard")},
        "vendorName": {"value": "Pinewood Ltd.", "citations": cite("pinewood  LTD.")},
        "officialUrl": SITE + "/?utm=1#x",
        "description": {
            "value": "Arrange every task on a shared wall and hand over work without mail.",
            "citations": cite("Arrange every task on a shared wall"),
        },
        "primaryCategory": {
            "slug": "Plan-Tasks", "confidence": 0.97, "citations": cite("Task planning keeps"),
        },
        "capabilities": [{"value": "Shared wall", "citations": cite("shared wall")}],
        "evidence": [document()],
    } | changes


def run(spark, candidates, identity=None, **context):
    batch = {"candidates": candidates, "context": CONTEXT | context}
    tables = captures.parse_batch(
        spark.createDataFrame([("f", json.dumps(batch))], "file string, value string")
    )
    results = gate.run_batch(
        tables["candidates"], tables["software"], tables["vendors"], tables["categories"], identity
    )
    return tables["candidates"], results


PRODUCT = {
    "id": "s1", "slug": "pineboard", "name": "Pineboard", "vendorId": "v1",
    "vendorName": "PINEWOOD Ltd", "officialUrl": SITE,
}
VENDOR = {"id": "v1", "slug": "pinewood", "name": "Pinewood  Ltd", "officialUrl": None}

# name -> (changes to the candidate, expected codes in order)
CASES = {
    "ready": ({}, []),
    "unsupported fact": (
        {"capabilities": [{"value": "x", "citations": cite("it thinks for itself")}]},
        ["UNSUPPORTED_FACT"],
    ),
    "short quote": (
        {"capabilities": [{"value": "x", "citations": cite("on")}]}, ["UNSUPPORTED_FACT"],
    ),
    "no citation then foreign source": (
        {
            "capabilities": [
                {"value": "x", "citations": []},
                {"value": "y", "citations": cite("shared wall", "https://blog.other.example/")},
            ]
        },
        ["INSUFFICIENT_PRODUCT_EVIDENCE", "CONFLICTING_EVIDENCE"],
    ),
    "plain http": (
        {"officialUrl": "http://pinewood.example/"},
        ["INVALID_OFFICIAL_URL", "NO_AUTHORITATIVE_SOURCE"],
    ),
    "no evidence": (
        {"evidence": [document(httpStatus=403), document(retrievedAt="2026-09-09")]},
        ["NO_AUTHORITATIVE_SOURCE"] + ["CONFLICTING_EVIDENCE"] * 5,
    ),
    "unknown category": (
        {"primaryCategory": {"slug": "plan-tasks", "confidence": 0.5, "citations": cite("Task planning")}},
        ["CATEGORY_UNRESOLVED"],
    ),
    "bad key": (
        {"source": {"providerKey": "not a key", "externalObjectType": "product", "externalId": "1"}},
        ["MISSING_REQUIRED_FIELD"],
    ),
    "bad slug": ({"requestedSlug": "Pine Board"}, ["MISSING_REQUIRED_FIELD"]),
    "nothing named": (
        {"productName": {"value": " ", "citations": cite("Pineboard")}},
        ["MISSING_REQUIRED_FIELD", "MISSING_REQUIRED_FIELD"],
    ),
    "short description": (
        {"description": {"value": "Arrange every task", "citations": cite("Arrange every task")}},
        ["UNSUPPORTED_FACT"],
    ),
    "no capability": ({"capabilities": []}, ["INSUFFICIENT_PRODUCT_EVIDENCE"]),
    "carried over": (
        {"acquisitionException": {"code": "NO_AUTHORITATIVE_SOURCE", "message": "HTTP 403"}},
        ["NO_AUTHORITATIVE_SOURCE"],
    ),
    "quote across documents of one page": (
        {
            "evidence": [
                document(content=TEXT.replace("Task planning keeps small", "Ｔask planning")),
                document(url=SITE + "/", content="keeps small"),
            ],
            "pricing": {"value": "7 euro", "citations": cite("a month. keeps small")},
        },
        ["UNSUPPORTED_FACT"],
    ),
    "subdomain evidence": (
        {
            "evidence": [document(), document(url="https://docs.pinewood.example/a")],
            "pricing": {"value": "7", "citations": cite("From 7 euro", "https://docs.pinewood.example/a#b")},
        },
        [],
    ),
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        candidate(**(changes if "source" in changes else changes | {
            "source": {"providerKey": "web", "externalObjectType": "product", "externalId": name}
        }))
        for name, (changes, _) in CASES.items()
    ]
    _, got = run(spark, rows)
    return dict(zip(CASES, sorted(got.collect(), key=lambda r: r["input_index"])))


@pytest.mark.parametrize("name", CASES)
def test_reasons(results, name):
    row = results[name]
    codes = [r["code"] for r in row["reasons"]]
    assert codes == CASES[name][1], row["reasons"]
    assert row["decision"] == ("READY" if not codes else "EXCEPTION")
    assert (row["payload"] is None) == bool(codes)


def test_ready_payload(results):
    row = results["ready"]
    payload = row["payload"]
    assert row["candidate"] == "Pineboard"
    assert payload["idempotency_key"] == '["web","product","ready"]'
    assert payload["vendor_resolution"] == "create" and payload["vendor_id"] is None
    assert payload["vendor_slug"] == "pinewood-ltd"
    assert payload["software_slug"] == "pineboard"
    assert payload["website_url"] == SITE and payload["outbound_destination"] == SITE
    assert payload["vendor_website_url"] == "https://pinewood.example"
    assert [c["category_id"] for c in payload["categories"]] == ["c-plan"]
    assert [p["url"] for p in payload["provenance"]] == [SITE]
    assert row["review"]["official_evidence"] == [SITE]


def codes(spark, candidates, **context):
    _, got = run(spark, candidates, **context)
    return [[r["code"] for r in row["reasons"]] for row in sorted(got.collect(), key=lambda r: r[0])]


def test_catalogue_conflicts(spark):
    other = PRODUCT | {"id": "s2", "slug": "other", "vendorName": "Someone else"}
    assert codes(spark, [candidate()], software=[PRODUCT]) == [["DUPLICATE_EXISTING_PRODUCT"]]
    assert codes(spark, [candidate(requestedSlug="fresh")], software=[PRODUCT, other]) == [
        ["DUPLICATE_EXISTING_PRODUCT", "AMBIGUOUS_IDENTITY"]
    ]
    assert codes(spark, [candidate()], vendors=[VENDOR]) == [[]]
    assert codes(spark, [candidate()], vendors=[VENDOR, VENDOR | {"id": "v2"}]) == [
        ["AMBIGUOUS_IDENTITY"]
    ]
    stranger = VENDOR | {"id": "v3", "slug": "pinewood-ltd", "name": "Oak"}
    assert codes(spark, [candidate()], vendors=[stranger]) == [["CONFLICTING_EVIDENCE"]]


def test_identity_evidence(spark):
    identity = {
        "entities": spark.createDataFrame(
            [("software", "s9", "v1")], "kind string, id string, vendor_id string"
        ),
        "claims": spark.createDataFrame(
            [("software", "s9", "domain", "product_specific", "pinewood.example", "active", "2026-01-01")],
            "target_kind string, target_id string, claim_type string, claim_scope string, "
            "normalized_value string, status string, verified_at string",
        ),
    }
    _, got = run(spark, [candidate()], identity)
    assert [tuple(r) for r in got.collect()[0]["reasons"]] == [
        ("DUPLICATE_EXISTING_PRODUCT", "Canonical identity evidence matched s9.")
    ]


def test_batch_counts_a_provider_object_once_and_is_stable(spark):
    rows, got = run(spark, [candidate(), candidate(), candidate(officialUrl="ftp://x")])
    first = sorted(got.collect(), key=lambda r: r["input_index"])
    assert [r["decision"] for r in first] == ["READY", "EXCEPTION", "EXCEPTION"]
    counters = gate.batch_counters(got).collect()[0].asDict()
    assert counters == {"processed": 3, "ready": 1, "exceptions": 2, "duplicates_detected": 2}
    _, again = run(spark, [candidate(), candidate(), candidate(officialUrl="ftp://x")])
    assert sorted(again.repartition(5).collect(), key=lambda r: r["input_index"]) == first


def test_batch_report(spark):
    from pyspark.sql import functions as F

    a = candidate(indiaRelevance=True)
    b = candidate(
        evidence=[document(url="https://b.example", httpStatus=403)],
        source={"providerKey": "web", "externalObjectType": "product", "externalId": "b"},
    )
    rows, got = run(spark, [a, b])
    before = spark.createDataFrame([("Plan-Tasks", 16)], "category string, published long")
    report = gate.category_report(rows, got, before).collect()
    assert [r.asDict() for r in report] == [
        {"category": "Plan-Tasks", "before": 16, "candidates": 2, "ready": 1, "projected": 17}
    ]
    figures = gate.batch_report(rows, got, 20, 16, 6).collect()[0].asDict()
    assert figures == {
        "india_relevant_candidates": 1, "evidence_documents": 2, "successful_evidence_documents": 1,
        "http_403": 1, "http_429": 0, "unique_evidence_urls": 2, "duplicate_descriptions": 1,
        "pre_existing_conflicts": 0, "identity_conflicts": 0, "india_relevant_ready": 1,
        "projected_published": 21, "published_before": 20, "uncategorised_before": 6,
    }
    derived = gate.batch_report(rows, got.filter(F.lit(True)), 20, 16).collect()[0]
    assert derived["uncategorised_before"] == 4


def test_texts_of_evidence_go_to_python_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(name)
    spark.conf.set(name, 10_000)
    try:
        run(spark, [candidate()])
        assert int(spark.conf.get(name)) <= 1000
    finally:
        spark.conf.set(name, held)


def test_catalogue_keys_of_plain_and_odd_names(spark):
    software = spark.createDataFrame(
        [
            ("1", " Ａcme-Tool", "Ａcme & Tool", "Vënd"), ("2", "acme-tool", "ACME and tool", "Vënd"),
            ("3", None, None, None), ("4", "Plain", "Plain  One", "Maker"), ("5", "ﬁne", "Plain One", None),
        ],
        "id string, slug string, name string, vendorName string",
    )
    vendors = spark.createDataFrame([("a", "Vënd", "VËND"), ("b", "maker", "Maker"), ("c", None, None)], "id string, slug string, name string")
    plain, odd = text.by_script(software, "slug", "name", "vendorName")
    assert sorted(r["id"] for r in plain.collect()) == ["3", "4"]
    assert sorted(r["id"] for r in odd.collect()) == ["1", "2", "5"]
    found = {(r["kind"], r["key"]): (r["n"], r["first"]["id"], r["last"]["id"], r["first_owner"], r["last_owner"]) for r in gate._catalogue_keys(software, vendors).collect()}
    assert found == {
        ("slug", "acme-tool"): (2, "1", "2", "vënd", "vënd"), ("slug", ""): (1, "3", "3", "", ""), ("slug", "plain"): (1, "4", "4", "maker", "maker"),
        ("slug", "fine"): (1, "5", "5", "", ""),
        ("name", "acme and tool"): (2, "1", "2", "vënd", "vënd"), ("name", ""): (1, "3", "3", "", ""), ("name", "plain one"): (2, "4", "5", "", "maker"),
        ("name+vendor", "acme and tool\x1fvënd"): (2, "1", "2", "vënd", "vënd"), ("name+vendor", "\x1f"): (1, "3", "3", "", ""),
        ("name+vendor", "plain one\x1fmaker"): (1, "4", "4", "maker", "maker"), ("name+vendor", "plain one\x1f"): (1, "5", "5", "", ""),
        ("vendor", "vënd"): (1, "a", "a", "vënd", "vënd"), ("vendor", "maker"): (1, "b", "b", "maker", "maker"), ("vendor", ""): (1, "c", "c", "", ""),
        ("vendor_slug", "vënd"): (1, "a", "a", "vënd", "vënd"), ("vendor_slug", "maker"): (1, "b", "b", "maker", "maker"), ("vendor_slug", ""): (1, "c", "c", "", ""),
    }
