from pyspark.sql import functions as F

from shelfmark.plans import gate
from shelfmark.registry import QUERIES, load_all


def test_report_holds_categories_and_the_figures_of_the_batch(spark):
    from test_gate import candidate, document, run

    b = candidate(
        evidence=[document(url="https://b.example", httpStatus=403)],
        source={"providerKey": "web", "externalObjectType": "product", "externalId": "b"},
    )
    rows, got = run(spark, [candidate(indiaRelevance=True), b])
    before = spark.createDataFrame([("Plan-Tasks", 16), ("Others", 1)], "category string, published long")
    (row,) = [r.asDict() for r in gate.whole_report(rows, got, before, 20).collect()]
    assert row == {
        "category": "Plan-Tasks", "before": 16, "candidates": 2, "ready": 1, "projected": 17,
        "india_relevant_candidates": 1, "evidence_documents": 2, "successful_evidence_documents": 1,
        "http_403": 1, "http_429": 0, "unique_evidence_urls": 2, "duplicate_descriptions": 1,
        "pre_existing_conflicts": 0, "identity_conflicts": 0, "india_relevant_ready": 1,
        "projected_published": 21, "published_before": 20, "uncategorised_before": 3,
    }
    given = gate.whole_report(rows, got, before.filter(F.lit(False)), 20, 6).collect()[0]
    assert given["uncategorised_before"] == 6 and given["before"] == 0


def test_query_reports_every_step(spark):
    load_all()
    found = QUERIES["batch_report"](spark, "/root/testdata/sf0.001")
    assert {"projected", "http_403", "unique_evidence_urls", "duplicate_descriptions", "uncategorised_before"} <= set(found.columns)
