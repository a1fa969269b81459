import json

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import programs
from shelfmark.sources import captures

SOURCE = {"kind": "export", "reference": "made-up-v1", "observedAt": "2026-09-08T00:00:00Z"}
ROWS = [
    {
        "programId": "p-board", "companyId": "c-board", "name": "boardly.com",
        "destinationUrl": "https://www.boardly.com/", "programUrl": "https://market.example.com/b",
        "commission": {
            "text": "20% revenue share", "model": "Revenue Share", "metadata": {"made_up": True}
        },
        "partnerTypes": ["Affiliate", "Publisher"], "supportsSubIds": True,
        "relationship": "Not applied",
    },
    {
        "programId": "p-mail", "name": "MailCampaign", "domains": ["mailcampaign.com"],
        "commission": {"model": "CPL"}, "supportsSubIds": False, "relationship": "Applied",
    },
    {"programId": "p-vault", "name": "9Vault", "commission": {"model": "CPA"},
     "relationship": "Approved"},
    {"programId": "p-desk", "name": "Deskfresh by Freshmakers", "commission": {"model": "CPC"}},
    {"programId": "p-serv", "name": "Servfresh by Freshmakers"},
    {"programId": "p-kit", "name": "Kit (formerly MakeKit)", "commission": {"text": "Up to 30%"}},
    {"companyId": "c-quo", "name": "Quo (formerly OpenRing)", "relationship": "Waitlisted"},
    {"programId": "p-new", "name": "Sample Future Charts", "partnerTypes": ["Publisher"]},
    {"programId": "p-fam", "name": "Freshmakers", "vendorName": "Freshmakers",
     "domains": ["freshmakers.com"]},
    {"programId": "p-conf", "name": "MailCampaign", "domains": ["boardly.com"]},
    {"programId": "p-dup", "name": "Sample Duplicate"},
    {"programId": "p-dup", "name": "Sample Duplicate", "commission": {"text": "Updated"}},
    {},
    {"name": "Malformed", "programId": {}, "destinationUrl": "javascript:alert(1)",
     "supportsSubIds": "yes"},
    None,
]
INVENTORY = [
    ("s-board", "boardly", "boardly.com", "boardly.com", "https://boardly.com"),
    ("s-mail", "mailcampaign", "MailCampaign", "MailCampaign", "https://mailcampaign.com"),
    ("s-vault", "9vault", "9Vault", "9Vault", "https://9vault.com"),
    ("s-desk", "deskfresh", "Deskfresh", "Freshmakers", "https://freshmakers.com"),
    ("s-serv", "servfresh", "Servfresh", "Freshmakers", "https://freshmakers.com"),
    ("s-kit", "kit", "Kit", None, "https://kit.com"),
    ("s-ring", "openring", "OpenRing", None, "https://openring.com"),
]


def envelope(rows, **extra):
    return json.dumps({"schemaVersion": 1, "source": SOURCE, "programs": rows} | extra)


def files(spark, *texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, value string")


def candidates(spark, rows):
    return programs.normalise_program(captures.parse_capture_json(files(spark, envelope(rows))))


@pytest.fixture(scope="module")
def inventory(spark):
    return spark.createDataFrame(
        INVENTORY, "id string, slug string, name string, vendor_name string, website_url string"
    )


@pytest.fixture(scope="module")
def reviewed(spark, inventory):
    return programs.review_partition(candidates(spark, ROWS), inventory).cache()


def by_index(df):
    return {r["input_index"]: r for r in df.collect()}


def test_golden_partition(reviewed):
    rows = by_index(reviewed)
    classes = {}
    for i, r in sorted(rows.items()):
        classes.setdefault(r["category"], []).append(i)
    assert classes["EXISTING_CATALOG_MATCH"] == [0, 1, 2, 3, 4, 5]
    assert classes["UNMATCHED_COMMERCIAL_OPPORTUNITY"] == [7]
    assert classes["AMBIGUOUS_REVIEW_REQUIRED"] == [6, 8, 9]
    assert classes["DUPLICATE_OR_INVALID"] == [10, 11, 12, 13, 14]
    slugs = [rows[i]["slug"] for i in range(6)]
    assert slugs == ["boardly", "mailcampaign", "9vault", "deskfresh", "servfresh", "kit"]
    assert all(rows[i]["software_id"] is None for i in (6, 8, 9))
    assert "Multiple software records matched." in rows[8]["evidence"]
    assert "Conflicting exact identity evidence." in rows[9]["evidence"]
    assert any("Former name" in e for e in rows[6]["evidence"])
    assert "2 copies, the first at 10. All copies held for review." in rows[11]["evidence"]


def test_partition_does_not_depend_on_row_order_or_partitions(spark, inventory, reviewed):
    shuffled = candidates(spark, ROWS).repartition(7).orderBy(F.rand(3))
    again = programs.review_partition(shuffled, inventory.repartition(5))
    assert by_index(again) == by_index(reviewed)


def test_normalised_fields(spark):
    rows = by_index(candidates(spark, ROWS))
    assert rows[0]["domains"] == ["boardly.com"]
    assert rows[0]["commission_model"] == "revenue_share"
    assert rows[0]["commission_terms"] == '{"made_up":true}'
    assert rows[0]["destination_url"] == "https://www.boardly.com/"
    assert rows[0]["source_reference"] == "made-up-v1"
    assert rows[3]["product_name"] == "Deskfresh" and rows[3]["vendor_name"] == "Freshmakers"
    assert rows[5]["former_name"] == "MakeKit" and rows[5]["commission_model"] == "unknown"
    assert [r["provider_relationship"] for _, r in sorted(rows.items())][:4] == [
        "available", "applied", "approved", "unknown",
    ]
    assert [i["field"] for i in rows[12]["issues"]] == ["name"]
    assert {i["field"] for i in rows[13]["issues"]} == {
        "programId", "destinationUrl", "supportsSubIds",
    }
    assert {i["field"] for i in rows[14]["issues"]} == {"record", "name"}
    assert rows[14]["source_reference"] == "made-up-v1"


def test_numbers_are_ids_and_own_source_wins(spark):
    rows = by_index(
        candidates(
            spark,
            [
                {"name": "A", "programId": 42, "source": {"reference": None, "kind": "api"}},
                {"name": "B", "programId": -1, "source": {"observedAt": "2026-13-01T00:00:00Z"}},
                {"name": "C", "programId": 1.5, "source": 3, "domains": ["a.com", 7, " "]},
            ],
        )
    )
    assert rows[0]["external_program_id"] == "42" and rows[0]["source_kind"] == "api"
    assert rows[0]["source_reference"] is None
    assert {i["field"] for i in rows[1]["issues"]} == {"programId", "source.observedAt"}
    assert [i["field"] for i in rows[2]["issues"]].count("domains") == 2
    assert {i["field"] for i in rows[2]["issues"]} == {"programId", "source", "domains"}


def test_bindings(spark, inventory):
    rows = [{"name": "X1", "programId": str(i)} for i in range(5)]
    bindings = spark.createDataFrame(
        [
            ("PartnerStack", "0", "s-kit", "KIT"),
            ("partnerstack", "1", "s-kit", None),
            ("partnerstack", "1", "s-ring", None),
            ("partnerstack", "2", "gone", None),
            ("partnerstack", "3", "s-kit", "openring"),
        ],
        "network string, external_program_id string, software_id string, software_slug string",
    )
    got = by_index(programs.match_program(candidates(spark, rows), inventory, bindings))
    assert [got[i]["decision"] for i in range(5)] == [
        "confirmed", "ambiguous", "ambiguous", "ambiguous", None,
    ]
    assert got[0]["software_id"] == "s-kit" and got[0]["confidence"] == 100
    assert got[1]["confidence"] == 0


def test_explicit_product_conflict_is_held(spark, inventory):
    rows = [{"name": "boardly.com", "productName": "MailCampaign"}]
    got = by_index(programs.review_partition(candidates(spark, rows), inventory))
    assert got[0]["category"] == "AMBIGUOUS_REVIEW_REQUIRED"


@pytest.mark.parametrize("bad", ['{"programs": []}', '{"schemaVersion": 1}', "[]"])
def test_unusable_envelope_fails(spark, bad):
    with pytest.raises(Exception, match="schemaVersion"):
        captures.parse_capture_json(files(spark, bad)).collect()


CARD = "[image](https://company-images.partnerstack.com/{n}.png)\n"
MARKDOWN = (
    "Programs not applied to yet\n\n1\n\n**All programs**3 programs\n\n"
    + CARD.format(n=1) + "**Alpha**\nFirst line\n|\nsecond line\n**20% revenue share**\n"
    + CARD.format(n=2) + "**Beta**\nNo commission here\nsvgApplication pending\n"
    + CARD.format(n=3) + "**Gamma**\nText\n**CPA or CPC**\nsvgJoined\n"
)


def test_markdown_capture(spark):
    got = by_index(
        programs.normalise_program(captures.parse_capture_text(files(spark, MARKDOWN)))
    )
    assert [got[i]["program_name"] for i in range(3)] == ["Alpha", "Beta", "Gamma"]
    assert [got[i]["provider_relationship"] for i in range(3)] == ["available", "applied", "approved"]
    assert got[0]["description"] == "First line second line"
    assert got[1]["description"] == "No commission here"
    assert [got[i]["commission_model"] for i in range(3)] == ["revenue_share", "unknown", "unknown"]


def test_markdown_count_must_agree(spark):
    bad = MARKDOWN.replace("3 programs", "4 programs")
    with pytest.raises(Exception, match="declares"):
        captures.parse_capture_text(files(spark, bad)).collect()


def test_inventory(spark, tmp_path):
    def write(rows):
        path = tmp_path / f"{abs(hash(str(rows)))}.json"
        path.write_text(json.dumps(rows))
        return captures.read_inventory(spark, str(path))

    good = [{"id": " a ", "slug": "A", "name": "A", "websiteUrl": "https://a.com"}]
    assert write(good).collect()[0]["id"] == "a"
    for bad in (
        [{}],
        [{"id": "a", "slug": "a", "name": "a", "websiteUrl": "javascript:bad"}],
        [{"id": "a", "slug": "a", "name": 3}],
        good + [{"id": "b", "slug": "a", "name": "B"}],
    ):
        with pytest.raises(Exception):
            write(bad).collect()


def test_programs_of_one_row_group_are_many_tasks_work(spark, tmp_path):
    from shelfmark.registry import programs as queries

    part = spark.range(20_000).select(
        F.col("id").alias("p_partkey"), F.lit("green lace").alias("p_name"), F.lit("Brand#11").alias("p_brand"),
        F.lit("STANDARD").alias("p_type"), F.lit(20).alias("p_size"),
    )
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for rows in (queries._raw(spark, str(tmp_path)), queries.inventory(spark, str(tmp_path))):
        busy = rows.select(F.spark_partition_id().alias("p")).distinct().count()
        assert busy == int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
