import hashlib

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import html, keys, rules, text, url


def apply(spark, function, values, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["x"] for r in rows.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


CASES = [
    (text.norm_name, [
        (" Ｆoo  &  Bär!", "foo and bär"), ("ﬁne—print", "fine print"), (None, ""), ("...", ""),
    ]),
    (text.norm_space, [("  A \tB\n", "a b"), ("x﻿y", "x y"), ("a\x85b", "a\x85b")]),
    (text.norm_slug, [(" Ａ-b ", "a-b"), (None, "")]),
    (text.slugify, [("Tasks & Teams", "tasks-and-teams")]),
    (text.slug_text, [("--Ab  c!", "ab-c"), (None, ""), ("é", "")]),
    (text.text_or_null, [(" x ", " x "), ("  ", None), (None, None)]),
    (text.iso_ts_ok, [
        ("2026-01-02T03:04:05Z", True), ("2026-01-02T03:04:05.123+05:30", True),
        ("2026-01-02T03:04:05", False), ("2026-02-30T00:00:00Z", False), (None, False),
    ]),
    (url.safe_url, [
        ("https://a.example.com/x?y#z", True), ("https://a.example.com:8443/", True),
        ("https://a.example.com:99999/", False), ("http://a.example.com", False),
        ("https://localhost/", False), ("https://a.1/", False), ("https://u@a.example.com/", False),
        ("https://a.example.com/ x", False), ("https://-a.example.com/", False), (None, False),
        ("https://a.example.com/" + "x" * 2048, False), ("javascript:alert(1)", False),
    ]),
    (url.standard, [
        ("https://MÜNCHEN.de:8443/ä?ö#ü", "https://xn--mnchen-3ya.de:8443/%C3%A4?%C3%B6#%C3%BC"),
        ("http://a。b/x/../../y/.?q=/../", "http://a.b/y/?q=/../"), ("https://a.b/x/%2E%2e/z/..", "https://a.b/"),
        ("https://straße.de/.hidden/..x", "https://xn--strae-oqa.de/.hidden/..x"),
        ("https://ü@a.b/./", "https://ü@a.b/./"), ("https://a.b/?q=/./", "https://a.b/?q=/./"), ("ä", "ä"), (None, None),
    ]),
    (url.canon_http_url, [
        ("https://Bücher.example.com/a/./b/../c/", "https://xn--bcher-kva.example.com/a/c"),
        ("https://a.example.com/\u00a0x", None),
        ("HTTPS://A.Example.com:443//p//?b=1&a=2&b=0#f", "https://a.example.com//p?a=2&b=1&b=0"),
        ("https://a.example.com", "https://a.example.com/"),
        ("https://a.example.com/?q", "https://a.example.com/?q="),
        ("http://a.example.com", None),
    ]),
    (url.canon_https_url, [
        ("https://A.example.com/x/?q=1#f", "https://a.example.com/x"),
        ("https://münchen.de/x/../y", "https://xn--mnchen-3ya.de/y"),
        ("https://a.example.com:8443/", None), ("https://nodot/", None),
        ("https://u:p@a.example.com/", None),
    ]),
    (url.norm_domain, [
        ("https://www.A.example.com/x", "a.example.com"), ("a.example.com", "a.example.com"),
        ("http://a.example.com:80/", "a.example.com"), ("http://a.example.com:8080/", None),
        ("https://u@a.example.com", None), (" ", None), ("WWW.München.de", "xn--mnchen-3ya.de"),
        # Read as a bare host, this is the host "ftp" with an empty port.
        ("ftp://a.example.com", "ftp"),
    ]),
    (lambda c: url.norm_domain(c, "discovery"), [
        ("https://www.a.example.com:8443/x", "a.example.com"), ("a.example.com", "a.example.com"),
        ("http://a.example.com", None), ("münchen.de", "xn--mnchen-3ya.de"),
    ]),
    (url.public_url, [
        ("https://example.com", True), ("http://example.com", False),
        ("https://127.0.0.1/x", False), ("https://172.16.0.1/", False), ("https://172.32.0.1/", True),
        ("https://u:s@example.com/", False), ("https://x.local/", False), ("https://[::1]/", False),
    ]),
    (url.evidence_url_ok, [("https://a.b", True), ("https://a", False), ("https://a.b:80/x y", False)]),
    (url.outbound_url_ok, [
        ("https://a.example.com/x", True), ("https://a.example.com:80/x", False),
        ("https://a.example.com/x\\y", False),
    ]),
    (url.canon_url_text, [("HTTP://A.b/C/?D=/", "http://a.b/C/?D="), ("https://A.B", "https://a.b")]),
    (rules.semantic_label, [
        ("Company name *", "BUSINESS_NAME"), ("What does your business do?", "BUSINESS_DESCRIPTION"),
        ("Select a country", "COUNTRY"), ("I agree to the terms", "TERMS_ACCEPTANCE"),
        ("I hereby certify", "LEGAL_ATTESTATION"), ("Shoe size", None),
    ]),
    (rules.commission_label, [
        ("30% rev share", "Revenue Share"), ("CPA or CPC", None), ("20%", None),
        ("Cost per action", "CPA"),
    ]),
    (rules.category_group, [
        ("HR", "Run your business"), ("Sales teams", "Run your business"), ("SEO", "Grow your business"),
        ("Pottery", "Create & manage"),
    ]),
    (keys.stable_id, [("a-b", "PF-" + hashlib.sha256(b"a-b").hexdigest()[:24])]),
    (html.file_name, [
        ("https://a.b/c/d%20e+f.png?x=/y", "d e+f.png"), ("https://a.b", ""),
    ]),
]


@pytest.mark.parametrize("function, cases", CASES)
def test_function(spark, function, cases):
    assert apply(spark, function, [c[0] for c in cases]) == [c[1] for c in cases]


def test_fingerprint_of_hosts_outside_ascii(spark):
    rows = spark.createDataFrame([(["Bücher.example.com", None, "xn--bcher-kva.example.com", ""],)], "d array<string>")
    none = F.lit(None).cast("string")
    got = rows.select(keys.fingerprint(F.lit("net"), none, none, F.col("d"), none, none, none).alias("k")).first()["k"]
    assert tuple(got) == ("net|domain:xn--bcher-kva.example.com", "domain")


def test_provider_key(spark):
    rows = spark.createDataFrame(
        [(" Web", "Product", " a/B "), ("no key", "p", "x"), ("web", "p", " "), (None, "p", "x")],
        "a string, b string, c string",
    )
    got = rows.select(keys.provider_key(F.col("a"), F.col("b"), F.col("c")).alias("k")).collect()
    assert [r["k"] for r in got] == ['["web","product","a/B"]', None, None, None]


def test_attributes_keep_the_last_value(spark):
    tag = """<IMG Alt='Say "x" &amp; y' src=/a.png class="" SRC="/b.png">"""
    pairs = spark.createDataFrame([(tag,)], "t string").select(
        html.html_attrs(F.col("t")).alias("a")
    )
    row = pairs.select(
        *[html.attribute(F.col("a"), n).alias(n) for n in ("alt", "src", "class", "id")]
    ).collect()[0]
    assert tuple(row) == ('Say "x" & y', "/b.png", "", None)
