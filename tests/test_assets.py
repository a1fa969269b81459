import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from shelfmark.operators import checks
from shelfmark.plans import assets
from shelfmark.sources import captures, sinks

PAGE = "https://handy.example/product"


def found(spark, html, name="Handy Tool", vendor="Example Maker"):
    pages = spark.createDataFrame(
        [("p", PAGE, html, name, vendor)],
        "product_id string, page_url string, html string, name string, vendor_name string",
    )
    rows = assets.page_assets(pages).orderBy(F.desc("score"), "url").collect()
    return [(r["url"], r["kind"], r["score"]) for r in rows]


def test_image_comes_before_icon(spark):
    got = found(
        spark,
        '<head><link rel="icon" sizes="192x192" href="/icon.png"><link rel=manifest href=m.json>'
        '<LINK REL="apple-touch-icon" href="/touch.png"></head>'
        '<img class="brand-logo" alt="Handy Tool logo" src="/handy-tool.png#x">'
        '<img class="site-logo" alt="Handy Tool" data-src="/mark.svg?a=1&amp;b=2">',
    )
    assert got == [
        ("https://handy.example/handy-tool.png", "logo_image", 94),
        ("https://handy.example/mark.svg?a=1&b=2", "logo_image", 86),
        ("https://handy.example/touch.png", "apple_touch_icon", 68),
        ("https://handy.example/icon.png", "favicon", 60),
    ]


@pytest.mark.parametrize(
    "html",
    [
        '<img alt="Team work" src="/images/feature.png"><img class="client-logo" src="/pnc.png">',
        '<img class="usecase-image" src="/laptop.png" alt="Laptop with an image of Handy Tool logo">',
        '<img class="logo" alt="Handy Tool" src="/handy-tool-award-logo.png">',
        '<img class="site-logo" alt="Handy Tool" src="data:image/png;base64,x">',
        '<meta property="og:logo" content="http://handy.example/plain.png">',
        '<script type="application/ld+json">{"@type": "Person", "logo": "/p.png"}</script>',
        '<script type="application/ld+json">{broken</script>',
    ],
)
def test_nothing_safe_to_take(spark, html):
    assert found(spark, html) == []


def test_structured_data(spark):
    got = found(
        spark,
        """<script type="application/ld+json">[{"@graph": [
        {"@type": ["Organization"], "name": "Handy Tool", "logo": {"url": "/handy-mark.png"}},
        {"@type": "Person", "name": "x", "logo": "/person.png"}]}]</script>
        <meta itemprop="logo" content="/handy-mark.png"><meta name="x" content="/y.png">""",
    )
    assert got == [("https://handy.example/handy-mark.png", "structured_logo", 100)]


def test_manifest_icons(spark):
    rows = spark.createDataFrame(
        [
            ("p", "https://handy.example/a/m.json",
             '{"icons": [{"src": "i.png", "sizes": "384x384"}, {"src": "/j.png"}, {"sizes": "1x1"}, 3]}'),
            ("q", "https://handy.example/b.json", '{"icons": "none"}'),
            ("r", "https://handy.example/c.json", "broken"),
        ],
        "product_id string, manifest_url string, json string",
    )
    got = assets.manifest_icons(rows).orderBy(F.desc("score")).collect()
    assert [(r["url"], r["score"]) for r in got] == [
        ("https://handy.example/a/i.png", 76), ("https://handy.example/j.png", 64),
    ]


CLASSES = [
    # url, evidence, kind, name, slug, website, vendor site, expected
    ("https://cdn.example/handy-tool.png", "", "logo_image", "Handy Tool", "handy-tool",
     "https://maker.example/h", "https://maker.example", "product"),
    ("https://cdn.example/maker-logo.png", "brand logo", "logo_image", "Handy Tool", "handy-tool",
     "https://maker.example/h", "https://maker.example", None),
    ("https://cdn.example/handy-tool/_next/image?url=handy.example/c.png", "brand logo",
     "logo_image", "Handy Tool", "handy-tool", "https://handy.example", "https://maker.example", None),
    ("https://cdn.example/example-favicon.png", "link rel=icon", "favicon", "Example Charts",
     "example-charts", "https://maker.example/charts", "https://maker.example", None),
    ("https://handy.example/icon.png", "link rel=icon", "favicon", "Handy Tool", "handy-tool",
     "https://www.handy.example", "https://maker.example", "favicon"),
    ("https://cdn.example/x.png", "structured", "structured_logo", "Example Maker", "m",
     "https://maker.example", None, "vendor"),
    ("https://cdn.example/x.png", "structured", "structured_logo", "Handy Tool", "h",
     "https://handy.example", "https://maker.example", "product"),
    ("https://cdn.example/x.png", "structured", "structured_logo", "Handy Tool", "h",
     "https://maker.example/a", "https://maker.example", None),
]


def test_classification(spark):
    rows = spark.createDataFrame(
        [(i, *c[:-1]) for i, c in enumerate(CLASSES)],
        "i int, url string, evidence string, kind string, name string, slug string, site string, "
        "vendor_site string",
    )
    kind = assets.classify_asset(
        F.col("url"), F.col("evidence"), F.col("kind"), F.col("name"), F.col("slug"),
        F.col("site"), F.lit("Example Maker"), F.lit("example-maker"), F.col("vendor_site"),
    )
    got = [r["k"] for r in rows.select("i", kind.alias("k")).orderBy("i").collect()]
    assert got == [c[-1] for c in CLASSES]


def png(width=128, height=128):
    return b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", width, height) + b"\0" * 8


def jpeg(width=64, height=48):
    frame = b"\xff\xc0" + struct.pack(">HBHH", 11, 8, height, width) + b"\0" * 6
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + frame + b"\0" * 12


def webp(width=200, height=100):
    size = (width - 1).to_bytes(3, "little") + (height - 1).to_bytes(3, "little")
    return b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + size


def ico(*sides):
    entries = b"".join(bytes([s % 256, s % 256]) + b"\0" * 14 for s in sides)
    return b"\0\0\1\0" + struct.pack("<H", len(sides)) + entries


IMAGES = [
    (png(), "image/png", ("png", 128, 128)),
    (png(), "", ("png", 128, 128)),
    (png(), "IMAGE/PNG; charset=x", ("png", 128, 128)),
    (png(1, 1), "image/png", None),
    (png(1200, 32), "image/png", None),
    (png(384, 32), "image/png", ("png", 384, 32)),
    (png(5000, 5000), "image/png", None),
    (png(), "image/svg+xml", None),
    (b"\1\2\3", "image/png", None),
    (b"", "image/png", None),
    (jpeg(), "image/jpg", ("jpg", 64, 48)),
    (webp(), "image/webp", ("webp", 200, 100)),
    (ico(16, 256), "image/x-icon", ("ico", 256, 256)),
    (ico(48), "application/octet-stream", ("ico", 48, 48)),
    (png() + b"\0" * (2 * 1024 * 1024), "image/png", None),
]


def test_image_headers(spark):
    rows = spark.createDataFrame(
        [(i, bytearray(b), m) for i, (b, m, _) in enumerate(IMAGES)],
        "i int, bytes binary, content_type string",
    )
    for r in assets.image_header(rows).collect():
        content, _, expected = IMAGES[r["i"]]
        got = None if r["extension"] is None else (r["extension"], r["width"], r["height"])
        assert got == expected, r["i"]
        assert r["sha256"] == (hashlib.sha256(content).hexdigest() if expected else None)


def test_acquisition(spark, tmp_path):
    def product(i, site=None, slug=None):
        return (i, slug or f"slug-{i}", f"Gizmo {i}", site or f"https://{i}.example/", f"Maker {i}",
                f"maker-{i}", f"https://maker-{i}.example")

    products = spark.createDataFrame(
        [product(i) for i in ("won", "blocked", "pdf", "empty", "unclear", "invalid", "same1", "same2",
                              "absent", "manifest")]
        + [product("unsafe", "http://unsafe.example")],
        "product_id string, slug string, name string, website_url string, vendor_name string, "
        "vendor_slug string, vendor_website string",
    )

    def logo(i, file):
        return f'<img class="logo" alt="Gizmo {i} logo" src="/{file}">'

    pages = spark.createDataFrame(
        [
            ("https://won.example/", 200, "text/html; charset=utf-8",
             logo("won", "gizmo-won-logo.png") + '<link rel=icon href="/bad.png">'),
            ("https://blocked.example/", 403, "text/html", ""),
            ("https://pdf.example/", 200, "application/pdf", ""),
            ("https://empty.example/", 200, "text/html", "<p>nothing</p>"),
            ("https://unclear.example/", 200, "text/html",
             '<img class="site-logo" alt="Maker unclear logo" src="/maker-unclear-logo.png">'),
            ("https://invalid.example/", 200, "text/html", logo("invalid", "gizmo-invalid-logo.png")),
            ("https://same1.example/", 200, "text/html", logo("same1", "gizmo-same1-logo.png")),
            ("https://same2.example/", 200, "text/html", logo("same2", "gizmo-same2-logo.png")),
            ("https://manifest.example/", 200, "text/html", '<link rel="manifest" href="/m.json">'),
        ],
        "url string, status int, content_type string, html string",
    )
    images = spark.createDataFrame(
        [
            ("https://won.example/gizmo-won-logo.png", 200, "image/png", bytearray(png(99, 99))),
            ("https://invalid.example/gizmo-invalid-logo.png", 200, "image/png", bytearray(png(9, 9))),
            ("https://same1.example/gizmo-same1-logo.png", 200, "image/png", bytearray(png(77, 77))),
            ("https://same2.example/gizmo-same2-logo.png", 200, "image/png", bytearray(png(77, 77))),
            ("https://manifest.example/i.png", 200, "image/png", bytearray(png(66, 66))),
        ],
        "url string, status int, content_type string, bytes binary",
    )
    manifests = spark.createDataFrame(
        [("https://manifest.example/m.json", 200, '{"icons": [{"src": "/i.png"}]}')],
        "url string, status int, json string",
    )
    picked = assets.pick_asset(products, pages, images, manifests)
    got = {r["product_id"]: r for r in assets.reject_shared(picked).collect()}
    reasons = {i: r["reason"] or r["source_kind"] for i, r in got.items()}
    assert reasons == {
        "won": "product", "blocked": "blocked", "pdf": "http_failure", "empty": "no_candidates",
        "unclear": "ambiguous_identity", "invalid": "invalid_assets", "same1": "ambiguous_identity",
        "same2": "ambiguous_identity", "absent": "http_failure", "manifest": "favicon",
        "unsafe": "unsafe_url",
    }
    assert got["won"]["width"] == 99 and got["invalid"]["invalid_candidates"] == 1
    report = checks.coverage_report(assets.reject_shared(picked)).collect()[0]
    assert (report["successful"], report["fallbacks"], report["http_403"]) == (2, 9, 1)
    assert float(report["coverage_percent"]) == 18.2
    rows = sinks.provenance(assets.reject_shared(picked))
    assert {r["src"] for r in sinks.asset_manifest(rows).collect()} == {
        "/software-logos/slug-won.png", "/software-logos/slug-manifest.png",
    }


def test_images_from_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png())
    rows = captures.read_images(spark, str(tmp_path), "*.png").withColumn("content_type", F.lit(""))
    assert assets.image_header(rows).collect()[0]["width"] == 128


def test_one_outcome_per_product_where_an_address_repeats(spark):
    sites = [("a", "Gizmo a"), ("b", "Gizmo b")]
    products = spark.createDataFrame(
        [(i, f"slug-{i}", n, "https://both.example/", "Maker", "maker", None) for i, n in sites],
        "product_id string, slug string, name string, website_url string, vendor_name string, "
        "vendor_slug string, vendor_website string",
    )
    pages = spark.createDataFrame(
        [("a", "https://both.example/", 200, "text/html", '<img class="logo" alt="Gizmo a logo" src="/gizmo-a-logo.png">'),
         ("b", "https://both.example/", 403, "text/html", "")],
        "product_id string, url string, status int, content_type string, html string",
    )
    images = spark.createDataFrame(
        [("https://both.example/gizmo-a-logo.png", 200, "image/png", bytearray(png(99, 99)))],
        "url string, status int, content_type string, bytes binary",
    )
    manifests = spark.createDataFrame([], "url string, status int, json string")

    def outcomes(given):
        return sorted((r["product_id"], r["reason"]) for r in assets.pick_asset(products, given, images, manifests).collect())

    assert outcomes(pages) == [("a", None), ("b", "blocked")]
    # fetched twice for whoever asks: the page that came counts
    assert outcomes(pages.drop("product_id")) == [("a", None), ("b", None)]
