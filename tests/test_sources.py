"""Files read by byte ranges: the same rows whatever the size of a range, and files that must fail."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.plans import assets
from shelfmark.sources import captures, ranges, sinks

SIZES = [29, 400, 1 << 20]
ODD = ['"', "\\", '\\"', "{", "}", "[", "],", ":", "é", "日本", "\n", "\t", "", "a,b", '{"programs":[', "\\\\", "0", "true"]


def odd_text(state):
    return "".join(state.choice(ODD) for _ in range(state.randint(0, 12)))


def odd_value(state, depth=0):
    kind = state.randint(0, 7 if depth < 3 else 4)
    if kind < 3:
        return odd_text(state)
    if kind < 5:
        return state.choice([None, True, False, 0, -1.5e10, 42])
    if kind == 5:
        return [odd_value(state, depth + 1) for _ in range(state.randint(0, 3))]
    return {odd_text(state): odd_value(state, depth + 1) for _ in range(state.randint(0, 3))}


def dumped(state, value):
    return json.dumps(value, ensure_ascii=state.random() < 0.5, indent=state.choice([None, None, 2]))


@pytest.mark.parametrize("seed", [1, 2])
def test_outline_whatever_the_range(spark, tmp_path, seed):
    state = random.Random(seed)
    wanted = {}
    for i in range(6):
        root = {"x" + odd_text(state): odd_value(state, 1) for _ in range(2)} | {"list": [odd_value(state) for _ in range(state.choice([0, 1, 9]))]}
        root["in"] = {"a": odd_value(state, 2), "rows": [odd_value(state) for _ in range(4)], "rows2": {"b": [1]}}
        root = dict(state.sample(list(root.items()), len(root)))
        (tmp_path / f"{i}.json").write_text(dumped(state, root))
        wanted[f"{i}.json"] = root
    (tmp_path / "_hidden.json").write_text("no JSON")
    for size in SIZES:
        rows = ranges.json_outline(spark, str(tmp_path), ["list", "in.rows"], size).orderBy("file", "at").collect()
        for name, root in wanted.items():
            own = [r for r in rows if r.file.endswith("/" + name)]

            def items(path):
                return [json.loads(r.value) for r in own if r.path == path and r.kind == "item"]  # noqa: B023

            assert items("list") == root["list"] and items("in.rows") == root["in"]["rows"]
            members = {r.path: json.loads(r.value) for r in own if r.kind == "member"}
            assert members == {k: v for k, v in root.items() if k not in ("list", "in")} | {"in.a": root["in"]["a"], "in.rows2": root["in"]["rows2"]}
            assert {r.path: r.kind for r in own if r.kind in ("object", "array")} == {"": "object", "list": "array", "in": "object", "in.rows": "array"}


def test_numbers_follow_the_file(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"i": i, "t": "],[" * (i % 5)} for i in range(300)]))
    (tmp_path / "b.json").write_text("[ ]")
    for size in SIZES:
        rows = ranges.numbered(ranges.json_outline(spark, str(tmp_path / "*.json"), [], size).filter("kind = 'item'")).collect()
        assert sorted((r.input_index, json.loads(r.value)["i"]) for r in rows) == [(i, i) for i in range(300)]


@pytest.mark.parametrize("text", ['[1, 2', '{"a": [1,, 2]}', '{"list": [1'])
def test_what_is_no_json_fails(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        ranges.json_outline(spark, str(tmp_path), ["a", "list"]).collect()
    with pytest.raises(FileNotFoundError):
        ranges.list_files(str(tmp_path / "none"))


def envelope(n, **more):
    rows = [{"programId": f"p{i}", "name": f"N {i}", "source": {"kind": "api"}} for i in range(n)]
    return {"schemaVersion": 1, "source": {"kind": "export", "reference": "r", "tags": [1, 2]}, "programs": rows} | more


def plain(rows):
    return sorted((r.file.split("/")[-1], r.input_index, r.record, r.source) for r in rows.select("file", "input_index", F.to_json("record").alias("record"), F.to_json("source").alias("source")).collect())


def test_capture_json_of_one_and_of_many_ranges(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(envelope(90)))
    (tmp_path / "b.json").write_text(json.dumps({"programs": [None, 1], "schemaVersion": 1.0}))
    (tmp_path / "c.json").write_text(json.dumps(envelope(0, source=None)))
    files = spark.createDataFrame([(p.name, p.read_text()) for p in tmp_path.iterdir()], "file string, value string")
    wanted = plain(captures.parse_capture_json(files))
    assert len(wanted) == 92
    for size in SIZES[1:]:
        assert plain(captures.read_capture_json(spark, str(tmp_path), size)) == wanted


@pytest.mark.parametrize("bad", [{"schemaVersion": 2}, {"programs": {}}, {"source": []}, [1], {"schemaVersion": "x"}])
def test_unusable_captures_fail_whatever_is_read_of_them(spark, tmp_path, bad):
    (tmp_path / "a.json").write_text(json.dumps(envelope(3) | bad if isinstance(bad, dict) else bad))
    with pytest.raises(Exception, match="schemaVersion|source must"):
        captures.read_capture_json(spark, str(tmp_path)).select("input_index").collect()


def page(n, declared=None, open_=None):
    cards = "".join(
        f"[image](https://company-images.partnerstack.com/{i}.png)\n\n**Name {i}**\nAbout {i}\n|\n" + ("**10% CPA**\n" if i % 2 else "") + ("svgJoined\n" if i % 3 == 0 else "")
        for i in range(n)
    )
    left = sum(i % 3 != 0 for i in range(n)) if open_ is None else open_
    return f"# A page\n[image](https://company-images.partnerstack.com/logo.png)\nPrograms not applied to yet\n\n{left}\n\n**All programs**{declared if declared is not None else n} programs\n\n{cards}"


def test_capture_text_of_one_and_of_many_ranges(spark, tmp_path):
    for name, text in {"a.md": page(120), "b.md": page(1), "c.md": page(5, open_=99), "d.md": page(0)}.items():
        (tmp_path / name).write_text(text)
    files = spark.createDataFrame([(p.name, p.read_text()) for p in tmp_path.iterdir()], "file string, value string")
    wanted = plain(captures.parse_capture_text(files))
    assert len(wanted) == 126
    for size in SIZES[1:]:
        assert plain(captures.read_capture_text(spark, str(tmp_path), size)) == wanted
    (tmp_path / "e.md").write_text(page(3, declared=4))
    with pytest.raises(Exception, match="declares"):
        captures.read_capture_text(spark, str(tmp_path)).select("input_index").collect()


def test_inventory_of_many_ranges(spark, tmp_path):
    rows = [{"id": f"i{i}", "slug": f"s{i}", "name": f" N{i} ", "websiteUrl": "https://a.example.com" if i % 2 else None} for i in range(100)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    one, many = ({tuple(r) for r in captures.read_inventory(spark, str(tmp_path), size).collect()} for size in (1 << 20, 500))
    assert one == many and len(one) == 100
    (tmp_path / "b.json").write_text(json.dumps([{"id": "other", "slug": "S7", "name": "n"}]))
    with pytest.raises(Exception, match="duplicate ID or slug"):
        captures.read_inventory(spark, str(tmp_path)).select("name").collect()
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception, match="Expected an array"):
        captures.read_inventory(spark, str(tmp_path)).collect()


def test_batch_of_one_and_of_many_ranges(spark, tmp_path):
    batch = {
        "candidates": [{"productName": {"value": f"P{i}", "citations": []}, "officialUrl": "https://x.example.com"} for i in range(40)],
        "context": {
            "software": [{"id": f"s{i}", "slug": "x", "name": "{["} for i in range(30)], "vendors": [], "extra": {"vendors": [1]},
            "categories": [{"id": "c", "slug": "c", "name": "C"}],
        },
        "reporting": {"categoryCountsBefore": {"a": 1}, "publishedCountBefore": 7},
    }
    (tmp_path / "a.json").write_text(json.dumps(batch))
    files = spark.createDataFrame([("a.json", json.dumps(batch))], "file string, value string")
    wanted = captures.parse_batch(files)
    for size in (300, 1 << 20):
        found = captures.read_batch(spark, str(tmp_path), size)
        for name, table in wanted.items():
            drop = lambda df: sorted(df.drop("file").toJSON().collect())
            assert drop(found[name]) == drop(table), name
    del batch["context"]["vendors"]
    (tmp_path / "a.json").write_text(json.dumps(batch))
    with pytest.raises(Exception, match="context arrays"):
        captures.read_batch(spark, str(tmp_path))["candidates"].select("input_index").collect()


def png(width, height):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"\0" * 5000, 0)) + chunk(b"IEND", b"")


def test_written_files_are_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", png(50, 40)), ("b.png", b"")], "name string, bytes binary")
    assert sinks.write_files(rows, f"{tmp_path}/new") == 2
    assert sinks.write_files(rows.limit(1), f"{tmp_path}/new") == 1
    assert sorted(p.name for p in (tmp_path / "new").iterdir()) == ["a.png", "b.png"]
    assert captures.read_images(spark, f"{tmp_path}/new").first().bytes == png(50, 40)


def test_images(spark, tmp_path):
    (tmp_path / "below").mkdir()
    (tmp_path / "a.png").write_bytes(png(128, 64))
    (tmp_path / "below" / "b.png").write_bytes(png(40, 40))
    (tmp_path / "c.txt").write_bytes(b"no image")
    (tmp_path / "empty.png").write_bytes(b"")
    short = lambda rows, c: {r.url.split("/")[-1]: r[c] for r in rows.collect()}
    size = len(png(40, 40))
    assert short(captures.list_images(spark, str(tmp_path), "*.png"), "length") == {"a.png": size, "b.png": size}  # Spark lists no empty files
    some = captures.read_images(spark, str(tmp_path), "*.png", largest=100)
    assert short(some, "bytes") == {"a.png": None, "b.png": None}
    heads = captures.read_image_heads(spark, str(tmp_path), "*.png", size=33)
    assert short(heads, "head") == {"a.png": png(128, 64)[:33], "b.png": png(40, 40)[:33]}
    measured = assets.image_header(heads.select("url", F.col("head").alias("bytes"), F.lit("").alias("content_type")))
    assert short(measured, "width") == {"a.png": 128, "b.png": 40}
