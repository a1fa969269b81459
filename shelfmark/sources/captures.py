"""Marketplace captures, product inventories and candidate batches as DataFrames.

The readers cut files at their records (``ranges``), so that one file may be read by many tasks; an unusable file fails
the load. The parsers take texts that are in a DataFrame already.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfmark.functions import text, url
from shelfmark.functions.rules import commission_label
from shelfmark.session import stored
from shelfmark.sources.ranges import RANGE_BYTES, json_outline, numbered, text_records

DEFAULT_KIND = "export"


def _fail_unless(holds: Column, value: Column, message: str) -> Column:
    """``value`` where the condition holds; elsewhere the job fails."""
    return F.when(F.coalesce(holds, F.lit(False)), value).otherwise(F.raise_error(F.lit(message)))


def variant_kind(v: Column) -> Column:
    """JSON kind in lower case without type parameters; null for absent or null values."""
    kind = F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))
    return F.when(kind != "void", kind)


def field(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def parse_capture_json(files: DataFrame, content: str = "value") -> DataFrame:
    """Envelopes to one row per program: ``(file, input_index, record, source)``.

    ``record`` and ``source`` are variants: what a row holds is judged later, field by
    field. ``files`` needs a ``file`` column next to the text.
    """
    envelope = F.parse_json(F.col(content))
    usable = (field(F.col("_e"), "schemaVersion").try_cast("int") == 1) & (
        variant_kind(field(F.col("_e"), "programs")) == "array"
    )
    source_ok = F.coalesce(variant_kind(field(F.col("_e"), "source")), F.lit("object")) == "object"
    programs = F.try_variant_get(F.col("_e"), "$.programs", "array<variant>")
    checked = _fail_unless(
        usable, programs, "Expected a capture object with schemaVersion: 1 and programs: []."
    )
    return (
        files.select("file", envelope.alias("_e"))
        .select(
            "file",
            field(F.col("_e"), "source").alias("source"),
            F.when(source_ok, checked)
            .otherwise(F.raise_error(F.lit("source must be an object.")))
            .alias("_programs"),
        )
        .select("file", "source", F.posexplode("_programs").alias("input_index", "record"))
    )


def _failing(rows: DataFrame, bad: Column, message: str, label: str, like: DataFrame) -> DataFrame:
    """No rows, of the shape of ``like``; the job fails if one of ``rows`` is ``bad``.

    The condition is a filter, so that it is judged whatever columns are used.
    """
    failed = F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.concat(F.lit(f"{message} "), F.coalesce(label, F.lit("")))))
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in like.schema]
    return rows.filter(failed.cast("string").isNotNull()).select(*none)


def _files_of(outline: DataFrame, *arrays: str) -> DataFrame:
    """Per file: the kind of its root, whether all ``arrays`` are arrays, and its first members ``_members`` by name."""
    plain = outline.filter("kind <> 'item'")
    held = [F.count_if((F.col("path") == a) & (F.col("kind") == "array")) == 1 for a in arrays]
    members = F.collect_list(F.when(F.col("kind") == "member", F.struct("path", "value")))
    every = F.lit(True)
    for h in held:
        every = every & h
    return plain.groupBy("file").agg(
        F.max(F.when(F.col("path") == "", F.col("kind"))).alias("_root"), every.alias("_arrays"), members.alias("_members")
    )


def _member(name: str) -> Column:
    return F.get(F.filter("_members", lambda m: m["path"] == name), 0)["value"]


def read_capture_json(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Envelopes in files to rows of the shape of ``parse_capture_json``; the programs of one file may be spread over many tasks.

    An envelope but for its programs travels with each of them as ``source`` does. It must hold each member once.
    """
    outline = json_outline(spark, path, ["programs"], range_bytes)
    files = _files_of(outline, "programs").select(
        "file",
        (F.coalesce(F.col("_root") == "object", F.lit(False)) & F.col("_arrays") & F.coalesce(_member("schemaVersion").try_cast("double") == 1, F.lit(False))).alias("_usable"),
        F.parse_json(_member("source")).alias("_given"),
    )
    files = files.select("file", "_usable", "_given", (F.coalesce(variant_kind(F.col("_given")), F.lit("object")) == "object").alias("_source_ok"))
    items = numbered(outline.filter("path = 'programs' and kind = 'item'")).select("file", "input_index", F.parse_json("value").alias("record"))
    rows = items.join(files.select("file", F.when(variant_kind(F.col("_given")) == "object", F.col("_given")).alias("source")), "file")
    rows = rows.select("file", "source", "input_index", "record")
    unusable = _failing(files, ~F.col("_usable"), "Expected a capture object with schemaVersion: 1 and programs: [].", "file", rows)
    return rows.unionAll(unusable).unionAll(_failing(files, ~F.col("_source_ok"), "source must be an object.", "file", rows))


# The layout of a marketplace page saved as Markdown.
COUNT_LINE = r"(?m)^\*\*All programs\*\*([\d,]+) programs\s*$"
CARD_IMAGE = r"(?m)^\[image\]\(https://company-images\.partnerstack\.com/[^)\r\n]+\)[^\S\n]*$"
NOT_APPLIED = r"(?i)Programs not applied to yet\s+([\d,]+)"
RELATIONSHIP_LINE = "(?i)^svg(?:Application pending|Application declined|Joined)$"
STATED = r"(?im)^[^\S\n]*svg(?:Application pending|Application declined|Joined)[^\S\n]*$"
BOLD_LINE = r"^\*\*(.+)\*\*$"
MISCOUNTED = "The capture does not hold the number of program cards it declares."
MARKDOWN_SOURCE = "PartnerStack All Programs marketplace Markdown capture"


def _number(c: Column) -> Column:
    return F.when(c != "", F.replace(c, F.lit(","), F.lit("")).try_cast("bigint"))


def parse_capture_text(files: DataFrame, content: str = "value") -> DataFrame:
    """Markdown captures to rows of the same shape as ``parse_capture_json``.

    A file must hold as many cards as it declares. Cards without a relationship count as
    "Not applied" only where the declared numbers prove it.
    """
    page = F.col(content)
    declared = files.select(
        "file",
        _number(F.regexp_extract(page, COUNT_LINE, 1)).alias("_declared"),
        _number(F.regexp_extract(page, NOT_APPLIED, 1)).alias("_not_applied"),
        F.try_element_at(F.split(page, COUNT_LINE, 2), F.lit(2)).alias("_body"),
    ).withColumn("_blocks", F.filter(F.split("_body", CARD_IMAGE), lambda b, i: i > 0))
    counted = _fail_unless(F.col("_declared") == F.size("_blocks"), F.col("_blocks"), MISCOUNTED)
    stated = F.size(F.filter(F.col("_blocks"), lambda b: b.rlike(STATED)))
    fill = F.coalesce(F.col("_not_applied") + stated == F.col("_declared"), F.lit(False))
    cards = declared.select(
        "file", fill.alias("_fill"), F.posexplode(counted).alias("input_index", "_block")
    )
    return _card_rows(cards)


def _card_rows(cards: DataFrame) -> DataFrame:
    """Cards (file, _fill, input_index, _block) as rows of a capture."""
    source = F.to_json(
        F.struct(F.lit(DEFAULT_KIND).alias("kind"), F.lit(MARKDOWN_SOURCE).alias("provenance"))
    )
    return _parsed_cards(cards).select(
        "file",
        F.parse_json(source).alias("source"),
        "input_index",
        F.parse_json(
            F.to_json(
                F.struct(
                    F.col("_name").alias("name"),
                    F.nullif(F.col("_description"), F.lit("")).alias("description"),
                    F.when(
                        F.col("_commission").isNotNull(),
                        F.struct(
                            F.col("_commission").alias("text"),
                            commission_label(F.col("_commission")).alias("model"),
                        ),
                    ).alias("commission"),
                    F.coalesce(
                        "_relationship", F.when(F.col("_fill"), F.lit("Not applied"))
                    ).alias("relationship"),
                )
            )
        ).alias("record"),
    )


def _parsed_cards(cards: DataFrame) -> DataFrame:
    """First bold line is the name, the second the commission, lines between the description.

    Each step is a column of its own: what a lambda refers to is computed once per card.
    """
    lines = F.filter(
        F.transform(F.split("_block", r"\r?\n"), lambda s: text.strip(s)), lambda s: s != ""
    )
    numbered = F.transform("_lines", lambda s, i: F.struct(i.alias("at"), s.alias("line")))

    def inside(n: str) -> Column:
        return text.strip(F.regexp_extract(F.col(n)["line"], BOLD_LINE, 1))

    located = (
        cards.withColumn("_lines", lines)
        .withColumn("_numbered", numbered)
        .withColumns(
            {
                "_bold": F.filter("_numbered", lambda n: n["line"].rlike(BOLD_LINE)),
                "_stated": F.filter("_numbered", lambda n: n["line"].rlike(RELATIONSHIP_LINE)),
            }
        )
        .withColumns(
            {"_first": F.get("_bold", 0), "_second": F.get("_bold", 1), "_state": F.get("_stated", 0)}
        )
        .withColumns(
            {
                "_from": F.col("_first.at"),
                "_stop": F.coalesce("_second.at", "_state.at", F.size("_lines")),
            }
        )
    )
    between = F.filter(
        "_numbered",
        lambda n: (n["at"] > F.col("_from")) & (n["at"] < F.col("_stop")) & (n["line"] != "|"),
    )
    return located.withColumns(
        {
            "_name": F.coalesce(inside("_first"), F.lit("")),
            "_description": F.array_join(F.transform(between, lambda n: n["line"]), " "),
            "_commission": inside("_second"),
            "_relationship": F.regexp_replace("_state.line", "(?i)^svg", ""),
        }
    )


def read_capture_text(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Markdown files to rows of the shape of ``parse_capture_text``; the cards of one file may be spread over many tasks.

    The first count line of a file opens its list; cards are the records behind it.
    """
    pieces = stored(text_records(spark, path, CARD_IMAGE.removeprefix("(?m)"), range_bytes), "cards")
    piece = F.col("text")
    at_count = F.when(piece.rlike(COUNT_LINE), F.col("at"))
    at_open = F.when(piece.rlike(NOT_APPLIED), F.col("at"))
    heads = pieces.groupBy("file").agg(
        F.min(at_count).alias("_list"),
        F.min_by(F.regexp_extract("text", COUNT_LINE, 1), at_count).alias("_declared"),
        F.min_by(F.regexp_extract("text", NOT_APPLIED, 1), at_open).alias("_not_applied"),
    )
    listed = pieces.join(heads.select("file", "_list"), "file").filter(F.col("at") > F.col("_list"))
    blocks = listed.select("file", "start", "at", F.regexp_replace("text", CARD_IMAGE.replace("(?m)^", r"\A"), "").alias("_block"))
    counts = blocks.groupBy("file").agg(F.count(F.lit(1)).alias("_cards"), F.count_if(F.col("_block").rlike(STATED)).alias("_stated"))
    files = heads.join(counts, "file", "left").select(
        "file",
        F.coalesce(_number(F.col("_declared")) == F.coalesce("_cards", F.lit(0)), F.lit(False)).alias("_counted"),
        F.coalesce(_number(F.coalesce("_not_applied", F.lit(""))) + F.col("_stated") == _number(F.col("_declared")), F.lit(False)).alias("_fill"),
    )
    cards = numbered(blocks).join(files.select("file", "_fill"), "file").select("file", "_fill", "input_index", "_block")
    rows = _card_rows(cards)
    return rows.unionAll(_failing(files, ~F.col("_counted"), MISCOUNTED, "file", rows))


INVENTORY = T.ArrayType(
    T.StructType(
        [T.StructField(n, T.StringType()) for n in ("id", "slug", "name", "vendorName", "websiteUrl")]
    )
)


def parse_inventory(rows: DataFrame) -> DataFrame:
    """Inventory variants (column ``record``) to ``(id, slug, name, vendor_name, website_url)``.

    Any violation fails the load: missing id, slug or name, a non-string field, an unsafe
    site, an id or slug (whatever its case) that occurs twice.
    """
    record = F.col("record")

    def required(name: str) -> Column:
        value = F.try_variant_get(record, f"$.{name}", "string")
        sound = (variant_kind(field(record, name)) == "string") & (text.strip(value) != "")
        return _fail_unless(sound, text.strip(value), f"Inventory row: {name} is required.")

    def optional(name: str) -> Column:
        kind = F.coalesce(variant_kind(field(record, name)), F.lit("string"))
        return _fail_unless(
            kind == "string",
            F.try_variant_get(record, f"$.{name}", "string"),
            f"Inventory row: invalid {name}.",
        )

    site = optional("websiteUrl")
    typed = rows.select(
        required("id").alias("id"),
        required("slug").alias("slug"),
        required("name").alias("name"),
        optional("vendorName").alias("vendor_name"),
        F.when(F.coalesce(site, F.lit("")) == "", site)
        .otherwise(
            _fail_unless(
                url.norm_domain(site, "discovery").isNotNull(),
                site,
                "Inventory row: invalid HTTPS websiteUrl.",
            )
        )
        .alias("website_url"),
    )
    out = typed
    for key in (F.col("id"), F.lower("slug")):  # only keys travel for that
        keys = typed.groupBy(key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
        out = out.unionAll(_failing(keys, F.col("_n") > 1, "Inventory: duplicate ID or slug.", "_key", typed))
    return out


def read_inventory(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Inventory files, each one JSON array of objects; one file may be read by many tasks."""
    outline = json_outline(spark, path, [], range_bytes)
    rows = parse_inventory(outline.filter("path = '' and kind = 'item'").select(F.parse_json("value").alias("record")))
    return rows.unionAll(_failing(_files_of(outline), F.col("_root") != "array", "Expected an array of inventory rows.", "file", rows))


_CITATION = "array<struct<sourceUrl: string, quote: string>>"
_SOURCED = f"struct<value: string, citations: {_CITATION}>"
_CATEGORY = f"struct<slug: string, confidence: double, citations: {_CITATION}>"
CANDIDATE = f"""struct<
  source: struct<providerKey: string, externalObjectType: string, externalId: string>,
  productName: {_SOURCED}, vendorName: {_SOURCED}, officialUrl: string, requestedSlug: string,
  description: {_SOURCED}, primaryCategory: {_CATEGORY}, additionalCategories: array<{_CATEGORY}>,
  capabilities: array<{_SOURCED}>, pricing: {_SOURCED},
  evidence: array<struct<url: string, retrievedAt: string, sourceType: string, httpStatus: int,
    content: string>>,
  monetizationClassification: string, indiaRelevance: boolean, indiaRelevanceNote: string,
  acquisitionException: struct<code: string, message: string>>"""
BATCH = f"""struct<
  candidates: array<{CANDIDATE}>,
  context: struct<
    software: array<struct<id: string, slug: string, name: string, vendorId: string,
      vendorName: string, officialUrl: string>>,
    vendors: array<struct<id: string, slug: string, name: string, officialUrl: string>>,
    categories: array<struct<id: string, slug: string, name: string>>>,
  reporting: struct<categoryCountsBefore: map<string, bigint>, publishedCountBefore: bigint,
    uncategorizedCountBefore: bigint>>"""


def parse_batch(files: DataFrame, content: str = "value") -> dict[str, DataFrame]:
    """Batch files to ``candidates`` and the context tables, each with its ``file``."""
    batch = files.select("file", F.from_json(F.col(content), BATCH.replace("\n", " ")).alias("b"))
    complete = (
        F.col("b.candidates").isNotNull()
        & F.col("b.context.software").isNotNull()
        & F.col("b.context.vendors").isNotNull()
        & F.col("b.context.categories").isNotNull()
    )
    candidates = _fail_unless(
        complete,
        F.col("b.candidates"),
        "Input must contain candidates plus software, vendor and category context arrays.",
    )

    def rows(column: str) -> DataFrame:
        return batch.select("file", F.inline(column))

    return {
        "candidates": batch.select("file", F.posexplode(candidates).alias("input_index", "candidate")),
        "software": rows("b.context.software"),
        "vendors": rows("b.context.vendors"),
        "categories": rows("b.context.categories"),
        "reporting": batch.select("file", "b.reporting.*"),
    }


_CONTEXT = {
    "software": "struct<id: string, slug: string, name: string, vendorId: string, vendorName: string, officialUrl: string>",
    "vendors": "struct<id: string, slug: string, name: string, officialUrl: string>",
    "categories": "struct<id: string, slug: string, name: string>",
}
_REPORTING = "struct<categoryCountsBefore: map<string, bigint>, publishedCountBefore: bigint, uncategorizedCountBefore: bigint>"


def read_batch(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> dict[str, DataFrame]:
    """Batch files to the tables of ``parse_batch``; candidates and context of one file may be spread over many tasks."""
    arrays = ["candidates", *[f"context.{name}" for name in _CONTEXT]]
    outline = json_outline(spark, path, arrays, range_bytes)
    files = _files_of(outline, *arrays)

    def items(array: str) -> DataFrame:
        return outline.filter((F.col("path") == array) & (F.col("kind") == "item"))

    candidates = numbered(items("candidates")).select("file", "input_index", F.from_json("value", CANDIDATE.replace("\n", " ")).alias("candidate"))
    message = "Input must contain candidates plus software, vendor and category context arrays."
    tables = {"candidates": candidates.unionAll(_failing(files, ~F.col("_arrays") | (F.col("_root") != "object"), message, "file", candidates))}
    for name, kind in _CONTEXT.items():
        tables[name] = items(f"context.{name}").select("file", F.from_json("value", kind).alias("_r")).select("file", "_r.*")
    reporting = F.from_json(_member("reporting"), _REPORTING).alias("_r")
    tables["reporting"] = files.select("file", reporting).select("file", "_r.*")
    return tables


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages: ``url``, ``status``, ``content_type``, ``html``."""
    return spark.read.schema(
        "url string, status int, content_type string, html string"
    ).parquet(path)


#: Bytes at the start of an image file in which its size stands, but for JPEG files with long leading segments.
HEADER_BYTES = 1 << 16


def list_images(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """(url, length, modified) of image files, without reading them. The files are split over tasks like their contents.

    Empty files are not listed, as Spark lists none.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("url"), "length", F.col("modificationTime").alias("modified"))


def read_images(spark: SparkSession, path: str, suffix: str = "*", largest: int | None = None) -> DataFrame:
    """Image files of a folder and those below it as ``(url, bytes, length)``; the path stands for the address.

    Files of more than ``largest`` bytes are listed with null bytes and are never read: the length is known from the listing.
    """
    found = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", "true").load(path)
    small = found if largest is None else found.filter(F.col("length") <= largest)
    out = small.select(F.col("path").alias("url"), F.col("content").alias("bytes"), "length")
    if largest is None:
        return out
    large = found.filter(F.col("length") > largest)
    return out.unionAll(large.select(F.col("path").alias("url"), F.lit(None).cast("binary").alias("bytes"), "length"))


def _heads(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        heads = []
        for address, length in zip(batch.column("url").to_pylist(), batch.column("length").to_pylist()):
            system, path = fs.FileSystem.from_uri(address)
            with system.open_input_file(path) as file:
                heads.append(file.read_at(min(size, length), 0))
        yield pa.RecordBatch.from_arrays([batch.column("url"), batch.column("length"), pa.array(heads, pa.binary())], names=["url", "length", "head"])


def read_image_heads(spark: SparkSession, path: str, suffix: str = "*", size: int = HEADER_BYTES) -> DataFrame:
    """(url, length, head): the first ``size`` bytes of image files, enough for format and sides; the rest is not read."""
    listed = list_images(spark, path, suffix).select("url", "length")
    return listed.mapInArrow(lambda batches: _heads(batches, size), "url string, length bigint, head binary")
