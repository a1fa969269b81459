"""Marketplace queries: captures, normalisation and matching, built from part.

Every product of part is also read as a marketplace program that names it in one way,
chosen by its type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.plans import programs
from shelfmark.registry import query
from shelfmark.session import scratch_path, spread, table
from shelfmark.sources import captures

PER_FILE = 100


def _record(spark: SparkSession, sf: str) -> DataFrame:
    """(input_index, record as JSON text), one program per product."""
    kind, key = F.col("p_type"), F.col("p_partkey")
    host = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_size", F.lit(".example.com"))
    other = F.concat(
        F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_size") + 1, F.lit(".example.com")
    )
    full = F.concat_ws(" ", "p_name", "p_brand")
    name = (
        F.when(kind.isin("ECONOMY", "STANDARD"), F.concat(F.lit("Solo "), key.cast("string")))
        .when(kind.isin("MEDIUM", "PROMO"), full)
        .when(kind == "SMALL", F.concat("p_brand", F.lit(" partners "), key.cast("string")))
        .otherwise(F.concat(F.lit("Unknown "), key.cast("string")))
    )
    repeated = (kind == "LARGE") & (F.col("p_size") < 20)
    record = F.struct(
        F.when(repeated, F.concat(F.lit("dup-"), "p_size", F.lit("-"), "p_brand"))
        .otherwise(F.concat(F.lit("p"), key.cast("string")))
        .alias("programId"),
        name.alias("name"),
        F.when(kind == "ECONOMY", F.array(host))
        .when(kind == "PROMO", F.array(F.concat(F.lit("WWW."), other)))
        .alias("domains"),
        F.when(kind == "STANDARD", F.concat(F.lit("P "), key.cast("string"))).alias("softwareSlugHint"),
        F.when(kind == "SMALL", F.col("p_brand")).alias("vendorName"),
        F.when(F.col("p_size") == 50, "http://plain.example.com").alias("applicationUrl"),
        F.when(F.col("p_size") < 30, "Approved").alias("relationship"),
        F.struct(F.lit("CPA").alias("model")).alias("commission"),
    )
    part = spread(spark, sf, "part", "p_partkey")
    return part.select(key.alias("input_index"), F.to_json(record).alias("json"))


CANDIDATES = """c as (
  select p_partkey as k, p_type as t, p_size as z, p_brand,
    case when p_type in ('ECONOMY', 'STANDARD') then 'Solo ' || p_partkey
      when p_type in ('MEDIUM', 'PROMO') then p_name || ' ' || p_brand
      when p_type = 'SMALL' then p_brand || ' partners ' || p_partkey
      else 'Unknown ' || p_partkey end as name,
    case when p_type = 'ECONOMY' then replace(p_name, ' ', '-') || '-' || p_size || '.example.com'
      when p_type = 'PROMO' then replace(p_name, ' ', '-') || '-' || (p_size + 1) || '.example.com'
      end as domain,
    case when p_type = 'LARGE' and p_size < 20 then 'dup-' || p_size || '-' || p_brand
      else 'p' || p_partkey end as program_id
  from part)"""

INVENTORY = """inv as (
  select 'S' || lpad(p_partkey::varchar, 8, '0') as id, 'p-' || p_partkey as slug, p_partkey,
    p_name || ' ' || p_brand as name, p_brand as vendor,
    replace(p_name, ' ', '-') || '-' || p_size || '.example.com' as domain
  from part)"""


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    source = F.parse_json(F.lit('{"kind": "export", "reference": "part"}'))
    return _record(spark, sf).select(
        "input_index", F.parse_json("json").alias("record"), source.alias("source")
    )


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return programs.normalise_program(_raw(spark, sf))


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    host = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_size", F.lit(".example.com"))
    return spread(spark, sf, "part", "p_partkey").select(
        F.concat(F.lit("S"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("id"),
        F.concat(F.lit("p-"), F.col("p_partkey").cast("string")).alias("slug"),
        F.concat_ws(" ", "p_name", "p_brand").alias("name"),
        F.col("p_brand").alias("vendor_name"),
        F.concat(F.lit("https://"), host, F.lit("/")).alias("website_url"),
    )


def as_files(rows: DataFrame, label: str) -> str:
    """A folder with one file per row (file, value), which holds the value; the folder it lies in names the row."""
    path = scratch_path(rows.sparkSession, label)
    rows.select("file", "value").write.partitionBy("file").text(path)
    return path


def file_name() -> Column:
    """The row that a file of ``as_files`` was written from."""
    return F.regexp_extract("file", "/file=([^/]+)/", 1)


def _files(spark: SparkSession, sf: str) -> DataFrame:
    """Programs packed into capture files of at most a hundred."""
    packed = (
        _record(spark, sf)
        .groupBy(F.floor(F.col("input_index") / PER_FILE).cast("string").alias("file"))
        .agg(F.array_sort(F.collect_list(F.struct("input_index", "json"))).alias("rows"))
    )
    programs_json = F.array_join(F.transform("rows", lambda r: r["json"]), ",")
    return packed.select(
        "file",
        F.concat(
            F.lit('{"schemaVersion":1,"source":{"kind":"api","reference":"file '), "file",
            F.lit('"},"programs":['), programs_json, F.lit("]}"),
        ).alias("value"),
    )


@query(
    "read_capture_json",
    f"""with {CANDIDATES} select (k // {PER_FILE})::varchar as file,
      row_number() over (partition by k // {PER_FILE} order by k) - 1 as input_index, name,
      'api' as source_kind, 'file ' || (k // {PER_FILE}) as reference from c""",
)
def read_capture_json(spark: SparkSession, sf: str) -> DataFrame:
    """Captures written as files and read back."""
    rows = captures.read_capture_json(spark, as_files(_files(spark, sf), "captures"))
    return rows.select(
        file_name().alias("file"),
        F.col("input_index").cast("long").alias("input_index"),
        F.variant_get("record", "$.name", "string").alias("name"),
        F.variant_get("source", "$.kind", "string").alias("source_kind"),
        F.variant_get("source", "$.reference", "string").alias("reference"),
    )


@query(
    "read_capture_text",
    f"""select (p_partkey // {PER_FILE})::varchar as file,
      row_number() over (partition by p_partkey // {PER_FILE} order by p_partkey) - 1 as input_index,
      p_name as program_name, 'About ' || p_brand || ' ' || p_type as description,
      case when p_size < 30 then 'cpa' else 'unknown' end as commission_model,
      case when p_size < 10 then 'approved' else 'available' end as relationship
    from part""",
)
def read_capture_text(spark: SparkSession, sf: str) -> DataFrame:
    card = F.concat(
        F.lit("[image](https://company-images.partnerstack.com/"), "p_partkey", F.lit(".png)\n\n**"),
        "p_name", F.lit("**\nAbout "), "p_brand", F.lit("\n|\n"), "p_type",
        F.when(F.col("p_size") < 30, "\n**10% CPA**\n").otherwise("\n"),
        F.when(F.col("p_size") < 10, "svgJoined\n").otherwise(""),
    )
    packed = (
        table(spark, sf, "part")
        .groupBy(F.floor(F.col("p_partkey") / PER_FILE).cast("string").alias("file"))
        .agg(
            F.array_sort(F.collect_list(F.struct("p_partkey", card.alias("card")))).alias("cards"),
            F.count_if(F.col("p_size") >= 10).alias("open"),
        )
    )
    page = F.concat(
        F.lit("Programs not applied to yet\n\n"), "open", F.lit("\n\n**All programs**"),
        F.format_number(F.size("cards"), 0), F.lit(" programs\n\n"),
        F.array_join(F.transform("cards", lambda c: c["card"]), ""),
    )
    rows = captures.read_capture_text(spark, as_files(packed.select("file", page.alias("value")), "pages"))
    normal = programs.normalise_program(rows, passing=("file",))
    return normal.select(
        file_name().alias("file"), F.col("input_index"), "program_name", "description", "commission_model",
        F.col("provider_relationship").alias("relationship"),
    )


@query(
    "read_inventory",
    f"""with {INVENTORY} select id, slug, name, vendor as vendor_name,
      'https://' || domain || '/' as website_url from inv""",
)
def read_inventory(spark: SparkSession, sf: str) -> DataFrame:
    """The inventory written as files of a thousand rows, each one array, and read back."""
    named = inventory(spark, sf).withColumnsRenamed({"vendor_name": "vendorName", "website_url": "websiteUrl"})
    row = F.to_json(F.struct(*named.columns))
    packed = named.groupBy(F.floor(F.substring("id", 2, 8).cast("bigint") / 1000).cast("string").alias("file")).agg(F.collect_list(row).alias("rows"))
    files = packed.select("file", F.concat(F.lit("["), F.array_join("rows", ",\n"), F.lit("]")).alias("value"))
    return captures.read_inventory(spark, as_files(files, "inventory"))


@query(
    "normalise_program",
    f"""with {CANDIDATES} select k as input_index, program_id as external_program_id,
      name as program_name, name as product_name, case when t = 'SMALL' then p_brand end as vendor_name,
      coalesce(domain, '') as domains, 'cpa' as commission_model,
      case when z < 30 then 'approved' else 'unknown' end as provider_relationship,
      case when z = 50 then 'applicationUrl' else '' end as issues
    from c""",
)
def normalise_program(spark: SparkSession, sf: str) -> DataFrame:
    return candidates(spark, sf).select(
        "input_index", "external_program_id", "program_name", "product_name", "vendor_name",
        F.array_join("domains", ",").alias("domains"), "commission_model", "provider_relationship",
        F.array_join(F.transform("issues", lambda i: i["field"]), ",").alias("issues"),
    )


MATCHED = f"""{CANDIDATES}, {INVENTORY}, hits as (
  select k, 95 as tier, i.id from c join inv i on i.domain = c.domain
  union all select k, 90, i.id from c join inv i on i.slug = 'p-' || k where t = 'STANDARD'
  union all select k, 85, i.id from c join inv i on i.name = c.name
  union all select k, 70, i.id from c join inv i on i.vendor = c.p_brand where t = 'SMALL'),
best as (
  select k, tier, count(distinct id) as n, min(id) as id from hits h
  where tier = (select max(tier) from hits g where g.k = h.k) group by k, tier),
crossed as (
  select k from hits group by k having count(distinct tier) filter (tier in (95, 90, 85)) >= 2
    and max(tier) <> 70),
shared as (
  select k from (select k, id from hits where tier in (95, 90, 85) group by k, id
    having count(distinct tier) >= 2)),
m as (
  select c.k, c.name, c.t, c.z, c.program_id, b.tier, b.n, b.id,
    c.k in (select k from crossed) and c.k not in (select k from shared) as conflict
  from c left join best b using (k))"""


@query(
    "match_program",
    f"""with {MATCHED} select k as input_index, tier as confidence,
      case when n = 1 then 'suggested' when n > 1 then 'ambiguous' end as decision,
      case when n = 1 then id end as software_id, conflict as conflicting_evidence from m""",
)
def match_program(spark: SparkSession, sf: str) -> DataFrame:
    return programs.match_program(candidates(spark, sf), inventory(spark, sf)).select(
        "input_index", "confidence", "decision", "software_id", "conflicting_evidence"
    )


@query(
    "review_partition",
    f"""with {MATCHED}, held as (
      select program_id from c group by program_id having count(*) > 1)
    select k as input_index, case
        when z = 50 or program_id in (select program_id from held) then 'DUPLICATE_OR_INVALID'
        when conflict or n > 1 then 'AMBIGUOUS_REVIEW_REQUIRED'
        when n = 1 then 'EXISTING_CATALOG_MATCH' else 'UNMATCHED_COMMERCIAL_OPPORTUNITY' end as category,
      case when z <> 50 and program_id not in (select program_id from held) and not conflict and n = 1
        then id end as software_id
    from m""",
)
def review_partition(spark: SparkSession, sf: str) -> DataFrame:
    return programs.review_partition(candidates(spark, sf), inventory(spark, sf)).select(
        "input_index", "category", "software_id"
    )
