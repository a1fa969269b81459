"""Batch jobs over the supplied tables: identity, gate, publication, commands, assets, forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text, url
from shelfmark.functions.html import REJECTED_WORDS
from shelfmark.operators import links
from shelfmark.operators.checks import union_all
from shelfmark.plans import assets, forms, gate, identity, publish
from shelfmark.registry import query
from shelfmark.session import cut_lineage, scratch_path, spread, table
from shelfmark.sources import sinks

# Vendors and claims --------------------------------------------------------------------------


@query(
    "canonical_vendors",
    """with v as (select lower(p_brand || ' ' || p_type) as canonical_name,
        min_by(case when p_size < 25 then p_brand else upper(p_brand) end || ' ' || p_type, p_partkey)
          as vendor_name
      from part group by 1)
    select p_partkey as software_id, v.canonical_name, v.vendor_name,
      'V-' || left(sha256(v.canonical_name), 24) as vendor_id
    from part p join v on v.canonical_name = lower(p.p_brand || ' ' || p.p_type)""",
)
def canonical_vendors(spark: SparkSession, sf: str) -> DataFrame:
    spelled = F.when(F.col("p_size") < 25, F.col("p_brand")).otherwise(F.upper("p_brand"))
    software = table(spark, sf, "part").select(
        F.col("p_partkey").alias("software_id"),
        F.concat(F.lit(" "), spelled, F.lit("  "), "p_type").alias("vendor"),
    )
    vendors, linked = links.canonical_vendors(software)
    return linked.join(vendors.select("vendor_id", "vendor_name"), "vendor_id").select(
        "software_id", "canonical_name", "vendor_name", "vendor_id"
    )


@query(
    "backfill_links",
    r"""with p as (select page_id, case when url like 'https:%' then 'Active' else 'paused' end as status,
        ' ' || upper(left(url, 9)) || substr(url, 10) || '/ ' as u from pages),
    c as (select page_id as software_id, trim(u) as destination_url,
        lower(regexp_extract(trim(u), '^([^:]+)://', 1)) || '://'
          || lower(regexp_extract(trim(u), '^[^:]+://([^/?#]+)', 1))
          || regexp_replace(regexp_extract(trim(u), '^[^:]+://[^/?#]+(.*)$', 1), '/+$', '')
          as canonical_destination_url,
        'affiliate_program:' || lower(hex(encode('P' || page_id))) as legacy_source_key
      from p where status = 'Active')
    select software_id, destination_url, canonical_destination_url, legacy_source_key from c
    where not contains(destination_url, '?') and not contains(destination_url, '#')""",
)
def backfill_links(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a query are linked already by key, those with a fragment by product and URL."""
    shouted = F.concat(
        F.lit(" "), F.upper(F.substring("url", 1, 9)), F.expr("substring(url, 10)"), F.lit("/ ")
    )
    programs = table(spark, sf, "pages").select(
        F.col("page_id").alias("software_id"),
        F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("affiliate_program_id"),
        shouted.alias("affiliate_url"),
        F.when(F.col("url").startswith("https:"), "Active").otherwise("paused").alias("status"),
    )
    by_key = F.contains("affiliate_url", F.lit("?"))
    known = programs.filter(by_key | F.contains("affiliate_url", F.lit("#")))
    existing = known.select(
        "software_id",
        "affiliate_program_id",
        F.trim("affiliate_url").alias("destination_url"),
        F.when(by_key, "elsewhere").otherwise(url.canon_url_text(F.col("affiliate_url"))).alias(
            "canonical_destination_url"
        ),
        F.concat(
            F.lit("affiliate_program:"),
            F.when(by_key, text.hex_text(F.col("affiliate_program_id"))).otherwise("other"),
        ).alias("legacy_source_key"),
        F.lit(100).alias("priority"),
        F.lit("active").alias("status"),
        F.lit("pending").alias("verification_status"),
    )
    return links.backfill_links(programs, existing).select(
        "software_id", "destination_url", "canonical_destination_url", "legacy_source_key"
    )


@query(
    "seed_claims",
    """with s as (
      select 'software' as target_kind, p_partkey::varchar as target_id, 'name' as claim_type,
        'canonical' as claim_scope, p_name as normalized_value from part
      union all select 'software', p_partkey::varchar, 'slug', 'canonical',
        lower(p_brand) || '-' || p_partkey from part
      union all select 'vendor', s_suppkey::varchar, 'name', 'canonical',
        'supplier ' || lpad(s_suppkey::varchar, 9, '0') from supplier
      union all select 'vendor', s_suppkey::varchar, 'domain', 'official_vendor',
        's' || s_suppkey || '.example.com' from supplier where s_acctbal > 0
      union all select 'category', n_nationkey::varchar, 'name', 'canonical',
        lower(replace(n_name, '_', ' ')) from nation
      union all select 'category', n_nationkey::varchar, 'slug', 'canonical', lower(n_name) from nation)
    select * from s where not (claim_type = 'name' and target_kind = 'software'
      and target_id in (select p_partkey::varchar from part where p_size < 5))""",
)
def seed_claims(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    software = part.select(
        F.col("p_partkey").alias("software_id"),
        F.col("p_name").alias("software_name"),
        F.concat(F.lit(" "), "p_brand", F.lit("-"), "p_partkey").alias("slug"),
    )
    vendors = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        F.lit(None).cast("string").alias("slug"),
        F.when(
            F.col("s_acctbal") > 0, F.concat(F.lit("HTTP://www.S"), "s_suppkey", F.lit(".example.com/x"))
        ).alias("website_url"),
    )
    categories = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("category_id"),
        F.col("n_name").alias("category_name"),
        F.col("n_name").alias("slug"),
    )
    existing = part.filter("p_size < 5").select(
        F.lit("software").alias("target_kind"),
        F.col("p_partkey").cast("string").alias("target_id"),
        F.lit("name").alias("claim_type"),
        F.lit("canonical").alias("claim_scope"),
        F.col("p_name").alias("normalized_value"),
    )
    return identity.seed_claims(software, vendors, categories, existing).select(
        "target_kind", "target_id", "claim_type", "claim_scope", "normalized_value"
    )


# Identity ------------------------------------------------------------------------------------


def _identity_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Products up to size 25 and their brands are canonical; claims are verified up to size 20."""
    part = table(spark, sf, "part").withColumn("sid", F.concat(F.lit("S"), "p_partkey"))
    known = part.filter("p_size < 25")
    entities = known.select(
        F.lit("software").alias("kind"), F.col("sid").alias("id"), F.col("p_brand").alias("vendor_id")
    ).unionByName(
        part.select(
            F.lit("vendor").alias("kind"), F.col("p_brand").alias("id"),
            F.lit(None).cast("string").alias("vendor_id"),
        ).distinct()
    )

    def claim(df: DataFrame, kind: str, owner: Column, what: str, scope: str, value: Column) -> DataFrame:
        return df.select(
            F.lit(kind).alias("target_kind"), owner.alias("target_id"), F.lit(what).alias("claim_type"),
            F.lit(scope).alias("claim_scope"), value.alias("normalized_value"),
            F.lit("active").alias("status"),
            F.when(F.col("p_size") < 20, "2026-01-01").alias("verified_at"),
        )

    brand_site = F.concat(F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example.com"))
    full = F.concat("p_name", F.lit(" "), "p_type")
    claims = (
        claim(known, "software", F.col("sid"), "name", "canonical", F.lower(full))
        .unionByName(
            claim(known, "software", F.col("sid"), "slug", "canonical", F.concat(F.lit("p-"), "p_partkey"))
        )
        .unionByName(
            claim(
                part, "vendor", F.col("p_brand"), "domain", "official_vendor",
                F.concat(F.when(F.col("p_size") == 1, "").otherwise("old."), brand_site),
            ).distinct()
        )
    )
    # Identities of other sizes are known under ids that no record asks for.
    asked = F.when(F.col("p_size").isin(2, 3, 30), "").otherwise("x")
    existing = part.select(
        F.concat(F.lit("E"), "p_partkey").alias("external_identity_id"),
        F.lit("market").alias("provider_key"),
        F.lit("product").alias("external_object_type"),
        F.concat(asked, "p_partkey").alias("external_id"),
        F.when(F.col("p_size") == 3, "ignored").otherwise("reviewed_matched").alias("match_state"),
        F.lit("alias").alias("match_method"),
        F.lit(90).alias("confidence"),
        F.lit("software").alias("target_kind"),
        F.col("sid").alias("target_id"),
    )
    kind = F.col("p_type")
    records = part.select(
        F.col("p_partkey").alias("record_id"),
        F.lit("Market").alias("provider_key"),
        F.lit("Product").alias("external_object_type"),
        F.col("p_partkey").cast("string").alias("external_id"),
        F.lit("software").alias("target_kind"),
        F.when(kind.isin("MEDIUM", "ECONOMY", "SMALL"), full).alias("display_name"),
        F.when(kind == "STANDARD", F.concat(F.lit("P-"), "p_partkey")).alias("external_slug"),
        F.when(kind.isin("ECONOMY", "PROMO"), F.concat(F.lit("https://www."), brand_site, F.lit("/a"))).alias(
            "domain"
        ),
        F.when(kind == "SMALL", F.col("p_brand")).alias("confirmed_vendor_id"),
    )
    return {"records": records, "entities": entities, "claims": claims, "existing": existing}


@query(
    "match_identity",
    """with known as (select *, 'S' || p_partkey as sid from part where p_size < 25),
    verified as (select * from known where p_size < 20),
    sites as (select distinct p_brand from part where p_size = 1),
    r as (select p.*, case when p_type = 'SMALL' then p_brand
        when p_type in ('ECONOMY', 'PROMO') and p_brand in (select p_brand from sites) then p_brand end
        as evidence from part p),
    named as (
      select r.p_partkey as k, count(distinct v.sid) as n, min(v.sid) as sid from r join verified v
        on v.p_name = r.p_name and v.p_type = r.p_type
        and (r.evidence is null or v.p_brand = r.evidence)
      where r.p_type in ('MEDIUM', 'ECONOMY', 'SMALL') group by 1),
    vendors as (select distinct p_brand from known)
    select p_partkey as record_id, case
        when p_size = 30 then 'review' when p_size in (2, 3) then 'refresh'
        when p_type = 'STANDARD' and p_size < 20 then 'auto_bind'
        when n.n > 1 then 'review' when n.n = 1 and evidence is not null then 'auto_bind'
        when evidence in (select p_brand from vendors) then 'review' else 'unmatched' end as decision,
      case when p_size = 30 or p_size = 2 then 'reviewed_binding' when p_size = 3 then 'alias'
        when p_type = 'STANDARD' and p_size < 20 then 'alias'
        when n.n = 1 and evidence is not null then 'name_vendor' end as match_method,
      case when p_size = 30 then null when p_size in (2, 3) then 'S' || p_partkey
        when p_type = 'STANDARD' and p_size < 20 then 'S' || p_partkey
        when n.n = 1 and evidence is not null then n.sid end as target_id
    from r left join named n on n.k = r.p_partkey""",
)
def match_identity(spark: SparkSession, sf: str) -> DataFrame:
    t = _identity_tables(spark, sf)
    decided = identity.match_identity(t["records"], t["entities"], t["claims"], t["existing"])
    return decided.select("record_id", "decision", "match_method", "target_id")


# Candidate gate ------------------------------------------------------------------------------


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents read as candidate products.

    The text is the evidence. Name, vendor and category quote its beginning, the
    description its first line, the capability quotes the benchmark passage of the same id.
    """
    documents = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    passages = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.col("text").alias("passage")
    )
    joined = documents.join(labels, "doc_id", "left").join(passages, "doc_id", "left")
    site = F.concat(F.lit("https://d"), "doc_id", F.lit(".example.com/about"))
    opening = F.substring("text", 1, 50)
    line = F.get(F.split("text", "\n"), 0)

    def cite(quote: Column) -> Column:
        return F.array(F.struct(site.alias("sourceUrl"), quote.alias("quote")))

    def sourced(value: Column, quote: Column) -> Column:
        return F.struct(value.alias("value"), cite(quote).alias("citations"))

    category = F.struct(
        F.upper("source").alias("slug"),
        F.when(F.col("quality") == 1, 0.95).otherwise(F.lit(0.5)).alias("confidence"),
        cite(opening).alias("citations"),
    )
    body = F.struct(
        F.struct(
            F.lit("web").alias("providerKey"), F.lit("product").alias("externalObjectType"),
            F.when(F.col("lang") == "de", F.concat(F.lit("n"), "n_chars"))
            .otherwise(F.concat(F.lit("d"), "doc_id"))
            .alias("externalId"),
        ).alias("source"),
        sourced(F.concat(F.lit("Doc "), "doc_id"), opening).alias("productName"),
        sourced(F.concat(F.lit("Maker "), "lang"), opening).alias("vendorName"),
        site.alias("officialUrl"),
        F.lit(None).cast("string").alias("requestedSlug"),
        sourced(line, line).alias("description"),
        category.alias("primaryCategory"),
        F.lit(None)
        .cast("array<struct<slug: string, confidence: double, citations: array<struct<sourceUrl: string, quote: string>>>>")
        .alias("additionalCategories"),
        F.array(sourced(F.lit("Reads well"), F.coalesce("passage", opening))).alias("capabilities"),
        F.lit(None)
        .cast("struct<value: string, citations: array<struct<sourceUrl: string, quote: string>>>")
        .alias("pricing"),
        F.array(
            F.struct(
                site.alias("url"),
                F.lit("2026-01-01T00:00:00Z").alias("retrievedAt"),
                F.lit("official_product").alias("sourceType"),
                F.when(F.col("toxic") == 1, 403).otherwise(200).alias("httpStatus"),
                F.col("text").alias("content"),
            )
        ).alias("evidence"),
        F.when(F.col("lang") == "en", "NO_MONETIZATION_FOUND_YET").alias("monetizationClassification"),
        (F.col("lang") == "fr").alias("indiaRelevance"),
        F.lit(None).cast("string").alias("indiaRelevanceNote"),
        F.lit(None).cast("struct<code: string, message: string>").alias("acquisitionException"),
    )
    return joined.select(F.col("doc_id").alias("input_index"), body.alias("candidate"))


def _context(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All products, of which those of sizes one to five hold the names of documents; sources are categories.

    Of the makers, those that write English or French are known by name.
    """
    part = table(spark, sf, "part")
    software = part.select(
        F.concat(F.lit("S"), "p_partkey").alias("id"),
        F.when(F.col("p_size") < 3, F.concat(F.lit("doc-"), "p_partkey"))
        .otherwise(F.concat(F.lit("other-"), "p_partkey"))
        .alias("slug"),
        F.concat(F.when(F.col("p_size") <= 5, "DOC ").otherwise("PART "), "p_partkey").alias("name"),
        F.lit(None).cast("string").alias("vendorId"),
        F.lit("Maker en").alias("vendorName"),
        F.lit("https://x.example.com").alias("officialUrl"),
    )
    tongue = F.coalesce("lang", F.lit("none"))
    known = F.col("lang").isin("en", "fr")
    vendors = (
        table(spark, sf, "documents")
        .select(
            F.concat(F.lit("V"), tongue).alias("id"),
            F.concat(F.when(known, "maker-").otherwise("studio-"), tongue).alias("slug"),
            F.concat(F.when(known, "MAKER ").otherwise("STUDIO "), tongue).alias("name"),
            F.lit(None).cast("string").alias("officialUrl"),
        )
        .distinct()
    )
    categories = (
        table(spark, sf, "documents")
        .select(F.col("source").alias("id"), F.col("source").alias("slug"), F.col("source").alias("name"))
        .distinct()
    )
    return software, vendors, categories


SPACES = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _norm(value: str) -> str:
    return f"lower(trim(regexp_replace({value}, '{SPACES}+', ' ', 'g')))"


GATED = f"""p as (select p_partkey, p_size from part where p_size <= 5),
g as (
  select d.doc_id, d.lang, d.n_chars, d.text, coalesce(l.toxic, 0) = 1 as refused, coalesce(l.quality, 0) = 1 as sure,
    trim(regexp_replace(split_part(d.text, chr(10), 1), '^{SPACES}+|{SPACES}+$', '', 'g')) as line,
    coalesce(b.text, left(d.text, 50)) as claim, p.p_size,
    {_norm("d.text")} as body, {_norm("left(d.text, 50)")} as opening,
    {_norm("split_part(d.text, chr(10), 1)")} as first_line
  from documents d left join labels l using (doc_id) left join benchmark b on b.item_id = d.doc_id
  left join p on p.p_partkey = d.doc_id),
codes as (
  select *, list_concat(
    case when refused then ['NO_AUTHORITATIVE_SOURCE', 'CONFLICTING_EVIDENCE', 'CONFLICTING_EVIDENCE',
        'CONFLICTING_EVIDENCE', 'CONFLICTING_EVIDENCE', 'CONFLICTING_EVIDENCE']
      else list_concat(
        case when length(opening) >= 3 then [] else ['UNSUPPORTED_FACT', 'UNSUPPORTED_FACT'] end,
        case when length(first_line) >= 3 then [] else ['UNSUPPORTED_FACT'] end,
        case when length({_norm("claim")}) >= 3 and contains(body, {_norm("claim")}) then []
          else ['UNSUPPORTED_FACT'] end,
        case when length(opening) >= 3 then [] else ['UNSUPPORTED_FACT'] end) end,
    case when length(line) between 40 and 320 then [] else ['UNSUPPORTED_FACT'] end,
    case when sure then [] else ['CATEGORY_UNRESOLVED'] end,
    case when p_size < 3 or (p_size <= 5 and lang = 'en') then ['DUPLICATE_EXISTING_PRODUCT'] else [] end,
    case when p_size <= 5 and lang <> 'en' then ['AMBIGUOUS_IDENTITY'] else [] end) as codes
  from g)"""


@query(
    "candidate_gate",
    f"""with {GATED} select doc_id as input_index,
      case when len(codes) = 0 then 'READY' else 'EXCEPTION' end as decision,
      array_to_string(codes, ',') as codes,
      case when len(codes) = 0 then case when lang in ('en', 'fr') then 'existing' else 'create' end end
        as vendor_resolution
    from codes""",
)
def candidate_gate(spark: SparkSession, sf: str) -> DataFrame:
    gated = gate.candidate_gate(_candidates(spark, sf), *_context(spark, sf))
    return gated.select(
        "input_index",
        "decision",
        F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"),
        F.col("payload.vendor_resolution").alias("vendor_resolution"),
    )


BATCH = f"""{GATED}, batch as (
  select *, lang = 'de' and row_number() over (partition by lang, n_chars order by doc_id) > 1 as repeated
  from codes)"""


@query(
    "run_batch",
    f"""with {BATCH} select doc_id as input_index,
      case when len(codes) = 0 and not repeated then 'READY' else 'EXCEPTION' end as decision,
      case when repeated then 'DUPLICATE_EXISTING_PRODUCT' else array_to_string(codes, ',') end as codes
    from batch""",
)
def run_batch(spark: SparkSession, sf: str) -> DataFrame:
    results = gate.run_batch(_candidates(spark, sf), *_context(spark, sf))
    return results.select(
        "input_index",
        "decision",
        F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("codes"),
    )


@query(
    "batch_counters",
    f"""with {BATCH} select count(*) as processed,
      count(*) filter (len(codes) = 0 and not repeated) as ready,
      count(*) filter (len(codes) > 0 or repeated) as exceptions,
      count(*) filter (repeated or list_contains(codes, 'DUPLICATE_EXISTING_PRODUCT'))
        as duplicates_detected
    from batch""",
)
def batch_counters(spark: SparkSession, sf: str) -> DataFrame:
    return gate.batch_counters(gate.run_batch(_candidates(spark, sf), *_context(spark, sf)))


@query(
    "batch_report",
    f"""with {BATCH}, t as (
      select lower(line) as d, count(*) as n from batch group by 1),
    ready as (select upper(source) as category, count(*) as ready
      from batch join documents using (doc_id) where len(codes) = 0 and not repeated group by 1),
    categories as (
      select upper(source) as category, 5::bigint as before, count(*) as candidates,
        coalesce(max(ready), 0)::bigint as ready, 5 + coalesce(max(ready), 0)::bigint as projected
      from documents left join ready on category = upper(source) group by 1),
    figures as (
      select count(*) filter (lang = 'fr') as india_relevant_candidates, count(*) as evidence_documents,
        count(*) filter (not refused) as successful_evidence_documents,
        count(*) filter (refused) as http_403, 0::bigint as http_429,
        count(distinct doc_id) as unique_evidence_urls,
        (select count(*) from t where n > 1) as duplicate_descriptions,
        count(*) filter (repeated or list_contains(codes, 'DUPLICATE_EXISTING_PRODUCT'))
          as pre_existing_conflicts,
        count(*) filter (not repeated and list_contains(codes, 'AMBIGUOUS_IDENTITY')) as identity_conflicts,
        count(*) filter (lang = 'fr' and len(codes) = 0 and not repeated) as india_relevant_ready,
        200 + count(*) filter (len(codes) = 0 and not repeated) as projected_published,
        200::bigint as published_before,
        greatest(0, 200 - (select 5 * count(*) from categories))::bigint as uncategorised_before
      from batch)
    select categories.*, figures.* from categories, figures""",
)
def batch_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    before = (
        table(spark, sf, "documents")
        .select(F.upper("source").alias("category"), F.lit(5).alias("published"))
        .distinct()
    )
    results = cut_lineage(gate.run_batch(rows, *_context(spark, sf)))
    return gate.whole_report(rows, results, before, published_before=200)


@query(
    "batch_figures",
    f"""with {BATCH}, t as (
      select lower(line) as d, count(*) as n from batch group by 1)
    select count(*) filter (lang = 'fr') as india_relevant_candidates, count(*) as evidence_documents,
      count(*) filter (not refused) as successful_evidence_documents,
      count(*) filter (refused) as http_403, 0::bigint as http_429,
      count(distinct doc_id) as unique_evidence_urls,
      (select count(*) from t where n > 1) as duplicate_descriptions,
      count(*) filter (repeated or list_contains(codes, 'DUPLICATE_EXISTING_PRODUCT'))
        as pre_existing_conflicts,
      count(*) filter (not repeated and list_contains(codes, 'AMBIGUOUS_IDENTITY')) as identity_conflicts,
      count(*) filter (lang = 'fr' and len(codes) = 0 and not repeated) as india_relevant_ready,
      100 + count(*) filter (len(codes) = 0 and not repeated) as projected_published,
      100::bigint as published_before, 40::bigint as uncategorised_before
    from batch""",
)
def batch_figures(spark: SparkSession, sf: str) -> DataFrame:
    rows = _candidates(spark, sf)
    results = cut_lineage(gate.run_batch(rows, *_context(spark, sf)))
    return gate.batch_report(rows, results, published_before=100, categorised_before=60)


@query(
    "read_batch",
    """select doc_id as input_index, 'Doc ' || doc_id as product, upper(source) as category,
      1 as documents, sha256(text) as digest from documents""",
)
def read_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates written as batch files of up to fifty and read back."""
    from shelfmark.registry.programs import as_files
    from shelfmark.sources.captures import read_batch as read

    empty = F.array().cast("array<struct<id: string>>")
    context = F.struct(empty.alias("software"), empty.alias("vendors"), empty.alias("categories"))
    packed = _candidates(spark, sf).groupBy(F.floor(F.col("input_index") / 50).cast("string").alias("file")).agg(
        F.sort_array(F.collect_list(F.struct("input_index", F.to_json("candidate").alias("json")))).alias("rows")
    )
    files = packed.select(
        "file",
        F.concat(
            F.lit('{"candidates":['), F.array_join(F.transform("rows", lambda r: r["json"]), ","),
            F.lit('],"context":'), F.to_json(context), F.lit("}"),
        ).alias("value"),
    )
    c = F.col("candidate")
    return read(spark, as_files(files, "batches"))["candidates"].select(
        F.regexp_extract(c["productName"]["value"], "[0-9]+", 0).cast("long").alias("input_index"),
        c["productName"]["value"].alias("product"),
        c["primaryCategory"]["slug"].alias("category"),
        F.size(c["evidence"]).alias("documents"),
        F.sha2(c["evidence"][0]["content"], 256).alias("digest"),
    )


# Publication ---------------------------------------------------------------------------------


@query(
    "prepare_publication",
    f"""with {BATCH} select 'PF-' || left(sha256('doc-' || doc_id), 24) as software_id,
      'doc-' || doc_id as software_slug, 'maker ' || lang as vendor_canonical_name,
      'https://d' || doc_id || '.example.com/about' as source_url
    from batch where len(codes) = 0 and not repeated""",
)
def prepare_publication(spark: SparkSession, sf: str) -> DataFrame:
    results = cut_lineage(gate.run_batch(_candidates(spark, sf), *_context(spark, sf)))
    return publish.prepare_publication(results).select(
        "software_id", "software_slug", "vendor_canonical_name", "source_url"
    )


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Products above size 25 proposed for a catalogue of those up to 25."""
    part = table(spark, sf, "part").filter("p_size > 25")
    key = F.col("p_partkey").cast("string")
    slug = F.concat(F.lit("p-"), key)
    name = F.concat("p_name", F.lit(" "), F.col("p_size") - 25)
    return part.select(
        F.concat(F.lit('["web","product","'), key, F.lit('"]')).alias("idempotency_key"),
        F.lit("web").alias("provider_key"),
        F.lit("product").alias("external_object_type"),
        F.col("p_partkey").cast("string").alias("external_id"),
        F.concat(F.lit("PF-"), key).alias("software_id"),
        name.alias("software_name"),
        slug.alias("software_slug"),
        F.when(F.col("p_type") == "SMALL", "existing").otherwise("create").alias("vendor_resolution"),
        F.when(F.col("p_type") == "SMALL", F.col("p_brand")).alias("vendor_id"),
        F.col("p_brand").alias("vendor_name"),
        F.lower("p_brand").alias("vendor_canonical_name"),
        F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")).alias("vendor_slug"),
        F.concat(F.lit("https://"), F.replace(F.lower("p_brand"), F.lit("#"), F.lit("")), F.lit(".example.com")).alias(
            "vendor_website_url"
        ),
        F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.com/"), F.col("p_partkey") / 10).alias(
            "website_url"
        ),
        F.lit("d").alias("short_description"),
        F.lit("k").alias("key_features"),
        F.lit(None).cast("string").alias("pricing"),
        F.array(
            F.struct(
                F.lit("c1").alias("category_id"), F.lit("c-1").alias("slug"),
                F.lit(True).alias("primary_category"),
            )
        ).alias("categories"),
        F.concat(F.lit("https://s/"), key).alias("source_url"),
        F.lit("2026-01-01T00:00:00Z").alias("source_observed_at"),
        F.lit("b").alias("batch_id"),
        F.lit("x").alias("batch_digest"),
    )


def _catalogue(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    part = table(spark, sf, "part").filter("p_size <= 25")
    none = F.lit(None).cast("string")
    brands = table(spark, sf, "part").select("p_brand").distinct()
    number = F.split("p_brand", "#")[1].cast("int")
    return {
        "software": part.select(
            F.concat(F.lit("S"), "p_partkey").alias("software_id"),
            F.concat(F.lit("p-"), F.col("p_partkey") + 1).alias("slug"),
            F.concat(F.initcap("p_name"), F.lit("  "), "p_size").alias("software_name"),
            F.col("p_brand").alias("vendor"),
            F.concat(F.lit("https://"), F.lower("p_type"), F.lit(".example.com/"), (F.col("p_partkey") + 3) / 10, F.lit("//")).alias(
                "website_url"
            ),
            F.lit("published").alias("publication_status"),
        ),
        # Brands up to 15 are vendors; those up to 5 under another name.
        "vendors": brands.filter(number <= 15).select(
            F.col("p_brand").alias("vendor_id"),
            F.when(number <= 5, F.concat("p_brand", F.lit(" old"))).otherwise(F.col("p_brand")).alias(
                "vendor_name"
            ),
            F.when(number <= 5, F.concat(F.lower("p_brand"), F.lit(" old")))
            .otherwise(F.lower("p_brand"))
            .alias("canonical_name"),
            F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-")).alias("slug"),
            none.alias("website_url"),
        ),
        "identities": part.filter("p_size < 5").select(
            F.lit("web").alias("provider_key"), F.lit("product").alias("external_object_type"),
            (F.col("p_partkey") + 2).cast("string").alias("external_id"),
            F.concat(F.lit("S"), "p_partkey").alias("software_id"),
        ),
        "claims": part.filter("p_size > 20").select(
            F.concat(F.lit("S"), "p_partkey").alias("software_id"),
            none.alias("vendor_id"),
            F.lit("slug").alias("claim_type"),
            F.lit("canonical").alias("claim_scope"),
            F.concat(F.lit("p-"), F.col("p_partkey") + 4).alias("normalized_value"),
            F.lit("active").alias("status"),
            F.expr("timestamp_ntz'2026-01-01 00:00:00'").alias("verified_at"),
        ),
        "relations": part.select(
            F.concat(F.lit("S"), "p_partkey").alias("software_id"), F.lit("c1").alias("category_id"),
            F.lit(True).alias("primary_category"),
        ),
        "providers": spark.createDataFrame([("other",)], "provider_key string"),
    }


DISPOSED = """s as (select *, lower(p_name) || ' ' || p_size as n from part where p_size <= 25),
r as (select *, p_name || ' ' || (p_size - 25) as n, split_part(p_brand, '#', 2)::int as b
  from part where p_size > 25),
f as (
  select r.*,
    exists (select 1 from s where s.p_size < 5 and s.p_partkey + 2 = r.p_partkey) as by_identity,
    exists (select 1 from s where s.p_partkey + 1 = r.p_partkey) as by_slug,
    exists (select 1 from s where s.p_partkey + 1 = r.p_partkey and s.n = r.n and s.p_brand = r.p_brand)
      as slug_same,
    exists (select 1 from s where s.n = r.n and s.p_brand = r.p_brand) as by_product,
    exists (select 1 from s where s.n = r.n and s.p_brand <> r.p_brand) as by_other,
    exists (select 1 from s where s.p_partkey + 3 = r.p_partkey and s.p_type = r.p_type) as by_site,
    exists (select 1 from s where s.p_size > 20 and s.p_partkey + 4 = r.p_partkey) as by_claim
  from r),
d as (
  select *, case when by_identity then 'EXCLUDED_IDENTITY_CONFLICT'
    when by_slug then case when slug_same then 'ALREADY_PRESENT' else 'EXCLUDED_SOFTWARE_CONFLICT' end
    when by_product then 'ALREADY_PRESENT' when by_other then 'EXCLUDED_AMBIGUOUS_IDENTITY'
    when by_site then 'EXCLUDED_SOFTWARE_CONFLICT' when by_claim then 'EXCLUDED_IDENTITY_CONFLICT'
    when p_type = 'SMALL' and (b <= 5 or b > 15) then 'EXCLUDED_VENDOR_CONFLICT'
    when p_type <> 'SMALL' and b <= 5 then 'EXCLUDED_VENDOR_CONFLICT' else 'READY' end as disposition
  from f)"""


@query(
    "dispose",
    f"with {DISPOSED} select 'PF-' || p_partkey as software_id, disposition from d",
)
def dispose(spark: SparkSession, sf: str) -> DataFrame:
    decided = publish.dispose(_records(spark, sf), _catalogue(spark, sf))
    return decided.select("software_id", "disposition")


@query(
    "merge_publication",
    f"""with {DISPOSED} select 'S' || p_partkey as software_id, null as vendor_id,
      'published' as publication_status from part where p_size <= 25
    union all select 'PF-' || p_partkey,
      case when b <= 15 then p_brand else 'V-' || left(sha256(lower(p_brand)), 24) end, 'published'
    from d where disposition = 'READY'""",
)
def merge_publication(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = _catalogue(spark, sf)
    catalogue["software"] = catalogue["software"].withColumn("vendor_id", F.lit(None).cast("string"))
    decided = cut_lineage(publish.dispose(_records(spark, sf), catalogue))
    after = publish.merge_publication(decided, catalogue, F.lit("2026-01-01"))
    return after["software"].select("software_id", "vendor_id", "publication_status")


@query(
    "merge_growth",
    f"""with {DISPOSED}, ready as (select * from d where disposition = 'READY')
    select 'software' as name, (select count(*) from part where p_size <= 25) as before, count(*) as added from ready
    union all select 'identities', (select count(*) from part where p_size < 5), count(*) from ready
    union all select 'relations', (select count(*) from part where p_size <= 25), count(*) from ready
    union all select 'vendors', (select count(distinct p_brand) from part where split_part(p_brand, '#', 2)::int <= 15),
      count(distinct p_brand) from ready where b > 15""",
)
def merge_growth(spark: SparkSession, sf: str) -> DataFrame:
    """How each table grows by a merge whose outcome was verified."""
    catalogue = _catalogue(spark, sf)
    catalogue["software"] = catalogue["software"].withColumn("vendor_id", F.lit(None).cast("string"))
    decided = cut_lineage(publish.dispose(_records(spark, sf), catalogue))
    after = publish.merge_publication(decided, catalogue, F.lit("2026-01-01"))
    # kept, as they are verified and counted
    after = {name: cut_lineage(after[name]) for name in ("software", "identities", "relations", "vendors", "new_vendors")}
    publish.verify_merge(catalogue, after, decided)

    def size(name: str) -> DataFrame:
        old = catalogue[name].agg(F.count(F.lit(1)).alias("before"))
        new = after[name].agg(F.count(F.lit(1)).alias("after"))
        return old.join(new, F.lit(True)).select(
            F.lit(name).alias("name"), "before", (F.col("after") - F.col("before")).alias("added")
        )

    return union_all([size(name) for name in ("software", "identities", "relations", "vendors")])


# Commands ------------------------------------------------------------------------------------


@query(
    "apply_verification",
    """with c as (
      select event_id, user_id, ts, case when event_type in ('click', 'view') then 'verify' else 'return' end
          as kind, event_type <> 'error' as valid,
        case when c_acctbal > 5000 then 'verified' when c_acctbal > 0 then 'needs_verification'
          else 'pending' end as initial, c_custkey is not null as found
      from events left join customer on c_custkey = user_id and c_nationkey < 20),
    o as (select *, lag(kind) over (partition by user_id order by ts, event_id) as before
      from c where valid and found)
    select c.event_id as command_id, case when not c.valid then 'invalid_input'
      when not c.found then 'not_found'
      when c.initial = 'pending' then 'invalid_transition'
      when c.kind = 'verify' and coalesce(o.before, case c.initial when 'verified' then 'verify'
        else 'return' end) = 'return' then 'success'
      when c.kind = 'return' and coalesce(o.before, case c.initial when 'verified' then 'verify'
        else 'return' end) = 'verify' then 'success' else 'invalid_transition' end as result
    from c left join o using (event_id)""",
)
def apply_verification(spark: SparkSession, sf: str) -> DataFrame:
    verify = F.col("event_type").isin("click", "view")
    commands = table(spark, sf, "events").select(
        F.col("event_id").alias("command_id"),
        F.col("user_id").cast("string").alias("software_id"),
        F.col("ts").alias("at"),
        F.when(verify, "verify").otherwise("return").alias("kind"),
        F.lit("https://a.example.com/x").alias("source_url"),
        F.when(F.col("event_type") != "error", "why").alias("note"),
    )
    balance = F.col("c_acctbal")
    software = table(spark, sf, "customer").filter("c_nationkey < 20").select(
        F.col("c_custkey").cast("string").alias("software_id"),
        F.when(balance > 5000, "verified")
        .when(balance > 0, "needs_verification")
        .otherwise("pending")
        .alias("verification_status"),
        F.lit(None).cast("timestamp_ntz").alias("verified_at"),
    )
    results, _ = publish.apply_verification(commands, software)
    return results.select("command_id", "result")


@query(
    "apply_publication",
    """with c as (
      select o_orderkey, o_orderdate, o_custkey,
        case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'published' else 'in_review' end as target,
        case when c_acctbal > 5000 then 'published' when c_acctbal > 0 then 'in_review' end as initial
      from orders left join customer on c_custkey = o_custkey),
    o as (select *, lag(target) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from c)
    select o_orderkey as command_id, target, case when initial is not null and coalesce(before, initial) <> target
        then 'success' else 'invalid_transition' end as result,
      case when initial is not null then target end as publication_status
    from o""",
)
def apply_publication(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as commands on their customers, in order of time; customers in debt have no state."""
    commands = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("command_id"),
        F.col("o_custkey").alias("software_id"),
        F.col("o_orderdate").alias("at"),
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "published").otherwise("in_review").alias("target"),
    )
    balance = F.col("c_acctbal")
    software = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("software_id"),
        F.when(balance > 5000, "published").when(balance > 0, "in_review").alias("publication_status"),
    )
    done = publish.apply_publication(commands, software)
    return done.select("command_id", "target", "result", "publication_status")


# Page assets ---------------------------------------------------------------------------------


def _crawl(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Pages as product sites. The crawled HTML gets a header with an icon and an image.

    Images are PNG headers; pages in French share one picture, German ones have too small a
    picture and plain http pages are unsafe.
    """
    language = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    pages = table(spark, sf, "pages").select(
        "page_id",
        F.col("url").alias("page_url"),
        "html",
        language.alias("lang"),
        F.concat(F.lit("Site "), "page_id").alias("name"),
        F.concat(F.lit("https://cdn.example.com/site"), "page_id", F.lit("-logo.png")).alias("logo"),
    )
    header = F.concat(
        F.lit('<link rel="icon" sizes="16x16" href="/icon.png"><img class="logo" alt="'), "name",
        F.lit(' logo" src="'), "logo", F.lit('">'), "html",
    )
    side = F.when(F.col("lang") == "de", 8).otherwise(64 + F.col("page_id") % 900)
    wide = F.when(F.col("lang") == "fr", 500).otherwise(side)
    bytes_ = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(wide.cast("bigint")), 8, "0"),
        F.lpad(F.hex(F.lit(100)), 8, "0"),
        F.when(F.col("lang") == "fr", F.lit("00000000")).otherwise(
            F.lpad(F.hex(F.col("page_id")), 8, "0")
        ),
    )
    none = F.lit(None).cast("string")
    return {
        "products": pages.select(
            F.col("page_id").alias("product_id"),
            F.concat(F.lit("site-"), "page_id").alias("slug"),
            "name",
            F.col("page_url").alias("website_url"),
            F.lit("Maker").alias("vendor_name"),
            F.lit("maker").alias("vendor_slug"),
            none.alias("vendor_website"),
        ),
        "pages": pages.select(
            F.col("page_id").alias("product_id"),
            F.col("page_url").alias("url"),
            F.when(F.col("lang") == "es", 403).otherwise(200).alias("status"),
            F.lit("text/html").alias("content_type"),
            header.alias("html"),
        ),
        "images": pages.select(
            F.col("logo").alias("url"),
            F.lit(200).alias("status"),
            F.lit("image/png").alias("content_type"),
            F.unhex(bytes_).alias("bytes"),
        ),
        "manifests": pages.select(
            F.col("page_url").alias("url"), F.lit(404).alias("status"), none.alias("json")
        ),
    }


@query(
    "page_assets",
    """with u as (select page_id, url, 'https://cdn.example.com/site' || page_id || '-logo.png' as logo
      from pages)
    select page_id as product_id, logo as url, 'logo_image' as kind, 94 as score from u
    union all select page_id, regexp_extract(url, '^(https://[^/?#]+)', 1) || '/icon.png', 'favicon', 52
    from u where url like 'https:%' and not regexp_matches(lower(url), '^[^/]*//[^/]*(REJECTED)')""".replace(
        "REJECTED", "|".join(REJECTED_WORDS)
    ),
)
def page_assets(spark: SparkSession, sf: str) -> DataFrame:
    crawl = _crawl(spark, sf)
    products = crawl["products"].select("product_id", "name", "vendor_name", F.col("website_url").alias("url"))
    pages = products.join(crawl["pages"], ["product_id", "url"]).withColumnRenamed("url", "page_url")
    found = assets.page_assets(pages.select("product_id", "page_url", "html", "name", "vendor_name"))
    return found.select("product_id", "url", "kind", "score")


PICKED = r"""site as (select page_id, url, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang from pages),
picked as (
  select page_id, lang, case when url not like 'https:%' then 'unsafe_url' when lang = 'es' then 'blocked'
    when lang = 'de' then 'invalid_assets' end as reason from site)"""


@query(
    "pick_asset",
    f"""with {PICKED} select page_id as product_id,
      case when reason is null then 'success' else 'fallback' end as status, reason,
      case when reason is null then 'product' end as source_kind,
      case when reason is null then case when lang = 'fr' then 500 else 64 + page_id % 900 end end as width
    from picked""",
)
def pick_asset(spark: SparkSession, sf: str) -> DataFrame:
    picked = assets.pick_asset(**_crawl(spark, sf))
    return picked.select("product_id", "status", "reason", "source_kind", "width")


@query(
    "write_provenance",
    f"""with {PICKED}, n as (select *, count(*) filter (reason is null and lang = 'fr') over () as shared
      from picked)
    select 'site-' || page_id as slug, case when reason is null and not (lang = 'fr' and shared > 1)
        then 'success' else 'fallback' end as status,
      case when reason is null and lang = 'fr' and shared > 1 then 'ambiguous_identity' else reason end
        as reason,
      case when reason is null and not (lang = 'fr' and shared > 1)
        then '/software-logos/site-' || page_id || '.png' end as asset_path
    from n""",
)
def write_provenance(spark: SparkSession, sf: str) -> DataFrame:
    outcomes = cut_lineage(assets.pick_asset(**_crawl(spark, sf)))
    rows = sinks.provenance(assets.reject_shared(outcomes))
    written = sinks.write_result(rows, "status")
    return written.select("slug", "status", "reason", "asset_path")


@query(
    "reject_shared",
    """with h as (select doc_id, sha256(text) as sha256 from documents)
    select doc_id as product_id, case when count(*) over (partition by sha256) > 1 then 'fallback'
      else 'success' end as status,
      case when count(*) over (partition by sha256) > 1 then 'ambiguous_identity' end as reason
    from h""",
)
def reject_shared(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("string")
    outcomes = table(spark, sf, "documents").select(
        F.col("doc_id").alias("product_id"),
        F.lit("success").alias("status"),
        none.alias("reason"),
        F.lit(200).alias("page_http_status"),
        F.lit(0).cast("long").alias("invalid_candidates"),
        F.sha2("text", 256).alias("sha256"),
    )
    return assets.reject_shared(outcomes).select("product_id", "status", "reason")


@query(
    "manifest_icons",
    """select p_partkey as product_id, 'https://m.example.com/' || p_partkey || '/i.png' as url,
      case when p_size >= 40 then 76 else 64 end as score from part
    union all select p_partkey, 'https://m.example.com/j-' || p_size || '.png', 64 from part""",
)
def manifest_icons(spark: SparkSession, sf: str) -> DataFrame:
    sizes = F.when(F.col("p_size") >= 40, "512x512").otherwise("48x48")
    icons = F.concat(
        F.lit('{"icons":[{"src":"i.png","sizes":"'), sizes, F.lit('"},{"src":"/j-'), "p_size",
        F.lit('.png"},{"src":"http://plain.example.com/x.png"},{"sizes":"1x1"}]}'),
    )
    manifests = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.concat(F.lit("https://m.example.com/"), "p_partkey", F.lit("/manifest.json")).alias(
            "manifest_url"
        ),
        icons.alias("json"),
    )
    return assets.manifest_icons(manifests).select("product_id", "url", "score")


@query(
    "image_source",
    """select s_suppkey, octet_length(b) as length, sha256(b) as digest, 40 + s_nationkey as width, 40 + s_suppkey % 60 as height
    from (select *, unhex('89504E470D0A1A0A0000000D49484452' || printf('%08X', 40 + s_nationkey)
      || printf('%08X', (40 + s_suppkey % 60)::int) || '0802000000' || hex(encode(repeat(s_name, (1 + s_suppkey % 400)::int)))) as b
      from supplier)""",
)
def image_source(spark: SparkSession, sf: str) -> DataFrame:
    """An image file per supplier, written and read back: sizes from its first bytes, length and digest from all of them."""
    from shelfmark.plans.assets import image_header
    from shelfmark.sources import captures, sinks

    def four_bytes(c: Column) -> Column:
        return F.lpad(F.hex(c.cast("bigint")), 8, "0")

    header = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"), four_bytes(40 + F.col("s_nationkey")), four_bytes(40 + F.col("s_suppkey") % 60),
        F.lit("0802000000"), F.hex(F.repeat("s_name", (1 + F.col("s_suppkey") % 400).cast("int"))),
    )
    images = table(spark, sf, "supplier").select(F.concat("s_suppkey", F.lit(".png")).alias("name"), F.unhex(header).alias("bytes"))
    folder = scratch_path(spark, "images")
    sinks.write_files(images, folder)
    whole = captures.read_images(spark, folder, "*.png").select("url", "length", F.sha2("bytes", 256).alias("digest"))
    heads = captures.read_image_heads(spark, folder, "*.png", size=64).select("url", F.col("head").alias("bytes"), F.lit("image/png").alias("content_type"))
    return whole.join(image_header(heads).select("url", "width", "height"), "url").select(
        F.regexp_extract("url", "([0-9]+)[.]png$", 1).cast("bigint").alias("s_suppkey"), "length", "digest", "width", "height"
    )


@query(
    "classify_asset",
    """select p_partkey, case when p_type = 'PROMO' then 'favicon'
      when p_size < 20 then 'product' when p_type = 'SMALL' then 'vendor' end as kind
    from part""",
)
def classify_asset(spark: SparkSession, sf: str) -> DataFrame:
    """Icons on an own host; images named after the product; structured marks of namesakes."""
    key = F.col("p_partkey").cast("string")
    promo, small = F.col("p_type") == "PROMO", F.col("p_type") == "SMALL"
    name = F.concat(F.lit("Item "), key, F.lit(" Pro"))
    file = F.when(F.col("p_size") < 20, F.concat(F.lit("item"), key, F.lit("pro"))).otherwise("mark")
    kind = assets.classify_asset(
        F.concat(F.lit("https://cdn.example.com/a/"), file, F.lit(".png?x=1")),
        F.lit("logo"),
        F.when(promo, "favicon").when(small, "structured_logo").otherwise("logo_image"),
        name,
        F.concat(F.lit("item-"), key),
        F.when(promo, "https://own.example.com/").otherwise("https://maker.example.com/p"),
        F.when(small, name).otherwise("Maker"),
        F.lit("maker"),
        F.lit("https://www.maker.example.com"),
    )
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"))


# Forms ---------------------------------------------------------------------------------------


def _snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Products as application forms whose wording depends on the product."""
    none = F.lit(None).cast("string")
    options = F.array(
        F.struct(F.lit("Norway").alias("label"), F.lit("no").alias("value")),
        F.struct(F.col("p_brand").alias("label"), F.lower("p_brand").alias("value")),
    )
    no_options = F.lit(None).cast("array<struct<label: string, value: string>>")

    def control(order: int, tag: str, kind: str | None, label, name=none, listed=no_options) -> Column:
        return F.struct(
            F.lit(tag).alias("tagName"), F.lit(kind).cast("string").alias("inputType"),
            none.alias("kind"), none.alias("role"), none.alias("id"), name.alias("name"),
            F.lit(order).alias("order"), label.alias("label"),
            F.lit(True).alias("visible"), F.lit(True).alias("enabled"), F.lit(order < 3).alias("required"),
            listed.alias("options"), none.alias("radioGroupLabel"), none.alias("radioOptionLabel"),
            none.alias("radioOptionValue"),
        )

    controls = F.array(
        control(1, "select", None, F.lit("Country *"), listed=options),
        control(2, "input", "url", F.lit("Website")),
        control(3, "input", "radio", F.col("p_name"), F.lit("size")),
        control(4, "input", "radio", F.col("p_type"), F.lit("size")),
        control(5, "input", "checkbox", F.concat(F.lit("I agree, "), "p_name")),
        control(6, "input", "hidden", F.lit("x")),
    )
    empty = F.filter(controls, lambda c: F.lit(False))
    return spread(spark, sf, "part", "p_partkey").select(
        F.col("p_partkey").alias("program_id"),
        F.col("p_name").alias("program_name"),
        F.lit("https://x.partnerstack.com/apply?a=1").alias("page_url"),
        F.lit("2026-01-01").alias("captured_at"),
        (F.col("p_size") < 5).alias("auth_required"),
        (F.col("p_size") > 8).alias("form_found"),
        F.lit(False).alias("unsupported"),
        none.alias("unsupported_reason"),
        F.when(F.col("p_size") > 45, empty).otherwise(controls).alias("controls"),
    )


def _profile(spark: SparkSession, sf: str) -> DataFrame:
    """A profile whose country is the first brand's name: it answers that brand's forms."""
    first = table(spark, sf, "part").agg(F.min("p_brand").alias("brand"))
    return first.select(
        F.explode(
            F.array(
                F.struct(F.lit("country").alias("field"), F.col("brand").alias("value")),
                F.struct(F.lit("website").alias("field"), F.lit("https://me.example.com").alias("value")),
            )
        ).alias("f")
    ).select(
        "f.field", "f.value", F.lit(True).alias("is_text"), F.lit(True).alias("approved"),
        F.lit(None).cast("array<string>").alias("entries"), F.lit("part").alias("reference"),
        F.lit(None).cast("string").alias("observed_at"),
    )


STATE = """case when p_size < 5 then 'AUTH_REQUIRED' when p_size <= 8 then 'FORM_NOT_FOUND'
  when p_size > 45 then 'UNSUPPORTED_FORM' else 'CAPTURED' end"""


@query(
    "fold_form",
    f"""with c as (select * from part where {STATE} = 'CAPTURED'), q as (
      select p_partkey, 1 as position, 'Country *' as exact_label, 'COUNTRY' as semantic_key,
        'select' as field_type, 'Norway,' || p_brand as options from c
      union all select p_partkey, 2, 'Website', 'WEBSITE', 'url', '' from c
      union all select p_partkey, 3, p_name, null, 'radio', p_name || ',' || p_type from c
      union all select p_partkey, 5, 'I agree, ' || p_name, 'LEGAL_ATTESTATION', 'checkbox', '' from c)
    select p_partkey as program_id, position, exact_label, semantic_key, field_type, options from q""",
)
def fold_form(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.array_join(F.transform("options", lambda o: o["label"]), ",")
    return forms.fold_form(_snapshots(spark, sf)).select(
        "program_id", "position", "exact_label", "semantic_key", "field_type",
        F.coalesce(shown, F.lit("")).alias("options"),
    )


@query(
    "prepare_answers",
    f"""with c as (select * from part where {STATE} = 'CAPTURED')
    select p_partkey as program_id, 1 as position,
      case when p_brand = (select min(p_brand) from part) then lower(p_brand) end as value,
      p_brand <> (select min(p_brand) from part) as review_required from c
    union all select p_partkey, 2, 'https://me.example.com', false from c
    union all select p_partkey, 3, null, true from c
    union all select p_partkey, 5, null, true from c""",
)
def prepare_answers(spark: SparkSession, sf: str) -> DataFrame:
    answers = forms.prepare_answers(forms.fold_form(_snapshots(spark, sf)), _profile(spark, sf))
    return answers.select("program_id", "position", "value", "review_required")


@query(
    "prepare_report",
    f"""with s as (select *, {STATE} as state, p_brand = (select min(p_brand) from part) as own from part)
    select p_partkey as program_id, state as form_state,
      case when state = 'CAPTURED' then 'NEEDS_REVIEW' else 'NOT_READY' end as readiness,
      case when state <> 'CAPTURED' then 0 else 4 end as answers,
      case when state <> 'CAPTURED' then 0 when own then 2 else 1 end as auto_answers,
      case when state <> 'CAPTURED' then 0 when own then 2 else 3 end as review_questions,
      case when state <> 'CAPTURED' then 0 else 1 end as legal_items
    from s""",
)
def prepare_report(spark: SparkSession, sf: str) -> DataFrame:
    snapshots = _snapshots(spark, sf)
    answers = forms.prepare_answers(forms.fold_form(snapshots), _profile(spark, sf))
    return forms.prepare_report(snapshots, answers).select(
        "program_id", "form_state", "readiness", "answers", "auto_answers", "review_questions",
        "legal_items",
    )
