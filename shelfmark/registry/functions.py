"""Scalar functions over whole columns of the supplied tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import html, keys, rules, text, url
from shelfmark.plans.publish import batch_digest as digest_of
from shelfmark.registry import query
from shelfmark.session import table

BLANK = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
SQUEEZED = rf"trim(regexp_replace(text, '{BLANK}+', ' ', 'g'))"
WORDS = r"trim(regexp_replace(replace(lower(text), '&', ' and '), '[^\p{L}\p{N}]+', ' ', 'g'))"


def _documents(spark: SparkSession, sf: str, value: Column) -> DataFrame:
    """Each text's result as a digest: whole texts, short rows."""
    return table(spark, sf, "documents").select("doc_id", F.sha2(value, 256).alias("digest"))


def _digest(sql: str) -> str:
    return f"select doc_id, sha256({sql}) as digest from documents"


@query("norm_name", _digest(WORDS))
def norm_name(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, text.norm_name(F.col("text")))


@query(
    "norm_name_sql",
    r"""select p_partkey, trim(lower(regexp_replace(replace(p_brand || ' & ' || p_name, '&', ' and '),
      '[^[:alnum:]]+', ' ', 'g'))) as name from part""",
)
def norm_name_sql(spark: SparkSession, sf: str) -> DataFrame:
    shown = F.concat_ws(" & ", "p_brand", "p_name")
    return table(spark, sf, "part").select("p_partkey", text.norm_name_ascii(shown).alias("name"))


@query("norm_space", _digest(f"lower({SQUEEZED})"))
def norm_space(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, text.norm_space(F.col("text")))


@query("norm_slug", _digest(f"lower(regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g'))"))
def norm_slug(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, text.norm_slug(F.col("text")))


@query("norm_evidence", _digest(f"lower({SQUEEZED})"))
def norm_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, text.norm_evidence(F.col("text")))


@query("slugify", _digest(f"replace({WORDS}, ' ', '-')"))
def slugify(spark: SparkSession, sf: str) -> DataFrame:
    return _documents(spark, sf, text.slugify(F.col("text")))


@query(
    "unique_slug",
    """select p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name || '!' || p_brand),
      '[^a-z0-9]+', '-', 'g'), '-'), ''), 'software') || '--' || lower(hex(encode(p_partkey::varchar)))
      as slug from part""",
)
def unique_slug(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("!", "p_name", "p_brand")
    return table(spark, sf, "part").select(
        "p_partkey", text.unique_slug(name, F.col("p_partkey"), "software").alias("slug")
    )


@query(
    "search_text",
    f"""select conv_id, turn, left({SQUEEZED}, 100) as query, left({SQUEEZED}, 200) as category_slug
    from conversations""",
)
def search_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        "conv_id",
        "turn",
        text.search_text(F.col("text")).alias("query"),
        text.search_text(F.col("text"), 200).alias("category_slug"),
    )


@query(
    "text_or_null",
    """select o_orderkey, case when trim(o_orderstatus) <> 'P' then o_orderstatus end as status,
      case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderpriority end as priority,
      case when o_orderstatus = 'F' then strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') end as verified_at
    from orders""",
)
def text_or_null(spark: SparkSession, sf: str) -> DataFrame:
    state = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("  ")
    stamp = F.when(
        F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ).otherwise("soon")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        text.text_or_null(state).alias("status"),
        text.member_or_null(F.col("o_orderpriority"), ["1-URGENT", "2-HIGH"]).alias("priority"),
        text.timestamp_or_null(stamp).alias("verified_at"),
    )


@query(
    "iso_ts_ok",
    """select event_id, event_type in ('click', 'view') as plain, event_type = 'click' as shifted
    from events""",
)
def iso_ts_ok(spark: SparkSession, sf: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    zoned = F.when(F.col("event_type") == "click", F.concat(stamp, F.lit(".5+02:00")))
    zoned = zoned.when(F.col("event_type") == "view", F.concat(stamp, F.lit("Z")))
    zoned = zoned.when(F.col("event_type") == "error", F.lit("2024-02-31T00:00:00Z"))
    good = zoned.otherwise(stamp)
    return table(spark, sf, "events").select(
        "event_id",
        text.iso_ts_ok(good).alias("plain"),
        (text.iso_ts_ok(good) & F.contains(good, F.lit("+"))).alias("shifted"),
    )


# URL rules on pages -------------------------------------------------------------------------

HOST = r"lower(regexp_extract(url, '^https?://([^/:?#]+)', 1))"
BARE = rf"regexp_replace({HOST}, '^www\.', '')"
PATH = r"regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1)"
TIDY = f"coalesce(nullif(regexp_replace({PATH}, '/+$', ''), ''), '/')"
SORTED_QUERY = r"""array_to_string(list_sort(list_filter(
  string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '')), '&')"""


def _pages(spark: SparkSession, sf: str, **columns: Column) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", *[c.alias(n) for n, c in columns.items()])


# Every fifth page gets a host outside ASCII, every fifth other one dot segments; the twin writes what they stand for.
SPELLED = r"""(select page_id, case page_id % 5 when 0 then replace(url, '://', '://xn--bcher-kva.')
  when 1 then regexp_replace(url, '^(https?://[^/?#]+)/', '\1/y/') else url end as url from pages) spelled"""


def _spelled(c: Column) -> Column:
    dotted = F.regexp_replace(c, "^(https?://[^/?#]+)/", "$1/x/../y/./")
    kind = F.col("page_id") % 5
    return F.when(kind == 0, F.replace(c, F.lit("://"), F.lit("://Bücher."))).when(kind == 1, dotted).otherwise(c)


@query("norm_domain", f"select page_id, {BARE} as identity, case when url like 'https:%' then {BARE} end as discovery from {SPELLED}")
def norm_domain(spark: SparkSession, sf: str) -> DataFrame:
    address = _spelled(F.col("url"))
    return _pages(
        spark, sf,
        identity=url.norm_domain(address),
        discovery=F.when(address.startswith("https:"), url.norm_domain(address, "discovery")),
    )


@query("domain_sql", f"select page_id, {BARE} as domain from pages")
def domain_sql(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, domain=url.domain_text(F.col("url")))


@query(
    "canon_http_url",
    f"""select page_id, case when url like 'https:%' then 'https://' || {HOST} || {TIDY}
      || case when {SORTED_QUERY} = '' then '' else '?' || {SORTED_QUERY} end end as url from {SPELLED}""",
)
def canon_http_url(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, url=url.canon_http_url(_spelled(F.col("url"))))


@query(
    "canon_https_url",
    f"select page_id, case when url like 'https:%' then 'https://' || {HOST} || {TIDY} end as url from {SPELLED}",
)
def canon_https_url(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf, url=url.canon_https_url(_spelled(F.col("url"))))


@query(
    "canon_url_sql",
    r"""select page_id, lower(regexp_extract(u, '^([^:]+)://', 1)) || '://'
      || lower(regexp_extract(u, '^[^:]+://([^/?#]+)', 1))
      || regexp_replace(regexp_extract(u, '^[^:]+://[^/?#]+(.*)$', 1), '/+$', '') as url
    from (select page_id, upper(left(url, 12)) || substr(url, 13) as u from pages)""",
)
def canon_url_sql(spark: SparkSession, sf: str) -> DataFrame:
    shouted = F.concat(F.upper(F.substring("url", 1, 12)), F.expr("substring(url, 13)"))
    return _pages(spark, sf, url=url.canon_url_text(shouted))


@query(
    "safe_url",
    r"""select page_id, url like 'https:%' as plain, url like 'https:%' and not regexp_matches(url, '[?]')
      as without_blank from pages""",
)
def safe_url(spark: SparkSession, sf: str) -> DataFrame:
    address = _spelled(F.col("url"))
    return _pages(
        spark, sf,
        plain=url.safe_url(address),
        without_blank=url.safe_url(F.replace(address, F.lit("?"), F.lit(" "))),
    )


@query(
    "public_url",
    """select page_id, url like 'https:%' as plain,
      url like 'https:%' and not contains(url, '.example.com/') as numeric_host
    from pages""",
)
def public_url(spark: SparkSession, sf: str) -> DataFrame:
    """Hosts replaced by addresses: private ones for .com hosts, public ones for the others."""
    first = F.when(F.contains("url", F.lit(".example.com/")), "10").otherwise("203")
    moved = F.concat(
        F.regexp_extract("url", "^(https?://)", 1), first, F.lit(".0.0."), F.col("page_id") % 250,
        F.regexp_extract("url", "^https?://[^/]+(/.*)$", 1),
    )
    return _pages(
        spark, sf, plain=url.public_url(F.col("url")), numeric_host=url.public_url(moved)
    )


@query(
    "outbound_slug_ok",
    "select p_partkey, p_size < 25 as good from part",
)
def outbound_slug_ok(spark: SparkSession, sf: str) -> DataFrame:
    dashed = F.replace("p_name", F.lit(" "), F.lit("-"))
    slug = F.when(F.col("p_size") < 25, dashed).when(F.col("p_size") < 40, F.col("p_name"))
    slug = slug.otherwise(F.concat(F.lit("-"), dashed))
    return table(spark, sf, "part").select("p_partkey", url.outbound_slug_ok(slug).alias("good"))


@query(
    "evidence_url_ok",
    """select page_id, url like 'https:%' as evidence,
      url like 'https:%' and not regexp_matches(url, '^https://[^/]*:') as outbound from pages""",
)
def evidence_url_ok(spark: SparkSession, sf: str) -> DataFrame:
    address = F.col("url")
    return _pages(
        spark, sf, evidence=url.evidence_url_ok(address), outbound=url.outbound_url_ok(address)
    )


@query(
    "official_source",
    rf"""with h as (select page_id, {BARE} as d from pages)
    select page_id, regexp_replace(d, '^[^.]+\.', '') = 'example.com' or d = 'example.com'
        or d like '%.example.com' as below, d = 'example.com' or d like '%.example.com' as above
    from h""",
)
def official_source(spark: SparkSession, sf: str) -> DataFrame:
    domain = url.domain_text(F.col("url"))
    return _pages(
        spark, sf,
        below=url.official_source(domain, F.lit("example.com")),
        above=url.official_source(F.lit("example.com"), domain),
    )


@query(
    "resolve_asset_url",
    """with links as (select page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) as ref
      from pages)
    select page_id, ref, case when url like 'https:%' then
      regexp_extract(url, '^(https://[^/?#]+)', 1)
      || replace(replace(url_encode(ref), '%2F', '/'), '%2C', ',') end as resolved,
      count(*) as n from links group by all""",
)
def resolve_asset_url(spark: SparkSession, sf: str) -> DataFrame:
    links = table(spark, sf, "pages").select(
        "page_id", "url", F.explode(html.tags(F.col("html"), "a")).alias("tag")
    )
    named = links.withColumn("ref", html.attribute(html.html_attrs(F.col("tag")), "href"))
    resolved = url.resolve_asset_url(named, "resolved", F.col("ref"), F.col("url"))
    return (
        resolved.filter("ref is not null")
        .groupBy("page_id", "ref", "resolved")
        .agg(F.count(F.lit(1)).alias("n"))
    )


# Keys ---------------------------------------------------------------------------------------


@query(
    "provider_key",
    """select o_orderkey, case when o_orderstatus <> 'P' then '["market","'
      || lower(trim(substr(o_orderpriority, 3, 4))) || '","' || o_orderkey || '"]' end as key
    from orders""",
)
def provider_key(spark: SparkSession, sf: str) -> DataFrame:
    provider = F.when(F.col("o_orderstatus") == "P", "no key").otherwise(" Market ")
    kind = F.substring("o_orderpriority", 3, 4)
    order = F.concat(F.lit("\n"), "o_orderkey")
    key = keys.provider_key(provider, kind, order)
    return table(spark, sf, "orders").select("o_orderkey", key.alias("key"))


@query(
    "stable_id",
    """select p_partkey, 'PF-' || left(sha256(replace(p_name, ' ', '-') || '-' || p_partkey), 24) as id
    from part""",
)
def stable_id(spark: SparkSession, sf: str) -> DataFrame:
    slug = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_partkey")
    return table(spark, sf, "part").select("p_partkey", keys.stable_id(slug).alias("id"))


def _digest_part(position: int) -> str:
    """Sixteen hex digits of each row digest, added up modulo 2**64."""
    high = f"('0x' || substr(h, {position}, 8))::bigint::hugeint"
    low = f"('0x' || substr(h, {position + 8}, 8))::bigint::hugeint"
    return f"(sum({high} * 4294967296 + {low}) % 18446744073709551616::hugeint)::varchar"


@query(
    "batch_digest",
    """with r as (select sha256('{"p_brand":"' || p_brand || '","p_name":"' || p_name
        || '","p_partkey":' || p_partkey || '}') as h from part),
    s as (select count(*)::varchar || '-' || %s as parts from r)
    select 'product_factory_' || left(sha256(parts), 16) as batch_id, sha256(parts) as batch_digest
    from s"""
    % " || '-' || ".join(_digest_part(1 + 16 * i) for i in range(4)),
)
def batch_digest(spark: SparkSession, sf: str) -> DataFrame:
    return digest_of(table(spark, sf, "part").select("p_partkey", "p_name", "p_brand"))


@query(
    "fingerprint",
    rf"""with p as (select *, case when contains(url, '.example.com/') then 'external-program-id'
        when contains(url, '.example.net/') and url like 'https:%' then 'program-url'
        when contains(url, '.example.net/') then 'domain' else 'names' end as basis from pages)
    select page_id, basis, 'partner net|' || basis || ':' || case basis
        when 'external-program-id' then page_id::varchar
        when 'program-url' then 'https://' || {HOST} || {TIDY}
          || case when {SORTED_QUERY} = '' then '' else '?' || {SORTED_QUERY} end
        when 'domain' then {BARE}
        else 'product-name:page ' || page_id || '|program-name:|vendor-name:maker '
          || regexp_replace({BARE}, '[^a-z0-9]+', ' ', 'g') end as fingerprint
    from p""",
)
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    domain = url.domain_text(F.col("url"))
    com, net = F.contains("url", F.lit(".example.com/")), F.contains("url", F.lit(".example.net/"))
    value = keys.fingerprint(
        F.lit("Partner-Net"),
        F.when(com, F.col("page_id").cast("string")),
        F.when(net, F.col("url")),
        F.when(net, F.array(domain, F.upper(domain))),
        F.concat(F.lit("Page "), F.col("page_id").cast("string")),
        F.lit(None).cast("string"),
        F.concat(F.lit("Maker "), domain),
    )
    return _pages(spark, sf, fingerprint=value["value"], basis=value["basis"])


# Rule tables --------------------------------------------------------------------------------

MODEL_TEXT = """case p_type when 'PROMO' then 'Revenue-Share' when 'SMALL' then 'Cost per LEAD'
  when 'LARGE' then 'cpa' when 'MEDIUM' then 'Cost per click!' when 'ECONOMY' then '20%' end"""


@query(
    "commission_model",
    """select p_partkey, case p_type when 'PROMO' then 'revenue_share' when 'SMALL' then 'cpl'
        when 'LARGE' then 'cpa' when 'MEDIUM' then 'cpc' when 'STANDARD' then 'cpl'
        else 'unknown' end as model,
      case when p_size < 10 then 'Revenue Share' when p_size < 20 then 'CPA' end as label
    from part""",
)
def commission_model(spark: SparkSession, sf: str) -> DataFrame:
    worded = F.when(F.col("p_size") < 10, "Up to 30% rev share, monthly").when(
        F.col("p_size") < 20, "One CPA or cost per action payment"
    ).when(F.col("p_size") < 30, "CPA or CPC").otherwise("Ask us")
    return table(spark, sf, "part").select(
        "p_partkey",
        rules.commission_model(F.expr(MODEL_TEXT), F.lit("CPL")).alias("model"),
        rules.commission_label(worded).alias("label"),
    )


@query(
    "relationship_state",
    """select o_orderkey, case o_orderpriority when '1-URGENT' then 'available' when '2-HIGH' then 'applied'
      when '5-LOW' then 'rejected' else 'unknown' end as state from orders""",
)
def relationship_state(spark: SparkSession, sf: str) -> DataFrame:
    shown = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "Not  applied")
        .when(F.col("o_orderpriority") == "2-HIGH", "Application pending")
        .when(F.col("o_orderpriority") == "5-LOW", "APPLICATION DECLINED")
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf, "orders").select(
        "o_orderkey", rules.relationship_state(shown).alias("state")
    )


@query(
    "split_display_name",
    """select p_partkey, p_name as product, case when p_size < 20 then p_brand end as former_name,
      case when p_size >= 20 and p_size < 35 then p_brand end as vendor from part""",
)
def split_display_name(spark: SparkSession, sf: str) -> DataFrame:
    shown = (
        F.when(F.col("p_size") < 20, F.concat("p_name", F.lit(" (Formerly  "), "p_brand", F.lit(")")))
        .when(F.col("p_size") < 35, F.concat("p_name", F.lit("  by "), "p_brand"))
        .otherwise(F.col("p_name"))
    )
    parts = rules.split_display_name(shown)
    return table(spark, sf, "part").select("p_partkey", parts.alias("s")).select("p_partkey", "s.*")


LEGAL = rules.LEGAL_WORDS.replace("'", "''")


@query(
    "legal_label",
    f"select doc_id, regexp_matches(text, '{LEGAL}', 'i') as legal from documents",
)
def legal_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", rules.legal_label(F.col("text")).alias("legal")
    )


ASKED = """case p_type when 'PROMO' then 'Company Name *' when 'SMALL' then 'Country/Region:'
  when 'LARGE' then 'How do you plan to promote ' || p_name || '?' when 'MEDIUM' then 'I accept the terms'
  when 'ECONOMY' then 'I certify that ' || p_name else p_name end"""


@query(
    "semantic_label",
    """select p_partkey, case p_type when 'PROMO' then 'BUSINESS_NAME' when 'SMALL' then 'COUNTRY'
      when 'LARGE' then 'PROMOTIONAL_PLAN' when 'MEDIUM' then 'TERMS_ACCEPTANCE'
      when 'ECONOMY' then 'LEGAL_ATTESTATION' end as semantic from part""",
)
def semantic_label(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        "p_partkey", rules.semantic_label(F.expr(ASKED)).alias("semantic")
    )


_GROUP_SQL = " ".join(
    f"when regexp_matches(text, '{pattern}', 'i') then '{group}'"
    for pattern, group in rules.CATEGORY_GROUPS
)


@query(
    "category_group",
    f"select doc_id, case {_GROUP_SQL} else '{rules.DEFAULT_GROUP}' end as grouped from documents",
)
def category_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", rules.category_group(F.col("text")).alias("grouped")
    )


@query(
    "rejected_asset",
    "select doc_id, regexp_matches(lower(text), '%s') as rejected from documents"
    % "|".join(html.REJECTED_WORDS),
)
def rejected_asset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", html.rejected_asset(F.col("text")).alias("rejected")
    )


@query(
    "identity_signal",
    r"""select page_id, contains(regexp_replace(lower(regexp_extract(url,
        '^[a-z]+://[^/?#]+[^?#]*?([^/?#]*)([?#].*)?$', 1) || ' ' || html), '[^a-z0-9]+', '', 'g'),
      'thewhst') as signal from pages""",
)
def identity_signal(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(
        spark, sf, signal=html.identity_signal(F.col("url"), F.col("html"), F.lit("The Whst"))
    )


@query(
    "html_attrs",
    r"""with tags as (select page_id, unnest(regexp_extract_all(html, '(?i)<(?:a|div|meta|html)\b[^>]*>'))
      as tag from pages)
    select page_id, coalesce(regexp_extract(tag, '(?:href|class|lang|charset)="([^"]*)"', 1), '') as value,
      count(*) as n from tags group by all""",
)
def html_attrs(spark: SparkSession, sf: str) -> DataFrame:
    tags = F.regexp_extract_all("html", F.lit(r"(?i)<(?:a|div|meta|html)\b[^>]*>"), F.lit(0))
    rows = table(spark, sf, "pages").select("page_id", F.explode(tags).alias("tag"))
    attributes = rows.select("page_id", html.html_attrs(F.col("tag")).alias("a"))
    named = [html.attribute(F.col("a"), n) for n in ("href", "class", "lang", "charset")]
    return (
        attributes.select("page_id", F.coalesce(*named, F.lit("")).alias("value"))
        .groupBy("page_id", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "json_access",
    """select event_id, (props->>'$.k')::bigint as k, json_type(props) = 'OBJECT' as is_object,
      json_type(props->'$.k') = 'UBIGINT' as is_number, json_array_length('[' || props || ']')::bigint as items,
      case when value > 50 then '{"type":"' || event_type || '","k":' || (props->>'$.k') || '}'
        else '{"type":"' || event_type || '"}' end as built
    from events""",
)
def json_access(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("bigint")
    parsed = F.try_parse_json("props")
    built = F.struct(F.col("event_type").alias("type"), F.when(F.col("value") > 50, k).alias("k"))
    return table(spark, sf, "events").select(
        "event_id",
        k.alias("k"),
        F.schema_of_variant(parsed).startswith("OBJECT").alias("is_object"),
        (F.schema_of_variant(F.variant_get(parsed, "$.k", "variant")) == "BIGINT").alias("is_number"),
        F.json_array_length(F.concat(F.lit("["), "props", F.lit("]"))).cast("bigint").alias("items"),
        F.to_json(built).alias("built"),
    )


@query(
    "image_header",
    """select p_partkey, case when good then w end as width, case when good then h end as height
    from (select *, w between 32 and 4096 and h between 32 and 4096
        and greatest(w / h, h / w) <= 12 and p_type <> 'PROMO' as good
      from (select p_partkey, p_type, p_size * 9 as w, floor(p_retailprice / 2)::int as h from part))""",
)
def image_header(spark: SparkSession, sf: str) -> DataFrame:
    """PNG headers whose sides come from size and price; one type is sent with a wrong MIME type."""
    from shelfmark.plans.assets import image_header as measured

    def four_bytes(c: Column) -> Column:
        return F.lpad(F.hex(c.cast("bigint")), 8, "0")

    header = F.concat(
        F.lit("89504E470D0A1A0A0000000D49484452"),
        four_bytes(F.col("p_size") * 9),
        four_bytes(F.floor(F.col("p_retailprice") / 2).cast("int")),
        F.lit("0802000000"),
    )
    images = table(spark, sf, "part").select(
        "p_partkey",
        F.unhex(header).alias("bytes"),
        F.when(F.col("p_type") == "PROMO", "image/svg+xml").otherwise("image/png").alias("content_type"),
    )
    return measured(images).select("p_partkey", "width", "height")


@query(
    "tag_inventory",
    r"""select page_id, lower(tag) as tag, count(*) as n from (
      select page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) as tag from pages)
    group by all""",
)
def tag_inventory(spark: SparkSession, sf: str) -> DataFrame:
    names = F.regexp_extract_all("html", F.lit("<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))
    return (
        table(spark, sf, "pages")
        .select("page_id", F.explode(names).alias("tag"))
        .groupBy("page_id", F.lower("tag").alias("tag"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "page_source",
    "select page_id, url, length(html) as characters, sha256(html) as digest from pages",
)
def page_source(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", "url", F.length("html").cast("long").alias("characters"),
        F.sha2("html", 256).alias("digest"),
    )
