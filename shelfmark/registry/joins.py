"""Join queries: references, normalised keys, links in time, containment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import rules, text, url
from shelfmark.operators import checks, keyed, links, versions
from shelfmark.operators.containment import containment_join
from shelfmark.registry import query
from shelfmark.registry.tables import SOFTWARE, software
from shelfmark.session import table

AT = "1998-06-01 00:00:00"


def at_time():
    return F.expr(f"timestamp_ntz'{AT}'")


def link_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Lineitem read as links: its product, quantity as priority, ship date as start."""
    identifier = F.concat_ws(
        "-",
        F.lpad(F.col("l_orderkey").cast("string"), 10, "0"),
        F.col("l_linenumber").cast("string"),
        F.lpad(F.col("l_suppkey").cast("string"), 8, "0"),
        F.date_format("l_shipdate", "yyyyMMdd"),
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("software_id"),
        identifier.alias("affiliate_link_id"),
        F.col("l_orderkey").alias("affiliate_program_id"),
        F.concat(
            F.when(F.col("l_tax") < 0.08, "https://shop").otherwise("http://shop"),
            F.col("l_suppkey"),
            F.lit(".example.com/item/"),
            F.col("l_partkey"),
        ).alias("destination_url"),
        F.col("l_quantity").cast("long").alias("priority"),
        F.when(F.col("l_linestatus") == "F", "active").otherwise("inactive").alias("status"),
        F.when(F.col("l_returnflag") == "N", "pending").otherwise("verified").alias(
            "verification_status"
        ),
        F.when(F.col("l_discount") < 0.09, F.col("l_shipdate")).alias("verified_at"),
        F.col("l_shipdate").alias("valid_from"),
        F.when(
            F.col("l_returnflag") == "A", F.col("l_shipdate") + F.expr("interval 120 days")
        ).alias("valid_until"),
    )


LINKS = """links as (
  select l_partkey as software_id,
    lpad(l_orderkey::varchar, 10, '0') || '-' || l_linenumber || '-'
      || lpad(l_suppkey::varchar, 8, '0') || '-' || strftime(l_shipdate, '%Y%m%d')
      as affiliate_link_id,
    l_orderkey as affiliate_program_id,
    case when l_tax < 0.08 then 'https://shop' else 'http://shop' end || l_suppkey
      || '.example.com/item/' || l_partkey as destination_url,
    l_quantity::bigint as priority,
    case when l_linestatus = 'F' then 'active' else 'inactive' end as status,
    case when l_returnflag = 'N' then 'pending' else 'verified' end as verification_status,
    case when l_discount < 0.09 then l_shipdate end as verified_at,
    l_shipdate as valid_from,
    case when l_returnflag = 'A' then l_shipdate + interval 120 day end as valid_until
  from lineitem)"""


def program_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Orders read as programs, one for each product on the order."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("affiliate_id"), F.col("l_partkey").alias("software_id")
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("affiliate_id"),
        F.when(F.col("o_orderstatus") == "P", " Paused").otherwise(" Active ").alias("status"),
        F.when(F.col("o_orderpriority") == "5-LOW", "pending").otherwise("verified").alias(
            "verification_status"
        ),
        F.col("o_orderdate").alias("verified_at"),
    )
    return lines.distinct().join(orders, "affiliate_id")


PROGRAMS = """programs as (
  select distinct o_orderkey as affiliate_id, l_partkey as software_id,
    case when o_orderstatus = 'P' then ' Paused' else ' Active ' end as status,
    case when o_orderpriority = '5-LOW' then 'pending' else 'verified' end as verification_status,
    o_orderdate as verified_at
  from orders join lineitem on l_orderkey = o_orderkey)"""

ELIGIBLE = f"""status = 'active' and verification_status = 'verified' and verified_at is not null
  and (valid_from is null or valid_from <= timestamp '{AT}')
  and (valid_until is null or valid_until > timestamp '{AT}')"""

OUTBOUND = r"^https://([a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}([/?#][^\s\\]*)?$"

STRICT = f"""strict as (
  select l.* from links l join programs p
    on p.affiliate_id = l.affiliate_program_id and p.software_id = l.software_id
  where lower(trim(p.status)) = 'active' and p.verification_status = 'verified'
    and p.verified_at <= timestamp '{AT}' and l.{ELIGIBLE.replace(' and v', ' and l.v').replace('(v', '(l.v').replace('or v', 'or l.v')}
    and l.verified_at <= timestamp '{AT}' and length(destination_url) <= 2048
    and regexp_matches(destination_url, '{OUTBOUND}', 'i'))"""


@query(
    "eligible_link",
    f"with {LINKS}, {PROGRAMS}, {STRICT} select software_id, affiliate_link_id, priority from strict",
)
def eligible_link(spark: SparkSession, sf: str) -> DataFrame:
    return links.strictly_eligible_links(
        link_rows(spark, sf), program_rows(spark, sf), at_time()
    ).select("software_id", "affiliate_link_id", "priority")


@query(
    "top_link",
    f"""with {LINKS} select software_id, affiliate_link_id, priority from links where {ELIGIBLE}
    qualify row_number() over (partition by software_id
      order by priority desc, affiliate_link_id) = 1""",
)
def top_link(spark: SparkSession, sf: str) -> DataFrame:
    best = links.top_link(links.eligible_links(link_rows(spark, sf), at_time()))
    return best.select("software_id", "affiliate_link_id", "priority")


SITE = """case when p_type = 'PROMO' then 'http://' else 'https://' end
  || replace(p_name, ' ', '-') || '.example.com/' || p_partkey"""


@query(
    "resolve_link",
    f"""with {LINKS}, {PROGRAMS}, {STRICT}, best as (
      select software_id, affiliate_link_id, destination_url from strict
      qualify row_number() over (partition by software_id
        order by priority desc, affiliate_link_id) = 1),
    sites as (select p_partkey as software_id, {SITE} as website_url from part where p_size < 25)
    select s.software_id, affiliate_link_id, coalesce(destination_url,
      case when regexp_matches(website_url, '{OUTBOUND}', 'i') then website_url end) as outbound_url
    from sites s left join best b on b.software_id = s.software_id
    where outbound_url is not null""",
)
def resolve_link(spark: SparkSession, sf: str) -> DataFrame:
    scheme = F.when(F.col("pricing") == "PROMO", "http://").otherwise("https://")
    name = F.replace("software_name", F.lit(" "), F.lit("-"))
    sites = software(spark, sf).withColumn(
        "website_url", F.concat(scheme, name, F.lit(".example.com/"), "software_id")
    )
    return links.resolve_link(sites, link_rows(spark, sf), program_rows(spark, sf), at_time())


@query(
    "point_in_time_link",
    f"""with {LINKS}, points as (
      select distinct l_partkey as software_id, o_orderdate as at
      from lineitem join orders on o_orderkey = l_orderkey)
    select p.software_id, p.at, l.affiliate_link_id from points p join links l
      on l.software_id = p.software_id and l.status = 'active'
      and l.verification_status = 'verified' and l.verified_at is not null
      and (valid_from is null or valid_from <= p.at) and (valid_until is null or valid_until > p.at)
    qualify row_number() over (partition by p.software_id, p.at
      order by priority desc, affiliate_link_id) = 1""",
)
def point_in_time_link(spark: SparkSession, sf: str) -> DataFrame:
    sold = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    points = (
        sold.join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
        .select(F.col("l_partkey").alias("software_id"), F.col("o_orderdate").alias("at"))
        .distinct()
    )
    return links.link_at(points, ["software_id", "at"], link_rows(spark, sf), unit="day")


@query(
    "orphan_refs",
    """select 'lineitem_part' as check_name, count(*) as issue_count from lineitem
      where not exists (select 1 from part where p_partkey = l_partkey and p_size < 25)
    union all select 'lineitem_supplier', count(*) from lineitem
      where not exists (select 1 from supplier where s_suppkey = l_suppkey and s_acctbal > 0)
    union all select 'lineitem_orders', count(*) from lineitem
      where not exists (select 1 from orders where o_orderkey = l_orderkey)
    union all select 'orders_lineitem', count(*) from orders
      where not exists (select 1 from lineitem where l_orderkey = o_orderkey)
    union all select 'documents_labels', count(*) from documents d
      where not exists (select 1 from labels l where l.doc_id = d.doc_id)""",
)
def orphan_refs(spark: SparkSession, sf: str) -> DataFrame:
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    part = table(spark, sf, "part").filter("p_size < 25")
    supplier = table(spark, sf, "supplier").filter("s_acctbal > 0")
    documents, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    return checks.union_all(
        [
            checks.orphan_count(lines, "l_partkey", part, "p_partkey", "lineitem_part"),
            checks.orphan_count(lines, "l_suppkey", supplier, "s_suppkey", "lineitem_supplier"),
            checks.orphan_count(lines, "l_orderkey", orders, "o_orderkey", "lineitem_orders"),
            checks.orphan_count(orders, "o_orderkey", lines, "l_orderkey", "orders_lineitem"),
            checks.orphan_count(documents, "doc_id", labels, "doc_id", "documents_labels"),
        ]
    )


@query(
    "tree_orphans",
    """select n_nationkey, n_regionkey, 'orphan_parent' as problem from nation
      where n_regionkey not in (select n_nationkey from nation where n_nationkey > 1)
    union all select n_nationkey, n_regionkey, 'self_parent' from nation
      where n_regionkey = n_nationkey and n_nationkey > 1""",
)
def tree_orphans(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    tree = nation.filter("n_nationkey > 1").select("n_nationkey", "n_regionkey")
    outer = nation.filter("n_nationkey <= 1").select("n_nationkey", "n_regionkey")
    inside = checks.tree_orphans(tree, "n_nationkey", "n_regionkey")
    parents = tree.select(F.col("n_nationkey").alias("p"))
    outside = outer.join(parents, F.col("n_regionkey") == F.col("p"), "left_anti")
    return inside.unionByName(outside.withColumn("problem", F.lit("orphan_parent")))


@query(
    "join_normalised_key",
    """with vendors as (select lower(regexp_replace(trim(p_brand || '  ' || p_type), '\\s+', ' ', 'g'))
        as canonical_name, min(p_partkey) as vendor_id from part group by 1)
    select p_partkey, v.vendor_id from part join vendors v
      on v.canonical_name = lower(regexp_replace(trim(' ' || p_brand || chr(9) || p_type),
        '\\s+', ' ', 'g'))""",
)
def join_normalised_key(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    vendors = part.groupBy(
        text.norm_space(F.concat_ws("  ", "p_brand", "p_type")).alias("canonical_name")
    ).agg(F.min("p_partkey").alias("vendor_id"))
    named = part.withColumn(
        "canonical_name", text.norm_space(F.concat(F.lit(" "), "p_brand", F.lit("\t"), "p_type"))
    )
    return named.join(vendors, "canonical_name").select("p_partkey", "vendor_id")


@query(
    "either_key_join",
    """with vendors as (select n_nationkey as vendor_id, lower(n_name) as canonical_name from nation),
    rows as (select c_custkey, c_nationkey, c_mktsegment,
        lower('Nation_' || (c_custkey % 30)::varchar) as vendor_name from customer)
    select c_custkey, vendor_id, canonical_name from rows r join vendors v
      on (c_mktsegment in ('BUILDING', 'MACHINERY') and v.vendor_id = r.c_nationkey)
      or (c_mktsegment not in ('BUILDING', 'MACHINERY') and v.canonical_name = r.vendor_name)""",
)
def either_key_join(spark: SparkSession, sf: str) -> DataFrame:
    vendors = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("vendor_id"), F.lower("n_name").alias("canonical_name")
    )
    named = F.concat(F.lit("nation_"), F.pmod("c_custkey", F.lit(30)).cast("string"))
    customers = table(spark, sf, "customer").withColumn("vendor_name", named)
    return versions.either_key_join(
        customers,
        vendors,
        F.col("c_mktsegment").isin("BUILDING", "MACHINERY"),
        ("c_nationkey", "vendor_id"),
        ("vendor_name", "canonical_name"),
    ).select("c_custkey", "vendor_id", "canonical_name")


@query(
    "not_exists_or",
    """select p_partkey, p_name, p_brand from part p where not exists (
      select 1 from part q where q.p_partkey * 3 = p.p_partkey
        or (q.p_name = p.p_name and q.p_brand || q.p_size = p.p_brand || (p.p_size + 1)))""",
)
def not_exists_or(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    existing = part.select(
        (F.col("p_partkey") * 3).alias("p_partkey"), "p_name", F.concat("p_brand", "p_size").alias("kind")
    )
    wanted = part.select("p_partkey", "p_name", "p_brand", F.concat("p_brand", F.col("p_size") + 1).alias("kind"))
    return versions.not_exists_or(wanted, existing, ["p_partkey"], ["p_name", "kind"]).drop("kind")


@query(
    "same_name_other_owner",
    """select p_partkey, p_name, p_brand from part a where exists (
      select 1 from part b where b.p_name = a.p_name and b.p_size = a.p_size and b.p_brand <> a.p_brand)""",
)
def same_name_other_owner(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    owners = keyed.sole_match(part, ["p_name", "p_size"], "p_brand")
    other = (F.col("min_p_brand") != F.col("p_brand")) | (F.col("max_p_brand") != F.col("p_brand"))
    return part.join(owners, ["p_name", "p_size"]).filter(other).select("p_partkey", "p_name", "p_brand")


def _hosts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select(
        "page_id", url.domain_text(F.col("url")).alias("domain")
    )


@query(
    "domain_join",
    r"""with hosts as (select page_id,
        regexp_replace(regexp_extract(lower(url), '^https?://([^/:?#]+)', 1), '^www\.', '') as domain
      from pages),
    wanted as (select page_id, unnest([domain, regexp_replace(domain, '^[^.]+\.', '')]) as domain
      from hosts)
    select w.page_id, min(h.page_id) as first_match, max(h.page_id) as last_match
    from wanted w join hosts h on h.domain = w.domain group by w.page_id""",
)
def domain_join(spark: SparkSession, sf: str) -> DataFrame:
    hosts = _hosts(spark, sf)
    inventory = keyed.sole_match(hosts, ["domain"], "page_id")
    parent = F.regexp_replace("domain", r"^[^.]+\.", "")
    wanted = hosts.select("page_id", F.explode(F.array("domain", parent)).alias("domain"))
    return (
        wanted.join(inventory, "domain")
        .groupBy("page_id")
        .agg(F.min("min_page_id").alias("first_match"), F.max("max_page_id").alias("last_match"))
    )


@query(
    "json_recordset",
    """select event_id, (props->>'$.k')::bigint as k from events""",
)
def json_recordset(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    rows = F.from_json(F.concat(F.lit("["), "props", F.lit("]")), "array<struct<k: bigint>>")
    return events.select("event_id", F.inline(rows))


@query(
    "lateral_unnest",
    r"""select page_id, tag from (
      select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)', 1)) as tag from pages)""",
)
def lateral_unnest(spark: SparkSession, sf: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit("<([a-z0-9]+)"), F.lit(1))
    encoded = F.to_json(F.transform(found, lambda t: F.struct(t.alias("tag"))))
    return (
        table(spark, sf, "pages")
        .select("page_id", encoded.alias("rows"))
        .select("page_id", F.inline(F.from_json("rows", "array<struct<tag: string>>")))
    )


@query(
    "containment_join",
    """with d as (select doc_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as body
      from documents),
    b as (select item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) as quote
      from benchmark)
    select item_id, count(*) as texts, min(doc_id) as first_text from b join d on contains(body, quote)
    group by item_id""",
)
def quote_support(spark: SparkSession, sf: str) -> DataFrame:
    return containment_join(
        table(spark, sf, "benchmark"), table(spark, sf, "documents"),
        "item_id", "text", "doc_id", "text", unicode=False,
    )


@query(
    "schema_compat",
    """select * from (values
      ('part', 'p_partkey', 'bigint', 'bigint', 'compatible'),
      ('part', 'p_size', 'bigint', 'int', 'STOP_incompatible_existing_column'),
      ('orders', 'o_orderdate', 'timestamp_ntz', 'timestamp_ntz', 'compatible'),
      ('orders', 'verified_at', 'timestamp_ntz', null, 'will_be_added'),
      ('lineitem', 'l_quantity', 'decimal(20,6)', 'double', 'STOP_incompatible_existing_column'))
    as t(table_name, column_name, expected_type, actual_type, compatibility)""",
)
def schema_compat(spark: SparkSession, sf: str) -> DataFrame:
    expected = [
        ("part", "p_partkey", "bigint"),
        ("part", "p_size", "bigint"),
        ("orders", "o_orderdate", "timestamp_ntz"),
        ("orders", "verified_at", "timestamp_ntz"),
        ("lineitem", "l_quantity", "decimal(20,6)"),
    ]
    actual = {name: table(spark, sf, name) for name in ("part", "orders", "lineitem")}
    return checks.schema_compat(expected, actual)
