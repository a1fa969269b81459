"""Listing queries on part (products), supplier (categories) and lineitem (relations)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import rules, text
from shelfmark.operators import listing
from shelfmark.operators.ranks import SortedIndex
from shelfmark.registry import query
from shelfmark.registry.tables import (
    CATEGORIES,
    RELATIONS,
    SOFTWARE,
    WITH_ALL,
    categories,
    relations,
    software,
)
from shelfmark.session import table


@query("scan_project", "select p_partkey, p_name, p_brand from part")
def scan_project(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")


@query(
    "catalog_export",
    f"""with {SOFTWARE}, vendors as (
      select p_brand as vendor, min(p_partkey) as vendor_id, count(*) as products
      from part where p_size < 30 group by p_brand)
    select software_id, slug, software_name, coalesce(v.vendor, s.vendor) as vendor_name,
      v.vendor_id, v.products as vendor_products
    from software s left join vendors v on v.vendor = s.vendor
    where publication_status = 'published'""",
)
def catalog_export(spark: SparkSession, sf: str) -> DataFrame:
    vendors = (
        table(spark, sf, "part")
        .filter("p_size < 30")
        .groupBy(F.col("p_brand").alias("vendor"))
        .agg(F.min("p_partkey").alias("vendor_id"), F.count(F.lit(1)).alias("vendor_products"))
    )
    return (
        listing.published_only(software(spark, sf))
        .join(vendors, "vendor", "left")
        .select(
            "software_id", "slug", "software_name", F.col("vendor").alias("vendor_name"),
            "vendor_id", "vendor_products",
        )
        .orderBy("slug")
    )


@query(
    "published_only",
    "select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'F'",
)
def published_only(spark: SparkSession, sf: str) -> DataFrame:
    return listing.published_only(table(spark, sf, "orders"), "o_orderstatus", "F").select(
        "o_orderkey", "o_custkey", "o_totalprice"
    )


@query(
    "id_in_list",
    """select p_partkey, p_name from part
    where p_partkey in (select l_partkey from lineitem where l_quantity >= 49)""",
)
def id_in_list(spark: SparkSession, sf: str) -> DataFrame:
    ids = (
        table(spark, sf, "lineitem")
        .filter("l_quantity >= 49")
        .select(F.col("l_partkey").alias("p_partkey"))
    )
    return listing.id_in_list(table(spark, sf, "part"), ids, "p_partkey").select(
        "p_partkey", "p_name"
    )


@query(
    "search_ilike",
    """select p_partkey, p_name, p_brand, p_type from part
    where contains(lower(p_name), 'an') or contains(lower(p_brand), 'an')
       or contains(lower(p_type), 'an')""",
)
def search_ilike(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return listing.search_any(part, "AN", ["p_name", "p_brand", "p_type"])


@query("prefix_filter", "select p_partkey, p_name from part where upper(left(p_name, 1)) = 'S'")
def prefix_filter(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    return part.filter(listing.starts_with_letter(F.col("p_name"), "s"))


@query(
    "valid_at",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate from lineitem
    where (l_shipdate is null or l_shipdate <= timestamp '1998-06-01')
      and (case when l_linestatus = 'F' then l_shipdate + interval 90 day end is null
        or l_shipdate + interval 90 day > timestamp '1998-06-01')""",
)
def valid_at(spark: SparkSession, sf: str) -> DataFrame:
    until = F.when(F.col("l_linestatus") == "F", F.expr("l_shipdate + interval 90 days"))
    at = F.expr("timestamp_ntz'1998-06-01 00:00:00'")
    rows = table(spark, sf, "lineitem").filter(rules.valid_at(at, F.col("l_shipdate"), until))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")


@query(
    "is_blank",
    """select doc_id, coalesce(trim(text), '') = '' as blank_text,
      coalesce(trim(split_part(text, chr(10), 2)), '') = '' as blank_second_line
    from documents""",
)
def is_blank(spark: SparkSession, sf: str) -> DataFrame:
    second = F.try_element_at(F.split("text", "\n"), F.lit(2))
    return table(spark, sf, "documents").select(
        "doc_id",
        text.is_blank(F.col("text")).alias("blank_text"),
        text.is_blank(second).alias("blank_second_line"),
    )


@query(
    "null_safe_ne",
    """select d.doc_id, l.quality from documents d left join labels l using (doc_id)
    where l.quality is distinct from 1""",
)
def null_safe_ne(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id").join(
        table(spark, sf, "labels"), "doc_id", "left"
    )
    return joined.filter(~F.col("quality").eqNullSafe(1)).select("doc_id", "quality")


@query(
    "exactly_n_set",
    """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
      (case when l_returnflag = 'R' then 1 else 0 end + case when l_linestatus = 'F' then 1 else 0 end
        + case when l_tax > 0.04 then 1 else 0 end) = 1 as one_set
    from lineitem""",
)
def exactly_n_set(spark: SparkSession, sf: str) -> DataFrame:
    marks = [
        F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")),
        F.when(F.col("l_linestatus") == "F", F.col("l_partkey")),
        F.when(F.col("l_tax") > 0.04, F.col("l_suppkey")),
    ]
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
        rules.exactly_n_set(marks, 1).alias("one_set"),
    )


@query(
    "regex_filter",
    "select page_id, url from pages where not regexp_matches(url, '^https://[a-z0-9.-]+/(en|fr)/', 'i')",
)
def regex_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    return pages.filter(~F.col("url").rlike("(?i)^https://[a-z0-9.-]+/(en|fr)/"))


@query(
    "view_defaults",
    """select p_partkey as id, p_name as name, replace(p_name, ' ', '-') || '-' || p_partkey as slug,
      coalesce(s_name, p_brand) as vendor_name,
      coalesce(case when p_size > 40 then true when p_size > 20 then false end, false) as free_plan,
      coalesce(case when p_retailprice > 950 then p_size > 10 end, false) as free_trial
    from part left join supplier on s_suppkey = p_partkey""",
)
def view_defaults(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    flags = software(spark, sf).join(
        part.select(
            F.col("p_partkey").alias("software_id"),
            F.when(F.col("p_size") > 40, True).when(F.col("p_size") > 20, False).alias("free_plan"),
            F.when(F.col("p_retailprice") > 950, F.col("p_size") > 10).alias("free_trial"),
        ),
        "software_id",
    )
    named = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("software_id"), F.col("s_name").alias("vendor_name")
    )
    return listing.view_defaults(flags.join(named, "software_id", "left"))


@query(
    "visible_software",
    f"""with {SOFTWARE} select software_id, software_name, vendor, slug, pricing from software
    where publication_status = 'published'""",
)
def visible_software(spark: SparkSession, sf: str) -> DataFrame:
    return listing.published_only(software(spark, sf)).select(
        "software_id", "software_name", "vendor", "slug", "pricing"
    )


@query(
    "visible_vendors",
    """select s_suppkey as vendor_id, s_name as vendor_name from supplier
    where s_acctbal > 0 and s_suppkey in (
      select l_suppkey from lineitem join part on p_partkey = l_partkey where p_size < 25)""",
)
def visible_vendors(spark: SparkSession, sf: str) -> DataFrame:
    vendors = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("vendor_id"),
        F.col("s_name").alias("vendor_name"),
        F.when(F.col("s_acctbal") > 0, "active").otherwise("inactive").alias("status"),
    )
    offers = table(spark, sf, "lineitem")
    sold = software(spark, sf).join(
        offers.select(F.col("l_partkey").alias("software_id"), F.col("l_suppkey").alias("vendor_id")),
        "software_id",
    )
    return listing.visible_vendors(vendors, sold).select("vendor_id", "vendor_name")


@query(
    "visible_relationships",
    f"""{WITH_ALL} select distinct r.software_id, r.category_id from relations r
    where exists (select 1 from software s where s.software_id = r.software_id
        and s.publication_status = 'published')
      and exists (select 1 from categories c where c.category_id = r.category_id
        and c.publication_status = 'published')""",
)
def visible_relationships(spark: SparkSession, sf: str) -> DataFrame:
    return listing.visible_relationships(
        relations(spark, sf).distinct(), software(spark, sf), categories(spark, sf)
    )


@query(
    "join_vendor",
    """select s_suppkey as software_id, s_name as software_name, n_nationkey as vendor_id,
      n_name as vendor_name, n_regionkey as vendor_region
    from supplier left join (select * from nation where n_regionkey < 4) on n_nationkey = s_nationkey""",
)
def join_vendor(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "supplier").withColumnRenamed("s_nationkey", "vendor_id")
    vendors = (
        table(spark, sf, "nation").filter("n_regionkey < 4").withColumnRenamed("n_nationkey", "vendor_id")
    )
    return listing.join_vendor(items, vendors).select(
        F.col("s_suppkey").alias("software_id"),
        F.col("s_name").alias("software_name"),
        F.col("vendors.vendor_id").alias("vendor_id"),
        F.col("vendors.n_name").alias("vendor_name"),
        F.col("vendors.n_regionkey").alias("vendor_region"),
    )


def _detail(spark: SparkSession, sf: str) -> DataFrame:
    part = software(spark, sf).join(
        table(spark, sf, "part").select(
            F.col("p_partkey").alias("software_id"), F.col("p_size").alias("vendor_id")
        ),
        "software_id",
    )
    vendors = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("vendor_id"), F.col("n_name").alias("vendor_name")
    )
    named = listing.published_only(categories(spark, sf))
    return listing.review_detail(part, vendors, relations(spark, sf).distinct(), named)


_DETAIL_SQL = f"""{WITH_ALL}, detail as (
  select s.software_id, s.software_name, n_name as vendor_name, r.category_id, c.category_name
  from software s join part on p_partkey = s.software_id
  left join nation on n_nationkey = p_size
  left join (select distinct * from relations) r on r.software_id = s.software_id
  left join categories c on c.category_id = r.category_id and c.publication_status = 'published')"""


@query(
    "review_detail",
    f"{_DETAIL_SQL} select software_id, software_name, vendor_name, category_id, category_name from detail",
)
def review_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _detail(spark, sf).select(
        "software_id", "software_name", "vendor_name", "category_id", "category_name"
    )


@query(
    "review_fold",
    f"""{_DETAIL_SQL} select software_id, software_name, vendor_name,
      coalesce(string_agg(category_id::varchar || ':' || coalesce(category_name, ''), ','
        order by category_name nulls first, category_id), '') as categories,
      case when bool_or(category_id is not null and category_name is null) then 'error'
        else 'success' end as status
    from detail group by all""",
)
def review_fold(spark: SparkSession, sf: str) -> DataFrame:
    folded = listing.review_fold(_detail(spark, sf))
    shown = F.transform(
        "categories",
        lambda c: F.concat(c["category_id"], F.lit(":"), F.coalesce(c["category_name"], F.lit(""))),
    )
    return folded.withColumn("categories", F.array_join(shown, ","))


@query(
    "review_entries",
    f"""{_DETAIL_SQL}, pairs as (
      select distinct software_id, category_name, category_id from detail where category_id is not null)
    select *, row_number() over (partition by software_id order by category_name nulls first, category_id) as position
    from pairs""",
)
def review_entries(spark: SparkSession, sf: str) -> DataFrame:
    return listing.review_entries(_detail(spark, sf))


@query(
    "semi_exists",
    """select c_custkey, c_name from customer where exists (
      select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""",
)
def semi_exists(spark: SparkSession, sf: str) -> DataFrame:
    big = table(spark, sf, "orders").filter("o_totalprice > 400000")
    customers = table(spark, sf, "customer").select("c_custkey", "c_name")
    return listing.id_in_list(customers, big.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query(
    "category_software",
    f"""{WITH_ALL}, page as (
      select distinct r.software_id from relations r join software s using (software_id)
      where r.category_id = 3 and s.publication_status = 'published'
      order by r.software_id limit 12 offset 12)
    select software_id, software_name from software where software_id in (select software_id from page)""",
)
def category_software(spark: SparkSession, sf: str) -> DataFrame:
    return listing.category_software(
        relations(spark, sf), software(spark, sf), 3, page=2, size=listing.PAGE_SIZE
    ).select("software_id", "software_name")


@query(
    "software_categories_of",
    f"""{WITH_ALL} select distinct r.software_id, c.category_id, c.category_name
    from relations r join categories c using (category_id) where c.publication_status = 'published'""",
)
def software_categories_of(spark: SparkSession, sf: str) -> DataFrame:
    return listing.software_categories_of(relations(spark, sf), categories(spark, sf)).select(
        "software_id", "category_id", "category_name"
    )


@query(
    "search_in_category",
    f"""{WITH_ALL}, chosen as (
      select category_id from categories
      where slug = 'supplier-000000003' and publication_status = 'published'),
    items as (
      select software_id, software_name, 'items' as outcome from software
      where publication_status = 'published' and contains(lower(software_name), 'bolt')
        and software_id in (select software_id from relations where category_id in (from chosen)))
    select * from items union all
    select null, null, case when (select count(*) from chosen) > 0 then 'no_matches'
      else 'category_unavailable' end
    where (select count(*) from items) = 0""",
)
def search_in_category(spark: SparkSession, sf: str) -> DataFrame:
    return listing.search_in_category(
        software(spark, sf), relations(spark, sf), categories(spark, sf),
        "bolt", "supplier-000000003", ["software_name"],
    )


@query(
    "count_exact",
    """select p_partkey, p_name, (select count(*) from part where p_type = 'PROMO') as total
    from part where p_type = 'PROMO' order by p_name, p_partkey limit 12""",
)
def count_exact(spark: SparkSession, sf: str) -> DataFrame:
    chosen = table(spark, sf, "part").filter("p_type = 'PROMO'").select("p_partkey", "p_name", "p_type")
    total = chosen.groupBy("p_type").agg(F.count(F.lit(1)).alias("total"))
    page = listing.page_by_name(chosen, 1, listing.PAGE_SIZE, ["p_name", "p_partkey"])
    return page.join(F.broadcast(total), "p_type").select("p_partkey", "p_name", "total")


@query(
    "dashboard",
    f"""with {SOFTWARE}, {CATEGORIES}
    select 'software_in_review' as measure, count(*) filter (publication_status = 'in_review') as total
      from software
    union all select 'software_published', count(*) filter (publication_status = 'published')
      from software
    union all select 'software_needs_verification',
      count(*) filter (verification_status = 'needs_verification') from software
    union all select 'categories_in_review', count(*) filter (publication_status = 'in_review')
      from categories
    union all select 'categories_published', count(*) filter (publication_status = 'published')
      from categories""",
)
def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return listing.dashboard_counts(software(spark, sf), categories(spark, sf))


@query(
    "queue_order",
    f"""with {SOFTWARE} select software_id, slug, software_name, vendor, verification_status
    from software where publication_status = 'in_review'""",
)
def queue_order(spark: SparkSession, sf: str) -> DataFrame:
    queue = listing.review_queue(software(spark, sf), "in_review", ["software_name", "software_id"])
    return queue.select("software_id", "slug", "software_name", "vendor", "verification_status")


@query(
    "category_index",
    f"""{WITH_ALL}, held as (
      select distinct r.category_id, r.software_id from relations r join software s using (software_id)
      where s.publication_status = 'published'),
    placed as (
      select *, row_number() over (partition by category_id order by software_id) as n, count(*) over (partition by category_id) as total
      from held where category_id in (3, 4))
    select category_id, software_id, software_name from placed join software using (software_id)
    where (n - 1) // 12 + 1 = least(case when category_id = 3 then 2 else 1000 end, (total + 11) // 12)""",
)
def category_index(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of one category and the last of another, from one index."""
    every = software(spark, sf)
    index = listing.category_index(relations(spark, sf), every)
    pages = index.page(2, listing.PAGE_SIZE, 3).unionAll(index.page(1000, listing.PAGE_SIZE, 4))
    return pages.join(every, "software_id").select("category_id", "software_id", "software_name")


@query(
    "initials",
    """select upper(left(p_name, 1)) as letter, count(*) as names from part
    group by 1 having regexp_full_match(letter, '[A-Z]')""",
)
def initials(spark: SparkSession, sf: str) -> DataFrame:
    return listing.initials(software(spark, sf))


@query(
    "page_by_name",
    f"""with {SOFTWARE} select software_id, software_name, slug from software
    where publication_status = 'published' order by software_name, software_id limit 12 offset 24""",
)
def page_by_name(spark: SparkSession, sf: str) -> DataFrame:
    public = listing.published_only(software(spark, sf)).select("software_id", "software_name", "slug")
    return listing.page_by_name(public, 3, listing.PAGE_SIZE, ["software_name", "software_id"])


@query(
    "deep_page",
    """select o_orderkey, o_orderdate from (
      select *, row_number() over (order by o_orderdate, o_orderkey) as n, count(*) over () as total from orders)
    where (n - 1) // 12 + 1 = least(1000, (total + 11) // 12)""",
)
def deep_page(spark: SparkSession, sf: str) -> DataFrame:
    """A page far from the start, read from one range of an index."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return SortedIndex(orders, ["o_orderdate", "o_orderkey"]).page(1000, listing.PAGE_SIZE)


@query(
    "az_index",
    f"""with {SOFTWARE} select count(*) as total, greatest(1, ceil(count(*) / 6))::bigint as total_pages
    from software where publication_status = 'published' and upper(left(software_name, 1)) = 'B'""",
)
def az_index(spark: SparkSession, sf: str) -> DataFrame:
    return listing.az_index(listing.published_only(software(spark, sf)), "B")


@query(
    "featured_6",
    f"""with {SOFTWARE} select software_id, software_name from software
    where publication_status = 'published' order by software_name, software_id limit 6""",
)
def featured_6(spark: SparkSession, sf: str) -> DataFrame:
    public = listing.published_only(software(spark, sf)).select("software_id", "software_name")
    return listing.page_by_name(public, 1, 6, ["software_name", "software_id"])


@query(
    "previews",
    f"""{WITH_ALL}, shown as (
      select category_id, category_name from categories where publication_status = 'published'
      order by category_name, category_id limit 4),
    page as (
      select distinct r.category_id, r.software_id, s.software_name from relations r
      join shown using (category_id) join software s using (software_id)
      where s.publication_status = 'published'
      qualify dense_rank() over (partition by r.category_id order by r.software_id) <= 5)
    select category_id, category_name, software_id, software_name
    from page join shown using (category_id)""",
)
def previews(spark: SparkSession, sf: str) -> DataFrame:
    return listing.previews(categories(spark, sf), relations(spark, sf), software(spark, sf))


@query(
    "related",
    f"""{WITH_ALL}, pairs as (
      select distinct r.software_id, r.category_id, c.category_name, s.software_name
      from relations r join categories c using (category_id) join software s using (software_id)
      where c.publication_status = 'published' and s.publication_status = 'published'),
    mine as (
      select software_id, category_id,
        row_number() over (partition by software_id order by category_name, category_id) as cat_pos
      from pairs qualify cat_pos <= 3),
    shelf as (
      select category_id, software_id as related_id, software_name as related_name from pairs
      qualify row_number() over (partition by category_id order by software_id) <= 7),
    offered as (
      select m.software_id, related_id, related_name, min(cat_pos) as cat_pos
      from mine m join shelf using (category_id) where related_id <> m.software_id group by all)
    select software_id, related_id, related_name,
      row_number() over (partition by software_id order by cat_pos, related_name, related_id) as position
    from offered qualify position <= 6""",
)
def related(spark: SparkSession, sf: str) -> DataFrame:
    return listing.related(relations(spark, sf), categories(spark, sf), software(spark, sf))


FIXED_PAGES = ["/", "/software", "/categories", "/privacy", "/terms", "/contact"]


@query(
    "distinct_paths",
    f"""with {SOFTWARE}, {CATEGORIES}
    select unnest({FIXED_PAGES!r}) as path
    union select '/categories/' || slug from categories where publication_status = 'published'
    union select '/software/' || slug from software where publication_status = 'published'""",
)
def distinct_paths(spark: SparkSession, sf: str) -> DataFrame:
    return listing.distinct_paths(FIXED_PAGES, categories(spark, sf), software(spark, sf))
