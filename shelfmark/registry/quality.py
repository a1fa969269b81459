"""Data-quality, aggregate, window and set queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import rules, text
from shelfmark.operators import checks, history, keyed, versions
from shelfmark.registry import query
from shelfmark.registry.tables import SOFTWARE, software
from shelfmark.session import table

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate"
LINE_COLUMNS = LINE.split(", ")


@query(
    "map_legacy_status",
    """select o_orderkey, case lower(coalesce(case o_orderstatus when 'F' then 'Published'
        when 'O' then 'Candidate' end, '')) when 'published' then 'published'
        when 'candidate' then 'in_review' else 'draft' end as software_status,
      case o_orderpriority when '1-URGENT' then 'in_review' when '2-HIGH' then 'archived'
        else 'draft' end as category_status
    from orders""",
)
def map_legacy_status(spark: SparkSession, sf: str) -> DataFrame:
    product = F.when(F.col("o_orderstatus") == "F", "Published").when(
        F.col("o_orderstatus") == "O", "Candidate"
    )
    category = F.when(F.col("o_orderpriority") == "1-URGENT", "ACTIVE").when(
        F.col("o_orderpriority") == "2-HIGH", "archived"
    )
    return table(spark, sf, "orders").select(
        "o_orderkey",
        rules.map_legacy_status(product).alias("software_status"),
        rules.map_legacy_status(category, "category").alias("category_status"),
    )


@query(
    "allowed_values",
    """select o_orderkey, o_orderstatus, o_orderpriority from orders
    where o_orderstatus not in ('F', 'O') or o_orderpriority not in ('1-URGENT', '2-HIGH', '5-LOW')""",
)
def allowed_values(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return checks.check_rules(
        rows,
        {
            "status": F.col("o_orderstatus").isin("F", "O"),
            "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW"),
        },
    ).drop("failed_rules")


@query(
    "dup_names",
    """select lower(trim(p_name)) as normalized_name, count(*) as duplicate_count from part
    where nullif(trim(p_name), '') is not null group by 1 having count(*) > 1""",
)
def dup_names(spark: SparkSession, sf: str) -> DataFrame:
    found = checks.duplicate_names(table(spark, sf, "part"), "p_name")
    return found.orderBy(F.desc("duplicate_count"), "normalized_name")


@query(
    "dup_pairs",
    """select l_partkey, l_suppkey, count(*) as duplicate_count from lineitem
    group by 1, 2 having count(*) > 1""",
)
def dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return checks.duplicate_keys(table(spark, sf, "lineitem"), ["l_partkey", "l_suppkey"])


@query(
    "count_distinct_norm",
    """select count(distinct lower(trim(p_brand))) as brands, count(distinct lower(p_name)) as names,
      count(*) filter (p_size > 25) as large, count(*) as products from part""",
)
def count_distinct_norm(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").agg(
        F.countDistinct(F.lower(F.trim("p_brand"))).alias("brands"),
        F.countDistinct(F.lower("p_name")).alias("names"),
        F.count_if(F.col("p_size") > 25).alias("large"),
        F.count(F.lit(1)).alias("products"),
    )


@query(
    "value_profile",
    """select 'o_orderstatus' as field, o_orderstatus as observed_value, count(*) as row_count
      from orders group by 2
    union all select 'o_orderpriority', o_orderpriority, count(*) from orders group by 2
    union all select 'l_returnflag', l_returnflag, count(*) from lineitem group by 2
    union all select 'l_linenumber', l_linenumber::varchar, count(*) from lineitem group by 2""",
)
def value_profile(spark: SparkSession, sf: str) -> DataFrame:
    return checks.value_profile(
        table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]
    ).unionByName(checks.value_profile(table(spark, sf, "lineitem"), ["l_returnflag", "l_linenumber"]))


@query(
    "json_type_profile",
    """select case when v is null then null else lower(json_type(v)) end as json_type,
      v as observed_value, count(*) as row_count,
      case when v is null then 'absent_or_null' when json_type(v) = 'UBIGINT' then 'compatible'
        else 'STOP_unexpected_type' end as verdict
    from (select (props->'$.k')::varchar as v from events) group by all""".replace(
        "lower(json_type(v))", "case json_type(v) when 'UBIGINT' then 'bigint' else 'other' end"
    ),
)
def json_type_profile(spark: SparkSession, sf: str) -> DataFrame:
    values = table(spark, sf, "events").select(F.get_json_object("props", "$.k").alias("v"))
    return checks.json_type_profile(values, "v", "bigint")


@query(
    "check_report",
    """select 'blank_text' as check_name, count(*) filter (trim(text) = '') as issue_count from documents
    union all select 'short_text', count(*) filter (n_chars < 200) from documents
    union all select 'unlabelled', (select count(*) from documents)
      - (select count(distinct doc_id) from labels)
    union all select 'big_discount', count(*) filter (l_discount > 0.08) from lineitem
    union all select 'no_tax', count(*) filter (l_tax = 0) from lineitem""",
)
def check_report(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    labelled = table(spark, sf, "labels").select("doc_id")
    return checks.union_all(
        [
            checks.check_report(
                documents,
                {"blank_text": text.is_blank(F.col("text")), "short_text": F.col("n_chars") < 200},
            ),
            checks.group_check(documents.join(labelled, "doc_id", "left_anti"), "unlabelled"),
            checks.check_report(
                table(spark, sf, "lineitem"),
                {"big_discount": F.col("l_discount") > 0.08, "no_tax": F.col("l_tax") == 0},
            ),
        ]
    )


@query(
    "one_primary",
    """select l_partkey as software_id, count(*) filter (l_returnflag = 'R') as primaries,
      count(*) as relations, count(distinct l_suppkey) as categories
    from lineitem group by 1
    having count(*) filter (l_returnflag = 'R') <> 1 or count(*) <> count(distinct l_suppkey)""",
)
def one_primary(spark: SparkSession, sf: str) -> DataFrame:
    relations = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("software_id"),
        F.col("l_suppkey").alias("category_id"),
        (F.col("l_returnflag") == "R").alias("primary_category"),
    )
    return checks.one_primary(relations)


@query(
    "conflicting_slugs",
    """select replace(p_name, ' ', '-') as slug, min(p_brand) as first_value, max(p_brand) as last_value
      from part group by 1 having count(distinct p_brand) > 1
    union all select p_brand, min(p_name), max(p_name) from part group by 1
      having count(distinct p_name) > 1""",
)
def conflicting_slugs(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").withColumn("slug", F.replace("p_name", F.lit(" "), F.lit("-")))
    by_slug = checks.conflicting(part, "slug", "p_brand")
    by_name = checks.conflicting(part, "p_brand", "p_name").withColumnRenamed("p_brand", "slug")
    return by_slug.unionByName(by_name)


@query(
    "ordered_array",
    """select p_brand, string_agg(distinct p_type, ',' order by p_type) as types
    from part group by 1""",
)
def ordered_array(spark: SparkSession, sf: str) -> DataFrame:
    return checks.ordered_array(table(spark, sf, "part"), ["p_brand"], "p_type", "types")


@query(
    "ordered_entries",
    """select p_brand, p_name, row_number() over (partition by p_brand order by p_name) as position
    from (select distinct p_brand, p_name from part)""",
)
def ordered_entries(spark: SparkSession, sf: str) -> DataFrame:
    return checks.ordered_entries(table(spark, sf, "part"), ["p_brand"], "p_name")


@query(
    "monetization_counts",
    """select coalesce(case when p_size < 10 then 'KNOWN_EXISTING_MONETIZATION'
        when p_size < 30 then 'PUBLIC_AFFILIATE_PROGRAM_FOUND' end, 'UNKNOWN') as classification,
      count(*) as products from part group by 1""",
)
def monetization_counts(spark: SparkSession, sf: str) -> DataFrame:
    known = F.when(F.col("p_size") < 10, "KNOWN_EXISTING_MONETIZATION").when(
        F.col("p_size") < 30, "PUBLIC_AFFILIATE_PROGRAM_FOUND"
    )
    named = F.coalesce(known, F.lit("UNKNOWN")).alias("classification")
    return table(spark, sf, "part").groupBy(named).agg(F.count(F.lit(1)).alias("products"))


REVIEW_CLASSES = [
    "EXISTING_CATALOG_MATCH",
    "UNMATCHED_COMMERCIAL_OPPORTUNITY",
    "AMBIGUOUS_REVIEW_REQUIRED",
    "DUPLICATE_OR_INVALID",
]


@query(
    "review_summary",
    """select class, position, count(o_orderkey) as n from (values
      ('EXISTING_CATALOG_MATCH', 0), ('UNMATCHED_COMMERCIAL_OPPORTUNITY', 1),
      ('AMBIGUOUS_REVIEW_REQUIRED', 2), ('DUPLICATE_OR_INVALID', 3)) as t(class, position)
    left join (select o_orderkey, case o_orderstatus when 'F' then 'EXISTING_CATALOG_MATCH'
      when 'O' then 'DUPLICATE_OR_INVALID' when 'P' then 'AMBIGUOUS_REVIEW_REQUIRED' end as c
      from orders) on c = class group by all""",
)
def review_summary(spark: SparkSession, sf: str) -> DataFrame:
    state = F.col("o_orderstatus")
    named = (
        F.when(state == "F", "EXISTING_CATALOG_MATCH")
        .when(state == "O", "DUPLICATE_OR_INVALID")
        .when(state == "P", "AMBIGUOUS_REVIEW_REQUIRED")
    )
    return checks.count_by_class(
        table(spark, sf, "orders").select(named.alias("class")), "class", REVIEW_CLASSES
    )


@query(
    "readiness_summary",
    """select readiness, position, count(conv_id) as n from (values
      ('READY_TO_APPLY', 0), ('NEEDS_REVIEW', 1), ('NOT_READY', 2)) as t(readiness, position)
    left join (select conv_id, case when bool_or(role = 'system') then 'NOT_READY'
      else 'NEEDS_REVIEW' end as r from conversations group by conv_id) on r = readiness
    group by all""",
)
def readiness_summary(spark: SparkSession, sf: str) -> DataFrame:
    programs = (
        table(spark, sf, "conversations")
        .groupBy("conv_id")
        .agg(
            F.when(F.bool_or(F.col("role") == "system"), "NOT_READY")
            .otherwise("NEEDS_REVIEW")
            .alias("readiness")
        )
    )
    return checks.count_by_class(
        programs, "readiness", ["READY_TO_APPLY", "NEEDS_REVIEW", "NOT_READY"]
    )


@query(
    "coverage_report",
    """with o as (select case when p_size < 30 then 'success' else 'fallback' end as status,
        case p_type when 'PROMO' then 'product' when 'SMALL' then 'vendor' else 'favicon' end as kind,
        case when p_size < 35 then 'ambiguous_identity' when p_size < 40 then 'blocked'
          when p_size < 45 then 'http_failure' else 'invalid_assets' end as reason,
        case when p_size = 36 then 403 when p_size = 37 then 429 else 200 end as http,
        p_size as invalid from part)
    select count(*) as products_considered, count(*) filter (status = 'success') as successful,
      round(100.0 * count(*) filter (status = 'success') / greatest(count(*), 1), 1)::double
        as coverage_percent,
      count(*) filter (status = 'success' and kind = 'product') as product_specific,
      count(*) filter (status = 'success' and kind = 'vendor') as vendor_logos,
      count(*) filter (status = 'success' and kind = 'favicon') as favicon_derived,
      count(*) filter (status = 'fallback') as fallbacks,
      count(*) filter (status = 'fallback' and reason = 'ambiguous_identity') as ambiguous,
      count(*) filter (status = 'fallback' and reason = 'blocked') as blocked,
      count(*) filter (status = 'fallback' and reason = 'http_failure') as http_failures,
      (sum(invalid) filter (status = 'fallback'))::bigint as invalid_candidates,
      count(*) filter (status = 'fallback' and http = 403) as http_403,
      count(*) filter (status = 'fallback' and http = 429) as http_429 from o""",
)
def coverage_report(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    outcomes = table(spark, sf, "part").select(
        F.when(size < 30, "success").otherwise("fallback").alias("status"),
        F.when(F.col("p_type") == "PROMO", "product")
        .when(F.col("p_type") == "SMALL", "vendor")
        .otherwise("favicon")
        .alias("source_kind"),
        F.when(size < 35, "ambiguous_identity")
        .when(size < 40, "blocked")
        .when(size < 45, "http_failure")
        .otherwise("invalid_assets")
        .alias("reason"),
        F.when(size == 36, 403).when(size == 37, 429).otherwise(200).alias("page_http_status"),
        size.alias("invalid_candidates"),
    )
    report = checks.coverage_report(outcomes)
    return report.withColumn("coverage_percent", F.col("coverage_percent").cast("double"))


@query(
    "duplicate_groups",
    r"""with f as (select doc_id,
        sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) as fingerprint from documents)
    select doc_id, fingerprint, count(*) over (partition by fingerprint) as copies,
      min(doc_id) over (partition by fingerprint) as first_copy
    from f qualify copies > 1""",
)
def duplicate_groups(spark: SparkSession, sf: str) -> DataFrame:
    marked = table(spark, sf, "documents").select(
        "doc_id", F.sha2(text.norm_space(F.col("text")), 256).alias("fingerprint")
    )
    return checks.members_of_repeated(marked, "fingerprint", "doc_id")


@query(
    "first_per_key",
    """select distinct on (p_brand) p_brand, p_partkey, p_name from part
    order by p_brand, p_retailprice, p_partkey""",
)
def first_per_key(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice")
    return keyed.first_per_key(part, ["p_brand"], ["p_retailprice", "p_partkey"]).drop(
        "p_retailprice"
    )


@query(
    "batch_first_wins",
    r"""with d as (select doc_id, case when lang <> 'de'
        then sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) end as provider_key
      from documents)
    select doc_id, provider_key is not null and row_number() over (
      partition by provider_key order by doc_id) > 1 as repeated from d""",
)
def batch_first_wins(spark: SparkSession, sf: str) -> DataFrame:
    from shelfmark.plans.gate import mark_repeats

    digest = F.sha2(text.norm_space(F.col("text")), 256)
    rows = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") != "de", digest).alias("provider_key")
    )
    return mark_repeats(rows, "provider_key", "doc_id").select("doc_id", "repeated")


@query(
    "history_50",
    """select user_id, event_id, ts, case when json_type(props, '$.k') = 'VARCHAR'
        then props->>'$.k' end as note, row_number() over (
        partition by user_id order by ts desc, event_id desc) as position
    from events qualify position <= 50""",
)
def history_50(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts", "props")
    newest = history.latest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return newest.withColumn("note", history.json_text("props", "k")).drop("props")


VIEWS = """with v as (select user_id, ts, event_id, event_type as path,
    lag(event_type) over (partition by user_id order by ts, event_id) as referrer
  from events where event_type <> 'error')
select user_id, ts, event_id, path, referrer from v where referrer is null or referrer <> path"""


@query("previous_page", VIEWS)
def previous_page(spark: SparkSession, sf: str) -> DataFrame:
    visits = table(spark, sf, "events").select(
        "user_id", "ts", "event_id", F.col("event_type").alias("path")
    )
    return history.page_views(
        visits, "user_id", "ts", "event_id", "path", F.col("path") == "error"
    )


@query("stable_sort", "select p_partkey, p_retailprice from part")
def stable_sort(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    return part.orderBy(F.desc("p_retailprice"), "p_partkey")


@query(
    "union_checks",
    """select 'duplicate_pair' as check_name, count(*) as issue_count from (
      select 1 from lineitem group by l_partkey, l_suppkey having count(*) > 1)
    union all select 'duplicate_line', count(*) from (
      select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)
    union all select 'duplicate_name', count(*) from (
      select 1 from part group by p_name having count(*) > 1)""",
)
def union_checks(spark: SparkSession, sf: str) -> DataFrame:
    lines, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return checks.union_all(
        [
            checks.group_check(
                checks.duplicate_keys(lines, ["l_partkey", "l_suppkey"]), "duplicate_pair"
            ),
            checks.group_check(
                checks.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]), "duplicate_line"
            ),
            checks.group_check(checks.duplicate_keys(part, ["p_name"]), "duplicate_name"),
        ]
    )


@query(
    "snapshot_diff",
    """with b as (select p_partkey, p_name, p_brand from part where p_size < 45),
    a as (select p_partkey, case when p_size = 7 then upper(p_name) else p_name end as p_name, p_brand
      from part where p_size > 5)
    select *, 'removed' as change from (select * from b except select * from a)
    union all select *, 'added' from (select * from a except select * from b)""",
)
def snapshot_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    before = part.filter("p_size < 45").select("p_partkey", "p_name", "p_brand")
    renamed = F.when(F.col("p_size") == 7, F.upper("p_name")).otherwise(F.col("p_name"))
    after = part.filter("p_size > 5").select("p_partkey", renamed.alias("p_name"), "p_brand")
    return versions.snapshot_diff(before, after)


@query(
    "snapshot_diff_all",
    """with b as (select l_partkey, l_suppkey, l_returnflag from lineitem where l_quantity < 40),
    a as (select l_partkey, l_suppkey, l_returnflag from lineitem where l_quantity > 10),
    u as (select *, 'removed' as change from (select * from b except all select * from a)
      union all select *, 'added' from (select * from a except all select * from b))
    select l_partkey, l_suppkey, l_returnflag, change, count(*) as copies from u group by all""",
)
def snapshot_diff_all(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["l_partkey", "l_suppkey", "l_returnflag"]
    lines = table(spark, sf, "lineitem")
    return versions.snapshot_diff_all(
        lines.filter("l_quantity < 40").select(*columns),
        lines.filter("l_quantity > 10").select(*columns),
    )


@query(
    "shared_ids",
    """with per as (select l_partkey, l_suppkey, count(distinct l_returnflag) as kinds
      from lineitem group by 1, 2),
    resolved as (select l_partkey, count(distinct l_returnflag) as kinds from lineitem group by 1)
    select r.l_partkey as candidate, r.kinds as resolved,
      coalesce(count(*) filter (p.kinds = r.kinds), 0) as shared,
      r.kinds >= 2 and count(*) filter (p.kinds = r.kinds) = 0 as conflict
    from resolved r join per p using (l_partkey) group by r.l_partkey, r.kinds""",
)
def shared_ids(spark: SparkSession, sf: str) -> DataFrame:
    from shelfmark.plans.programs import shared_ids as divide

    evidence = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("candidate"),
        F.col("l_returnflag").alias("kind"),
        F.col("l_suppkey").alias("id"),
    )
    return divide(evidence)


@query(
    "dedupe_by_key",
    """select p_name, p_brand, max_by(p_type, p_partkey) as last_type, min(p_partkey) as first_position
    from part group by 1, 2""",
)
def dedupe_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "part")
        .groupBy("p_name", "p_brand")
        .agg(
            F.max_by("p_type", "p_partkey").alias("last_type"),
            F.min("p_partkey").alias("first_position"),
        )
    )


@query(
    "insert_ignore",
    """with old as (select p_name, p_brand, p_partkey from part where p_size < 10),
    new as (select p_name, p_brand, min(p_partkey) as p_partkey from part where p_size >= 10
      group by all)
    select * from old union all select * from new where not exists (
      select 1 from old where old.p_name = new.p_name and old.p_brand = new.p_brand)""",
)
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    columns = ["p_name", "p_brand", "p_partkey"]
    return versions.insert_ignore(
        part.filter("p_size < 10").select(*columns),
        part.filter("p_size >= 10").select(*columns),
        ["p_name", "p_brand"],
        ["p_partkey"],
    )


@query(
    "update_from",
    """select o_orderkey, case when c_acctbal > 0 and o_orderstatus = 'O' then 'X' || c_mktsegment
      else o_orderpriority end as o_orderpriority,
      case when c_acctbal > 0 and o_orderstatus = 'O' then timestamp '2002-01-01' else o_orderdate end
        as o_orderdate
    from orders left join customer on c_custkey = o_custkey""",
)
def update_from(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    customers = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return versions.update_from(
        orders,
        customers,
        ["c_custkey"],
        (F.col("new_c_acctbal") > 0) & (F.col("o_orderstatus") == "O"),
        {"o_orderpriority": F.concat(F.lit("X"), "new_c_mktsegment")},
        touched=("o_orderdate", F.expr("timestamp_ntz'2002-01-01 00:00:00'")),
    ).select("o_orderkey", "o_orderpriority", "o_orderdate")


@query(
    "touch_updated_at",
    """select p_partkey, case when p_name like 'small%' then upper(p_name) else p_name end as p_name,
      case when p_name like 'small%' then timestamp '2026-01-01' else timestamp '2025-01-01' end
        as updated_at from part""",
)
def touch_updated_at(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(
        "p_partkey", "p_name", F.expr("timestamp_ntz'2025-01-01 00:00:00'").alias("updated_at")
    )
    renamed = F.when(F.col("p_name").startswith("small"), F.upper("p_name")).otherwise(F.col("p_name"))
    return versions.update_from(
        part,
        part.select("p_partkey", renamed.alias("name")),
        ["p_partkey"],
        F.lit(True),
        {"p_name": F.col("new_name")},
        touched=("updated_at", F.expr("timestamp_ntz'2026-01-01 00:00:00'")),
    )


@query(
    "snapshot_table",
    "select o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority from orders",
)
def snapshot_table(spark: SparkSession, sf: str) -> DataFrame:
    return versions.snapshot_table(table(spark, sf, "orders"), drop=["o_totalprice"])


@query(
    "count_guard",
    f"""with {SOFTWARE} select publication_status, count(*) as products from software group by 1""",
)
def count_guard(spark: SparkSession, sf: str) -> DataFrame:
    catalogue = software(spark, sf)
    before = table(spark, sf, "part").count()
    checks.count_guard(before, catalogue, what="products")
    return catalogue.groupBy("publication_status").agg(F.count(F.lit(1)).alias("products"))


@query(
    "change_log",
    """with b as (select p_partkey, p_name, p_size from part where p_size < 45),
    a as (select p_partkey, case when p_size = 7 then upper(p_name) else p_name end as p_name, p_size
      from part where p_size > 5)
    select coalesce(b.p_partkey, a.p_partkey) as p_partkey,
      case when b.p_partkey is null then 'insert' when a.p_partkey is null then 'delete'
        else 'update' end as action,
      case when b.p_partkey is not null then '{"p_name":"' || b.p_name || '","p_size":' || b.p_size || '}'
        end as before_data,
      case when a.p_partkey is not null then '{"p_name":"' || a.p_name || '","p_size":' || a.p_size || '}'
        end as after_data
    from b full join a on a.p_partkey = b.p_partkey
    where b.p_name is distinct from a.p_name""",
)
def change_log(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    before = part.filter("p_size < 45").select("p_partkey", "p_name", "p_size")
    renamed = F.when(F.col("p_size") == 7, F.upper("p_name")).otherwise(F.col("p_name"))
    after = part.filter("p_size > 5").select("p_partkey", renamed.alias("p_name"), "p_size")
    return versions.change_log(before, after, ["p_partkey"])


@query(
    "clear_removed_target",
    """select l.p_partkey, case when s.s_suppkey is null and state like '%matched' and state <> 'unmatched'
        then 'unmatched' else state end as match_state,
      case when s.s_suppkey is null and state <> 'ignored' then null else 'alias' end as match_method,
      s.s_suppkey as software_id
    from (select p_partkey, p_size, case when p_size < 20 then 'auto_matched'
      when p_size < 35 then 'reviewed_matched' else 'ignored' end as state from part) l
    left join (select * from supplier where s_acctbal > 0) s on s.s_suppkey = l.p_size""",
)
def clear_removed_target(spark: SparkSession, sf: str) -> DataFrame:
    from shelfmark.plans.identity import clear_removed_target as clear

    size = F.col("p_size")
    identities = table(spark, sf, "part").select(
        "p_partkey",
        size.cast("long").alias("software_id"),
        F.when(size < 20, "auto_matched").when(size < 35, "reviewed_matched").otherwise("ignored")
        .alias("match_state"),
        F.lit("alias").alias("match_method"),
        F.lit(90).alias("confidence"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias(
            "match_evidence"
        ),
    )
    alive = table(spark, sf, "supplier").filter("s_acctbal > 0").select(
        F.col("s_suppkey").alias("software_id")
    )
    cleared = clear(identities, alive, F.lit("2026-01-01T00:00:00Z"))
    return cleared.select("p_partkey", "match_state", "match_method", "software_id")


RULES = {
    "valid_window": "l_quantity < 2 or l_shipdate < timestamp '2001-01-01'",
    "discounted_has_tax": "l_discount <= 0.05 or l_tax > 0",
    "positive_price": "l_extendedprice > 1000",
    "returned_is_final": "l_returnflag <> 'R' or l_linestatus = 'F'",
}


@query(
    "check_rules",
    "with r as (select {line}, concat_ws(',', {marks}) as failed_rules from lineitem) "
    "select * from r where failed_rules <> ''".format(
        line=LINE,
        marks=", ".join(f"case when not ({c}) then '{n}' end" for n, c in RULES.items()),
    ),
)
def check_rules(spark: SparkSession, sf: str) -> DataFrame:
    named = {n: F.expr(c.replace("timestamp '", "timestamp_ntz '")) for n, c in RULES.items()}
    broken = checks.check_rules(table(spark, sf, "lineitem"), named)
    return broken.select(*LINE_COLUMNS, F.array_join("failed_rules", ",").alias("failed_rules"))


@query(
    "preflight_suite",
    """select 'orders_blank_priority' as check_name, count(*) filter (
        coalesce(trim(o_orderpriority), '') = '') as issue_count from orders
    union all select 'orders_unknown_status', count(*) filter (o_orderstatus not in ('F', 'O')) from orders
    union all select 'lines_bad_discount', count(*) filter (l_discount > 0.09) from lineitem
    union all select 'part_duplicate_name', count(*) from (
      select 1 from part group by lower(trim(p_name)) having count(*) > 1)
    union all select 'relation_duplicate_pair', count(*) from (
      select 1 from lineitem group by l_partkey, l_suppkey having count(*) > 1)
    union all select 'relation_multiple_primaries', count(*) from (
      select 1 from lineitem where l_returnflag = 'R' group by l_partkey having count(*) > 1)
    union all select 'relation_orphan_part', count(*) from lineitem
      where l_partkey not in (select p_partkey from part where p_size < 25)
    union all select 'events_orphan_customer', count(*) from events
      where user_id not in (select c_custkey from customer where c_acctbal > 0)
    union all select 'pages_bad_url', count(*) filter (not regexp_matches(url, '^https://', 'i')) from pages
    union all select 'pages_duplicate_host', count(*) from (
      select 1 from pages group by regexp_extract(lower(url), '^https?://([^/:?#]+)', 1)
      having count(*) > 1)
    union all select 'documents_blank', count(*) filter (trim(text) = '') from documents
    union all select 'labels_orphan_document', count(*) from labels
      where doc_id not in (select doc_id from documents where lang = 'en')
    union all select 'benchmark_blank', count(*) filter (trim(text) = '') from benchmark
    union all select 'conversations_blank', count(*) filter (trim(text) = '') from conversations
    union all select 'embeddings_empty', count(*) filter (len(embedding) = 0) from embeddings
    union all select 'nation_orphan_region', count(*) from nation
      where n_regionkey not in (select r_regionkey from region where r_regionkey < 4)
    union all select 'supplier_negative_balance', count(*) filter (s_acctbal < 0) from supplier""",
)
def preflight_suite(spark: SparkSession, sf: str) -> DataFrame:
    def t(name: str) -> DataFrame:
        return table(spark, sf, name)

    lines, part, pages = t("lineitem"), t("part"), t("pages")
    host = F.regexp_extract(F.lower("url"), "^https?://([^/:?#]+)", 1)
    primaries = lines.filter("l_returnflag = 'R'")
    blank = {"benchmark": "text", "conversations": "text"}
    reports = [
        checks.check_report(
            t("orders"),
            {
                "orders_blank_priority": text.is_blank(F.col("o_orderpriority")),
                "orders_unknown_status": ~F.col("o_orderstatus").isin("F", "O"),
            },
        ),
        checks.check_report(lines, {"lines_bad_discount": F.col("l_discount") > 0.09}),
        checks.group_check(checks.duplicate_names(part, "p_name"), "part_duplicate_name"),
        checks.group_check(
            checks.duplicate_keys(lines, ["l_partkey", "l_suppkey"]), "relation_duplicate_pair"
        ),
        checks.group_check(
            checks.duplicate_keys(primaries, ["l_partkey"]), "relation_multiple_primaries"
        ),
        checks.orphan_count(
            lines, "l_partkey", part.filter("p_size < 25"), "p_partkey", "relation_orphan_part"
        ),
        checks.orphan_count(
            t("events"), "user_id", t("customer").filter("c_acctbal > 0"), "c_custkey",
            "events_orphan_customer",
        ),
        checks.check_report(pages, {"pages_bad_url": ~F.col("url").rlike("(?i)^https://")}),
        checks.group_check(
            checks.duplicate_keys(pages.select(host.alias("host")), ["host"]), "pages_duplicate_host"
        ),
        checks.check_report(t("documents"), {"documents_blank": text.is_blank(F.col("text"))}),
        checks.orphan_count(
            t("labels"), "doc_id", t("documents").filter("lang = 'en'"), "doc_id",
            "labels_orphan_document",
        ),
        *[
            checks.check_report(t(name), {f"{name}_blank": text.is_blank(F.col(column))})
            for name, column in blank.items()
        ],
        checks.check_report(t("embeddings"), {"embeddings_empty": F.size("embedding") == 0}),
        checks.orphan_count(
            t("nation"), "n_regionkey", t("region").filter("r_regionkey < 4"), "r_regionkey",
            "nation_orphan_region",
        ),
        checks.check_report(
            t("supplier"), {"supplier_negative_balance": F.col("s_acctbal") < 0}
        ),
    ]
    return checks.union_all(reports)


@query(
    "constraint_gate",
    """select 'orphan_order' as check_name, count(*) as issue_count from lineitem
      where l_orderkey not in (select o_orderkey from orders)
    union all select 'duplicate_order', count(*) from (
      select 1 from orders group by o_orderkey having count(*) > 1)""",
)
def constraint_gate(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    report = checks.orphan_count(
        table(spark, sf, "lineitem"), "l_orderkey", orders, "o_orderkey", "orphan_order"
    ).unionByName(checks.group_check(checks.duplicate_keys(orders, ["o_orderkey"]), "duplicate_order"))
    checks.constraint_gate(report)
    return report


@query(
    "write_result",
    """select case when n_chars > 500 then 'READY' else 'EXCEPTION' end as decision,
      count(*) as rows, sum(n_chars)::bigint as characters from documents group by 1""",
)
def write_result(spark: SparkSession, sf: str) -> DataFrame:
    from shelfmark.sources.sinks import write_result as write

    decided = table(spark, sf, "documents").select(
        "doc_id", "n_chars",
        F.when(F.col("n_chars") > 500, "READY").otherwise("EXCEPTION").alias("decision"),
    )
    return (
        write(decided, "decision")
        .groupBy("decision")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("n_chars").cast("long").alias("characters"))
    )
