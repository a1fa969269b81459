"""Event queries: the batch rules, and the streaming jobs over the same table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import history
from shelfmark.registry import query
from shelfmark.session import table
from shelfmark.streaming import events as rules
from shelfmark.streaming import streams


def conversions(frame: DataFrame) -> DataFrame:
    """Purchases: large ones identified by user and day, the others by their content."""
    big = F.col("value") >= 10
    by_day = F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyyMMdd"))
    content = F.sha2(F.concat_ws("|", F.col("user_id"), "props"), 256)
    return frame.filter("event_type = 'purchase'").select(
        F.col("event_id").alias("affiliate_conversion_id"),
        F.lit("shop").alias("network"),
        F.when(big, by_day).alias("external_event_id"),
        F.when(~big, content).alias("payload_digest"),
        F.get_json_object("props", "$.k").cast("bigint").alias("affiliate_click_id"),
        F.col("value").cast("decimal(20,6)").alias("commission_amount"),
        F.col("ts").alias("occurred_at"),
    )


CONVERSIONS = """conversions as (
  select event_id as affiliate_conversion_id, 'shop' as network,
    case when value >= 10 then user_id || '-' || strftime(ts, '%Y%m%d') end as external_event_id,
    case when value < 10 then sha256(user_id || '|' || props) end as payload_digest,
    (props->>'$.k')::bigint as affiliate_click_id,
    value::decimal(20,6) as commission_amount, ts as occurred_at
  from events where event_type = 'purchase')"""


@query(
    "ingest_conversions",
    f"""with {CONVERSIONS}, old as (select * from conversions where occurred_at < timestamp '2024-01-03'),
    new as (select * from conversions where occurred_at >= timestamp '2024-01-02')
    select affiliate_conversion_id, external_event_id, payload_digest from new
    where external_event_id is not null
      and external_event_id not in (select external_event_id from old where external_event_id is not null)
    qualify row_number() over (partition by external_event_id order by affiliate_conversion_id) = 1
    union all
    select affiliate_conversion_id, external_event_id, payload_digest from new
    where payload_digest is not null
      and payload_digest not in (select payload_digest from old where payload_digest is not null)
    qualify row_number() over (partition by payload_digest order by affiliate_conversion_id) = 1""",
)
def ingest_conversions(spark: SparkSession, sf: str) -> DataFrame:
    every = conversions(table(spark, sf, "events"))
    old = every.filter("occurred_at < timestamp_ntz'2024-01-03 00:00:00'")
    new = every.filter("occurred_at >= timestamp_ntz'2024-01-02 00:00:00'")
    return rules.ingest_conversions(new, old, "affiliate_conversion_id").select(
        "affiliate_conversion_id", "external_event_id", "payload_digest"
    )


@query(
    "ingest_both_identities",
    """with recursive c as (
      select event_id as id, user_id,
        case when value >= 5 then user_id || '-' || strftime(ts, '%Y%m%d') end as e,
        case when event_id % 7 <> 0 then user_id || '|' || (event_id % 5) end as d,
        row_number() over (partition by user_id order by event_id) as n
      from events),
    walk as (
      select user_id, 0::bigint as n, []::varchar[] as es, []::varchar[] as ds, null::bigint as id, false as taken
      from (select distinct user_id from c)
      union all
      select user_id, n, case when fits and e is not null then list_append(es, e) else es end,
        case when fits and d is not null then list_append(ds, d) else ds end, id, fits
      from (
        select w.user_id, c.n, es, ds, c.id, e, d, (e is not null or d is not null)
          and not coalesce(list_contains(es, e), false) and not coalesce(list_contains(ds, d), false) as fits
        from walk w join c on c.user_id = w.user_id and c.n = w.n + 1))
    select id as affiliate_conversion_id, e as external_event_id, d as payload_digest
    from walk join c using (id) where taken""",
)
def ingest_both_identities(spark: SparkSession, sf: str) -> DataFrame:
    """All events as conversions, most with both identities, so that a row may be refused for either."""
    big, day = F.col("value") >= 5, F.date_format("ts", "yyyyMMdd")
    rows = table(spark, sf, "events").select(
        F.col("event_id").alias("affiliate_conversion_id"),
        F.lit("shop").alias("network"),
        F.when(big, F.concat_ws("-", F.col("user_id").cast("string"), day)).alias("external_event_id"),
        F.when(F.col("event_id") % 7 != 0, F.concat_ws("|", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string"))).alias("payload_digest"),
    )
    return rules.ingest_conversions(rows, rows.limit(0), "affiliate_conversion_id").drop("network")


@query(
    "clicks_by_link",
    """select user_id, time_bucket(interval 6 hour, ts) as window_start,
      time_bucket(interval 6 hour, ts) + interval 6 hour as window_end, count(*) as n
    from events where event_type = 'click' group by all""",
)
def clicks_by_link(spark: SparkSession, sf: str) -> DataFrame:
    clicks = table(spark, sf, "events").filter("event_type = 'click'")
    return rules.events_by_link(clicks, "user_id", "ts", "6 hours")


@query(
    "newest_clicks",
    """select user_id, event_id, ts, row_number() over (
      partition by user_id order by ts desc, event_id desc) as position
    from events where event_type in ('click', 'purchase') qualify position <= 5""",
)
def newest_clicks(spark: SparkSession, sf: str) -> DataFrame:
    clicks = table(spark, sf, "events").filter("event_type in ('click', 'purchase')")
    return history.latest(
        clicks.select("user_id", "event_id", "ts"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 5
    )


def _links(spark: SparkSession, sf: str) -> DataFrame:
    from shelfmark.registry.joins import link_rows

    shifted = {c: F.col(c) + F.expr("interval 27 years") for c in ("valid_from", "valid_until")}
    return link_rows(spark, sf).withColumns(shifted)


def _clicks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"), F.col("user_id").alias("software_id"), F.col("ts").alias("at")
    )


def _enriched_sql() -> str:
    from shelfmark.registry.joins import LINKS

    return f"""with {LINKS}, clicks as (
      select event_id as click_id, user_id as software_id, ts as at from events
      where event_type = 'click'),
    found as (
      select click_id, affiliate_link_id from clicks c join links l on l.software_id = c.software_id
        and status = 'active' and verification_status = 'verified' and verified_at is not null
        and valid_from + interval 27 year <= c.at
        and (valid_until is null or valid_until + interval 27 year > c.at)
      qualify row_number() over (partition by click_id order by priority desc, affiliate_link_id) = 1)
    select c.click_id, c.software_id, c.at, f.affiliate_link_id
    from clicks c left join found f using (click_id)"""


@query("enrich_click", _enriched_sql())
def enrich_click(spark: SparkSession, sf: str) -> DataFrame:
    return rules.enrich_click(_clicks(spark, sf), _links(spark, sf), unit="day")


@query(
    "conversions_to_clicks",
    f"""with {CONVERSIONS}, clicks as (
      select event_id as affiliate_click_id, user_id as affiliate_link_id, ts as occurred_at
      from events where event_type = 'click')
    select affiliate_conversion_id, v.affiliate_click_id, c.affiliate_link_id as click_link_id,
      c.occurred_at as clicked_at
    from conversions v left join clicks c using (affiliate_click_id)""",
)
def conversions_to_clicks(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    clicks = events.filter("event_type = 'click'").select(
        F.col("event_id").alias("affiliate_click_id"),
        F.col("user_id").alias("affiliate_link_id"),
        F.col("ts").alias("occurred_at"),
    )
    return rules.conversions_to_clicks(conversions(events), clicks).select(
        "affiliate_conversion_id", "affiliate_click_id", "click_link_id", "clicked_at"
    )


@query(
    "expire_ip_hash",
    """select event_id, case when ts + interval 10 day <= timestamp '2024-01-20' then null
        else sha256(user_id::varchar) end as ip_hash,
      case when ts + interval 10 day <= timestamp '2024-01-20' then null when value > 50 then null
        else ts + interval 10 day end as ip_hash_expires_at,
      value <= 50 as valid
    from (select event_id, ts, user_id, value from events)
    where value <= 50
    union all
    select event_id, sha256(user_id::varchar), null, false from events where value > 50""",
)
def expire_ip_hash(spark: SparkSession, sf: str) -> DataFrame:
    clicks = table(spark, sf, "events").select(
        "event_id",
        F.sha2(F.col("user_id").cast("string"), 256).alias("ip_hash"),
        F.when(F.col("value") <= 50, F.col("ts") + F.expr("interval 10 days")).alias(
            "ip_hash_expires_at"
        ),
    )
    return rules.expire_ip_hash(clicks, F.expr("timestamp_ntz'2024-01-20 00:00:00'"))


@query(
    "seen_bounds",
    """select user_id, event_type, min(ts) as first_seen_at, max(ts) as last_seen_at
    from events group by 1, 2""",
)
def seen_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return history.seen_bounds(table(spark, sf, "events"), ["user_id", "event_type"], "ts")


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return streams.read_stream(spark, sf, schema, "events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )


@query(
    "page_view_dedupe",
    """with v as (select user_id as session, event_id as view_id, ts as at, event_type as path,
        lag(event_type) over (partition by user_id order by ts, event_id) as referrer
      from events where event_type <> 'error')
    select * from v where referrer is null or referrer <> path""",
)
def page_view_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    visits = _stream(spark, sf).select(
        F.col("user_id").alias("session"),
        F.col("event_id").alias("view_id"),
        F.col("ts").alias("at"),
        F.col("event_type").alias("path"),
    )
    views = streams.run_available(streams.page_views(visits, F.col("path") == "error"))
    return views.withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "page_views_in_order",
    """with v as (select user_id as session, event_id as view_id, ts as at, event_type as path,
        lag(event_type) over (partition by user_id order by ts, event_id) as referrer
      from events where event_type <> 'error')
    select * from v where (referrer is null or referrer <> path)
      and time_bucket(interval 1 day, v.at) + interval 1 day <= (select max(ts) - interval 1 hour from events where event_type <> 'error')""",
)
def page_views_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """Views of all days that the watermark has passed."""
    visits = _stream(spark, sf).select(
        F.col("user_id").alias("session"), F.col("event_id").alias("view_id"), F.col("ts").alias("at"), F.col("event_type").alias("path")
    )
    ordered = streams.ordered_page_views(visits, F.col("path") == "error", hours=24 * 1000, width_ms=86_400_000)
    return streams.run_available(ordered).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query(
    "stream_counts_by_link",
    """select event_type, window_start, window_start + interval 1 hour as window_end, count(*) as n
    from (select event_type, time_bucket(interval 1 hour, ts) as window_start from events)
    group by 1, 2
    having window_start + interval 1 hour <= (select max(ts) - interval 10 minute from events)""",
)
def stream_counts_by_link(spark: SparkSession, sf: str) -> DataFrame:
    counted = streams.counts_by_link(_stream(spark, sf), "event_type", "ts")
    plain = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return streams.run_available(counted).withColumns(plain)


@query(
    "stream_unique_conversions",
    f"""with {CONVERSIONS} select distinct network, external_event_id, payload_digest
    from conversions""",
)
def stream_unique_conversions(spark: SparkSession, sf: str) -> DataFrame:
    unique = streams.unique_conversions(conversions(_stream(spark, sf)), "60 days")
    folder = streams.store_conversions(unique, "affiliate_conversion_id")
    return spark.read.parquet(folder).select("network", "external_event_id", "payload_digest")


@query("stream_enrich_click", _enriched_sql())
def stream_enrich_click(spark: SparkSession, sf: str) -> DataFrame:
    links = _links(spark, sf)
    clicks = _stream(spark, sf).filter("event_type = 'click'").select(
        F.col("event_id").alias("click_id"),
        F.col("user_id").alias("software_id"),
        F.col("ts").cast("timestamp_ntz").alias("at"),
    )
    folder = streams.run_batches(clicks, lambda batch: rules.enrich_click(batch, links, unit="day"))
    return spark.read.parquet(folder).drop("batch")


@query(
    "stream_conversions_with_clicks",
    f"""with {CONVERSIONS}, clicks as (
      select event_id as affiliate_click_id, user_id as affiliate_link_id, ts as occurred_at
      from events where event_type = 'click')
    select affiliate_conversion_id, v.affiliate_click_id, c.affiliate_link_id as click_link_id
    from conversions v join clicks c on c.affiliate_click_id = v.affiliate_click_id
      and c.occurred_at <= v.occurred_at and c.occurred_at >= v.occurred_at - interval 30 day""",
)
def stream_conversions_with_clicks(spark: SparkSession, sf: str) -> DataFrame:
    """Matched pairs; a conversion without a click comes out only after its 30 days are over."""
    events = _stream(spark, sf)
    clicks = _stream(spark, sf).filter("event_type = 'click'").select(
        F.col("event_id").alias("affiliate_click_id"),
        F.col("user_id").alias("affiliate_link_id"),
        F.col("ts").alias("occurred_at"),
    )
    joined = streams.conversions_with_clicks(conversions(events), clicks)
    return (
        streams.run_available(joined)
        .filter("click_link_id is not null")
        .select("affiliate_conversion_id", "affiliate_click_id", "click_link_id")
    )
