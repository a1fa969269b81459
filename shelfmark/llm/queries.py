"""The operators of this subpackage applied to the supplied tables, and SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from shelfmark.llm import bpe, decontamination, embeddings, html, language, licenses, lm, mixing, negatives, quality, search, simhash, substrings
from shelfmark.llm.common import remainder
from shelfmark.session import table

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


@query("op1_language_id")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = language.fit(docs.filter(~held_out))
    narrow = docs.select("doc_id", held_out.alias("held_out"), "text")
    return language.predict(narrow, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


@query("op2_quality")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = quality.fit(docs, labels.filter(~held_out))
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return quality.score(marked, model, keep=("doc_id", "held_out"))


@query("op3_suffix_dedup")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf, "documents"))


@query("op4_embeddings")
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf, "embeddings"))


@query("op5_html_text")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return html.main_texts(table(spark, sf, "pages"))


@query("op6_decontamination")
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontamination.with_matches(docs, table(spark, sf, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


@query("op7_license_scan")
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf, "documents")))


MIXED = r"""
with sized as (
  select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from documents),
per_source as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, [5, 2, 1][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from per_source),
marked as (
  select *, sum(source_size) over () as everything,
    (150 * sum(source_size) over () - 200 * coalesce(sum(source_size) over (
        order by source_size::double / weight, source nulls last
        rows between unbounded preceding and 1 preceding), 0))::double * weight
      > 200 * source_size::double * sum(weight) over (
        order by source_size::double / weight, source nulls last
        rows between current row and unbounded following) as capped
  from ranked),
targets as (
  select source, source_size, case when capped then source_size::double * 2.0 else
    ((150 * everything - 200 * coalesce(sum(case when capped then source_size end) over (), 0)) * weight)::double
      / (100 * sum(case when not capped then weight end) over ())::double end as target
  from marked),
rated as (
  select doc_id, size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':42'), 1, 13))::bigint::double
      / 4503599627370496.0 as drawn
  from sized s join targets t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
  (size * (floor(rate)::bigint + (drawn < rate - floor(rate))::bigint))::bigint as taken
from rated"""


@query("op8_mixing", MIXED)
def op8(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


@query("op9_lm_score")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    held_out = remainder(F.col("doc_id"), 7) == 2
    marked = docs.select("doc_id", held_out.alias("held_out"), "text")
    return lm.score(marked, ~F.col("held_out"), keep=("doc_id", "held_out"))


@query("op10_simhash")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op11_byte_bpe")
def op11(spark: SparkSession, sf: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.encode(table(spark, sf, "documents").select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    decoded = bpe.decode(encoded.select("doc_id", "ids"), ranks)
    size = (F.length("ids") / 4).cast("bigint").alias("n_tokens")
    return decoded.select("doc_id", size, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


NEGATIVES = r"""
with usable as (
  select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select a.id as anchor, r.id as other, a.label = r.label as alike, list_dot_product(a.v, r.v)::bigint as score
  from usable a join usable r on a.id <> r.id
  where a.id % 100 = 0),
positives as (
  select * from scored where alike
  qualify row_number() over (partition by anchor order by score desc, other) <= 5)
select p.anchor as anchor_id, p.other as positive_id,
  row_number() over (partition by p.anchor, p.other order by n.score desc, n.other)::int as rank,
  n.other as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scored n on p.anchor = n.anchor
where not n.alike and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify rank <= 5"""


@query("op12_hard_negatives", NEGATIVES)
def op12(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", shifted), F.col("id") % 100 == 0)


SEARCH = r"""
with pieces as (
  select r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as r, doc_id, text from documents)),
sized as (select r, count(*) as n from pieces group by r),
whole as (select count(*) as docs, sum(n)::bigint as length from sized),
held as (select r, doc_id, term, count(*) as tf from pieces group by r, doc_id, term),
wanted as (
  select distinct item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
  from (select row_number() over () as item, item_id, text from (select distinct item_id, text from benchmark))),
weighed as (
  select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
  from held, whole where term in (select term from wanted) group by term, docs),
scored as (
  select item, item_id, doc_id, h.r,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length))))::bigint as score
  from wanted join weighed using (term) join held h using (term) join sized s on s.r = h.r, whole
  group by item, item_id, doc_id, h.r)
select item_id, row_number() over (partition by item order by score desc, doc_id)::int as rank, doc_id, score
from scored where score > 0
qualify rank <= 50"""


@query("op13_lexical_search", SEARCH)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES["pipeline"] = corpus_pipeline.run
