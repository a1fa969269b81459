"""Texts that no learned language is near are rejected, short clean ones are not."""

import base64
import random

from pyspark.sql import functions as F

from shelfmark.llm import language


def test_noise_and_unlearned_languages_are_rejected(spark):
    random.seed(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").filter("text is not null")
    polish = "litwo ojczyzno moja ty jesteś jak zdrowie ile cię trzeba cenić ten tylko się dowie kto cię stracił dziś piękność twą w całej ozdobie widzę i opisuję bo tęsknię po tobie panno święta co jasnej bronisz częstochowy".split()
    noise = [base64.b64encode(random.randbytes(n)).decode() for n in (150, 600, 2500)]
    noise += [random.randbytes(n).hex() for n in (150, 600, 2500)]
    noise += [" ".join("".join(random.choice("bcdfghjklmnpqrstvwxz") for _ in range(6)) for _ in range(n)) for n in (30, 100, 600)]
    noise += [" ".join(random.choices(polish, k=n)) for n in (30, 100, 500)]
    short = docs.filter("doc_id % 2 = 0").select(F.col("doc_id"), F.regexp_extract("text", r"(?s)^.{0,30}\S*", 0).alias("text"))
    model = language.fit(docs.filter("doc_id % 2 = 1"))
    asked = spark.createDataFrame([(-1 - i, t) for i, t in enumerate(noise)], "doc_id bigint, text string").unionByName(short)
    found = [(r.doc_id, r.rejected) for r in language.predict(asked, model).select("doc_id", "rejected").collect()]
    assert [i for i, rejected in found if i < 0 and not rejected] == []
    clean = [rejected for i, rejected in found if i >= 0]
    assert len(clean) > 300 and sum(clean) <= 0.02 * len(clean)
