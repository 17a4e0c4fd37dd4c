"""Whole texts with links before them: only short ones that are mostly links lead elsewhere."""

import re

from pyspark.sql import functions as F

from sparkquill.plans import registry


def test_whole_texts(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null")
    text = F.when(F.col("doc_id") % 4 == 0, F.substring("text", 1, 12)).when(F.col("doc_id") % 4 == 1, F.concat(F.repeat(F.lit("[[long]] "), 60), "text")).otherwise(F.col("text"))
    docs.withColumn("text", text).write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect():
        body = f"[[{r['source']}]] [[{r['lang']}]] {r['text']}".strip()
        links = re.findall(r"\[\[[^\]|#]+(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]", body)
        want[f"{r['source']}/{r['doc_id']}"] = len(body) < 400 and sum(map(len, links)) > 0.25 * len(body)
    got = {r["file_id"]: r["navigational"] for r in registry.QUERIES["navigational_sections"](spark, str(tmp_path)).collect()}
    assert got == want
    assert set(want.values()) == {True, False}
