"""The registered queries: SQL where there is some, contracts elsewhere, and the pipeline stage by stage."""

import duckdb
import pytest

import corpus_pipeline
from sparkquill.llm import common, dart_minhash, fm_decontaminate, queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    duck = duckdb.connect()
    for t in ("conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = queries.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = duck.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(str(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize(("name", "table", "columns"), [
    ("op1_decontaminate", "documents", {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}),
    ("op3_toxicity", "documents", {"doc_id", "held_out", "score", "predicted"}),
    ("op4_token_counts", "documents", {"doc_id", "n_tokens"}),
    ("op5_token_planes", "documents", {"doc_id", "start", "n_tokens", "ids_crc32"}),
    ("op6_quality", "documents", {"doc_id", "held_out", "score", "predicted"}),
    ("op7_cap_filters", "embeddings", {"vec_id", "n_links", "component_id", "kept"}),
    ("op8_near_duplicates", "documents", {"doc_id", "component_id", "kept"}),
    ("op9_warc", "pages", {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"}),
    ("op10_source_mix", "documents", {"doc_id", "size", "source_size", "target", "taken"}),
])
def test_whole_tables(spark, small, name, table, columns):
    df = queries.QUERIES[name](spark, small)
    assert columns <= set(df.columns)
    assert df.count() == common.table(spark, small, table).count()


def test_decontamination_on_the_small_tables(spark, small):
    docs, items = (common.table(spark, small, t).collect() for t in ("documents", "benchmark"))
    want = fm_decontaminate.brute_force([(r["doc_id"], r["text"]) for r in docs], [(r["item_id"], r["text"]) for r in items])
    assert sorted(map(tuple, queries.QUERIES["op1_decontaminate"](spark, small).collect())) == sorted(want)


def test_near_duplicates_on_the_small_tables(spark, small):
    docs = common.table(spark, small, "documents").orderBy("doc_id").collect()
    groups = dart_minhash.brute_force([r["text"] for r in docs])
    want = {r["doc_id"]: docs[g]["doc_id"] for r, g in zip(docs, groups, strict=True)}
    assert {r["doc_id"]: r["component_id"] for r in queries.QUERIES["op8_near_duplicates"](spark, small).collect()} == want


def test_pipeline(spark, small):
    docs = common.table(spark, small, "documents")
    columns, kept = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = common.written(stage(spark, docs, small), f"test-{name}")
        if i < 4:
            assert docs.columns == columns
        if i < 3:
            assert 0 < docs.count() <= kept
            kept = docs.count()
    assert docs.select("start").distinct().count() == docs.count()
