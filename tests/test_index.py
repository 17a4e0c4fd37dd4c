"""The stored index: scores equal a search over the sections; a refresh equals a rebuild."""

import os

from pyspark.sql import functions as F

from sparkquill.operators import index, search
from sparkquill.sources.corpus import files_of, table
from sparkquill.sources.records import parse_yaml_subset


def rows(df):
    df = df.select(*sorted(df.columns))
    return sorted(map(str, df.collect()))


def test_index_round_trip_and_refresh(spark, small, tmp_path):
    docs = table(spark, small, "documents").where("doc_id < 40")
    listed = files_of(docs).select("file_id", F.sha1("text").alias("sig"), F.lit("").alias("anchor_sig"), F.lit("").alias("sha1"))
    path = str(tmp_path / "index")
    assert index.read(spark, path) is None
    index.write(index.build(search.sections_of(docs.where("doc_id < 30")), listed.where("split(file_id, '/')[1] < 30")), path)
    changed = docs.where("doc_id >= 5").withColumn("text", F.when(F.col("doc_id") == 7, "loser text").otherwise(F.col("text")))
    files = files_of(changed).select("file_id", F.sha1("text").alias("sig"), F.lit("").alias("anchor_sig"), F.lit("").alias("sha1"))
    new = index.refresh(index.read(spark, path), search.sections_of(changed), files)
    whole = index.build(search.sections_of(changed), files)
    assert rows(new.postings) == rows(whole.postings)
    assert rows(new.meta.select("n_docs")) == rows(whole.meta.select("n_docs"))
    terms = search.query_terms("loser the thing")
    assert rows(search.scored(new, terms)) == rows(search.scored(search.sections_of(changed), terms))


def test_index_is_built_once_probed_and_rebuilt_when_unreadable(spark, small, tmp_path):
    docs = table(spark, small, "documents").where("doc_id < 20")
    listed = files_of(docs).select("file_id", F.sha1("text").alias("sig"), F.lit("").alias("anchor_sig"), F.lit("").alias("sha1"))
    path, built = str(tmp_path / "lazy"), []

    def sections():
        built.append(1)
        return search.sections_of(docs)

    assert index.probe(spark, path) == {"present": False, "readable": False, "files": 0}
    for _ in range(2):
        held = index.opened(spark, path, sections, lambda: listed)
        assert rows(search.postings(held)) == rows(search.postings(search.analysed(search.sections_of(docs))))
    assert len(built) == 1
    assert index.probe(spark, path) == {"present": True, "readable": True, "files": 20}
    held.meta.withColumn("version", F.lit(99)).write.mode("overwrite").parquet(path + "/meta2")
    os.rename(path + "/meta", path + "/meta0")
    os.rename(path + "/meta2", path + "/meta")
    assert index.read(spark, path) is None and index.probe(spark, path)["files"] == 0
    index.opened(spark, path, sections, lambda: listed)
    assert len(built) == 2


def test_yaml_subset():
    text = "---\nname: 'a b'\nlong: >\n  one\n  two\nlist:\n  - x\n---\nbody"
    got = parse_yaml_subset(text)
    assert got["name"] == "a b" and got["long"] == "one two"
    assert parse_yaml_subset("no") == {} == parse_yaml_subset(None)


def test_index_is_built_and_turned_without_a_shuffle_of_postings(spark, small, tmp_path):
    docs = table(spark, small, "documents").where("doc_id < 20")
    listed = files_of(docs).select("file_id", F.sha1("text").alias("sig"), F.lit("").alias("anchor_sig"), F.lit("").alias("sha1"))
    held = index.opened(spark, str(tmp_path / "i"), lambda: search.sections_of(docs), lambda: listed)
    for frame in (index.segmented(held.rows), search.transposed(held)):
        assert "Exchange" not in frame._jdf.queryExecution().executedPlan().toString()
    assert rows(index.segmented(held.rows)) == rows(search.of_rows(held.rows).postings) == rows(held.postings)
    terms = [r["term"] for r in index.segmented(held.rows.coalesce(1)).collect()]
    assert terms == sorted(terms, key=lambda t: t.encode())  # one segment holds them all


def test_terms_of_a_repeated_document_are_counted_together(spark, tmp_path):
    from sparkquill.plans import registry

    texts = [(1, "loser thing"), (2, "word"), (1, "loser"), (None, "a null"), (None, "null"), (3, None)]
    spark.createDataFrame(texts, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["stem_tokens"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "loser", 2), (1, "thing", 1), (2, "word", 1), (None, "null", 2)], key=str)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString()
