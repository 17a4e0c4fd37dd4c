"""Notes: folders, frontmatter, structure, chunks, links, lifecycle, incremental maintenance."""

import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkquill.operators import graph, introspect, lifecycle, search, structure
from sparkquill.sources import corpus
from sparkquill.streaming import incremental

NOTE = """---
type: topic
titre: "Répondre à trop cher"
statut: draft
sources:
  - a
  - b
---
intro

# Title

## Part one ##
body [[other|that]] `[[not]]`
```
# hidden [[hidden]]
```
## Fil de preuves
- x
"""


@pytest.fixture(scope="module")
def notes(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    for rel, content in {"wiki/objection-prix.md": NOTE, "wiki/other.md": "# Other\ntext", "wiki/.hidden.md": "x", "wiki/skip/a.md": "x", "wiki/note.bin": "x", "wiki/crlf.md": "---\r\nstatut: canon\r\n---\r\nx"}.items():
        path = root / rel
        os.makedirs(path.parent, exist_ok=True)
        path.write_bytes(content.encode())
    return corpus.text_of(corpus.scan_folder(spark, str(root), "kb", "distilled", ("skip",))).cache()


def test_scan_keeps_notes_only(notes):
    assert {r["rel"] for r in notes.select("rel").collect()} == {"wiki/objection-prix.md", "wiki/other.md", "wiki/crlf.md"}


def test_frontmatter(notes):
    row = notes.where("rel like '%prix%'").select(corpus.frontmatter(F.col("text")).alias("f"), corpus.listed_values(F.col("text"), "sources").alias("s"), corpus.status_of(F.col("text")).alias("st")).first()
    assert row["f"]["titre"] == "Répondre à trop cher"
    assert row["s"] == ["a", "b"]
    assert row["st"] == "draft"
    assert notes.where("rel like '%crlf%'").select(corpus.status_of(F.col("text")).alias("s")).first()["s"] == "canon"


def test_sections_and_links(notes):
    one = notes.where("rel like '%prix%'")
    rows = structure.sections(one).orderBy("section").collect()
    assert [r["title"] for r in rows] == ["(preamble)", "Title", "Part one", "Fil de preuves"]
    assert rows[2]["breadcrumb"] == "Title > Part one"
    assert [r["target"] for r in structure.links(one).collect()] == ["other"]
    assert structure.chunks(structure.sections(one)).count() >= 1


def test_promote_and_demote(notes):
    one = notes.where("rel like '%prix%'")
    row = one.select("text", lifecycle.promoted(F.col("text")).alias("p"), lifecycle.demoted(F.col("text")).alias("d"), lifecycle.promoted(F.col("text"), F.lit("2024-01-31 promoted")).alias("n")).first()
    assert row["p"] == row["text"].replace("statut: draft", "statut: canon")
    assert row["d"] is None
    assert row["n"].count("2024-01-31 promoted") == 1


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab. \n", max_size=400))
def test_split_ranges_cover_the_text(text):
    ranges = structure.split_ranges(text, 50)
    assert ranges[0][0] == 0 and ranges[-1][1] == len(text)
    assert all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
    assert all(b - a <= 50 for a, b in ranges)


def test_pdf_pages(spark):
    out = spark.range(1).select(corpus.pdf_markdown(F.lit("one\f  \fthree"), F.lit("doc")).alias("x")).first()["x"]
    assert "## Page 1\n\none" in out and "## Page 3\n\nthree" in out and "Page 2" not in out


def test_links_resolve_and_break(spark):
    files = spark.createDataFrame([("kb/wiki/Été.md", "kb", "wiki/Été.md"), ("x/ete.md", "x", "ete.md")], "file_id string, source string, rel string")
    links = spark.createDataFrame([("n", "x", 1, "ete", ""), ("n", "kb", 2, "ete", ""), ("n", "kb", 3, "none", "")], "from_id string, from_source string, line int, target string, anchor string")
    got = {r["line"]: r["to_id"] for r in graph.resolved(links, files).collect()}
    assert got == {1: "x/ete.md", 2: "x/ete.md", 3: None} or got[2] == "kb/wiki/Été.md"
    assert got[3] is None


def test_diff_and_soft_delete(spark):
    old = spark.createDataFrame([("a", "1", "", "h"), ("b", "1", "", "h"), ("c", "1", "", "h")], "file_id string, sig string, anchor_sig string, sha1 string")
    new = spark.createDataFrame([("a", "1", "", "h"), ("b", "2", "", "h"), ("d", "1", "", "h")], "file_id string, sig string, anchor_sig string, sha1 string")
    assert {r["file_id"]: r["change"] for r in incremental.diff(old, new).collect()} == {"a": "same", "b": "changed", "c": "gone", "d": "new"}
    notes = spark.createDataFrame([("a", "distilled"), ("r", "raw")], "file_id string, zone string")
    stays, manifest = lifecycle.soft_deleted(notes, notes, F.lit("now"))
    assert [r["file_id"] for r in stays.collect()] == ["r"]
    assert manifest.count() == 1


def test_replace_table_guards_against_shrinking(spark, tmp_path):
    path = str(tmp_path / "t")
    lifecycle.replace_table(spark.range(100), path)
    lifecycle.replace_table(spark.range(95), path, 100)
    assert spark.read.parquet(path).count() == 95
    with pytest.raises(ValueError, match="lost"):
        lifecycle.replace_table(spark.range(10), path, 95)
    assert spark.read.parquet(path).count() == 95


def test_search_finds_titles_first(spark):
    rows = [("kb/a.md", "kb", "distilled", "a.md", "Répondre à trop cher", "", "", "une note", 1), ("kb/b.md", "kb", "distilled", "b.md", "Relancer", "", "", "phrase sans rapport " * 20 + "trop cher", 1), ("kb/r.md", "kb", "raw", "r.md", "trop cher", "", "", "trop cher", 1)]
    sections = spark.createDataFrame(rows, "file_id string, source string, zone string, rel string, heading string, crumb string, meta string, body string, line long")
    found = [r["file_id"] for r in search.search(sections, "trop chères").orderBy("rank").collect()]
    assert found == ["kb/a.md", "kb/b.md"]
    assert search.search(sections, "xylophonie introuvable").count() == 0
    assert search.search(sections, "").count() == 0
    assert "kb/r.md" in [r["file_id"] for r in search.search(sections, "trop cher", raw=True).collect()]
    titled = search.search(sections, "répondre à trop cher").join(sections.select("file_id", "line", "heading"), ["file_id", "line"])
    labelled = search.evidence(titled, search.query_terms("répondre à trop cher"), "répondre à trop cher")
    assert labelled.orderBy("rank").first()["evidence"] == "exact_title"


def test_risk(spark):
    named = spark.createDataFrame([("gmail", None), ("drive_x", None), ("odd", "read"), ("new", None)], "name string, declared string")
    policy = spark.createDataFrame([("gmail", "action")], "name string, level string")
    prefixes = spark.createDataFrame([(0, "drive", "write")], "place int, prefix string, level string")
    got = {r["name"]: (r["level"], r["origin"]) for r in introspect.assessed(named, policy, prefixes).collect()}
    assert got == {"gmail": ("action", "policy"), "drive_x": ("write", "policy"), "odd": ("read", "declared"), "new": ("unknown", "default")}
