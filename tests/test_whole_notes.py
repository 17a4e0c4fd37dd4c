"""The structure queries over whole documents, against notes composed in Python."""

import re
from collections import defaultdict

import pytest

from sparkquill.plans import registry

FENCE = re.compile(r"\s*(?:>\s*)*(```|~~~)")


@pytest.fixture(scope="module")
def notes(spark, small):
    out = {}
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        first, *rest = (r["text"] or "").split("\n")
        out[f"{r['source']}/{r['doc_id']}"] = (
            [r["lang"], f"# {r['source']}", first, f"## Part {r['doc_id']} ##", *(rest or [""]), "```", "# not a heading", "```", f"see [[{r['source']}|alias]] and [[{r['lang']}#part]]", "# Last", "### Deep", first],
            "\n".join(rest),
        )
    assert max(len(lines) for lines, _ in out.values()) > 20
    return out


def rows_of(spark, small, name):
    found = defaultdict(list)
    for r in registry.QUERIES[name](spark, small).collect():
        found[r["file_id"]].append(r)
    return found


def test_lines_and_fences(spark, small, notes):
    got = rows_of(spark, small, "fence_lines")
    for file_id, (lines, _) in notes.items():
        open_, want = False, []
        for i, body in enumerate(lines):
            fence = bool(FENCE.match(body))
            want.append((i + 1, body, fence, open_))
            open_ ^= fence
        assert sorted(tuple(r[1:]) for r in got[file_id]) == want


def test_sections_and_breadcrumbs(spark, small, notes):
    got, crumbs = rows_of(spark, small, "sections"), rows_of(spark, small, "breadcrumbs")
    for file_id, (lines, _) in notes.items():
        rows = sorted(got[file_id], key=lambda r: r["section"])
        assert "\n".join(r["body"] for r in rows) == "\n".join(lines)
        assert [r["line"] for r in rows] == [1, *(r["line_end"] + 1 for r in rows[:-1])]
        assert rows[-1]["line_end"] == len(lines)
        source, doc = file_id.split("/")
        part = next(r["breadcrumb"] for r in crumbs[file_id] if r["section"] == 2)
        assert part == f"{source} > Part {doc}"


def test_links(spark, small, notes):
    got = rows_of(spark, small, "wikilinks")
    for file_id, (lines, _) in notes.items():
        line = len(lines) - 3
        assert {(r["line"], r["target"]) for r in got[file_id]} >= {(line, file_id.split("/")[0]), (line, lines[0])}


def test_chunks_hold_the_whole_text(spark, small, notes):
    got = rows_of(spark, small, "chunk_merge_split")
    long = {k: rest for k, (_, rest) in notes.items() if len(rest) > 3000}
    assert long
    for file_id, rest in long.items():
        rows = sorted(got[file_id], key=lambda r: (r["chunk"], r["part"]))
        assert rest in "".join(r["text"] for r in rows)
        assert max(r["parts"] for r in rows) > 1
        assert all(len(r["text"]) <= 3000 for r in rows)
