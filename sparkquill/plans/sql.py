"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from sparkquill.functions.text import COMPOUND, ELISION, HYPHENS, STEM_RULES, WORD


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(x: str) -> str:
    return f"strip_accents(lower({x}))"


def stem(w: str) -> str:
    out = w
    for pattern, to in STEM_RULES:
        out = f"regexp_replace({out}, {quoted(pattern)}, {quoted(to)})"
    return f"CASE WHEN length({w}) >= 5 THEN {out} ELSE {w} END"


def words(x: str) -> str:
    found = f"regexp_extract_all({fold(x)}, {quoted(WORD)})"
    bare = f"list_transform({found}, lambda w: regexp_replace(w, {quoted(ELISION)}, '\\2'))"
    return f"list_filter({bare}, lambda w: length(w) >= 2)"


def compounds(x: str) -> str:
    return f"list_transform(regexp_extract_all({fold(x)}, {quoted(COMPOUND)}), lambda w: regexp_replace(w, {quoted(HYPHENS)}, '', 'g'))"


def tokens(x: str) -> str:
    return f"list_transform(list_concat({words(x)}, {compounds(x)}), lambda w: {stem('w')})"


def slug(x: str) -> str:
    return f"regexp_replace(regexp_replace({fold(x)}, '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g')"


def half_up(x: str, digits: int) -> str:
    p = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({x}) * {p} + 0.5) / {p})"


ZONE = "CASE WHEN doc_id % 10 IN (7, 8) THEN 'raw' WHEN doc_id % 10 = 9 THEN 'outputs' ELSE 'distilled' END"

FILES = f"""files AS (
  SELECT source || '/' || doc_id AS file_id, doc_id, source, {ZONE} AS zone, CAST(doc_id AS VARCHAR) AS rel,
    split_part(text, chr(10), 1) AS title, lang, text FROM documents)"""

SECTIONS = f"""{FILES},
sections AS (
  SELECT file_id, source, zone, rel, title AS heading, lang AS crumb, source || ' ' || lang AS meta, i AS line, string_split(text, chr(10))[i] AS body
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files))"""

FIELD_WEIGHTS = (("heading", 4.0), ("meta", 2.0), ("crumb", 1.5), ("body", 1.0))

#: term, file_id, line, tf; and lengths.
POSTINGS = f"""{SECTIONS},
tokens AS ({' UNION ALL '.join(f"SELECT file_id, source, zone, rel, line, heading, {w}::DOUBLE AS weight, unnest({tokens(f)}) AS term FROM sections" for f, w in FIELD_WEIGHTS)}),
postings AS (SELECT term, file_id, source, zone, rel, line, heading, sum(weight) AS tf FROM tokens GROUP BY ALL),
lengths AS (SELECT s.file_id, s.line, coalesce(sum(t.weight), 0)::DOUBLE AS length FROM sections s LEFT JOIN tokens t ON s.file_id = t.file_id AND s.line = t.line GROUP BY ALL),
stats AS (SELECT count(*)::DOUBLE AS n_docs, avg(length) AS avg_len FROM lengths),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY term)"""


def terms_of(query: str) -> str:
    return f"(SELECT DISTINCT unnest({tokens(quoted(query))}) AS term)"


def scored(query: str, name: str = "scored") -> str:
    """A CTE of the sections' scores for a query; after POSTINGS."""
    return f"""{name} AS (
  SELECT file_id, source, zone, rel, line, heading,
    {half_up("sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(length, 120) / avg_len))) * (1 + 0.15 * (count(*) - 1)) * CASE WHEN zone = 'outputs' THEN 0.7 ELSE 1.0 END", 6)} AS score,
    count(*) AS hits, array_to_string(list_sort(list(term)), ' ') AS matched
  FROM postings JOIN {terms_of(query)} USING (term) JOIN df USING (term) JOIN lengths USING (file_id, line), stats
  GROUP BY file_id, source, zone, rel, line, heading)"""


def diversified(source: str, order: str = "score DESC, file_id, line", per_file: int = 2, where: str = "zone <> 'raw'") -> str:
    return f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY {order}) AS nth FROM {source} WHERE {where}) WHERE nth <= {per_file})"


def top(source: str, k: int = 5, order: str = "score DESC, file_id, line") -> str:
    return f"(SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {source} QUALIFY row_number() OVER (ORDER BY {order}) <= {k})"
