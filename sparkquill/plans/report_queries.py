"""Reports over several operators: lint, outline, sections by line or name, stale feedback, corpus totals, file descriptions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import feedback, lint, structure
from sparkquill.plans import analytics_queries as A
from sparkquill.plans import sql
from sparkquill.plans.search_queries import stored_index
from sparkquill.sources.corpus import files_of, frontmatter, table

QUERIES, ORACLES = {}, {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


@query("outline", f"{A.PARSED} SELECT file_id, line, level, title FROM s WHERE level > 0")
def outline(spark, d):
    return structure.outline(A._notes(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("show_line", f"{A.PARSED}, a AS (SELECT *, CASE WHEN 9 BETWEEN line AND line_end THEN 0 ELSE least(abs(line - 9), abs(line_end - 9)) END AS away FROM s) SELECT file_id, section, title, line, line_end FROM a QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY away, section) = 1")
def show_line(spark, d):
    found = structure.section_at(structure.sections(A._notes(spark, d)), 9)
    return found.select("file_id", F.col("section").cast("long").alias("section"), "title", F.col("line").cast("long").alias("line"), F.col("line_end").cast("long").alias("line_end"))


@query("show_slug", f"{A.PARSED}, a AS (SELECT *, {sql.slug('title')} AS slug FROM s) SELECT file_id, section, title FROM a WHERE contains(slug, 'part') QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY CASE WHEN slug = 'part' THEN 0 ELSE 1 END, section) = 1")
def show_slug(spark, d):
    found = structure.section_by_slug(structure.sections(A._notes(spark, d)), "part")
    return found.select("file_id", F.col("section").cast("long").alias("section"), "title")


# Lint.


def _marked(spark, d):
    """Documents as notes with dream marks and a slug."""
    rows = A._files(spark, d)
    dream = F.when(F.col("doc_id") % 4 == 0, "true")
    date = F.when(F.col("doc_id") % 8 == 0, "2024-01-01")
    return rows.select("file_id", "doc_id", "rel", dream.alias("dream"), date.alias("dream_date"), F.when(F.col("doc_id") % 3 == 0, "canon").otherwise("draft").alias("statut"), F.concat_ws("-", "source", "rel").alias("slug"))


_DREAMS = f"WITH {sql.FILES}, t AS (SELECT * FROM files WHERE doc_id % 4 = 0) SELECT file_id, 'no date' AS reason FROM t WHERE doc_id % 8 <> 0 UNION ALL SELECT file_id, 'promoted' FROM t WHERE doc_id % 3 = 0"


@query("lint_dreams", _DREAMS)
def lint_dreams(spark, d):
    return lint.dream_issues(_marked(spark, d))


_INDEX_TEXT = "(SELECT string_agg('- src' || n_nationkey || '-' || n_nationkey, chr(10)) AS t FROM nation)"


@query("lint_not_mentioned", f"WITH {sql.FILES} SELECT file_id FROM files, {_INDEX_TEXT} WHERE NOT contains(t, source || '-' || rel)")
def lint_not_mentioned(spark, d):
    line = F.format_string("- src%s-%s", "n_nationkey", "n_nationkey")
    index = table(spark, d, "nation").agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return lint.not_mentioned(_marked(spark, d), index).select("file_id")


@query("lint_context_missing", f"WITH {sql.FILES} SELECT file_id FROM files WHERE NOT starts_with(file_id, 'src1') AND NOT starts_with(file_id, 'src2/')")
def lint_context_missing(spark, d):
    prefixes = spark.createDataFrame([("src1",), ("src2/",)], "prefix string")
    return lint.without_context(A._files(spark, d).select("file_id"), prefixes)


_CHECKS = {
    "broken_links": (A.graph_ghosts, A.ORACLES["graph_ghosts"], "node", None),
    "orphans": (A.graph_orphans, A.ORACLES["graph_orphans"], "node", None),
    "index_drift": (A.lint_drift, A.ORACLES["lint_drift"], "file_id", "category"),
    "stale": (A.lint_stale, A.ORACLES["lint_stale"], "file_id", "reason"),
    "duplicates": (A.lint_duplicates, A.ORACLES["lint_duplicates"], "key", None),
    "manual_budget": (lambda spark, d: A.lint_budget(spark, d).where("over"), f"SELECT * FROM ({A.ORACLES['lint_budget']}) WHERE over", "file_id", None),
    "context_missing": (lint_context_missing, ORACLES["lint_context_missing"], "file_id", None),
    "dream_issues": (lint_dreams, _DREAMS, "file_id", "reason"),
    "evidence_trail_missing": (A.lint_evidence_trail, A.ORACLES["lint_evidence_trail"], "file_id", None),
    "raw_unprocessed": (A.lint_unprocessed, A.ORACLES["lint_unprocessed"], "file_id", None),
    "self_source": (A.lint_self_source, A.ORACLES["lint_self_source"], "file_id", "slug"),
    "not_mentioned": (lint_not_mentioned, ORACLES["lint_not_mentioned"], "file_id", None),
}
_REPORT = " UNION ALL ".join(f"SELECT '{c}' AS category, CAST({key} AS VARCHAR) AS subject, {f'CAST({more} AS VARCHAR)' if more else repr('')} AS detail, {str(c in lint.FAILING).lower()} AS fails FROM ({o})" for c, (_, o, key, more) in _CHECKS.items())


@query("lint_report", _REPORT)
def lint_report(spark, d):
    checks = {c: f(spark, d).select(key, *([more] if more else [])) for c, (f, _, key, more) in _CHECKS.items()}
    return lint.report(checks, {c: more for c, (_, _, _, more) in _CHECKS.items() if more})


# Feedback against the content that files have now.


@query("feedback_stale", f"""WITH log AS (SELECT ts, user_id AS file, CASE event_type WHEN 'purchase' THEN 'used' ELSE 'deadend' END AS outcome, json_extract_string(props, '$.k') AS query, CASE event_id % 2 WHEN 0 THEN 'a' ELSE 'b' END AS sha1,
  CASE user_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN '' END AS now FROM events WHERE event_type IN ('purchase', 'error')),
o AS (SELECT *, coalesce(now <> '' AND sha1 <> now, false) AS old FROM log),
r AS (SELECT file, sum(CASE outcome WHEN 'used' THEN 1 ELSE -1 END * pow(0.5, greatest((epoch_ms({A.NOW_SQL}) - epoch_ms(ts)) / 86400000.0, 0) / 30)) AS exact, bool_or(old) AS stale,
  count(DISTINCT CASE WHEN outcome = 'used' AND NOT old THEN array_to_string(list_sort(list_distinct({sql.tokens('query')})), ' ') END) AS corroborations FROM o GROUP BY file)
SELECT file, CASE WHEN exact > 0 AND corroborations >= 2 THEN 'preferred' WHEN exact <= 0 THEN 'contested' ELSE 'tentative' END AS status, {sql.half_up('exact', 3)} AS score, corroborations, stale FROM r""")
def feedback_stale(spark, d):
    events = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    log = events.select("ts", F.col("user_id").alias("file"), F.when(F.col("event_type") == "purchase", "used").otherwise("deadend").alias("outcome"), F.get_json_object("props", "$.k").alias("query"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("sha1"))
    current = events.select(F.col("user_id").alias("file")).distinct().where("file % 3 <> 2").withColumn("sha1_now", F.when(F.col("file") % 3 == 0, "a").otherwise(""))
    return feedback.report(log, A._now(), current).select("file", "status", "score", "corroborations", "stale")


# Totals and descriptions.


@query("corpus_totals", f"""WITH {sql.POSTINGS}, a AS (SELECT source, count(*) AS sections, count(DISTINCT file_id) AS files FROM sections GROUP BY ROLLUP (source)), b AS (SELECT source, count(DISTINCT term) AS terms FROM postings GROUP BY ROLLUP (source))
SELECT a.source, files, sections, coalesce(terms, 0) AS terms FROM a LEFT JOIN b ON a.source IS NOT DISTINCT FROM b.source""")
def corpus_totals(spark, d):
    held = stored_index(spark, d)
    sections = held.sections.rollup("source").agg(F.count("*").alias("sections"), F.count_distinct("file_id").alias("files"))
    terms = held.postings.select("source", "term").rollup("source").agg(F.count_distinct("term").alias("terms")).withColumnRenamed("source", "s")
    return sections.join(terms, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "files", "sections", F.coalesce("terms", F.lit(0)).alias("terms"))


_NOTED = "'---' || chr(10) || 'type: topic' || chr(10) || 'tags: [a, \"b\"]' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'resume:  on  ' || lang || chr(10) ELSE '' END || '---' || chr(10)"


@query("file_meta", f"""WITH {sql.FILES}, t AS (SELECT *, 'notes/' || source || '_' || rel || '.md' AS path FROM files)
SELECT file_id, source || ' ' || rel || ' notes ' || source || ' ' || rel || '.md ' || title || ' topic  a,  b   ' || lang AS meta,
  CASE WHEN doc_id % 2 = 0 THEN 'on ' || lang WHEN trim(regexp_replace(title, '\\s+', ' ', 'g')) = '' THEN source || ' ' || rel ELSE CASE WHEN length(trim(regexp_replace(title, '\\s+', ' ', 'g'))) > 220 THEN left(trim(regexp_replace(title, '\\s+', ' ', 'g')), 220) || '…' ELSE trim(regexp_replace(title, '\\s+', ' ', 'g')) END END AS synopsis FROM t""")
def file_meta(spark, d):
    files = files_of(table(spark, d, "documents"))
    head = F.concat(F.lit('---\ntype: topic\ntags: [a, "b"]\n'), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("resume:  on  "), "lang", F.lit("\n"))).otherwise(""), F.lit("---\n"))
    rel = F.concat(F.lit("notes/"), "source", F.lit("_"), "rel", F.lit(".md"))
    rows = files.select("file_id", "title", "lang", rel.alias("path"), frontmatter(head).alias("fm"))
    return rows.select("file_id", T.meta_text(F.col("path"), F.col("title"), F.col("fm"), F.col("lang")).alias("meta"), T.synopsis(F.col("path"), F.col("title"), F.col("fm")).alias("synopsis"))
