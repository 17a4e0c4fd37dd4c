"""Structure, graph, lint, evaluation, feedback, lifecycle, sessions, introspection, incremental queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.operators import evaluate, feedback, graph, introspect, lifecycle, lint, search, sessions, structure
from sparkquill.plans import sql
from sparkquill.plans.search_queries import ORACLES as _SEARCH
from sparkquill.plans.search_queries import stored_index
from sparkquill.session import shared_folder
from sparkquill.sources.corpus import files_of, listed_values, status_of, table
from sparkquill.streaming import incremental

QUERIES, ORACLES = {}, {}
NOW = "2024-01-31"
NOW_SQL = f"TIMESTAMP '{NOW}'"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _now():
    return F.lit(NOW).cast("timestamp")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return files_of(table(spark, d, "documents"))


# Structure: Markdown composed of document columns.


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Notes with a preamble, two levels of headings, all lines of the document, a fence that hides a heading, wikilinks."""
    lines = F.split("text", "\n", -1)
    first = F.coalesce(F.get(lines, F.lit(0)), F.lit(""))
    rest = F.coalesce(F.array_join(F.slice(lines, F.lit(2), F.size(lines)), "\n"), F.lit(""))
    rows = [F.col("lang"), F.concat(F.lit("# "), "source"), first, F.concat(F.lit("## Part "), F.col("doc_id").cast("string"), F.lit(" ##")), rest, F.lit("```"), F.lit("# not a heading"), F.lit("```"), F.concat(F.lit("see [["), "source", F.lit("|alias]] and [["), "lang", F.lit("#part]]")), F.lit("# Last"), F.lit("### Deep"), first]
    return _files(spark, d).select("file_id", "source", F.array_join(F.array(*rows), "\n").alias("text"))


#: The same notes, parsed line by line: p has lines with fences, s has sections.
PARSED = f"""WITH {sql.FILES}, notes AS (SELECT file_id, source, lang || chr(10) || '# ' || source || chr(10) || split_part(text, chr(10), 1) || chr(10) || '## Part ' || doc_id || ' ##' || chr(10)
  || array_to_string(string_split(text, chr(10))[2:], chr(10)) || chr(10) || '```' || chr(10) || '# not a heading' || chr(10) || '```' || chr(10)
  || 'see [[' || source || '|alias]] and [[' || lang || '#part]]' || chr(10) || '# Last' || chr(10) || '### Deep' || chr(10) || split_part(text, chr(10), 1) AS text FROM files),
l AS (SELECT file_id, i AS line, string_split(text, chr(10))[i] AS body FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM notes)),
f AS (SELECT *, regexp_matches(body, '^\\s*(?:>\\s*)*(```|~~~)') AS is_fence FROM l),
p AS (SELECT *, coalesce(sum(CASE WHEN is_fence THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS in_fence FROM f),
h AS (SELECT *, CASE WHEN NOT is_fence AND NOT in_fence AND regexp_matches(body, '^(#{{1,6}})\\s+(.*)$') THEN length(regexp_extract(body, '^(#{{1,6}})\\s+(.*)$', 1)) END AS level,
  regexp_replace(trim(regexp_extract(body, '^(#{{1,6}})\\s+(.*)$', 2)), '\\s+#+\\s*$', '') AS heading FROM p),
n AS (SELECT *, CAST(count(level) OVER (PARTITION BY file_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS BIGINT) AS section FROM h),
s AS (SELECT file_id, section, CAST(coalesce(max(level), 0) AS INTEGER) AS level, coalesce(max(CASE WHEN level IS NOT NULL THEN heading END), '(preamble)') AS title, min(line) AS line, max(line) AS line_end, string_agg(body, chr(10) ORDER BY line) AS body FROM n GROUP BY file_id, section)"""


@query("fence_lines", f"{PARSED} SELECT file_id, line, body, is_fence, in_fence FROM p")
def fence_lines(spark, d):
    return structure.lines(_notes(spark, d)).select("file_id", F.col("line").cast("long").alias("line"), "body", "is_fence", "in_fence")


@query("sections", f"{PARSED} SELECT file_id, section, level, title, line, line_end, body FROM s")
def sections(spark, d):
    rows = structure.sections(_notes(spark, d))
    return rows.select("file_id", F.col("section").cast("long").alias("section"), "level", "title", F.col("line").cast("long").alias("line"), F.col("line_end").cast("long").alias("line_end"), "body")


#: Of each level, the last section of the level that no section above it has closed.
_OPEN = ", ".join(f"last_value(CASE WHEN level = {k} THEN title WHEN level BETWEEN 1 AND {k - 1} THEN '' END IGNORE NULLS) OVER w" for k in range(1, 7))


@query("breadcrumbs", f"{PARSED} SELECT file_id, section, array_to_string(list_filter([{_OPEN}], lambda x: x <> ''), ' > ') AS breadcrumb FROM s WINDOW w AS (PARTITION BY file_id ORDER BY section ROWS UNBOUNDED PRECEDING)")
def breadcrumbs(spark, d):
    return structure.sections(_notes(spark, d)).select("file_id", F.col("section").cast("long").alias("section"), "breadcrumb")


@query("navigational_sections", f"""WITH {sql.FILES}, t AS (SELECT file_id, regexp_replace('[[' || source || ']] [[' || lang || ']] ' || text, '^\\s+|\\s+$', '', 'g') AS body FROM files)
SELECT file_id, length(body) < 400 AND list_sum(list_transform(regexp_extract_all(body, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|([^\\]]+))?\\]\\]'), lambda x: length(x))) > length(body) * 0.25 AS navigational FROM t""")
def navigational_sections(spark, d):
    body = F.concat(F.lit("[["), "source", F.lit("]] [["), "lang", F.lit("]] "), "text")
    return _files(spark, d).select("file_id", structure.is_navigational(body).alias("navigational"))


_LINK_PARTS = ", ".join(f"unnest(regexp_extract_all(plain, '\\[\\[([^\\]|#]+)(?:#([^\\]|]+))?(?:\\|([^\\]]+))?\\]\\]', {k})) AS g{k}" for k in (1, 2, 3))


@query("wikilinks", f"{PARSED}, b AS (SELECT file_id, line, regexp_replace(body, '`[^`]*`', '', 'g') AS plain FROM p WHERE NOT is_fence AND NOT in_fence), g AS (SELECT file_id, line, {_LINK_PARTS} FROM b) SELECT file_id, line, trim(g1) AS target, nullif(g2, '') AS anchor, nullif(g3, '') AS alias FROM g")
def wikilinks(spark, d):
    return structure.links(_notes(spark, d)).withColumn("line", F.col("line").cast("long"))


@query("chunk_merge_split")
def chunk_merge_split(spark, d):
    return structure.chunks(structure.sections(_notes(spark, d)))


# Graph.

_HREF = r"""'<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)'"""
_LINKS = f"""found AS (SELECT page_id, regexp_extract_all(html, {_HREF}, 1) AS t, regexp_extract_all(html, {_HREF}, 2) AS a FROM pages),
links AS (SELECT page_id AS from_id, i - 1 AS line, t[i] AS target, a[i] AS anchor FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM found))"""
_EDGES = f"""{_LINKS}, edges AS (SELECT CAST(from_id AS VARCHAR) AS from_id, 'ghost:' || target AS to_id FROM links),
ends AS (SELECT from_id AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT to_id, 1, 0 FROM edges),
counted AS (SELECT node, CAST(sum(i) AS BIGINT) AS inbound, CAST(sum(o) AS BIGINT) AS outbound FROM ends GROUP BY node),
degrees AS (SELECT coalesce(n.node, c.node) AS node, coalesce(inbound, 0) AS inbound, coalesce(outbound, 0) AS outbound, n.node IS NULL AS ghost, n.node IS NOT NULL AND inbound IS NULL AND outbound IS NULL AS orphan
  FROM (SELECT CAST(page_id AS VARCHAR) AS node FROM pages) n FULL JOIN counted c ON n.node = c.node)"""


@query("link_extract", f"WITH {_LINKS} SELECT * FROM links")
def link_extract(spark, d):
    return graph.page_links(table(spark, d, "pages"))


def _graph(spark, d):
    pages = table(spark, d, "pages")
    files = pages.select(F.col("page_id").cast("string").alias("file_id"), F.lit("web").alias("source"), F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")).alias("rel"))
    links = graph.page_links(pages).select(F.col("from_id").cast("string").alias("from_id"), F.lit("web").alias("from_source"), "line", "target", "anchor")
    # No target of the test pages is a page, so every one is a ghost.
    edges = graph.edges_of(graph.resolved(links, files))
    return edges, graph.degrees(files.select(F.col("file_id").alias("node")), edges)


@query("graph_degrees", f"WITH {_EDGES} SELECT * FROM degrees")
def graph_degrees(spark, d):
    return _graph(spark, d)[1]


@query("graph_orphans", f"WITH {_EDGES} SELECT node FROM degrees WHERE orphan")
def graph_orphans(spark, d):
    return _graph(spark, d)[1].where("orphan").select("node")


@query("graph_ghosts", f"WITH {_EDGES} SELECT node, inbound FROM degrees WHERE ghost")
def graph_ghosts(spark, d):
    return _graph(spark, d)[1].where("ghost").select("node", "inbound")


@query("graph_stats", f"WITH {_EDGES} SELECT count(*) FILTER (NOT ghost) AS nodes, count(*) FILTER (ghost) AS ghosts, count(*) FILTER (orphan) AS orphans, (SELECT count(*) FROM edges) AS links, (SELECT count(*) FROM edges) AS broken FROM degrees")
def graph_stats(spark, d):
    edges, nodes = _graph(spark, d)
    return graph.stats(nodes, edges)


@query("anchor_text", f"WITH {_LINKS} SELECT target AS to_id, string_agg(anchor, ' ' ORDER BY from_id, line) AS anchors FROM links WHERE anchor <> '' GROUP BY target")
def anchor_text(spark, d):
    return graph.anchor_text(graph.page_links(table(spark, d, "pages")).withColumn("to_id", F.col("target")))


@query("link_resolve", """WITH c AS (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'customer/' || c_custkey AS from_id, 'nation/' || n_nationkey AS to_id FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def link_resolve(spark, d):
    nation = table(spark, d, "nation")
    files = nation.select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string")).alias("file_id"), F.lit("nation").alias("source"), F.concat(F.lit("wiki/"), "n_name", F.lit(".md")).alias("rel"))
    links = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias("from_id"), F.lit("customer").alias("from_source"), F.lit(1).cast("long").alias("line"), F.upper("n_name").alias("target"), F.lit("").alias("anchor"))
    return graph.resolved(links, files).select("from_id", "to_id")


_TREE = """e AS (SELECT 'nation' || n_nationkey AS a, 'region' || n_regionkey AS b FROM nation UNION ALL SELECT 'supplier' || s_suppkey, 'nation' || s_nationkey FROM supplier),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e)"""


@query("related_bfs", f"""WITH RECURSIVE {_TREE}, r AS (SELECT 'nation3' AS node, 0 AS depth UNION SELECT b, depth + 1 FROM r JOIN both_ways ON node = a WHERE depth < 3),
seen AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), g AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY node)
SELECT node, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY depth, degree DESC, node) AS rank FROM seen JOIN g USING (node) WHERE depth > 0""")
def related_bfs(spark, d):
    nations = table(spark, d, "nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("to_id"))
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supplier"), F.col("s_suppkey").cast("string")).alias("from_id"), F.concat(F.lit("nation"), F.col("s_nationkey").cast("string")).alias("to_id"))
    edges = nations.unionByName(suppliers)
    nodes = edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    return graph.ranked_related(graph.related(edges, ["nation3"], 3), graph.degrees(nodes, edges.withColumn("broken", F.lit(False))))


@query("graph_layout")
def graph_layout(spark, d):
    edges = table(spark, d, "nation").select(F.concat(F.lit("nation"), F.col("n_nationkey").cast("string")).alias("from_id"), F.concat(F.lit("region"), F.col("n_regionkey").cast("string")).alias("to_id"))
    return graph.layout(edges.select(F.explode(F.array("from_id", "to_id")).alias("node")).distinct(), edges)


# Lint and statistics.


@query("lint_duplicates", f"""WITH {sql.FILES}, k AS (SELECT file_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all({sql.fold('title')}, '[a-z0-9]+'), lambda w: length(w) >= 4))), ' ') AS key FROM files)
SELECT key, count(*) AS n, min(file_id) AS first FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1""")
def lint_duplicates(spark, d):
    return lint.duplicates(_files(spark, d))


_MODIFIED = "CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN 'someday' ELSE strftime(o_orderdate, '%Y-%m-%d') END"


@query("lint_stale", f"""WITH t AS (SELECT o_orderkey AS file_id, {_MODIFIED} AS m FROM orders), u AS (SELECT *, CAST(floor((epoch_ms(TIMESTAMP '1998-10-01') - epoch_ms(try_cast(m AS TIMESTAMP))) / 86400000) AS BIGINT) AS age FROM t),
r AS (SELECT file_id, CASE WHEN m IS NULL THEN 'missing' WHEN age IS NULL THEN 'unparsable' WHEN age > 90 THEN 'stale' END AS reason, age FROM u) SELECT * FROM r WHERE reason IS NOT NULL""")
def lint_stale(spark, d):
    modified = F.when(F.col("o_orderkey") % 10 == 1, "someday").when(F.col("o_orderkey") % 10 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return lint.stale(table(spark, d, "orders").select(F.col("o_orderkey").alias("file_id"), modified.alias("modified")), F.lit("1998-10-01").cast("timestamp"))


@query("lint_drift", f"WITH {sql.FILES} SELECT file_id, CASE WHEN l.doc_id IS NULL THEN 'missing_from_index' ELSE 'missing_from_disk' END AS category FROM files f FULL JOIN (SELECT doc_id + 100 AS doc_id, 'labels/' || (doc_id + 100) AS lid FROM labels) l ON f.doc_id = l.doc_id WHERE f.doc_id IS NULL OR l.doc_id IS NULL".replace("SELECT file_id, CASE", "SELECT coalesce(file_id, lid) AS file_id, CASE"))
def lint_drift(spark, d):
    files = _files(spark, d).select("doc_id", "file_id")
    index = table(spark, d, "labels").select((F.col("doc_id") + 100).alias("doc_id")).withColumn("file_id", F.concat(F.lit("labels/"), F.col("doc_id").cast("string")))
    return lint.missing_from(files, index, "doc_id").select("file_id", F.lit("missing_from_index").alias("category")).unionByName(lint.missing_from(index, files, "doc_id").select("file_id", F.lit("missing_from_disk").alias("category")))


@query("lint_unprocessed", f"WITH {sql.FILES} SELECT file_id FROM files f WHERE zone = 'raw' AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT 'raw/' || n_nationkey || 7 AS path FROM nation) p WHERE contains('raw/' || f.rel, p.path) OR contains(p.path, 'raw/' || f.rel))")
def lint_unprocessed(spark, d):
    registry = table(spark, d, "nation").select(F.concat(F.lit("raw/"), F.col("n_nationkey").cast("string"), F.lit("7")).alias("path"))
    return lint.unprocessed(_files(spark, d).withColumn("rel", F.concat(F.lit("raw/"), "rel")), registry).select("file_id")


@query("lint_self_source", f"WITH {sql.FILES}, s AS (SELECT file_id AS written, 'src1/' || n_nationkey AS slug FROM files JOIN nation ON doc_id = n_nationkey) SELECT DISTINCT f.file_id, slug FROM files f JOIN s ON contains(f.file_id, slug) AND f.file_id <> written")
def lint_self_source(spark, d):
    files = _files(spark, d)
    slugs = files.join(table(spark, d, "nation"), F.col("doc_id") == F.col("n_nationkey")).select("file_id", F.concat(F.lit("src1/"), F.col("n_nationkey").cast("string")).alias("slug"))
    return lint.self_sources(files.select("file_id", F.array("file_id").alias("sources")), slugs)


@query("lint_budget", f"WITH {sql.FILES}, t AS (SELECT file_id, len(string_split(text, chr(10))) AS lines, CAST(strlen(text) AS BIGINT) AS bytes FROM files) SELECT *, lines > 200 OR bytes > 12288 AS over FROM t")
def lint_budget(spark, d):
    return lint.budget(_files(spark, d), "manual")


@query("lint_evidence_trail", f"WITH {sql.FILES} SELECT file_id FROM files WHERE doc_id % 3 < 2 AND doc_id % 5 <> 0")
def lint_evidence_trail(spark, d):
    kind = F.element_at(F.array(F.lit("entity"), F.lit("topic"), F.lit("log")), (F.col("doc_id") % 3 + 1).cast("int"))
    text = F.concat("text", F.when(F.col("doc_id") % 5 == 0, "\n### Fil de PREUVES  \n- x").otherwise("\nfil de preuves"))
    return lint.lacks_evidence_trail(_files(spark, d).select("file_id", kind.alias("type"), text.alias("text")))


@query("usage_summary", "SELECT count(*) AS searches, count(*) FILTER (event_type = 'error') AS low, CAST(sum(length(props)) AS BIGINT) AS chars FROM events")
def usage_summary(spark, d):
    return lint.usage(table(spark, d, "events").select(F.when(F.col("event_type") == "error", "low").otherwise("ok").alias("confidence"), F.length("props").cast("long").alias("chars")))


# Evaluation.


def _fixtures(spark, d):
    """Fixtures of the benchmark: the query is its first eight words; targets are the documents that hold the whole text."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.regexp_replace("text", r"\s+", " ").alias("passage"))
    query_text = F.array_join(F.slice(F.split("passage", " "), 1, 8), " ")
    docs = _files(spark, d).select("file_id", F.regexp_replace("text", r"\s+", " ").alias("flat"))
    targets = evaluate.holding(docs, "file_id", "flat", items, "q_id", "passage")
    kinds = targets.select("q_id").distinct().withColumn("good", F.lit(True))
    return items.join(kinds, "q_id", "left").select("q_id", query_text.alias("query"), F.when(F.col("good"), "good").otherwise("weak").alias("kind")), targets


def _trial_sql(trials: str) -> str:
    score = sql.half_up("sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * greatest(length, 120) / avg_len))) * (1 + 0.15 * (count(*) - 1)) * CASE WHEN zone = 'outputs' THEN 0.7 ELSE 1.0 END", 6)
    fields = [f for f, _ in sql.FIELD_WEIGHTS]
    tokens = " UNION ALL ".join(f"SELECT file_id, zone, line, '{f}' AS field, unnest({sql.tokens(f)}) AS term FROM sections" for f in fields)
    weight = "CASE field WHEN 'heading' THEN heading WHEN 'meta' THEN meta WHEN 'crumb' THEN crumb ELSE 1.0 END"
    return f"""WITH {sql.SECTIONS}, trials AS ({trials}), tokens AS MATERIALIZED ({tokens}), counts AS (SELECT file_id, zone, line, field, term, count(*) AS n FROM tokens GROUP BY ALL),
fixtures AS (SELECT item_id AS q_id, array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:8], ' ') AS query, regexp_replace(text, '\\s+', ' ', 'g') AS passage FROM benchmark),
targets AS (SELECT q_id, file_id FROM fixtures JOIN files ON contains(regexp_replace(text, '\\s+', ' ', 'g'), passage)),
terms AS (SELECT DISTINCT q_id, unnest({sql.tokens('query')}) AS term FROM fixtures),
totals AS (SELECT s.file_id, s.line, field, coalesce(sum(n), 0) AS n FROM (SELECT file_id, line FROM sections) s LEFT JOIN counts c ON c.file_id = s.file_id AND c.line = s.line GROUP BY ALL),
dl AS (SELECT trial, file_id, line, sum(n * {weight}) AS length FROM trials CROSS JOIN totals GROUP BY ALL),
stats AS (SELECT trial, count(*)::DOUBLE AS n_docs, avg(length) AS avg_len FROM dl GROUP BY trial),
tf AS (SELECT trial, any_value(k1) AS k1, any_value(b) AS b, file_id, zone, line, term, sum(n * {weight}) AS tf FROM counts SEMI JOIN terms USING (term) CROSS JOIN trials GROUP BY trial, file_id, zone, line, term),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT file_id, line, term FROM tf) GROUP BY term),
scored AS (SELECT trial, q_id, file_id, zone, line, {score} AS score FROM tf JOIN terms USING (term) JOIN df USING (term) JOIN dl USING (trial, file_id, line) JOIN stats USING (trial) WHERE zone <> 'raw' GROUP BY trial, q_id, file_id, zone, line),
few AS (SELECT *, row_number() OVER (PARTITION BY trial, q_id, file_id ORDER BY score DESC, line) AS nth FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trial, q_id ORDER BY score DESC, file_id, line) AS rank FROM few WHERE nth <= 2),
best AS (SELECT * FROM ranked WHERE rank <= 5),
hits AS (SELECT t.trial, f.q_id, CASE WHEN EXISTS (SELECT 1 FROM targets x WHERE x.q_id = f.q_id) THEN 'good' ELSE 'weak' END AS kind,
  (SELECT min(rank) FROM best r JOIN targets x USING (q_id, file_id) WHERE r.trial = t.trial AND r.q_id = f.q_id) AS rank,
  (SELECT max(score) FROM best r WHERE r.trial = t.trial AND r.q_id = f.q_id) AS top1, (SELECT min(score) FROM best r WHERE r.trial = t.trial AND r.q_id = f.q_id AND rank = 5) AS top5 FROM fixtures f CROSS JOIN trials t)"""


_DEFAULT_TRIAL = "SELECT 0 AS trial, 4.0::DOUBLE AS heading, 2.0::DOUBLE AS meta, 1.5::DOUBLE AS crumb, 1.2::DOUBLE AS k1, 0.75::DOUBLE AS b"
_METRICS = f"""SELECT trial, count(*) AS n, {sql.half_up("avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END::DOUBLE)", 3)} AS p_at_1, {sql.half_up("avg(CASE WHEN rank IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE)", 3)} AS p_at_5, {sql.half_up("avg(coalesce(1.0::DOUBLE / rank, 0))", 3)} AS mrr FROM hits WHERE kind = 'good' GROUP BY trial"""


def _hits(spark, d, trials):
    fixtures, targets = _fixtures(spark, d)
    results = evaluate.ranked(stored_index(spark, d), fixtures, trials)
    return evaluate.first_hits(results, fixtures, targets, trials).join(fixtures.select("q_id", "kind"), "q_id")


@query("eval_metrics", _trial_sql(_DEFAULT_TRIAL) + _METRICS)
def eval_metrics(spark, d):
    trials = evaluate.grid(spark, {"heading": (4.0,), "meta": (2.0,), "crumb": (1.5,), "k1": (1.2,), "b": (0.75,)})
    return evaluate.metrics(_hits(spark, d, trials).where("kind = 'good'"))


@query("calibrate_threshold", _trial_sql(_DEFAULT_TRIAL) + f""", t AS (SELECT coalesce(min(top1) FILTER (kind = 'good' AND rank IS NOT NULL), 10.0) AS good_least, coalesce(max(top1) FILTER (kind = 'weak'), 0.0) AS weak_most,
  min(top1 / top5) FILTER (kind = 'good' AND rank IS NOT NULL AND top5 > 0) AS r FROM hits)
SELECT good_least, weak_most, {sql.half_up("CASE WHEN weak_most > 0 AND weak_most < good_least THEN sqrt(good_least * weak_most) ELSE good_least * 0.8 END", 2)} AS threshold, {sql.half_up("least(1.5::DOUBLE, coalesce(r * 0.95::DOUBLE, 1.5))", 2)} AS ratio FROM t""")
def calibrate_threshold(spark, d):
    trials = evaluate.grid(spark, {"heading": (4.0,), "meta": (2.0,), "crumb": (1.5,), "k1": (1.2,), "b": (0.75,)})
    return evaluate.thresholds(_hits(spark, d, trials))


def _grid_sql() -> str:
    """All trials of the grid, numbered in the order of its parameters."""
    lists = ", ".join(f"(VALUES {', '.join(f'({x}::DOUBLE)' for x in values)}) {k}_list({k})" for k, values in evaluate.GRID.items())
    return f"SELECT CAST(row_number() OVER (ORDER BY {', '.join(evaluate.GRID)}) - 1 AS INTEGER) AS trial, * FROM {lists}"


@query("tune_grid", _trial_sql(_grid_sql()) + _METRICS)
def tune_grid(spark, d):
    """The metrics of all trials of the grid; tune_grid_full has the rest of the sweep's report."""
    return evaluate.metrics(_hits(spark, d, evaluate.grid(spark)).where("kind = 'good'"))


@query("tune_grid_full")
def tune_grid_full(spark, d):
    """All trials of the grid. A quarter of the fixtures is held out, a fifth of the good ones are traps; their ids say which."""
    trials = evaluate.grid(spark)
    fixtures, targets = _fixtures(spark, d)
    held = stored_index(spark, d)
    results = evaluate.ranked(held, fixtures, trials)
    lot = F.crc32(F.col("q_id").cast("string").cast("binary"))
    marked = fixtures.select("q_id", "kind", (lot % 4 == 0).alias("held_out"), ((lot % 5 == 0) & (F.col("kind") == "good")).alias("trap"), F.lit(evaluate.DEPTH).alias("rank_max"))
    hits = evaluate.first_hits(results, fixtures, targets, trials).join(marked, "q_id")
    return evaluate.tuned(hits.join(evaluate.navigational_hits(results, held.sections), ["trial", "q_id"], "left"), trials)


# Feedback.

_EVENTS = "log AS (SELECT ts, user_id AS file, CASE event_type WHEN 'purchase' THEN 'used' ELSE 'deadend' END AS outcome, json_extract_string(props, '$.k') AS query FROM events WHERE event_type IN ('purchase', 'error'))"


def _log(spark, d):
    rows = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    return rows.select("ts", F.col("user_id").alias("file"), F.when(F.col("event_type") == "purchase", "used").otherwise("deadend").alias("outcome"), F.get_json_object("props", "$.k").alias("query"), F.lit("").alias("sha1"))


@query("feedback_report", f"""WITH {_EVENTS}, r AS (SELECT file, sum(CASE outcome WHEN 'used' THEN 1 ELSE -1 END * pow(0.5, greatest((epoch_ms({NOW_SQL}) - epoch_ms(ts)) / 86400000.0, 0) / 30)) AS exact,
  count(*) FILTER (outcome = 'used') AS used, count(*) FILTER (outcome <> 'used') AS deadend, count(DISTINCT CASE WHEN outcome = 'used' THEN array_to_string(list_sort(list_distinct({sql.tokens('query')})), ' ') END) AS corroborations, max(ts) AS last_ts FROM log GROUP BY file)
SELECT file, CASE WHEN exact > 0 AND corroborations >= 2 THEN 'preferred' WHEN exact <= 0 THEN 'contested' ELSE 'tentative' END AS status, {sql.half_up('exact', 3)} AS score, used, deadend, corroborations, last_ts FROM r""")
def feedback_report(spark, d):
    return feedback.report(_log(spark, d), _now()).drop("stale")


@query("feedback_recent", f"""WITH {_EVENTS}, n AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY ts DESC, query) AS nth FROM log WHERE outcome <> 'used')
SELECT file, ts, query, CAST(floor(greatest((epoch_ms({NOW_SQL}) - epoch_ms(ts)) / 86400000.0, 0)) AS BIGINT) AS age_days FROM n WHERE nth <= 3 ORDER BY ts DESC, file, query LIMIT 10""")
def feedback_recent(spark, d):
    return feedback.dead_ends(_log(spark, d), _now())


@query("feedback_dedupe", f"WITH {_EVENTS} SELECT DISTINCT date_trunc('hour', ts) AS ts, file, outcome, query FROM log")
def feedback_dedupe(spark, d):
    return feedback.stable(_log(spark, d).withColumn("ts", F.date_trunc("hour", "ts"))).drop("sha1")


# Lifecycle.

_HEAD = "'---' || chr(10) || 'type: topic' || chr(10) || 'statut: ' || CASE WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'canon' END || chr(10) || 'sources:' || chr(10) || '  - a' || doc_id || chr(10) || '  - b' || chr(10) || '---' || chr(10)"


def _drafted(spark, d):
    status = F.when(F.col("doc_id") % 3 == 0, "draft").otherwise("canon")
    head = F.concat(F.lit("---\ntype: topic\nstatut: "), status, F.lit("\nsources:\n  - a"), F.col("doc_id").cast("string"), F.lit("\n  - b\n---\n"))
    return _files(spark, d).withColumn("text", F.concat(head, "text")).withColumn("modified", F.date_format(F.date_sub(_now().cast("date"), (F.col("doc_id") % 200).cast("int")), "yyyy-MM-dd"))


@query("drafts_list", f"WITH {sql.FILES} SELECT file_id, doc_id % 200 AS age_days, 'a' || doc_id || ',b' AS sources FROM files WHERE doc_id % 3 = 0")
def drafts_list(spark, d):
    rows = _drafted(spark, d).withColumn("statut", status_of(F.col("text")))
    listed = rows.select("file_id", F.array_join(listed_values(F.col("text"), "sources"), ",").alias("sources"))
    return lifecycle.drafts(rows, _now()).select("file_id", "age_days").join(listed, "file_id")


@query("promote_draft", f"WITH {sql.FILES} SELECT file_id, replace({_HEAD}, 'draft', 'canon') || text AS text FROM files WHERE doc_id % 3 = 0")
def promote_draft(spark, d):
    return _drafted(spark, d).select("file_id", lifecycle.promoted(F.col("text")).alias("text")).where("text is not null")


# Sessions.

_TURNS = f"""t AS (SELECT conv_id AS session, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND NOT regexp_matches(text, {sql.quoted(T.NOISE)})),
m AS (SELECT *, CASE WHEN lag(role) OVER w = role THEN 0 ELSE 1 END AS change FROM t WINDOW w AS (PARTITION BY session ORDER BY turn)),
i AS (SELECT *, CAST(sum(change) OVER (PARTITION BY session ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM m)"""


def _turns(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text")


@query("session_merge", f"WITH {_TURNS} SELECT session, island, role, min(turn) AS first, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM i GROUP BY session, island, role")
def session_merge(spark, d):
    return sessions.merged(_turns(spark, d), (F.trim("text") != "") & ~T.is_tool_noise(F.col("text")))


@query("session_substance", "SELECT conv_id AS session, count(*) FILTER (role = 'user') AS human, count(*) AS messages FROM conversations GROUP BY conv_id HAVING count(*) FILTER (role = 'user') >= 3")
def session_substance(spark, d):
    return sessions.substantial(_turns(spark, d))


@query("session_truncate", """WITH c AS (SELECT conv_id AS session, turn, role, CASE WHEN length(text) > 3000 THEN left(text, 3000) || chr(10) || '[…]' ELSE text END AS text FROM conversations),
b AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY session ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c) SELECT session, turn, role, text FROM b WHERE before <= 256000""")
def session_truncate(spark, d):
    return sessions.truncated(_turns(spark, d))


# Introspection, increments.


@query("risk_policy", """WITH n AS (SELECT s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'read' END AS declared FROM supplier)
SELECT name, CASE WHEN name = 'Supplier#000000003' THEN 'action' WHEN starts_with(name, 'Supplier#00000001') THEN 'write' WHEN starts_with(name, 'Supplier#00000000') THEN 'read' ELSE coalesce(declared, 'unknown') END AS level,
  CASE WHEN starts_with(name, 'Supplier#00000001') OR starts_with(name, 'Supplier#00000000') THEN 'policy' WHEN declared IS NOT NULL THEN 'declared' ELSE 'default' END AS origin FROM n""")
def risk_policy(spark, d):
    named = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "read").alias("declared"))
    policy = spark.createDataFrame([("Supplier#000000003", "action")], "name string, level string")
    prefixes = spark.createDataFrame([(0, "Supplier#00000001", "write"), (1, "Supplier#00000000", "read")], "place int, prefix string, level string")
    return introspect.assessed(named, policy, prefixes)


@query("incremental_diff", """SELECT file_id, CASE WHEN a IS NULL THEN 'new' WHEN b IS NULL THEN 'gone' WHEN a = b THEN 'same' ELSE 'changed' END AS change FROM (
SELECT coalesce(o.doc_id, n.doc_id) AS file_id, o.n AS a, n.n AS b FROM (SELECT doc_id, n_chars AS n FROM documents WHERE doc_id % 7 <> 0) o FULL JOIN (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE doc_id % 11 <> 0) n ON o.doc_id = n.doc_id)""")
def incremental_diff(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("file_id"), F.lit("").alias("anchor_sig"), F.lit("").alias("sha1"), "n_chars")
    old = docs.where("file_id % 7 <> 0").withColumn("sig", F.col("n_chars"))
    new = docs.where("file_id % 11 <> 0").withColumn("sig", F.when(F.col("file_id") % 5 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return incremental.diff(old, new)


@query("stream_incremental", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def stream_incremental(spark, d):
    """Replays the events as a stream of files into a table of the latest event of each user."""
    import uuid

    base = f"{shared_folder(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    events = table(spark, d, "events")
    events.select("user_id", "event_id", "event_type", "value").repartition(2, "user_id").write.parquet(f"{base}/in")
    schema = "user_id long, event_id long, event_type string, value double"
    incremental.upsert_stream(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state", "user_id", "event_id").awaitTermination()
    return spark.read.parquet(f"{base}/out")


@query("debounce_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS change FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(change) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, min(ts) AS begin, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, burst""")
def debounce_sessions(spark, d):
    return incremental.debounced(table(spark, d, "events").select("user_id", "ts"), "user_id", "6 hours")


@query("redaction_counts", f"SELECT source, count(*) FILTER (contains(r, {sql.quoted(T.MASK)})) AS masked FROM (SELECT source, redacted AS r FROM documents JOIN (REDACTED) USING (doc_id)) GROUP BY source")
def redaction_counts(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_if(T.redact(F.col("text")).contains(T.MASK)).alias("masked"))


ORACLES["redaction_counts"] = ORACLES["redaction_counts"].replace("REDACTED", _SEARCH["redact_secrets"])
