"""Text analysis and search over documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.functions import text as T
from sparkquill.functions.scalars import half_up
from sparkquill.functions.analysis import term_counts
from sparkquill.operators import graph, index, lint, search
from sparkquill.plans import sql
from sparkquill.session import shared_folder
from sparkquill.sources.corpus import files_of, fingerprint, first_zone, lines_of, page_of_lines, spread, table

QUERIES, ORACLES = {}, {}
#: The searched words: common ones, a rare one, one of each language's text.
QUERY = "disgusting loser threading chen"
ANGLES = "lex: disgusting idiot\nlex: loser thing\nintent: rude words"


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return search.sections_of(_docs(spark, d))


def files_with_signatures(docs: DataFrame) -> DataFrame:
    return files_of(docs).select("file_id", F.sha1("text").alias("sig"), F.lit("").alias("anchor_sig"), F.sha1("text").alias("sha1"))


def stored_index(spark: SparkSession, d: str) -> search.Index:
    """The index of the documents table in the shared folder, built when a table (by its files' sizes and change times) is first searched."""
    path = f"{shared_folder(spark).rstrip('/')}/index-{fingerprint(spark, d, 'documents')}"
    return index.opened(spark, path, lambda: _sections(spark, d), lambda: files_with_signatures(_docs(spark, d)))


def _flat(rows: DataFrame) -> DataFrame:
    return rows.withColumn("matched", F.array_join("matched", " "))


RESULT = ["file_id", "line", "score", "hits", "matched", "rank"]
RESULT_SQL = "SELECT file_id, line, score, hits, matched, rank"


@query("scan_files_zones", f"WITH {sql.FILES} SELECT file_id, source, zone, rel, title FROM files")
def scan_files_zones(spark, d):
    return first_zone(files_of(_docs(spark, d))).select("file_id", "source", "zone", "rel", "title")


@query("fold_slugify", f"SELECT doc_id, {sql.fold('text')} AS folded, {sql.slug('text')} AS slug FROM documents")
def fold_slugify(spark, d):
    return _docs(spark, d).select("doc_id", T.fold(F.col("text")).alias("folded"), T.slugify(F.col("text")).alias("slug"))


@query("stem_tokens", f"SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({sql.tokens('text')}) AS term FROM documents) GROUP BY ALL")
def stem_tokens(spark, d):
    # Rows of one doc_id, if there are several, stand together: their terms need no aggregation of all rows.
    return term_counts(_docs(spark, d).select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id"), "doc_id", "text")


@query("token_compounds", f"SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({sql.compounds('text')}) AS word FROM documents) GROUP BY ALL")
def token_compounds(spark, d):
    return _docs(spark, d).select("doc_id", F.explode(T.compounds(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query("postings_tf", f"WITH {sql.POSTINGS} SELECT term, file_id, line, tf FROM postings")
def postings_tf(spark, d):
    return search.postings(search.analysed(_sections(spark, d)))


@query("doc_lengths", f"WITH {sql.POSTINGS} SELECT file_id, line, length FROM lengths")
def doc_lengths(spark, d):
    return search.lengths(search.analysed(_sections(spark, d)))


@query("index_meta", f"WITH {sql.POSTINGS} SELECT CAST(n_docs AS BIGINT) AS n_docs, {sql.half_up('avg_len', 6)} AS avg_len FROM stats")
def index_meta(spark, d):
    return search.index_meta(search.analysed(_sections(spark, d)))


@query("document_frequency", f"WITH {sql.POSTINGS} SELECT term, df FROM df")
def document_frequency(spark, d):
    return search.document_frequency(search.analysed(_sections(spark, d)))


@query("search_bm25", f"WITH {sql.POSTINGS}, {sql.scored(QUERY)} {RESULT_SQL} FROM {sql.top(sql.diversified('scored'), 20)}")
def search_bm25(spark, d):
    return _flat(search.search(stored_index(spark, d), QUERY, 20)).select(*RESULT)


@query("search_sections", f"WITH {sql.POSTINGS}, {sql.scored(QUERY)} {RESULT_SQL} FROM {sql.top(sql.diversified('scored'), 20)}")
def search_sections(spark, d):
    """The same over sections that no index holds: only the query's terms leave the analysis."""
    return _flat(search.search(_sections(spark, d), QUERY, 20)).select(*RESULT)


_CHANGED = "CASE WHEN doc_id % 5 = 0 THEN text || chr(10) || 'loser thing' ELSE text END"


@query("search_refreshed", f"WITH {sql.POSTINGS}, {sql.scored(QUERY)} {RESULT_SQL} FROM {sql.top(sql.diversified('scored'), 20)}".replace("lang, text FROM documents", f"lang, {_CHANGED} AS text FROM documents WHERE doc_id % 11 <> 0"))
def search_refreshed(spark, d):
    """A search after a change: some documents are gone, some longer; the others keep their rows of the stored index."""
    docs = _docs(spark, d)
    changed = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nloser thing"))).otherwise(F.col("text")))
    held = index.refresh(stored_index(spark, d), search.sections_of(changed), files_with_signatures(changed), verify=True)
    return _flat(search.search(held, QUERY, 20)).select(*RESULT)


@query("postings_transposed", f"WITH {sql.POSTINGS} SELECT file_id, line, count(*) AS terms, sum(tf)::DOUBLE AS total FROM postings GROUP BY file_id, line")
def postings_transposed(spark, d):
    rows = search.transposed(stored_index(spark, d))
    return rows.select("file_id", "line", F.size("terms").cast("long").alias("terms"), F.aggregate(F.map_values("terms"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("search_filtered", f"WITH {sql.POSTINGS}, {sql.scored(QUERY)} {RESULT_SQL} FROM {sql.top(sql.diversified('scored', where="source = 'src1' AND (rel LIKE '1%' OR file_id LIKE '1%')"), 20)}")
def search_filtered(spark, d):
    return _flat(search.search(stored_index(spark, d), QUERY, 20, source="src1", folder="1", raw=True)).select(*RESULT)


@query("search_diverse", f"WITH {sql.POSTINGS}, {sql.scored(QUERY)} {RESULT_SQL} FROM {sql.top(sql.diversified('scored', per_file=1), 50)}")
def search_diverse(spark, d):
    return _flat(search.search(stored_index(spark, d), QUERY, 50, per_file=1)).select(*RESULT)


@query(
    "search_confidence",
    f"""WITH {sql.POSTINGS}, {sql.scored(QUERY)}, best AS (SELECT count(*) AS n, max(score) AS top1, CASE WHEN count(*) >= 5 THEN min(score) END AS top5 FROM {sql.top(sql.diversified('scored'), 5)})
SELECT n, top1, top5, CASE WHEN n = 0 THEN 'none' WHEN coalesce(top1 < 7.0 OR (top5 > 0 AND top1 / top5 < 1.5), false) THEN 'low' ELSE 'ok' END AS confidence FROM best""",
)
def search_confidence(spark, d):
    rows = search.scored(stored_index(spark, d), search.query_terms(QUERY))
    return search.confidence(search.diversified(search.allowed(rows)))


def _rrf_sql() -> str:
    _, lex, _ = search.parse_query(ANGLES)
    lists = search.fusion_lists(lex)
    ctes = ", ".join(sql.scored(q, f"s{i}") for i, (q, _) in enumerate(lists))
    ranks = " UNION ALL ".join(f"SELECT *, {w} / (60 + r) + CASE r WHEN 1 THEN 0.05 WHEN 2 THEN 0.02 WHEN 3 THEN 0.02 ELSE 0.0 END AS gain FROM (SELECT *, row_number() OVER (ORDER BY score DESC, file_id, line) AS r FROM s{i} WHERE zone <> 'raw')" for i, (_, w) in enumerate(lists))
    fused = f"SELECT file_id, zone, line, {sql.half_up('sum(gain::DOUBLE)', 6)} AS rrf, max(score) AS score, array_to_string(list_sort(list_distinct(flatten(list(string_split(matched, ' '))))), ' ') AS matched, count(*) AS n_lists FROM ({ranks}) GROUP BY ALL"
    order = "rrf DESC, score DESC, file_id, line"
    return f"WITH {sql.POSTINGS}, {ctes}, fused AS ({fused}) SELECT file_id, line, rrf, score, matched, n_lists, rank FROM {sql.top(sql.diversified('fused', order), 20, order)}"


@query("search_rrf", _rrf_sql())
def search_rrf(spark, d):
    return _flat(search.search_document(stored_index(spark, d), ANGLES, 20)).select("file_id", "line", "rrf", "score", "matched", "n_lists", "rank")


@query(
    "search_evidence",
    f"""WITH {sql.POSTINGS}, {sql.scored(QUERY)}, best AS (SELECT *, (SELECT list_sort(list(term)) FROM {sql.terms_of(QUERY)}) AS wanted FROM {sql.top(sql.diversified('scored'), 50)}),
e AS (SELECT *, CASE WHEN list_sort(list_distinct({sql.tokens('heading')})) = wanted OR {sql.slug('rel')} = {sql.slug(sql.quoted(QUERY))} THEN 'exact_title' WHEN hits = len(wanted) THEN 'keyword_exact' ELSE 'partial' END AS evidence FROM best)
SELECT file_id, line, score, evidence, CASE WHEN evidence = 'exact_title' THEN 'exists' WHEN score >= 7 THEN 'probable' ELSE 'unknown' END AS creation_sure FROM e""",
)
def search_evidence(spark, d):
    held = stored_index(spark, d)
    rows = search.with_headings(search.search(held, QUERY, 50), held)
    return search.evidence(rows, search.query_terms(QUERY), QUERY).select("file_id", "line", "score", "evidence", "creation_sure")


_NEIGHBOURS = r"""anchors AS (SELECT page_id, unnest(regexp_extract_all(html, '<a\s[^>]*href="([^"]*)"[^>]*>([^<]*)', 1)) AS target FROM pages),
near AS (SELECT DISTINCT f.file_id, 'page:' || a.target AS other FROM files f JOIN anchors a ON f.doc_id = a.page_id),
degrees AS (SELECT 'page:' || target AS other, count(*) AS degree FROM anchors GROUP BY ALL)"""


@query(
    "search_expand",
    f"""WITH {sql.POSTINGS}, {_NEIGHBOURS}, {sql.scored(QUERY)}, results AS (SELECT * FROM {sql.top(sql.diversified('scored'), 20)}),
seeds AS (SELECT file_id, max(score) AS score FROM results GROUP BY file_id ORDER BY score DESC, file_id LIMIT 3),
added AS (SELECT n.other, max(s.score) AS seed, any_value(g.degree) AS degree FROM seeds s JOIN near n USING (file_id) JOIN degrees g USING (other) GROUP BY n.other ORDER BY degree DESC, n.other LIMIT 2)
SELECT file_id, score, false AS expanded FROM results UNION ALL SELECT other, {sql.half_up('seed * 0.3', 6)}, true FROM added""",
)
def search_expand(spark, d):
    anchors = graph.page_links(table(spark, d, "pages"))
    other = F.concat(F.lit("page:"), F.col("target")).alias("other")
    near = files_of(_docs(spark, d)).join(anchors, F.col("doc_id") == F.col("from_id")).select("file_id", other).distinct()
    return search.expanded(search.search(stored_index(spark, d), QUERY, 20), near, anchors.groupBy(other).agg(F.count("*").alias("degree")))


@query(
    "search_learn",
    f"""WITH {sql.POSTINGS}, {sql.scored(QUERY)}, results AS (SELECT * FROM {sql.top(sql.diversified('scored'), 20)}),
entries AS (SELECT user_id % 1000 AS doc_id, {sql.half_up("sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END * pow(0.5, greatest((epoch_ms(TIMESTAMP '2024-01-31') - epoch_ms(ts)) / 86400000.0, 0) / 30))", 3)} AS learned FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1),
moved AS (SELECT r.file_id, r.line, r.score, r.rank, {sql.half_up('r.rank - 0.75 * tanh(coalesce(e.learned, 0))', 6)} AS place FROM results r JOIN files f USING (file_id) LEFT JOIN entries e ON e.doc_id = f.doc_id)
SELECT file_id, line, score, rank, place, row_number() OVER (ORDER BY place, rank) AS new_rank FROM moved""",
)
def search_learn(spark, d):
    from sparkquill.operators.feedback import report

    events = table(spark, d, "events").where("event_type in ('purchase', 'error')").select("ts", F.pmod("user_id", F.lit(1000)).alias("doc_id"), F.when(F.col("event_type") == "purchase", "used").otherwise("deadend").alias("outcome"))
    logged = events.select("ts", F.col("doc_id").alias("file"), "outcome", F.lit("").alias("query"), F.lit("").alias("sha1"))
    learned = report(logged, F.lit("2024-01-31").cast("timestamp")).select(F.col("file").alias("doc_id"), F.col("score").alias("learned"))
    entries = files_of(_docs(spark, d)).join(learned, "doc_id").select("file_id", "learned")
    return search.learned(search.search(stored_index(spark, d), QUERY, 20), entries).select("file_id", "line", "score", "rank", "place", "new_rank")


@query("snippet")
def snippet(spark, d):
    return search.with_snippets(search.search(stored_index(spark, d), QUERY, 20), _sections(spark, d), search.query_terms(QUERY))


_DIRTY = "'<|im_start|>' || chr(27) || '[31m' || text || '[INST]' || chr(8238) || ' ### System: x </system>'"


@query(
    "sanitize_text",
    f"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace({_DIRTY}, '\\x1b\\[[0-9;?]*[ -/]*[@-~]', '', 'g'), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]', '', 'g') AS t FROM documents),
u AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '<(\\|[^|>\\n]{{0,40}}\\|>)', '<' || chr(8203) || '\\1', 'g'), '\\[(/?INST\\])', '[' || chr(8203) || '\\1', 'gi'), '#(##\\s*(?:System|Instruction|Human|Assistant|Système|Consigne)\\s*:)', '#' || chr(8203) || '\\1', 'gi'), '<(/?(?:source_non_verifiee|untrusted_source|system|assistant|human)\\b[^>\\n]{{0,120}}>)', '<' || chr(8203) || '\\1', 'gi') AS t FROM t)
SELECT doc_id, CASE WHEN length(t) > 420 THEN left(t, 420) || '…' ELSE t END AS clean, right(t, 40) AS tail FROM u""",
)
def sanitize_text(spark, d):
    dirty = F.concat(F.lit("<|im_start|>\x1b[31m"), "text", F.lit("[INST]\u202e ### System: x </system>"))
    return _docs(spark, d).select("doc_id", T.sanitize(dirty, T.CLIP["snippet"]).alias("clean"), F.right(T.sanitize(dirty, 1 << 30), F.lit(40)).alias("tail"))


@query("redact_secrets", None)
def redact_secrets(spark, d):
    return spread(_docs(spark, d)).select("doc_id", T.redact(F.col("text")).alias("redacted"))


def _redact_sql() -> str:
    out = "text"
    for p in (*T.SECRETS, None, T.IBAN):
        out = f"regexp_replace({out}, {sql.quoted(p)}, {sql.quoted(T.MASK)}, 'g')" if p else f"regexp_replace({out}, {sql.quoted(T.LABELLED_SECRET)}, '\\1 : {T.MASK}', 'g')"
    return f"SELECT doc_id, {out} AS redacted FROM documents"


ORACLES["redact_secrets"] = _redact_sql()


@query(
    "context_prefix_join",
    f"""WITH {sql.FILES}, p(prefix, text) AS (VALUES ('src', 'all'), ('src1', 'first'), ('src1/', 'one'), ('src1/1', 'ones'))
SELECT file_id, string_agg(p.text, ' — ' ORDER BY length(prefix), prefix) AS context FROM files JOIN p ON starts_with(file_id, prefix) GROUP BY file_id""",
)
def context_prefix_join(spark, d):
    prefixes = spark.createDataFrame([("src", "all"), ("src1", "first"), ("src1/", "one"), ("src1/1", "ones")], "prefix string, text string")
    return lint.contexts(files_of(_docs(spark, d)), prefixes)


@query("file_page", f"WITH {sql.FILES} SELECT file_id, len(string_split(text, chr(10))) AS total, least(4, len(string_split(text, chr(10)))) AS line_end, array_to_string(string_split(text, chr(10))[2:4], chr(10)) AS page FROM files")
def file_page(spark, d):
    return page_of_lines(files_of(_docs(spark, d)), 2, 4).select("file_id", F.col("total").cast("long").alias("total"), F.col("line_end").cast("long").alias("line_end"), F.col("text").alias("page"))


@query("line_offsets", f"WITH {sql.FILES} SELECT file_id, i AS line, CAST(coalesce(list_sum(list_transform(string_split(text, chr(10))[1:i - 1], lambda x: length(x) + 1)), 0) AS BIGINT) AS offset_chars FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM files)")
def line_offsets(spark, d):
    from sparkquill.operators.structure import lines

    return lines(files_of(_docs(spark, d))).select("file_id", F.col("line").cast("long").alias("line"), F.col("offset").alias("offset_chars"))


@query("stats_per_source", f"WITH {sql.FILES} SELECT source, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS lines, count(*) FILTER (zone = 'distilled') AS distilled, count(*) FILTER (zone = 'raw') AS raw, count(*) FILTER (zone = 'outputs') AS outputs FROM files GROUP BY ROLLUP (source)")
def stats_per_source(spark, d):
    return lint.per_source(files_of(_docs(spark, d)))


@query("query_keys", f"SELECT item_id, array_to_string(list_sort(list_distinct({sql.tokens('text')})), ' ') AS query_key FROM benchmark")
def query_keys(spark, d):
    return table(spark, d, "benchmark").select("item_id", T.query_key(F.col("text")).alias("query_key"))


@query("round_half_up", f"SELECT l_orderkey, l_linenumber, {sql.half_up('l_extendedprice * (1 - l_discount)', 1)} AS rounded FROM lineitem")
def round_half_up(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")), 1).alias("rounded"))


@query("line_lengths", f"WITH {sql.FILES} SELECT zone, count(*) AS lines, max(length(x)) AS longest FROM (SELECT zone, unnest(string_split(text, chr(10))) AS x FROM files) GROUP BY zone")
def line_lengths(spark, d):
    rows = lines_of(files_of(_docs(spark, d)), "zone")
    return rows.groupBy("zone").agg(F.count("*").alias("lines"), F.max(F.length("body")).cast("long").alias("longest"))
