"""Fielded BM25 search over sections: postings, scores, filters, diversity, confidence, fusion, evidence, expansion, feedback.

Sections have file_id, source, zone, line, heading, crumb, meta, body. Statistics cover all sections;
filters on source, zone or folder act on the scored rows only, as the ranking contract asks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkquill.functions import scalars as S
from sparkquill.functions import text as T
from sparkquill.functions.analysis import Analyzer, field_counts
from sparkquill.sources.corpus import ZONE_WEIGHT, files_of, spread

# Fixed values of the search contract.
FIELDS = {"heading": 4.0, "meta": 2.0, "crumb": 1.5, "body": 1.0}
TOP, PER_FILE = 5, 2
THRESHOLD, RATIO = 7.0, 1.5
EXPAND_SEEDS, EXPAND_ADDED, EXPAND_WEIGHT = 3, 2, 0.3
DIGITS = 6


def sections_of(documents: DataFrame) -> DataFrame:
    """The documents table as sections, one per line: heading is the first line, crumb the language, meta the source and language."""
    files = files_of(spread(documents))
    return files.select("file_id", "source", "zone", "rel", F.col("title").alias("heading"), F.col("lang").alias("crumb"), F.concat_ws(" ", "source", "lang").alias("meta"), F.posexplode(F.split("text", "\n", -1)).alias("place", "body")).withColumn("line", (F.col("place") + 1).cast("long")).drop("place")


KEEP = ["file_id", "source", "zone", "rel", "line", "heading"]
POSTED = ["term", "file_id", "source", "zone", "rel", "line", *(f"f_{f}" for f in FIELDS), *(f"n_{f}" for f in FIELDS)]


@dataclass
class Index:
    """What ranking needs of a corpus, stored or computed on demand: tokens are counted by field, so any weights apply afterwards."""

    sections: DataFrame  # file_id, source, zone, rel, line, heading, n_<field>
    postings: DataFrame  # POSTED
    meta: DataFrame  # n_docs, a_<field> (mean tokens)
    files: DataFrame | None = None  # file_id, sig, anchor_sig, sha1
    rows: DataFrame | None = None  # sections with their counts: what sections and postings are read from


def meta_of(sections: DataFrame) -> DataFrame:
    return sections.agg(F.count("*").alias("n_docs"), *[F.coalesce(F.avg(f"n_{f}"), F.lit(0.0)).alias(f"a_{f}") for f in FIELDS])


def of_rows(rows: DataFrame) -> Index:
    """The index of analysed sections (see analysis.field_counts)."""
    posted = rows.where(F.size("counts") > 0).select("*", F.explode("counts").alias("c")).select(*[F.col(f"c.{x}").alias(x) if x == "term" or x.startswith("f_") else F.col(x) for x in POSTED])
    return Index(rows.drop("counts"), posted, meta_of(rows), rows=rows)


def analysed(sections: DataFrame, only: list[str] | None = None) -> Index:
    """The index of sections, each with a number of its own in its file. Of the given terms only, if any are given; lengths and means always count all tokens."""
    return of_rows(field_counts(sections, KEEP, list(FIELDS), only))


def weighed(prefix: str, weights: dict[str, float] = FIELDS) -> Column:
    """The sum of a field's count times its weight."""
    return sum((F.col(f"{prefix}_{f}") * F.lit(w) for f, w in weights.items()), F.lit(0.0))


def postings(index: Index, weights: dict[str, float] = FIELDS) -> DataFrame:
    """term, file_id, line, tf: the sum of field weights."""
    return index.postings.select("term", "file_id", "line", weighed("f", weights).alias("tf"))


def lengths(index: Index) -> DataFrame:
    return index.sections.select("file_id", "line", weighed("n").alias("length"))


def index_meta(index: Index) -> DataFrame:
    return index.meta.select("n_docs", S.half_up(weighed("a"), DIGITS).alias("avg_len"))


def document_frequency(index: Index) -> DataFrame:
    return index.postings.groupBy("term").agg(F.count("*").alias("df"))


def transposed(index: Index, weights: dict[str, float] = FIELDS) -> DataFrame:
    """Postings by section: file_id, line, terms (a map of term to tf). The sections hold their counts, so nothing is dealt."""
    entry = lambda c: F.struct(c["term"].alias("term"), sum((c[f"f_{f}"] * F.lit(w) for f, w in weights.items()), F.lit(0.0)).alias("tf"))
    return index.rows.where(F.size("counts") > 0).select("file_id", "line", F.map_from_entries(F.transform("counts", entry)).alias("terms"))


def query_terms(query: str) -> list[str]:
    """The distinct search tokens of a query, in order."""
    return list(dict.fromkeys(Analyzer().tokens(query)))


def zone_weight(zone: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in ZONE_WEIGHT.items() for x in pair))[zone], F.lit(1.0))


def scored(corpus: DataFrame | Index, terms: list[str], k1: float = S.K1, b: float = S.B, weights: dict[str, float] = FIELDS) -> DataFrame:
    """file_id, source, zone, rel, line, score, hits, matched (sorted terms), of sections with any term.

    The terms reach a stored index's scan as a filter. The statistics are one row, and one row per term of the query.
    """
    index = corpus if isinstance(corpus, Index) else analysed(corpus, terms)
    found = index.postings.where(F.col("term").isin(terms)) if terms else index.postings.limit(0)
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    stats = index.meta.select(F.col("n_docs").cast("double").alias("n_docs"), weighed("a", weights).alias("avg_len"))
    parts = found.select("term", "file_id", "source", "zone", "rel", "line", weighed("f", weights).alias("tf"), weighed("n", weights).alias("length")).join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    part = S.idf(F.col("n_docs"), F.col("df")) * S.saturated(F.col("tf"), F.col("length"), F.col("avg_len"), k1, b)
    totals = parts.withColumn("part", part).groupBy("file_id", "source", "zone", "rel", "line").agg(F.sum("part").alias("total"), F.count("*").alias("hits"), F.array_sort(F.collect_list("term")).alias("matched"))
    score = F.col("total") * S.coverage(F.col("hits")) * zone_weight(F.col("zone"))
    return totals.select("file_id", "source", "zone", "rel", "line", S.half_up(score, DIGITS).alias("score"), "hits", "matched")


def allowed(rows: DataFrame, source: str | None = None, folder: str | None = None, raw: bool = False) -> DataFrame:
    """Raw notes only on demand; one source; a folder as the beginning of the path or id."""
    if not raw:
        rows = rows.where("zone <> 'raw'")
    if source:
        rows = rows.where(F.col("source") == source)
    if folder:
        rows = rows.where(F.col("rel").startswith(folder) | F.col("file_id").startswith(folder))
    return rows


def by_score(*more: Column) -> list[Column]:
    return [F.desc("score"), *more, F.asc("file_id"), F.asc("line")]


def diversified(rows: DataFrame, per_file: int = PER_FILE, order: list[Column] | None = None) -> DataFrame:
    """At most per_file rows of each file."""
    w = Window.partitionBy("file_id").orderBy(*(order or by_score()))
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= per_file).drop("nth")


def top(rows: DataFrame, k: int = TOP, order: list[Column] | None = None) -> DataFrame:
    """The k best rows with their rank; k rows are left before they are numbered."""
    order = order or by_score()
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_rows(rows: DataFrame, lead: list[tuple[str, bool]], rest: list[Column], name: str = "rank") -> DataFrame:
    """Numbers all rows in the order of the lead columns (name, descending) and, among equal ones, of rest.

    Rows are numbered within their lead values in parallel; a row per distinct lead values says how many come before.
    """
    by = [F.desc(c) if down else F.asc(c) for c, down in lead]
    names = [c for c, _ in lead]
    counts = rows.groupBy(*names).agg(F.count("*").alias("rows_here"))
    before = counts.withColumn("rows_before", F.coalesce(F.sum("rows_here").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("rows_here")
    nth = F.row_number().over(Window.partitionBy(*names).orderBy(*rest))
    return rows.withColumn("nth_here", nth).join(before, names).withColumn(name, F.col("rows_before") + F.col("nth_here")).drop("nth_here", "rows_before")


def search(corpus: DataFrame | Index, query: str, k: int = TOP, per_file: int = PER_FILE, source: str | None = None, folder: str | None = None, raw: bool = False) -> DataFrame:
    """Ranked results: rank, file_id, line, score, hits, matched, ..."""
    return top(diversified(allowed(scored(corpus, query_terms(query)), source, folder, raw), per_file), k)


def confidence(rows: DataFrame, threshold: float = THRESHOLD, ratio: float = RATIO) -> DataFrame:
    """One row: n, top1, top5, confidence (none, low or ok) of a diversified ranking."""
    best = rows.orderBy(*by_score()).limit(5).agg(F.count("*").alias("n"), F.max("score").alias("top1"), F.when(F.count("*") >= 5, F.min("score")).alias("top5"))
    low = (F.col("top1") < threshold) | ((F.col("top5") > 0) & (F.col("top1") / F.col("top5") < ratio))
    return best.withColumn("confidence", F.when(F.col("n") == 0, "none").when(F.coalesce(low, F.lit(False)), "low").otherwise("ok"))


def parse_query(document: str) -> tuple[bool, list[str], list[str]]:
    """(structured, sub-queries, notes) of a query document: lines "lex: ..." are sub-queries, other "key: ..." lines notes."""
    lex, notes = [], []
    for line in document.split("\n"):
        m = re.match(r"^\s*([A-Za-z_]{2,12})\s*:\s*(.*)$", line)
        if m and m[2].strip():
            (lex if m[1].lower() == "lex" else notes).append(m[2].strip())
    return (True, lex, notes) if lex else (False, [document.strip()] if document.strip() else [], notes)


def fusion_lists(lex: list[str]) -> list[tuple[str, float]]:
    """Queries to fuse and their weights: all lines together count twice."""
    return [(" ".join(lex), 2.0), *((x, 1.0) for x in lex)] if len(lex) > 1 else [(lex[0], 2.0)] if lex else []


def fused(lists: list[tuple[DataFrame, float]]) -> DataFrame:
    """Reciprocal-rank fusion of rankings: file_id, line, ..., rrf, score (the best), matched, n_lists."""
    parts = None
    for rows, weight in lists:
        # Scores in bins of a sixteenth: a list is numbered bin by bin, in parallel.
        ranked = ranked_rows(rows.withColumn("bin", F.floor(F.col("score") * 16)), [("bin", True)], by_score()).drop("bin")
        part = ranked.withColumn("gain", F.lit(weight) / (S.RRF_K + F.col("rank")) + S.rrf_bonus(F.col("rank")))
        parts = part if parts is None else parts.unionByName(part)
    out = parts.groupBy("file_id", "source", "zone", "rel", "line").agg(F.sum("gain").alias("gain"), F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("matched")))).alias("matched"), F.count("*").alias("n_lists"))
    return out.withColumn("rrf", S.half_up(F.col("gain"), DIGITS)).drop("gain")


def search_document(corpus: DataFrame | Index, document: str, k: int = TOP, per_file: int = PER_FILE) -> DataFrame:
    """A query document: several sub-queries are fused, a single line is searched as it is."""
    structured, lex, _ = parse_query(document)
    if not structured:
        return search(corpus, document, k, per_file)
    lists = [(allowed(scored(corpus, query_terms(q))), w) for q, w in fusion_lists(lex)]
    order = [F.desc("rrf"), *by_score()]
    return top(diversified(fused(lists), per_file, order), k, order)


def with_headings(rows: DataFrame, index: Index) -> DataFrame:
    """Adds the headings of the few rows that a search returns."""
    return index.sections.select("file_id", "line", "heading").join(F.broadcast(rows), ["file_id", "line"])


def evidence(rows: DataFrame, terms: list[str], query: str, aliases: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Adds evidence (exact_title, alias, keyword_exact, partial) and creation_sure. aliases: file_id, anchors (tokens of links to it)."""
    wanted = F.array(*map(F.lit, terms)) if terms else F.array().cast("array<string>")

    def same(t: Column) -> Column:
        return (F.size(F.array_except(t, wanted)) == 0) & (F.size(F.array_except(wanted, t)) == 0)

    if aliases is not None:
        rows = rows.join(aliases, "file_id", "left")
        is_alias = F.coalesce((F.size("anchors") > 0) & (F.size(F.array_except(wanted, F.col("anchors"))) == 0), F.lit(False))
    else:
        is_alias = F.lit(False)
    slug = T.slugify(F.regexp_replace(F.element_at(F.split("rel", "/"), -1), r"\.[^.]+$", ""))
    exact = same(T.tokens(F.col("heading"))) | ((slug != "") & (slug == T.slugify(F.lit(query))))
    label = F.when(exact, "exact_title").when(is_alias, "alias").when(F.size("matched") == len(terms), "keyword_exact").otherwise("partial")
    if not terms:
        label = F.lit("partial")
    sure = F.when(F.col("evidence").isin("exact_title", "alias"), "exists").when(F.col("score") >= threshold, "probable").otherwise("unknown")
    return rows.withColumn("evidence", label).withColumn("creation_sure", sure)


def expanded(results: DataFrame, neighbours: DataFrame, degrees: DataFrame) -> DataFrame:
    """Results and up to EXPAND_ADDED graph neighbours of the best three files, at EXPAND_WEIGHT of their seed's score.

    neighbours: file_id, other; degrees: other, degree. Of a file that several seeds reach, the best seed counts.
    """
    files = results.groupBy("file_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "file_id").limit(EXPAND_SEEDS)
    near = files.join(neighbours, "file_id").groupBy("other").agg(F.max("score").alias("seed")).join(results.select(F.col("file_id").alias("other")), "other", "left_anti")
    added = near.join(degrees, "other").orderBy(F.desc("degree"), "other").limit(EXPAND_ADDED)
    extra = added.select(F.col("other").alias("file_id"), S.half_up(F.col("seed") * EXPAND_WEIGHT, DIGITS).alias("score"), F.lit(True).alias("expanded"))
    return results.select("file_id", "score", F.lit(False).alias("expanded")).unionByName(extra)


def learned(results: DataFrame, entries: DataFrame) -> DataFrame:
    """Results reordered by feedback: a file's learned score moves its rank by less than one place. entries: file_id, learned."""
    own = entries.join(F.broadcast(results.select("file_id").distinct()), "file_id", "left_semi")  # a search's few rows are the small side
    moved = results.join(own, "file_id", "left").withColumn("place", S.half_up(S.nudged(F.col("rank"), F.coalesce("learned", F.lit(0.0))), DIGITS))
    return moved.withColumn("new_rank", F.row_number().over(Window.orderBy("place", "rank")))


def with_snippets(results: DataFrame, sections: DataFrame, terms: list[str]) -> DataFrame:
    """Adds the snippet of the few result rows, headed by their lines."""
    rows = sections.select("file_id", "line", "body").join(F.broadcast(results.select("file_id", "line", "rank", "score")), ["file_id", "line"])
    head = F.format_string("@@ -%d,%d @@ ", F.col("line"), F.lit(1).cast("long"))
    return rows.select("rank", "file_id", "line", "score", F.concat(head, T.snippet_udf(terms)("body")).alias("snippet"))
