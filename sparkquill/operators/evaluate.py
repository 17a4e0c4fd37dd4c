"""Retrieval evaluation: ranks of targets, P@1, P@5, MRR, thresholds, parameter sweeps.

All queries are scored in one pass over the sections (see functions.sweep), so the number of fixtures and trials
does not change the plan.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkquill.functions import scalars as S
from sparkquill.functions import text as T
from sparkquill.functions.sweep import Best, Sweep
from sparkquill.operators.search import DIGITS, FIELDS, Index
from sparkquill.sources.corpus import ZONE_WEIGHT

# The sweep's grid and the evaluation's depth.
GRID = {"heading": (3.0, 4.0, 5.0), "meta": (1.5, 2.0, 3.0), "crumb": (1.0, 1.5, 2.0), "k1": (1.0, 1.2, 1.5), "b": (0.6, 0.75, 0.9)}
DEPTH, PER_FILE = 5, 2
#: Words of a passage that are joined to find the documents that hold it.
ANCHOR = 5
#: Passages whose anchors every task may hold; those of more are joined.
KEPT_ANCHORS = 200_000
DEFAULT_GOOD_LEAST = 10.0
NAVIGATIONAL_HEADING = r"^(fiches liees|voir aussi)\b"


def grid(spark: SparkSession, values: dict[str, tuple[float, ...]] = GRID) -> DataFrame:
    """trial and one column per parameter."""
    rows = [(i, *map(float, x)) for i, x in enumerate(product(*values.values()))]
    return spark.createDataFrame(rows, "trial int, " + ", ".join(f"{k} double" for k in values))


def ranked(index: Index, fixtures: DataFrame, trials: DataFrame | None = None) -> DataFrame:
    """trial, q_id, file_id, line, score, rank (up to DEPTH) of every fixture (q_id, query) under every trial.

    The index counts tokens by field, so no trial needs another one. Each task reads its sections once and keeps the
    rows that are among a fixture's best under any trial; only these are dealt, by fixture, and merged.
    """
    spark = fixtures.sparkSession
    trials = trials if trials is not None else grid(spark, {"heading": (FIELDS["heading"],), "meta": (FIELDS["meta"],), "crumb": (FIELDS["crumb"],), "k1": (S.K1,), "b": (S.B,)})
    asked = fixtures.select("q_id", F.array_distinct(T.tokens(F.col("query"))).alias("terms")).collect()
    tried = trials.collect()
    terms = spark.createDataFrame([(t,) for t in sorted({t for r in asked for t in r["terms"] or []})], "term string")
    df = {r["term"]: r["df"] for r in index.postings.select("term").join(F.broadcast(terms), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df")).collect()}
    meta = index.meta.first()
    settings = (float(meta["n_docs"]), [meta[f"a_{f}"] for f in FIELDS], df, [r["terms"] or [] for r in asked], {k: [r[k] for r in tried] for k in GRID}, DEPTH, PER_FILE, S.LEAST_LENGTH, S.COVERAGE, ZONE_WEIGHT, DIGITS)
    numbers, q_ids = [r["trial"] for r in tried], [r["q_id"] for r in asked]
    q_type = to_arrow_type(fixtures.schema["q_id"].dataType)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(*settings)
        for batch in batches:
            sweep.add(batch)
        for q, best in enumerate(sweep.best):
            if best.rows:
                yield pa.RecordBatch.from_arrays([pa.array([q] * len(best.rows), pa.int64()), pa.array([f for f, _ in best.rows], pa.string()), pa.array([n for _, n in best.rows], pa.int64()), pa.array([x.tobytes() for x in best.scores], pa.binary())], names=["q", "file_id", "line", "scores"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Best] = {}
        for batch in batches:
            owners = batch.column(0).to_numpy()
            for q in np.unique(owners):
                for at in range(0, len(own := np.flatnonzero(owners == q)), 512):
                    part = batch.take(pa.array(own[at : at + 512]))
                    rows = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
                    scores = np.stack([np.frombuffer(x, np.float64) for x in part.column(3).to_pylist()])
                    found.setdefault(int(q), Best(len(numbers), DEPTH, PER_FILE)).add(rows, scores)
        for q, best in found.items():
            row, trial = np.nonzero(best.ranks)
            columns = [pa.array([numbers[t] for t in trial], pa.int32()), pa.array([q_ids[q]] * len(row), q_type), pa.array([best.rows[r][0] for r in row], pa.string()), pa.array([best.rows[r][1] for r in row], pa.int64()), pa.array(best.scores[row, trial]), pa.array(best.ranks[row, trial], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["trial", "q_id", "file_id", "line", "score", "rank"])

    sections = index.rows.where("zone <> 'raw'").select("file_id", "zone", "line", *[f"n_{f}" for f in FIELDS], "counts")
    few = sections.mapInArrow(local, "q long, file_id string, line long, scores binary").repartition("q")
    return few.mapInArrow(merged, f"trial int, q_id {fixtures.schema['q_id'].dataType.simpleString()}, file_id string, line long, score double, rank int")


def _anchored(docs: DataFrame, anchors: list[str]) -> DataFrame:
    """key, anchor of the documents (key, text) that hold the words of an anchor."""
    key, wanted = docs.columns[0], {}
    for x in anchors:
        words = tuple(x.split(" "))
        wanted.setdefault(len(words), set()).add(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part, at, found = batch.slice(begin, 1000), [], []
                for i, x in enumerate(part.column(1).to_pylist()):
                    own = x.split(" ") if x is not None else []
                    for n, some in wanted.items():
                        here = some.intersection(zip(*(own[j:] for j in range(n)), strict=False))
                        at += [i] * len(here)
                        found += map(" ".join, here)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=[key, "anchor"])

    return docs.mapInArrow(run, f"{key} {docs.schema[0].dataType.simpleString()}, anchor string")


def holding(docs: DataFrame, key: str, text: str, items: DataFrame, item: str, passage: str) -> DataFrame:
    """item, key of the documents whose text contains a passage; words are parted by single spaces in both.

    Up to ANCHOR words from inside a passage, which are whole words wherever it occurs, are joined to all
    word windows of that size; only such candidates are compared. Passages of one or two words have none inside
    and are looked for by their own windows of characters.
    """
    words = F.split(passage, " ")
    size = F.least(F.size(words) - 2, F.lit(ANCHOR))
    sized = items.select(item, passage, size.alias("size"), F.array_join(F.slice(words, 2, F.greatest(size, F.lit(1))), " ").alias("anchor"))
    anchors = sized.where("size > 0").select("size", "anchor").distinct().limit(KEPT_ANCHORS + 1).collect()
    if len(anchors) <= KEPT_ANCHORS:
        near = _anchored(docs.select(key, text), [r["anchor"] for r in anchors]).join(sized.where("size > 0").select(item, passage, "anchor"), "anchor").select(key, item, passage) if anchors else None
    else:
        near = None
        for n in [r["size"] for r in sized.where("size > 0").select("size").distinct().collect()]:  # ANCHOR values at most
            own = F.split(text, " ")
            # Texts stay out of the windows' rows: they are joined again for the candidates.
            windows = docs.select(key, own.alias("own")).where(F.size("own") >= n).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("own") - n + 1), lambda i: F.xxhash64(F.array_join(F.slice("own", i, F.lit(n)), " "))))).alias("anchor"))
            found = windows.join(sized.where(F.col("size") == n).select(item, passage, F.xxhash64("anchor").alias("anchor")), "anchor").select(key, item, passage)
            near = found if near is None else near.unionByName(found)
    out = None if near is None else docs.select(key, text).join(near, key).where(F.col(text).contains(F.col(passage))).select(item, key)
    short = sized.where("size <= 0").select(item, passage)
    lengths = [r["n"] for r in short.select(F.length(passage).alias("n")).distinct().collect()]
    for n in lengths:
        windows = docs.where(F.length(text) >= n).select(key, F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substr(F.col(text), i, F.lit(n))))).alias(passage)) if n else docs.where(F.col(text).isNotNull()).select(key, F.lit("").alias(passage))
        hits = windows.join(short, passage).select(item, key)
        out = hits if out is None else out.unionByName(hits)
    return out.distinct() if out is not None else items.limit(0).select(item).crossJoin(docs.limit(0).select(key))


def first_hits(results: DataFrame, fixtures: DataFrame, targets: DataFrame, trials: DataFrame) -> DataFrame:
    """trial, q_id, rank of the first target (null if none is in the results), top1 score, top5 score."""
    marked = results.join(targets.select("q_id", "file_id", F.lit(True).alias("hit")).distinct(), ["q_id", "file_id"], "left")
    found = marked.groupBy("trial", "q_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"), F.max("score").alias("top1"), F.min(F.when(F.col("rank") == DEPTH, F.col("score"))).alias("top5"))
    return fixtures.select("q_id").crossJoin(F.broadcast(trials.select("trial"))).join(found, ["trial", "q_id"], "left")


def metrics(hits: DataFrame) -> DataFrame:
    """trial, n, p_at_1, p_at_5, mrr over the rows of hits."""
    return hits.groupBy("trial").agg(
        F.count("*").alias("n"),
        S.half_up(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 3).alias("p_at_1"),
        S.half_up(F.avg(F.when(F.col("rank").isNotNull(), 1.0).otherwise(0.0)), 3).alias("p_at_5"),
        S.half_up(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 3).alias("mrr"),
    )


def thresholds(hits: DataFrame) -> DataFrame:
    """One row from hits with kind (good, weak): good_least, weak_most, threshold, ratio."""
    success = (F.col("kind") == "good") & F.col("rank").isNotNull()
    least = F.coalesce(F.min(F.when(success, F.col("top1"))), F.lit(DEFAULT_GOOD_LEAST))
    weak = F.coalesce(F.max(F.when(F.col("kind") == "weak", F.col("top1"))), F.lit(0.0))
    ratio = F.min(F.when(success & (F.col("top5") > 0), F.col("top1") / F.col("top5")))
    one = hits.agg(least.alias("good_least"), weak.alias("weak_most"), ratio.alias("r"))
    return one.select("good_least", "weak_most", S.threshold_between(F.col("good_least"), F.col("weak_most")).alias("threshold"), S.half_up(F.least(F.lit(1.5), F.coalesce(F.col("r") * 0.95, F.lit(1.5))), 2).alias("ratio"))


def receipt(hits: DataFrame, config: str, at: Column) -> DataFrame:
    """One row that records a calibration: metrics of the good fixtures, thresholds, the constants they were measured with, a hash of the configuration."""
    constants = {**FIELDS, "k1": S.K1, "b": S.B}
    row = metrics(hits.where("kind = 'good'")).drop("trial").crossJoin(thresholds(hits))
    return row.select("*", *[F.lit(v).alias(k) for k, v in constants.items()], F.sha1(F.lit(config)).alias("config_sha1"), at.alias("at"))


def navigational_hits(results: DataFrame, sections: DataFrame) -> DataFrame:
    """trial, q_id, navigational: how many results are sections that only lead elsewhere."""
    headings = sections.where(T.fold(F.col("heading")).rlike(NAVIGATIONAL_HEADING)).select("file_id", "line")
    return results.join(headings, ["file_id", "line"]).groupBy("trial", "q_id").agg(F.count("*").alias("navigational"))


def tuned(hits: DataFrame, trials: DataFrame) -> DataFrame:
    """Every trial with its parameters, metrics, held-out metrics, broken traps, threshold, place and whether it is recommended.

    hits has, beside first_hits(), kind, held_out, trap, rank_max and navigational. Broken are: a trap
    whose target comes after rank_max, a weak fixture that scores like good ones, a navigational result.
    Trials that break none are placed by mrr, p@1, held-out mrr and key; the others have no place.
    """
    held = metrics(hits.where("kind = 'good' and held_out")).select("trial", F.col("n").alias("n_held_out"), F.col("p_at_1").alias("held_out_p_at_1"), F.col("p_at_5").alias("held_out_p_at_5"), F.col("mrr").alias("held_out_mrr"))
    success = (F.col("kind") == "good") & F.col("rank").isNotNull()
    weak = F.col("kind") == "weak"
    least = hits.groupBy("trial").agg(F.coalesce(F.min(F.when(success, F.col("top1"))), F.lit(DEFAULT_GOOD_LEAST)).alias("good_least"), F.coalesce(F.max(F.when(weak, F.col("top1"))), F.lit(0.0)).alias("weak_most"))
    late = F.col("trap") & (F.col("rank").isNull() | (F.col("rank") > F.coalesce("rank_max", F.lit(1))))
    high = weak & (F.coalesce("top1", F.lit(0.0)) >= F.col("good_least"))
    broken = F.coalesce(late, F.lit(False)).cast("long") + high.cast("long") + F.coalesce("navigational", F.lit(0)).cast("long")
    traps = hits.join(least, "trial").groupBy("trial").agg(F.sum(broken).alias("traps_broken"), S.threshold_between(F.any_value("good_least"), F.any_value("weak_most")).alias("threshold"))
    rows = trials.join(metrics(hits.where("kind = 'good'")), "trial", "left").join(held, "trial", "left").join(traps, "trial", "left")
    key = F.concat_ws("/", *[F.regexp_replace(F.col(k).cast("string"), r"\.0$", "") for k in GRID])
    sound = F.coalesce("traps_broken", F.lit(0)) == 0
    order = Window.partitionBy(sound).orderBy(F.desc("mrr"), F.desc("p_at_1"), F.desc("held_out_mrr"), key)
    placed = rows.withColumn("place", F.when(sound, F.row_number().over(order).cast("long")))
    return placed.withColumn("recommended", F.coalesce(F.col("place") == 1, F.lit(False)))
