"""The sweep's one pass: equal to scoring everything under every trial, and no rows multiplied by trials or dealt by section."""

import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkquill.functions.sweep import Best, Sweep
from sparkquill.operators import evaluate, index, search
from sparkquill.sources.corpus import files_of, table


def test_sweep_equals_scoring_everything():
    r, words = random.Random(3), [f"w{i}" for i in range(30)]
    trials = {"heading": [3.0, 5.0, 4.0], "meta": [1.5, 3.0, 2.0], "crumb": [1.0, 2.0, 1.5], "k1": [1.0, 1.5, 1.2], "b": [0.6, 0.9, 0.75]}
    sections = []
    for file in range(700):
        for line in range(1, 1 + r.choice([1, 3, 6])):
            counts = {w: [r.choice([0, 0, 1]), 0, 0, r.choice([1, 1, 2])] for w in r.choices(words[: 4 + file % 27], k=r.randint(0, 6))}
            n = [sum(c[i] for c in counts.values()) for i in range(4)]
            sections.append((f"f{file}", r.choice(["distilled", "outputs"]), line, [n[0], 5, 1, n[3] + r.randint(0, 400)], counts))
    df = {w: sum(w in s[4] for s in sections) for w in words}
    means = [float(np.mean([s[3][i] for s in sections])) for i in range(4)]
    queries = [r.sample(words, k) for k in (1, 2, 4, 8)] + [["absent"], []]
    settings = (float(len(sections)), means, df, queries, trials, 5, 2, 120.0, 0.15, {"outputs": 0.7}, 6)

    def batch(rows):
        counts = [[{"term": w, **dict(zip("abcd", c, strict=True))} for w, c in s[4].items()] for s in rows]
        kind = pa.list_(pa.struct([("term", pa.string()), *((x, pa.int32()) for x in "abcd")]))
        columns = [pa.array([s[0] for s in rows]), pa.array([s[1] for s in rows]), pa.array([s[2] for s in rows]), *(pa.array([s[3][i] for s in rows], pa.int32()) for i in range(4)), pa.array(counts, kind)]
        return pa.RecordBatch.from_arrays(columns, names=["file_id", "zone", "line", *(f"n{i}" for i in range(4)), "counts"])

    whole, halves = Sweep(*settings), [Sweep(*settings), Sweep(*settings)]
    whole.add(batch(sections))
    for i, half in enumerate(halves):
        half.add(batch(sections[i::2]))  # a file's sections come to both
    for q, terms in enumerate(queries):
        joined = Best(3, 5, 2)
        for half in halves:
            joined.add(half.best[q].rows, half.best[q].scores)
        for t in range(3):
            weights = [trials["heading"][t], trials["meta"][t], trials["crumb"][t], 1.0]
            k1, b = trials["k1"][t], trials["b"][t]
            average, scored = np.dot(means, weights), []
            for f, zone, line, n, counts in sections:
                total, hits = 0.0, 0
                for w in sorted(x for x in terms if x in counts):
                    tf = np.dot(counts[w], weights)
                    total += math.log(1 + (len(sections) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * max(np.dot(n, weights), 120) / average))
                    hits += 1
                if hits:
                    scored.append((-math.floor(total * (1 + 0.15 * (hits - 1)) * (0.7 if zone == "outputs" else 1.0) * 1e6 + 0.5) / 1e6, f, line))
            want, of = [], {}
            for score, f, line in sorted(scored):
                of[f] = of.get(f, 0) + 1
                if of[f] <= 2 and len(want) < 5:
                    want.append((f, line, -score))
            for best in (whole.best[q], joined):
                at = sorted(np.flatnonzero(best.ranks[:, t]), key=lambda i: best.ranks[i, t])
                got = [(*best.rows[i], best.scores[i, t]) for i in at]
                assert [x[:2] for x in got] == [x[:2] for x in want]
                assert np.allclose([x[2] for x in got], [x[2] for x in want], atol=1.1e-6)


def test_trials_multiply_no_rows(spark, small, tmp_path):
    docs = table(spark, small, "documents").where("doc_id < 40")
    listed = files_of(docs).select("file_id", F.sha1("text").alias("sig"), F.lit("").alias("anchor_sig"), F.lit("").alias("sha1"))
    held = index.opened(spark, str(tmp_path / "i"), lambda: search.sections_of(docs), lambda: listed)
    fixtures = spark.createDataFrame([(1, "loser thing"), (2, "the")], "q_id long, query string")
    plan = evaluate.ranked(held, fixtures, evaluate.grid(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan and plan.count("Exchange") == 1


def test_passages_are_found_by_either_way(spark, monkeypatch):
    texts = ["x a b c d e f g y", "a b c d e f", None, "zz a b c dd", "za b cz"]
    passages = ["a b c d e f g", "a b c", "c d", "b c d e f g q"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    items = spark.createDataFrame(list(enumerate(passages)), "i int, p string")
    want = {(i, d) for i, p in enumerate(passages) for d, t in enumerate(texts) if t and p in t}
    for kept in (evaluate.KEPT_ANCHORS, 1):
        monkeypatch.setattr(evaluate, "KEPT_ANCHORS", kept)
        assert {(r["i"], r["d"]) for r in evaluate.holding(docs, "d", "t", items, "i", "p").collect()} == want
