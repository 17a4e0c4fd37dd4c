"""The whole sweep: ranking and traps by hand, and all trials of the grid on the smallest tables."""

import duckdb

from sparkquill.operators import evaluate
from sparkquill.plans import registry


def test_traps_and_order(spark):
    trials = evaluate.grid(spark, {"heading": (3.0,), "meta": (2.0,), "crumb": (1.0, 1.5), "k1": (1.2,), "b": (0.6, 0.75, 0.9)})
    rows = []
    for trial, (trap, held, weak, navigational) in enumerate([(1, 2, 1.0, None), (1, 2, 9.0, None), (2, 1, 1.0, None), (1, 2, 1.0, None), (1, 2, 1.0, 1), (1, None, 1.0, None)]):
        rows += [(trial, 1, trap, 5.0, None, "good", False, True, 1, navigational), (trial, 2, held, 6.0, None, "good", True, False, None, None), (trial, 3, None, weak, None, "weak", False, False, None, None)]
    hits = spark.createDataFrame(rows, "trial int, q_id long, rank int, top1 double, top5 double, kind string, held_out boolean, trap boolean, rank_max int, navigational long")
    got = {r["trial"]: r for r in evaluate.tuned(hits, trials).collect()}
    assert [got[i]["traps_broken"] for i in range(6)] == [0, 1, 1, 0, 1, 0]
    # "1.5/" comes before "1/" in a key
    assert [got[i]["place"] for i in range(6)] == [2, None, None, 1, None, 3]
    assert [got[i]["recommended"] for i in range(6)] == [False, False, False, True, False, False]
    assert [got[i]["mrr"] for i in (0, 5)] == [0.75, 0.5]
    assert [got[i]["held_out_mrr"] for i in (0, 2, 5)] == [0.5, 1.0, 0.0]
    assert got[0]["threshold"] == 2.24


def test_all_trials(spark, small):
    rows = registry.QUERIES["tune_grid_full"](spark, small).collect()
    assert len({(r["heading"], r["meta"], r["crumb"], r["k1"], r["b"]) for r in rows}) == len(rows) == 243
    found = {r["trial"]: r for r in rows}
    duck = duckdb.connect()
    for t in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    plain = duck.execute(registry.ORACLES["tune_grid"]).df().to_dict("records")
    assert len(plain) == 243
    for r in plain:
        assert [r[k] for k in ("n", "p_at_1", "p_at_5", "mrr")] == [found[r["trial"]][k] for k in ("n", "p_at_1", "p_at_5", "mrr")]
