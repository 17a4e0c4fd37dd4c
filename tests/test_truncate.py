"""Conversations cut at the limits of the contract, on messages long enough to reach them."""

from sparkquill.plans import registry


def test_contract_limits(spark, tmp_path):
    rows = [("a", 0, "user", "x" * 3000), ("a", 1, "assistant", "y" * 3001), ("a", 2, "user", "z" * 2999)]
    rows += [("b", i, "user", "w" * 2560) for i in range(103)]
    spark.createDataFrame(rows, "conv_id string, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r["session"], r["turn"]): r["text"] for r in registry.QUERIES["session_truncate"](spark, str(tmp_path)).collect()}
    assert [got["a", i] for i in range(3)] == ["x" * 3000, "y" * 3000 + "\n[…]", "z" * 2999]
    # 100 messages are 256 000 characters; the next one passes the limit and is the last.
    assert sorted(t for s, t in got if s == "b") == list(range(101))
