"""Operators that no registered query applies, on small made inputs."""

import json
import plistlib

from pyspark.sql import functions as F

from sparkquill.functions import analysis, scalars
from sparkquill.functions import text as T
from sparkquill.operators import evaluate, graph, introspect, lifecycle, lint, search, sessions, structure
from sparkquill.sources import corpus, records


def values(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_structure_helpers(spark):
    row = spark.createDataFrame([("ab\ncd\nef", "# T\n## U\nbody")], "t string, b string")
    assert row.select(structure.line_of_offset(F.col("t"), F.lit(4)), structure.strip_headings(F.col("b"))).first()[:] == (2, "body")
    fm = F.create_map(F.lit("title"), F.lit("From head"))
    assert row.select(structure.title_of(F.lit(None).cast("string"), fm, F.lit("x.md"))).first()[0] == "From head"


def test_text_helpers(spark):
    row = spark.createDataFrame([("  a \n",), ("<system-reminder> x",), (None,)], "t string")
    assert [r[0] for r in row.select(T.js_trim(F.col("t"))).collect()] == ["a", "<system-reminder> x", None]
    assert [r[0] for r in row.select(T.is_tool_noise(F.col("t"))).collect()] == [False, True, False]
    assert str(spark.range(1).select(scalars.day_or_today(F.lit("2024-02-03"))).first()[0]) == "2024-02-03"


def test_analyzer_equals_the_column_functions(spark):
    texts = ["L’entreprise n'est aujourd'hui pas à l'étranger", "porte-à-porte game-dev – vis‑à‑vis", "nouveaux changements ement ÉLÉVATION x1.y2 a_b 3.14", "", None, "é" * 3 + " élévation"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    a = analysis.Analyzer(kept=3)
    for r in df.select("t", T.tokens(F.col("t")).alias("want")).collect()[:5]:
        assert a.tokens(r["t"]) == list(r["want"])
    assert a.tokens(texts[5])[-1] == a.tokens("élévation")[0]


def test_all_rows_are_numbered_in_order(spark):
    rows = spark.range(500).select((F.col("id") * 7 % 13).alias("score"), F.col("id").alias("file_id"))
    got = search.ranked_rows(rows, [("score", True)], [F.asc("file_id")]).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(-r["score"], r["file_id"]) for r in got] == sorted((-r["score"], r["file_id"]) for r in got)


def test_passages_are_found_like_by_comparing_all(spark):
    texts = ["a b c d e f g h", "x a b c d e f g", "b", "ab c", "", "bb cc dd"]
    items = ["a b c d e f g", "b", "b c", "x a b", "", "b cc d", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "d int, t string")
    want = sorted((i, d) for i, p in enumerate(items) for d, t in enumerate(texts) if p in t)
    assert values(evaluate.holding(docs, "d", "t", spark.createDataFrame(list(enumerate(items)), "i int, p string"), "i", "p"), "i", "d") == want


def test_parts_are_found_like_by_comparing_all(spark):
    texts, parts = ["raw/abcdefghij", "abc", "x", "raw/abcdefghiX"], ["abcdefghij", "abc", "raw/abcdefgh", "zz", "x", ""]
    found = lint.contained(spark.createDataFrame([(t,) for t in texts], "t string"), "t", "t", spark.createDataFrame([(p,) for p in parts], "p string"), "p")
    assert values(found) == sorted((t, p) for t in texts for p in parts if p and p in t)


def test_servers_are_listed_without_secrets(spark):
    kind = "servers map<string, struct<type: string, url: string, command: string, args: array<string>>>"
    config = spark.createDataFrame([({"a": ("http", "https://host.example/x?key=1", None, None), "b": (None, None, "node", ["/home/u/server.js", "--token"])},)], kind)
    got = values(introspect.servers(config, "user"))
    assert got == [("a", "user", "http", "host.example", ""), ("b", "user", "stdio", "", "node server.js")]
    both = introspect.servers(config, "user").unionByName(introspect.servers(config, "project"))
    assert values(introspect.first_by(both, ["name"], ["provenance"]), "name", "provenance") == [("a", "project"), ("b", "project")]
    row = spark.range(1).select(introspect.connector_name(F.lit("My – tool!")), introspect.schedule_text(F.lit(7), F.lit(5), F.lit(1)), introspect.declared_level(F.lit(False), F.lit(True))).first()
    assert row[:] == ("My_tool", "Monday at 07:05", "action")


def test_graph_documents_are_repaired(spark):
    nodes = spark.createDataFrame([("a", None, "3", None), ("a", "A", "x", None), (None, "n", "1", None)], "id string, label string, size string, ghost boolean").limit(3)
    edges = spark.createDataFrame([("a", "b"), (None, "a")], "source string, target string")
    fixed, sound = graph.normalised(nodes, edges)
    assert values(fixed, "id", "ghost") == [("a", False), ("b", True)] and sound.count() == 1


def test_new_sessions(spark):
    turns = spark.createDataFrame([("12345678-a", 1), ("87654321-b", 1)], "session string, turn int")
    assert values(sessions.new_sessions(turns, spark.createDataFrame([("12345678",)], "id8 string")), "session") == [("87654321-b",)]


def test_logs_registries_and_transcripts(spark, tmp_path):
    log = spark.createDataFrame([("t", "a\tb\nc", "low", 1, 5)], "ts string, query string, confidence string, n_results int, chars long")
    for _ in range(2):
        corpus.append_usage(log, str(tmp_path / "usage"))
    assert values(corpus.usage_log(spark, str(tmp_path / "usage")), "query", "chars") == [("a b c", 5)] * 2
    assert values(corpus.registry(spark.createDataFrame([("- 2024 raw/x.md — y raw/z",), ("none",)], "value string"))) == [("raw/x.md",)]
    lines = [{"type": "user", "message": {"content": "hi"}}, {"type": "assistant", "isMeta": True, "message": {"content": "yo"}}]
    (tmp_path / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "broken {"]))
    assert values(corpus.transcripts(spark, str(tmp_path / "t.jsonl")), "role", "is_meta", "text") == [("assistant", True, "yo"), ("user", False, "hi")]


def test_pdf_cache_misses(spark):
    files = spark.createDataFrame([("k/a.pdf", "a.pdf", "1:2"), ("k/b.pdf", "b.pdf", "1:2"), ("k/c.md", "c.md", "1:2")], "file_id string, rel string, sig string")
    cache = files.where("rel = 'a.pdf'").select(F.sha1("file_id").alias("key"), "sig")
    assert values(corpus.pdf_cache_misses(files, cache), "rel") == [("b.pdf",)]


def test_property_lists_and_skills(spark):
    data = plistlib.dumps({"Label": "nightly", "ProgramArguments": ["sh", "run.sh"], "StartCalendarInterval": {"Hour": 3, "Minute": 5}})
    got = spark.createDataFrame([(data,), (b"broken",)], "content binary").select(records.property_list(F.col("content")).alias("p")).select("p.*").collect()
    assert got[0][:] == ("nightly", "sh run.sh", 3, 5, None) and got[1]["label"] is None
    files = spark.createDataFrame([("user", "a/SKILL.md", "---\nname: one\ndescription: d1\n---\n"), ("user", "b/SKILL.md", "---\nname: one\ndescription: d2\n---\n"), ("repo", "c/SKILL.md", "no head"), ("repo", "c/other.md", "x")], "scope string, rel string, text string")
    assert values(records.skills(files), "scope", "name") == [("repo", "c"), ("user", "one")]


def test_configuration_and_file_arguments(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"sources": [{"id": "kb"}, {"id": "x", "raw": ["in"]}], "context": {"kb/": "notes"}}))
    held = corpus.config_tables(spark, str(tmp_path / "c.json"))
    assert values(held["sources"], "id", "root") == [("kb", "."), ("x", ".")]
    assert [r["raw"] for r in held["sources"].orderBy("id").collect()] == [["raw"], ["in"]]
    files = spark.createDataFrame([("kb/wiki/Élan.md", "wiki/Élan.md"), ("kb/wiki/other.md", "wiki/other.md")], "file_id string, rel string")
    for wanted, want in (("kb/wiki/other.md", "kb/wiki/other.md"), ("elan", "kb/wiki/Élan.md"), ("wiki/elan", "kb/wiki/Élan.md"), ("other.md", "kb/wiki/other.md"), ("the", "kb/wiki/other.md")):
        assert corpus.resolve_file(files, wanted).first()["file_id"] == want
    assert corpus.resolve_file(files, "nothing").count() == 0


def test_graph_is_stored_and_laid_out_from_the_last_positions(spark, tmp_path):
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "ghost:z")], "from_id string, to_id string").withColumn("broken", F.col("to_id").startswith("ghost:"))
    path = str(tmp_path / "graph")
    graph.write(nodes, edges, path)
    first = values(spark.read.parquet(path + "/nodes"), "node", "x", "y")
    assert len(first) == 5 and values(spark.read.parquet(path + "/stats"), "nodes", "ghosts", "orphans", "links", "broken") == [(4, 1, 1, 3, 1)]
    graph.write(nodes, edges, path)
    again = values(spark.read.parquet(path + "/nodes"), "node", "x", "y")
    assert len(again) == 5 and again != first  # a warm start goes on from the stored positions


def test_a_calibration_is_recorded(spark, tmp_path):
    hits = spark.createDataFrame([(0, 1, "good", 1, 20.0, 8.0), (0, 2, "weak", None, 5.0, None)], "trial int, q_id int, kind string, rank int, top1 double, top5 double")
    row = evaluate.receipt(hits, "config text", F.lit("2024-01-31").cast("timestamp")).first()
    assert (row["n"], row["mrr"], row["threshold"], row["k1"], row["heading"]) == (1, 1.0, 10.0, 1.2, 4.0) and len(row["config_sha1"]) == 40


def test_sessions_are_captured_once(spark):
    rows = [("12345678-x", i, ("user", "assistant")[i % 2], False, f"message {i}") for i in range(6)]
    rows += [("12345678-x", 6, "user", True, "meta"), ("12345678-x", 7, "user", False, "<system-reminder> noise"), ("12345678-x", 8, "user", False, "password: hunter2222"), ("short000-y", 0, "user", False, "one")]
    turns = spark.createDataFrame(rows, "session string, turn int, role string, is_meta boolean, text string")
    made = sessions.captured(turns, spark.createDataFrame([], "id8 string")).collect()
    assert [r["session"] for r in made] == ["12345678-x"] and made[0]["human"] == 4
    assert "meta" not in made[0]["text"] and "noise" not in made[0]["text"] and "hunter2222" not in made[0]["text"] and made[0]["text"].count("message") == 6
    assert made[0]["name"].endswith("12345678.md")
    assert sessions.captured(turns, spark.createDataFrame([("12345678",)], "id8 string")).count() == 0


def test_work_gate_and_cool_down(spark):
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    runs = spark.createDataFrame([("2024-01-31 01:00:00",)], "at string").select(F.col("at").cast("timestamp").alias("at"))
    assert lifecycle.cooling_down(runs, now).first()["cooling_down"] is True
    assert lifecycle.cooling_down(runs.limit(0), now).first()["cooling_down"] is False
    some, none = spark.range(3), spark.range(0)
    assert [lifecycle.work_waits(a, b).first()["work"] for a, b in ((some, none), (none, some), (none, none))] == [True, True, False]
