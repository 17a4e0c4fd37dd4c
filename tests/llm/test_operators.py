"""The training-data operators against brute force, round trips and held-out accuracy, with the odd rows of every table."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkquill.llm import cap_filters, common, compression_quality, dart_minhash, fm_decontaminate, graph_components, labelled, prefix_targets, source_mix, token_planes, toxicity_cnn, unigram_counts, warc_store

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def odd_documents(spark):
    """Nulls, empty and long texts, repeated rows and doc_ids, columns whose names operators use themselves."""
    base = prose(1, 60)
    rows = [
        (1, base, "en", "a"), (2, base, "en", "a"), (3, base.replace("alpha", "omega", 1), "en", "b"), (4, None, "en", None), (5, "", None, ""),
        (None, prose(2, 40), "fr", "b"), (7, prose(3, 4), "xx", "b"), (7, prose(3, 4), "xx", "b"), (8, prose(4, 5000), "de", "a"), (9, "  \n\t ", "de", "c"),
        (7, "another text with the same number", "en", "a"), (10, "Ünïcödé ’quotes’ 12\n\n  two  spaces\n", "es", "c"),
    ]
    rows = [(*r, len(r[1]) if r[1] is not None else None, "x", 0.5) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, score double")


def empty_documents(spark):
    return odd_documents(spark).limit(0)


# 1


def test_decontamination_equals_brute_force(spark):
    docs = odd_documents(spark)
    base = prose(1, 60).split()
    items = [(1, " ".join(base[5:25])), (2, " ".join(base[50:53])), (10, None), (11, ""), (12, prose(99, 20)), (13, " ".join(base[:10]).upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(fm_decontaminate.brute_force([(r["doc_id"], r["text"]) for r in docs.collect()], items), key=str)
    for settings in ({}, {"block_bytes": 30}, {"shard_bytes": 100}):
        rows = fm_decontaminate.contamination_report(docs, bench, **settings)
        got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], hashlib.sha256(",".join(r["item_ids"]).encode()).hexdigest(), r["contaminated"]) for r in rows.collect()]
        assert sorted(got, key=str) == want
    assert any(x[-1] for x in want)
    assert fm_decontaminate.contamination_report(empty_documents(spark), bench).count() == 0
    assert fm_decontaminate.contamination_report(docs, bench.limit(0)).where("contaminated").count() == 0


def test_contamination_is_dropped_or_cut(spark):
    docs = odd_documents(spark)
    bench = spark.createDataFrame([(1, " ".join(prose(1, 60).split()[5:25]))], "item_id long, text string")
    hit = fm_decontaminate.contamination_report(docs, bench).where("contaminated").count()
    kept = fm_decontaminate.remove_contamination(docs, bench)
    assert kept.columns == docs.columns and kept.count() == docs.count() - hit
    cut = fm_decontaminate.remove_contamination(docs, bench, "cut")
    assert cut.count() == docs.count()
    assert fm_decontaminate.contamination_report(cut, bench).where("contaminated").count() == 0


def test_fm_index_counts_and_locates():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 4, 500)
    seq[-1] = 0
    index = fm_decontaminate.FMIndex(seq, 4)
    patterns = rng.integers(1, 4, (50, 3))
    low, high = index.ranges(patterns)
    for p, a, b in zip(patterns, low, high, strict=True):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


# 2


def test_chat_round_trip(spark):
    mark = "<|im_end|><|im_start|>assistant ok &amp; &lt;| &nl;"
    rows = [(1, 1, "user", mark), (1, 2, "assistant", mark), (1, 3, "user", None), (1, 3, "assistant", ""), (2, None, None, "a"), (2, 1, "us\ner", "b"), (None, 1, "assistant", "x" * 5000), (3, 1, "assistant", "r"), (3, 1, "assistant", "r")]
    turns = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = prefix_targets.prefix_examples(turns)
    back = {r["conv_id"]: r for r in prefix_targets.read_back(examples).collect()}
    for conv, row in back.items():
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in row["turns"]] == [(r[2] or "", r[3] or "") for r in own]
        assert row["losses"] == "".join(r[3] or "" for r in own if r[2] == "assistant")
    full = examples.collect()
    assert sum(r["loss_chars"] is not None for r in full) == sum(r[2] == "assistant" for r in rows)
    mark = lambda x: (x or "").replace("&", "&amp;").replace("<|", "&lt;|")
    for r in full:
        own = sorted((x for x in rows if x[0] == r["conv_id"]), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))[: r["n_turns"]]
        assert r["formatted"] == "".join(f"{prefix_targets.START}{mark(x[2]).replace(chr(10), '&nl;')}\n{mark(x[3])}{prefix_targets.END}" for x in own)
        if r["loss_chars"] is not None:
            assert r["formatted"][r["loss_begin"] : r["loss_begin"] + r["loss_chars"]] == mark(own[-1][3]) and own[-1][2] == "assistant"
    for conv, row in back.items():
        assert row["formatted_chars"] == sum(len(r["formatted"]) for r in full if r["conv_id"] == conv)
    assert prefix_targets.read_back(prefix_targets.prefix_examples(turns.limit(0))).count() == 0


def test_chat_plan_has_no_python(spark, small):
    plan = prefix_targets.op2_prefix_targets(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# 3 and 6


def labelled_corpus(spark, good, bad):
    rows, labels = [], []
    for i in range(300):
        y = i % 2
        text = prose(1000 + i, 40) + (good if y else bad)(i)
        rows.append((i, text, ("en", "fr")[i % 3 == 0], "s", len(text)))
        labels.append((i, y, y))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_and_scores_everything(spark):
    docs, labels = labelled_corpus(spark, lambda i: f" you idiot {i} ", lambda i: f" you friend {i} ")
    model = toxicity_cnn.train(docs, labels)
    rows = toxicity_cnn.score(docs, model).join(labels, "doc_id").where(labelled.fold("doc_id", 5) == 0).collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in rows]) > 0.9
    odd = odd_documents(spark)
    scores = [r["score"] for r in toxicity_cnn.score(odd, model).collect()]
    assert len(scores) == odd.count() and all(0 <= s <= 1 for s in scores)
    assert toxicity_cnn.reject_toxic(odd, model).columns == odd.columns
    assert toxicity_cnn.score(empty_documents(spark), model).count() == 0
    none = toxicity_cnn.train(docs, labels.limit(0))
    assert {r["score"] < 0.5 for r in toxicity_cnn.score(odd, none).collect()} == {True}


def test_held_out_labels_do_not_matter(spark):
    docs, labels = labelled_corpus(spark, lambda i: " idiot ", lambda i: " friend ")
    flipped = labels.withColumn("toxic", F.when(labelled.fold("doc_id", 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity_cnn.score(docs, toxicity_cnn.train(docs, x)).collect()} for x in (labels, flipped))
    assert a == b


@pytest.mark.parametrize("shard_rows", [100_000, 2_000, 300])
def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch, shard_rows):
    """Of 3 000 rows of each class, the last thousand by hash have words of their own."""
    monkeypatch.setattr(toxicity_cnn, "SHARD_ROWS", shard_rows, raising=False)
    ids = spark.range(7_500).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), (labelled.fold("id", 5) == 0).alias("held"))
    rows = ids.orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    seen, texts = {0: 0, 1: 0}, []
    for r in rows:
        seen[r["toxic"]] += not r["held"]
        late = r["doc_id"] % 3 == 0 if r["held"] else seen[r["toxic"]] > 2_000
        word = (("friend", "dear"), ("idiot", "moron"))[r["toxic"]][late]
        texts.append((r["doc_id"], f"{prose(r['doc_id'], 6)} {word} {prose(r['doc_id'] + 1, 3)}", "en", r["toxic"], r["held"], late))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, toxic int, held boolean, late boolean")
    model = toxicity_cnn.train(docs.select("doc_id", "text", "lang"), docs.select("doc_id", "toxic"))
    held = toxicity_cnn.score(docs, model).join(docs.where("held and late"), "doc_id").collect()
    assert len(held) > 300
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.95


def test_toxicity_counts_every_row_once(spark, monkeypatch):
    """Counts, curve and thresholds that shards add up are those of all rows, however the table is dealt."""
    docs, labels = labelled_corpus(spark, lambda i: " you idiot " * (i % 5 > 0), lambda i: " you friend " * (i % 7 > 0))
    monkeypatch.setattr(toxicity_cnn, "SHARD_ROWS", 20, raising=False)
    odd = spark.createDataFrame([(9_001, None, "en", "s", 0), (9_002, "", None, "s", 0), (9_003, "word " * 20_000, "", "s", 0)], docs.schema)
    docs, labels = docs.union(odd).union(docs.limit(3)), labels.union(spark.createDataFrame([(i, 1, i % 2) for i in (9_001, 9_002, 9_003)], labels.schema))
    usable = toxicity_cnn.usable_labels(labels, "toxic")
    rows = toxicity_cnn.training_rows(docs, usable, 7)
    counts = {(r["what"], r["item"]): r["n"] for r in toxicity_cnn.write_shards(rows, common.new_folder(spark, "test-shards")).collect()}
    want = collections.Counter(r["label"] for r in docs.join(usable, "doc_id").collect())
    n_docs = collections.Counter(w for r in rows.collect() for w in set(toxicity_cnn._from_bytes([r["slots"]]).tolist()))
    assert {k: n for k, n in counts.items() if k[0] == "word"}.keys() <= {("word", w) for w in n_docs}
    assert len({k for k in counts if k[0] == "shard"}) == 7
    assert {k: counts["trains", k] + counts["calibrates", k] for k in (0, 1)} == want
    assert all(abs(counts["calibrates", k] - want[k] / 4) <= 7 for k in (0, 1))
    a, b = (toxicity_cnn.train(x, labels) for x in (docs, docs.repartition(5)))
    assert np.array_equal(a.embedding, b.embedding) and (a.slope, a.intercept, a.thresholds) == (b.slope, b.intercept, b.thresholds)
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=500), rng.integers(0, 2, 500)
    scale = max(np.abs(x).std(), np.abs(x).mean())
    parts = np.array_split(np.arange(500), 7)
    theta = labelled.newton(lambda at: tuple(sum(s) for s in zip(*(labelled.platt_sums(x[p] / scale, y[p], np.ones(len(p)), at) for p in parts), strict=True)))
    assert np.allclose(labelled.platt(x, y, np.ones(500)), (theta[0] / scale, theta[1]))
    scores = rng.random(500)
    n_passed = np.zeros((2, len(toxicity_cnn.GRID) + 1), np.int64)
    np.add.at(n_passed, (y, np.searchsorted(toxicity_cnn.GRID, scores, "right")), 1)
    wrong = {t: ((scores >= t) != (y == 1)).sum() for t in toxicity_cnn.GRID}
    assert wrong[toxicity_cnn.best_threshold(n_passed)] == min(wrong.values())


def test_quality_learns_and_scores_everything(spark):
    docs, labels = labelled_corpus(spark, lambda i: " plain words of the same kind " * 4, lambda i: " CLICK!!! $$$ ### buy|buy|now " * 4)
    model = compression_quality.train(docs, labels)
    rows = compression_quality.score(docs, model).join(labels, "doc_id").where(labelled.fold("doc_id", 4) == 2).collect()
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in rows]) > 0.9
    odd = odd_documents(spark)
    assert all(0 <= r["score"] <= 1 for r in compression_quality.score(odd, model).collect())
    flat = compression_quality.train(docs, labels.limit(0))
    assert {r["score"] for r in compression_quality.score(odd, flat).collect()} == {0.5}


# 4


def test_token_counts_equal_brute_force(spark):
    path = unigram_counts.default_model()
    pieces = unigram_counts.PieceTable(path)
    docs = odd_documents(spark)
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in unigram_counts.token_counts(docs, path).collect()), key=str)
    assert got == sorted(((r["doc_id"], *unigram_counts.brute_force(r["text"], pieces)) for r in docs.collect()), key=str)
    assert unigram_counts.token_counts(empty_documents(spark), path).count() == 0


def test_prefixes_are_computed_once():
    counter = unigram_counts.TrieCounter(unigram_counts.PieceTable(unigram_counts.default_model()))
    counter.count(["internet international inter"])
    assert counter.made == len("\u2581international") + len("et")
    before = counter.made
    counter.count(["internet inter internat"])
    assert counter.made == before
    deep = "x" * (unigram_counts.DEEPEST + 5)
    first = counter.count([deep + " " + deep + "y"])
    assert len(counter.best) < before + unigram_counts.DEEPEST + 2
    assert counter.count([deep + " " + deep + "y"]) == first
    assert first[1] == [sum(unigram_counts.brute_force(x, counter.pieces)[1] for x in (deep, deep + "y"))]


def test_a_new_trie_gives_the_same_counts():
    pieces = unigram_counts.PieceTable(unigram_counts.default_model())
    texts = [prose(k, 30) for k in range(20)]
    small, large = (unigram_counts.TrieCounter(pieces, kept) for kept in (50, 10**9))
    assert [small.count([x]) for x in texts] == [large.count([x]) for x in texts]


def test_token_counts_equal_the_unigram_model_of_the_library():
    """The library's own unigram model over the same log probabilities; words with several best segmentations may differ."""
    from tokenizers import Tokenizer, models

    pieces = unigram_counts.PieceTable(unigram_counts.default_model())
    assert abs(sum(np.exp(list(pieces.scores.values()))) - 1) < 1e-9
    library = Tokenizer(models.Unigram([("<unk>", min(pieces.scores.values()) - 20), *pieces.scores.items()], 0, False))
    counter = unigram_counts.TrieCounter(pieces)
    words = sorted({w for k in range(40) for w in prose(k, 60).split()} | set("international Verantwortung déjà responsabilité l'entreprise x1.y2 (hello), aaaa".split()))
    differ = [w for w in words if counter.count([w])[1] != [len(library.encode("\u2581" + w).ids)]]
    assert len(differ) <= len(words) // 50


# 5


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_token_files_round_trip(spark, planes):
    from tokenizers import Tokenizer

    path = token_planes.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    docs = odd_documents(spark)
    rows = token_planes.token_files(docs, path, planes, 100).collect()
    want = {}
    for r in docs.collect():
        ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.setdefault(r["doc_id"], []).append((len(ids), zlib.crc32(ids.tobytes())))
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["n_tokens"], r["ids_crc32"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    at = 0
    for r in sorted(rows, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert token_planes.token_files(empty_documents(spark), path).count() == 0


@pytest.mark.parametrize("special_as_text", [False, True])
def test_encoder_equals_the_library(special_as_text):
    """Special tokens' strings give their ids, as in the library as loaded, or those of ordinary text."""
    from tokenizers import Tokenizer

    path = token_planes.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = special_as_text
    encode, rng = token_planes.UnitEncoder(path, 50, special_as_text), random.Random(3)
    bits = ["hello", "<|endoftext|>", " ", "\n", "  ", "world,", "é", "\t", "<|end", "oftext|>", "9", "!", "\u00a0", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(10)))
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    if not special_as_text:
        assert np.frombuffer(encode("hello <|endoftext|> world"), "<u4").tolist() == [31373, 220, 50256, 995]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_and_ranges(tmp_path, planes):
    from pyarrow import fs

    ids = np.random.default_rng(0).integers(0, 50257, 1000).astype("<u4")
    assert (token_planes.join_planes(token_planes.split_planes(ids[:37], planes), 37, planes) == ids[:37]).all()
    store = fs.LocalFileSystem()
    with store.open_output_stream(str(tmp_path / "x")) as out:
        writer = token_planes.ShardWriter(out, planes, 64)
        for i in range(0, 1000, 10):
            writer.add(i, ids[i : i + 10].tobytes())
        writer.close()
    with store.open_input_file(str(tmp_path / "x")) as file:
        reader = token_planes.ShardReader(file)
        assert (reader.ids(130, 515) == ids[130:515]).all()
        assert len(reader.ids(5, 5)) == 0
        assert [x[3] for x in reader.stream()] == [zlib.crc32(ids[i : i + 10].tobytes()) for i in range(0, 1000, 10)]


def test_units_do_not_change_ids():
    encode = token_planes.UnitEncoder(token_planes.default_tokenizer(), 50)
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["ab", "é", " ", "  ", "\n", "\n\n", "\t", "don't", "'s", ".", ",", "12", "ß", " ", "日本", "x!"]) for _ in range(rng.randrange(12)))
        assert encode(text) == encode.encode(text), repr(text)


# 7


def test_cap_filters_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    vectors = [c + 0.05 * rng.normal(size=16) for c in centres for _ in range(8)]
    rows = [(i, [float(x) for x in v.astype(np.float32)], i // 120) for i, v in enumerate(vectors)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 1), (902, None, 0), (903, [0.0] * 16, 0), (904, [float("nan")] * 16, 0), (905, rows[0][1], None), (906, [1.0, 2.0], 0), (907, [None] * 16, 0), (908, [], 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, key string")
    links = {r[0]: set() for r in rows}
    sound = [r for r in rows if r[0] < 902]
    unit = np.array([r[1] for r in sound])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    for i, j in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True):
        if i != j and sound[i][2] == sound[j][2]:
            links[sound[i][0]].add(sound[j][0])
    group = {k: k for k in links}
    for _ in links:
        group = {k: min([group[k], *(group[x] for x in v)]) for k, v in links.items()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cap_filters.linked(table).collect()}
    assert got == {k: (len(v), group[k]) for k, v in links.items()}
    assert cap_filters.linked(table.limit(0)).count() == 0


def test_cap_filters_tiles(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = rng.normal(size=8)
    rows = [(i, [float(x) for x in v + 0.02 * rng.normal(size=8)], 0) for i in range(60)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    whole = sorted(map(tuple, cap_filters.linked(table).collect()))
    monkeypatch.setattr(cap_filters, "TILE", 7)
    assert sorted(map(tuple, cap_filters.linked(table).collect())) == whole


@pytest.mark.parametrize("largest", [218, 20_000, 300_000, 3_000_000])
def test_cap_filters_leave_no_pair_apart(largest):
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(2, 1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.98 * a + (1 - 0.98**2) ** 0.5 * b / np.linalg.norm(b, axis=1, keepdims=True)
    code = cap_filters.CapFilters.build(64, largest)
    x, y = code.decode(a), code.decode(b)
    assert x.shape == (1500, cap_filters.CAPTURES)
    assert (x[:, :, None] == y[:, None, :]).any(axis=(1, 2)).all()


def test_cap_filters_are_the_nearest_directions():
    code = cap_filters.CapFilters([np.random.default_rng(k).normal(size=(6, 5)) for k in range(3)], 10)
    unit = np.random.default_rng(8).normal(size=(40, 5))
    first, second, third = (unit @ b.T for b in code.books)
    sums = (first[:, :, None, None] + second[:, None, :, None] + third[:, None, None, :]).reshape(40, -1)
    assert (code.decode(unit) == np.sort(np.argsort(-sums, axis=1)[:, :10], axis=1)).all()


def test_cap_filters_link_every_pair(spark):
    rng = np.random.default_rng(9)
    a = rng.normal(size=(700, 64))
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([a, a + 0.18 * rng.normal(size=a.shape)]))]
    unit = np.array([r[1] for r in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = cap_filters.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert want.sum() > 1000
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want))


def test_cap_filters_of_odd_ids_and_sizes(spark):
    a, b = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [(None, a, 0), (None, b, 0), (5, a, 0), (5, [x * 1e250 for x in a], 0), (7, [x * 1e-250 for x in a], 0), (8, a, 1), (9, [-0.0, 1.0, 0.0], 2), (10, [0.0, 1.0, 0.0], 2)]
    got = cap_filters.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [(None, 3, 5), (None, 0, None), (5, 3, 5), (5, 3, 5), (7, 3, 5), (8, 0, 8), (9, 1, 9), (10, 1, 9)]))


def test_whole_groups_across_batches():
    group = [0] * 5 + [1] * 9 + [2] + [3] * 4
    rows = pa.RecordBatch.from_pydict({"group": group, "row": list(range(len(group)))})
    for size in (1, 2, 3, 7, 30):
        found = []
        for batch, ends in cap_filters._whole_groups((rows.slice(i, size) for i in range(0, len(group), size)), 1):
            assert ends[-1] == batch.num_rows
            found += [batch.column(1)[a:b].to_pylist() for a, b in zip(ends, ends[1:], strict=False)]
        assert found == [[i for i, g in enumerate(group) if g == k] for k in range(4)]


# 8


@pytest.mark.parametrize("weights", ["set", "count"])
def test_near_duplicates_equal_brute_force(spark, weights, monkeypatch):
    monkeypatch.setattr(dart_minhash, "TILE", 5)
    rng = random.Random(2)
    texts = []
    for k in range(6):
        base = prose(200 + k, 120).split()
        for _ in range(9):
            own = list(base)
            for _ in range(rng.randrange(5)):
                own[rng.randrange(len(own))] = f"edit{rng.randrange(1000)}"
            texts.append(" ".join(own) + (" tail" * 40 if weights == "count" else ""))
    texts += [None, "", "one two", "one two", "ONE, two!", "one", prose(1, 3000)]
    docs = spark.createDataFrame([(i, x, "en", "s", 0) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["component_id"] for r in dart_minhash.near_duplicates(docs, weights).collect()}
    assert got == dict(enumerate(dart_minhash.brute_force(texts, weights)))
    kept = dart_minhash.deduplicated(docs, weights)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, v in got.items() if k == v}


def test_near_duplicates_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = dart_minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1}
    kept = dart_minhash.deduplicated(docs)
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 4, 5, 7, 7, 8, 9, 10]
    assert dart_minhash.near_duplicates(empty_documents(spark)).count() == 0


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    a, b = rng.uniform(0.2, 3, 300), rng.uniform(0.2, 3, 300)
    element = np.tile(rng.integers(0, 1 << 60, 300).astype(np.uint64), 2)
    got = dart_minhash.darts(np.repeat([0, 1], 300), element, np.concatenate([a, b]), 2, 4000)
    assert abs((got[0] == got[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(1000 + i, 1001 + i) for i in range(25)]
    up = {x: x for e in edges for x in e}
    for _ in up:
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    got = {r["node"]: r["root"] for r in graph_components.components(spark.createDataFrame(edges, "a long, b long"), one_task).collect()}
    assert got == {x: r for x, r in up.items() if any(x in e and e[0] != e[1] for e in edges)}


# 9


def test_warc_round_trip(spark):
    rows = [(3, "http://a/\r\nX: y", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, None), (5, "http://c", ""), (None, "http://d", "é\r\n\r\nx"), (7, "u", "é" * 70_000), (7, "u", "é" * 70_000)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    folder = common.new_folder(spark, "warc-test")
    index = warc_store.write_archives(pages, folder, 2000)
    got = warc_store.read_records(index, folder).collect()
    assert len(got) == len(rows)
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert by[3, "revisit"]["refers_to"] == 1 and by[1, "response"]["refers_to"] is None
    assert by[5, "revisit"]["refers_to"] == 2 and by[2, "response"]["payload"] == b""
    assert by[None, "response"]["payload"] == "é\r\n\r\nx".encode()
    assert by[7, "response"]["payload_bytes"] == 140_000
    some = warc_store.read_records(index.where("page_id = 7"), folder)
    assert {r["page_id"] for r in some.collect()} == {7}
    assert warc_store.read_records(warc_store.write_archives(pages.limit(0), folder + "-none"), folder + "-none").count() == 0


def test_ranges_are_coalesced():
    reads = warc_store.coalesced([(0, 10), (12, 10), (1000, 5), (1005, 5)], gap=5, most=100)
    assert [(a, b, len(m)) for a, b, m in reads] == [(0, 22, 2), (1000, 1010, 2)]


# 10


def test_targets():
    assert source_mix.targets([100, 100, 100], [1, 2, 3]) == [50.0, 100.0, 150.0]
    got = source_mix.targets([1000, 10, 1], [1, 2, 3])
    assert got == [978.0, 30.0, 3.0]
    assert source_mix.targets([], []) == [] and source_mix.targets([0, 5], [1, 2]) == [0.0, 5.0]


@pytest.mark.parametrize("n", [1, 2, 3, 64, 1000])
def test_permutation(n):
    p = source_mix.Permutation(n, 99)
    out = p(np.arange(n))
    assert sorted(out.tolist()) == list(range(n))
    assert all(p.inverse(int(out[i])) == i for i in range(n))


@pytest.mark.parametrize("block", [1, 7, 256])
def test_mix_of_odd_rows(spark, block):
    docs = odd_documents(spark)
    mixed = source_mix.mix(docs, block=block, shard_slots=3)
    rows = source_mix.taken(mixed).collect()
    assert len(rows) == docs.count()
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    sums = {}
    for r in rows:
        size, target, took = sums.get((r["source_size"], r["target"]), (0, r["target"], 0))
        sums[r["source_size"], r["target"]] = (size + r["size"], target, took + r["taken"])
    assert all(abs(took - target) <= 1 for _, target, took in sums.values())
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, source_mix.taken(source_mix.mix(docs, block=block, shard_slots=3)).collect()), key=str)
    with pytest.raises(ValueError):
        source_mix.mixed_documents(docs, mixed)
    whole = source_mix.mix(docs, block=block, shard_slots=3, whole_rows=True)
    assert sorted(map(tuple, source_mix.taken(whole).collect()), key=str) == sorted(map(tuple, rows), key=str)
    out = source_mix.mixed_documents(docs, whole)
    assert out.columns == docs.columns
    words = sum(len(source_mix._WORD.findall(r["text"])) for r in out.collect())
    assert words == sum(r["taken"] for r in rows)
    assert source_mix.taken(source_mix.mix(empty_documents(spark))).count() == 0
    assert source_mix.mixed_documents(empty_documents(spark), source_mix.mix(empty_documents(spark), whole_rows=True)).count() == 0


def test_mixed_rows_keep_their_own_columns(spark):
    """Rows that repeat doc_id, text and source: each keeps its other columns, and equal rows are not multiplied."""
    rows = [(1, "one two three four", "s", k) for k in (10, 11, 12)] + [(2, "five six", "s", 20)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumn("mark", F.col("n_chars") * 7)
    out = source_mix.mixed_documents(docs, source_mix.mix(docs, block=2, whole_rows=True)).collect()
    assert sorted((r["doc_id"], r["text"], r["mark"]) for r in out) == [(1, "one two three four", 70), (1, "one two three four", 77), (1, "one two three four", 84)] + [(2, "five six", 140)] * 3


@pytest.mark.parametrize("shard_slots", [1, 3, 4096])
def test_draws_add_up_and_tasks_agree(shard_slots):
    counts = np.array([500, 0, 7, 40])
    shards = -(-int(counts.sum()) // shard_slots)
    whole = list(source_mix.draw(counts, shard_slots, 5, 0, shards))
    assert [s for s, _, _ in whole] == list(range(shards))
    assert (sum(n for _, _, n in whole) == counts).all()
    done = np.zeros(4, np.int64)
    for _, first, n in whole:
        assert (first == done).all() and n.sum() == min(shard_slots, counts.sum() - done.sum())
        done = done + n
    parts = [x for k in range(0, shards, 8) for x in source_mix.draw(counts, shard_slots, 5, k, k + 8)]
    assert all(a == x and (b == y).all() and (c == z).all() for (a, b, c), (x, y, z) in zip(whole, parts, strict=True))
