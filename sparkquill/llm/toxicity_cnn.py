"""Toxicity: a convolutional text classifier trained in numpy.

Words (as in the decontamination operator: A-Z lower-cased, split at other ASCII characters) are
hashed to SLOTS; slots that the network's rows use in two documents or more have an embedding, all
others the zero vector. Filters of several widths run over a document's words, each filter's largest
activation is kept, and a logistic layer on these makes the score, whatever the text's length. A
logistic curve fitted to training rows that the network has not seen calibrates it.

Every document with a label outside the held-out fold is learned from: three quarters of each class
train the network, the others calibrate it. Rows are dealt by doc_id to shards, files of slots in the
shared folder. In each epoch a task per shard trains on its whole shard, from the state that all start
with; then the states are averaged: layers by rows, a word's vector by the batches that changed it.
Counts of words, the curve and the thresholds are sums over all shards. Shards and their order depend
on the rows alone, so reruns agree.

Thresholds are calibrated by language on the same rows: the score is independent of lang, only the
decision `flagged` compares it with the threshold of the document's language.

Defined results: null and empty texts are scored as the padding alone; without labels of both classes
every score is the share of label 1 (0 without any); a null, empty or unknown lang has the threshold
0.5; each row is scored and, if labelled, learned from, repeated or not, once with each label of its
doc_id; other columns are ignored (or passed on by reject_toxic).
"""

from __future__ import annotations

import copy
import io
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import labelled
from sparkquill.llm.common import new_folder, open_store, table, text_chunks
from sparkquill.llm.fm_decontaminate import words_of

SLOTS = 1 << 21
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
#: Labelled rows of a shard, about; every shard is read in every epoch, a quarter of it calibrates.
SHARD_ROWS = 8192
EPOCHS = 8
BATCH = 32
#: Words whose activations are computed at once (or one text), states that are added up at once, tasks of a light pass.
PIECE = 1 << 18
FAN_IN = 16
LIGHT_TASKS = 32
#: The map of labelled doc_ids has 2 to this power bits at most.
MOST_BITS = 26
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: A language's threshold stays within these, and is 0.5 for languages with fewer rows of a class.
THRESHOLD_RANGE = (0.3, 0.7)
GRID = np.round(np.arange(THRESHOLD_RANGE[0], THRESHOLD_RANGE[1] + 0.005, 0.01), 2)
LEAST_ROWS = 20
CHUNK = 4 << 20


def slots_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hash slots of all words in order, and the words of each text."""
    words = [words_of(x) for x in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    hashes = np.fromiter(map(zlib.crc32, chain.from_iterable(words)), np.uint32, int(sizes.sum()))
    return (hashes % SLOTS).astype(np.int64), sizes


def padded(rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers with zeros of the widest filter's size after each text, and where texts begin."""
    pad = max(WIDTHS)
    starts = np.concatenate([[0], np.cumsum(sizes + pad)])
    out = np.zeros(starts[-1] + pad, rows.dtype)
    out[np.arange(len(rows)) + np.repeat(pad * np.arange(len(sizes)), sizes)] = rows
    return out, starts[:-1]


@dataclass
class ToxicityModel:
    row_of: np.ndarray  # slot to row of the embedding; 0 is the zero vector
    embedding: np.ndarray
    filters: dict[int, np.ndarray]  # width to (width, DIM, FILTERS)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    out_bias: float
    slope: float = 1.0
    intercept: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def activations(self, rows: np.ndarray, width: int, vectors: np.ndarray) -> np.ndarray:
        n = len(rows) - max(WIDTHS)
        total = vectors[:n] @ self.filters[width][0]
        for j in range(1, width):
            total += vectors[j : n + j] @ self.filters[width][j]
        return total + self.bias[width]

    def pooled(self, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
        vectors = self.embedding[rows]
        return np.concatenate([np.maximum(np.maximum.reduceat(self.activations(rows, w, vectors), starts, axis=0), 0) for w in WIDTHS], axis=1)

    def raw(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        slots, sizes = slots_of(texts)
        return self.raw_rows(self.row_of[slots], sizes)

    def raw_rows(self, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return self.pooled(*padded(rows, sizes)) @ self.out + self.out_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return labelled.logistic(self.slope * self.raw(texts).astype(np.float64) + self.intercept)


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0.0, rate

    def step(self, value: np.ndarray, gradient: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.001 * (gradient * gradient - self.v)
        value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


class Trainer:
    """The network and the state of its optimisers. Only the place of each filter's maximum in each text gets a gradient."""

    def __init__(self, used: np.ndarray, class_weight: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        row_of = np.zeros(SLOTS, np.int32)
        row_of[used] = np.arange(1, len(used) + 1)
        filters = {w: rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS}
        embedding = rng.normal(0, 0.1, (len(used) + 1, DIM)).astype(np.float32)
        embedding[0] = 0
        width_total = FILTERS * len(WIDTHS)
        self.model = ToxicityModel(row_of, embedding, filters, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, rng.normal(0, 0.3, width_total).astype(np.float32), 0.0)
        self.class_weight, self.out_bias = class_weight, np.zeros(1, np.float32)
        self.adams = {("f", w): _Adam(filters[w].shape, 0.01) for w in WIDTHS} | {("b", w): _Adam(FILTERS, 0.01) for w in WIDTHS} | {"out": _Adam(width_total, 0.01), "bias": _Adam(1, 0.01)}
        self.squares = np.full(len(embedding), 1e-6, np.float32)  # Adagrad by row: a batch touches few
        self.touches = np.zeros(len(embedding), np.float32)
        self.seen = 0

    def layers(self) -> list[np.ndarray]:
        """All arrays that every batch changes; they are views."""
        moments = [x for k in self.adams for x in (self.adams[k].m, self.adams[k].v)]
        return [*self.model.filters.values(), *self.model.bias.values(), self.model.out, self.out_bias, *moments]

    def windows(self, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Pooled activations of some texts, and by width the rows (width, text, filter) under each filter's maximum."""
        kept, under = [], {w: [] for w in WIDTHS}
        bounds, begin = np.concatenate([[0], np.cumsum(sizes)]), 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + PIECE, "right")) - 1)
            part, starts = padded(rows[bounds[begin] : bounds[end]], sizes[begin:end])
            vectors, ends, values = self.model.embedding[part], np.append(starts[1:], len(part) - max(WIDTHS)), []
            for w in WIDTHS:
                act = self.model.activations(part, w, vectors)
                best = np.stack([a + act[a:b].argmax(0) for a, b in zip(starts, ends, strict=True)])
                values.append(np.maximum(np.take_along_axis(act, best, 0), 0))
                under[w].append(np.stack([part[best + j] for j in range(w)]))
            kept.append(np.concatenate(values, axis=1))
            begin = end
        return np.concatenate(kept), {w: np.concatenate(x, axis=1) for w, x in under.items()}

    def step(self, rows: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> None:
        model = self.model
        h, under = self.windows(rows, sizes)
        p = labelled.logistic(h @ model.out + self.out_bias)
        error = (self.class_weight[y] * (p - y) / len(y)).astype(np.float32)
        back = error[:, None] * model.out * (h > 0)
        self.adams["out"].step(model.out, h.T @ error + 1e-4 * model.out)
        self.adams["bias"].step(self.out_bias, np.array([error.sum()], np.float32))
        touched, gradients = [], []
        for i, w in enumerate(WIDTHS):
            g = back[:, i * FILTERS : (i + 1) * FILTERS]  # (texts, filters)
            df = np.zeros_like(model.filters[w])
            for j in range(w):
                df[j] = np.einsum("tfd,tf->df", model.embedding[under[w][j]], g)
                touched.append(under[w][j].ravel())
                gradients.append((g[:, :, None] * model.filters[w][j].T[None]).reshape(-1, DIM))
            self.adams["f", w].step(model.filters[w], df)
            self.adams["b", w].step(model.bias[w], g.sum(0))
        where, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        total = np.zeros((len(where), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(gradients))
        total[where == 0] = 0
        self.squares[where] += (total * total).mean(1)
        self.touches[where] += 1
        model.embedding[where] -= 0.05 * total / np.sqrt(self.squares[where])[:, None]

    def epoch(self, chunks: Iterator[pa.RecordBatch], seed: list[int]) -> None:
        """One pass over the rows of a shard that do not calibrate, in an order of its own within each chunk."""
        rng = np.random.default_rng(seed)
        for chunk in chunks:
            rows, sizes, y, calibrates, _ = _unpacked(chunk, self.model.row_of)
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            order = rng.permutation(np.flatnonzero(~calibrates))
            for k in range(0, len(order), BATCH):
                some = order[k : k + BATCH]
                self.step(np.concatenate([rows[bounds[i] : bounds[i + 1]] for i in some]), sizes[some], y[some])
            self.seen += len(order)

    def changes(self, start: Trainer) -> dict[str, np.ndarray]:
        """What an epoch adds to the sums from which all shards' mean state is taken."""
        where = np.flatnonzero(self.touches)
        moved = np.column_stack([self.model.embedding[where] - start.model.embedding[where], self.squares[where] - start.squares[where], np.ones(len(where), np.float32)])
        layers = np.concatenate([x.ravel() for x in self.layers()]).astype(np.float64)
        steps = [self.adams["bias"].t]
        return {"where": where.astype(np.int32), "moved": moved * self.touches[where][:, None], "layers": self.seen * np.concatenate([layers, steps, [1.0]])}

    def move(self, sums: dict[str, np.ndarray]) -> None:
        where, moved = sums["where"], sums["moved"]
        self.model.embedding[where] += moved[:, :DIM] / moved[:, -1:]
        self.squares[where] += moved[:, DIM] / moved[:, -1]
        mean, place = sums["layers"] / max(sums["layers"][-1], 1.0), 0
        for x in self.layers():
            x[...] = mean[place : place + x.size].reshape(x.shape)
            place += x.size
        for adam in self.adams.values():
            adam.t = float(mean[place])


def _bytes(slots: np.ndarray) -> np.ndarray:
    """Three bytes a slot, lowest first."""
    return np.ascontiguousarray(slots.astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3])


def _from_bytes(parts: list[bytes]) -> np.ndarray:
    found = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, 3)
    slots = np.zeros((len(found), 4), np.uint8)
    slots[:, :3] = found
    return slots.view("<i4").ravel()


def _unpacked(chunk: pa.RecordBatch, row_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Embedding rows of all words, words a text, labels, whether a text calibrates, langs."""
    slots = chunk.column("slots").to_pylist()
    sizes = np.fromiter(map(len, slots), np.int64, len(slots)) // 3
    return row_of[_from_bytes(slots)], sizes, chunk.column("label").to_numpy(), chunk.column("calibrates").to_numpy(zero_copy_only=False), chunk.column("lang").to_pylist()


def _put(store, path: str, write: Callable) -> None:
    """A file of the shared folder, written under another name first, so that a lost task only costs a rerun."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, path)


def _batches(store, path: str) -> Iterator[pa.RecordBatch]:
    """The record batches of a file, none if no task wrote it."""
    if store.get_file_info(path).is_file:
        with store.open_input_stream(path) as file, pa.ipc.open_stream(file) as reader:
            yield from reader


def _tasks(spark: SparkSession, n: int, work: Callable[[int], np.ndarray], tasks: int | None = None) -> list[np.ndarray]:
    """Arrays of work(0), ..., work(n - 1), done by tasks, in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.asarray(work(i), np.float64).tobytes()])], names=["id", "result"])

    rows = spark.range(0, n, 1, min(n, tasks or n)).mapInArrow(run, "id long, result binary").collect()
    return [np.frombuffer(r["result"]) for r in sorted(rows)]


def usable_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label, where there are both and the row is outside the held-out fold."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (labelled.fold("doc_id", FOLDS) != HELD_OUT))
    return usable.select("doc_id", F.col(label).cast("int").alias("label"))


def _bit(size: int):
    """The bit of a doc_id in a map of that size, from 1."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(size)) + 1


def label_bits(usable: DataFrame, size: int) -> np.ndarray:
    """A map in which the bits of all labelled doc_ids are set; a bounded one, so others' may be, too."""
    bit = _bit(size)
    found = usable.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))
    out = np.zeros((size // 32768, 4096), np.uint8)
    for r in found.collect():
        out[r["bucket"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def training_rows(docs: DataFrame, usable: DataFrame, shards: int) -> DataFrame:
    """doc_id, label, lang and slots of every document for each label of its doc_id, a partition a shard.

    Documents whose bit is not set have no label: they go before their words are hashed and moved.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    usable = usable.select(F.col("doc_id").cast(kind).alias("doc_id"), "label")
    size = 1 << int(np.clip(np.ceil(np.log2(16 * max(1, usable.count()))), 15, MOST_BITS))
    shared = docs.sparkSession.sparkContext.broadcast(label_bits(usable, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def labelled_ones() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bit = batch.column("bit").to_numpy() - 1
                yield batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))

        for chunk, texts in text_chunks(labelled_ones(), "text", CHUNK):
            slots, sizes = slots_of(texts)
            parts = np.split(_bytes(slots), np.cumsum(sizes)[:-1])
            yield pa.RecordBatch.from_arrays([chunk.column("doc_id"), chunk.column("lang"), pa.array([x.tobytes() for x in parts], pa.binary())], names=["doc_id", "lang", "slots"])

    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang")
    candidates = docs.where(F.col("doc_id").isNotNull() & (labelled.fold("doc_id", FOLDS) != HELD_OUT)).select("doc_id", "text", lang, _bit(size).alias("bit"))
    slotted = candidates.mapInArrow(run, f"doc_id {kind}, lang string, slots binary")
    rows = slotted.repartition(shards, "doc_id").join(usable.repartition(shards, "doc_id").distinct().hint("merge"), "doc_id")
    return rows.coalesce(1) if shards == 1 else rows  # the join deals a single partition anew


def write_shards(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file a partition; the result, to be read once, counts documents by word ("word", slot), rows by use and label, and names the files ("shard", number)."""
    rows = rows.withColumn("place", F.xxhash64("doc_id", "label", "lang", "slots")).sortWithinPartitions("place", "doc_id", "label")
    schema = pa.schema({"label": pa.int32(), "lang": pa.string(), "calibrates": pa.bool_(), "slots": pa.binary()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        store.create_dir(place, recursive=True)
        shard = TaskContext.get().partitionId()
        n_docs, n_rows = np.zeros(SLOTS, np.int64), np.zeros((2, 2), np.int64)

        def write(out) -> None:
            with pa.ipc.new_stream(out, schema) as writer:
                for chunk, texts in text_chunks(batches, "slots", CHUNK):
                    y = chunk.column("label").to_numpy()
                    calibrates = np.zeros(len(y), bool)
                    for k in (0, 1):  # from another row in each shard, so that rare classes have their quarter over all
                        calibrates[y == k] = (shard + n_rows[:, k].sum() + np.arange((y == k).sum())) % 4 == 0
                        n_rows[:, k] += np.bincount(calibrates[y == k], minlength=2)
                    for x, skip in zip(texts, calibrates, strict=True):
                        if not skip:
                            n_docs[np.unique(_from_bytes([x]))] += 1
                    writer.write_batch(pa.record_batch([chunk.column("label"), chunk.column("lang"), pa.array(calibrates), chunk.column("slots")], schema=schema))

        _put(store, f"{place}/shard-{shard}", write)
        used = np.flatnonzero(n_docs)
        what = ["word"] * len(used) + ["trains"] * 2 + ["calibrates"] * 2 + ["shard"]
        yield pa.RecordBatch.from_arrays([pa.array(what), pa.array(np.concatenate([used, [0, 1, 0, 1, shard]])), pa.array(np.concatenate([n_docs[used], n_rows.ravel(), [1]]))], names=["what", "item", "n"])

    counted = rows.select("lang", "label", "slots").mapInArrow(run, "what string, item long, n long")
    return counted.groupBy("what", "item").agg(F.sum("n").alias("n")).where((F.col("what") != "word") | (F.col("n") >= 2))


def _added(store, paths: list[str], n_rows: int) -> dict[str, np.ndarray]:
    """The sums of several files of changes, added in order."""
    moved, layers = np.zeros((n_rows, DIM + 2), np.float32), 0.0
    for path in paths:
        with store.open_input_stream(path) as file, np.load(io.BytesIO(file.read())) as found:
            moved[found["where"]] += found["moved"]
            layers = layers + found["layers"]
    where = np.flatnonzero(moved[:, -1]).astype(np.int32)
    return {"where": where, "moved": moved[where], "layers": layers}


def _put_changes(store, path: str, changes: dict[str, np.ndarray]) -> None:
    def write(out) -> None:
        buffer = io.BytesIO()
        np.savez(buffer, **changes)
        out.write(buffer.getbuffer())

    _put(store, path, write)


def run_epoch(spark: SparkSession, trainer: Trainer, folder: str, shards: int, epoch: int) -> None:
    """Each shard's task trains from the trainer's state; the trainer takes the mean of their states."""
    shared = spark.sparkContext.broadcast(trainer)
    n_rows, work = len(trainer.squares), f"{folder}/epoch-{epoch}"
    store, place = open_store(work)
    store.create_dir(place, recursive=True)

    def train_shard(i: int) -> list:
        files, shard = open_store(folder)
        own = copy.deepcopy(shared.value)
        own.epoch(_batches(files, f"{shard}/shard-{i}"), [7, epoch, i])
        _put_changes(files, f"{open_store(work)[1]}/0-{i}", own.changes(shared.value))
        return []

    _tasks(spark, shards, train_shard)
    level, n = 0, shards
    while n > FAN_IN:

        def add_up(i: int, level: int = level, n: int = n) -> list:
            files, at = open_store(work)
            _put_changes(files, f"{at}/{level + 1}-{i}", _added(files, [f"{at}/{level}-{j}" for j in range(i * FAN_IN, min(n, (i + 1) * FAN_IN))], n_rows))
            return []

        n = -(-n // FAN_IN)
        _tasks(spark, n, add_up)
        level += 1
    trainer.move(_added(store, [f"{place}/{level}-{j}" for j in range(n)], n_rows))
    store.delete_dir(place)
    shared.destroy()


def calibrate(spark: SparkSession, model: ToxicityModel, folder: str, shards: int) -> None:
    """The logistic curve and the thresholds by language, from every row that calibrates."""
    shared = spark.sparkContext.broadcast(model)

    def measure(i: int) -> list[float]:
        store, place = open_store(folder)
        raw, y, langs = [np.zeros(0)], [np.zeros(0, np.int32)], []
        for chunk in _batches(store, f"{place}/shard-{i}"):
            chunk = chunk.filter(chunk.column("calibrates"))
            if chunk.num_rows:
                rows, sizes, labels, _, lang = _unpacked(chunk, shared.value.row_of)
                raw.append(shared.value.raw_rows(rows, sizes).astype(np.float64))
                y.append(labels)
                langs += lang
        x = np.concatenate(raw)
        batch = pa.record_batch([pa.array(x), pa.array(np.concatenate(y)), pa.array(langs, pa.string())], names=["raw", "label", "lang"])

        def write(out) -> None:
            with pa.ipc.new_stream(out, batch.schema) as writer:
                writer.write_batch(batch)

        _put(store, f"{place}/raw-{i}", write)
        return [max(len(x), 1e-9), (x * x).sum(), np.abs(x).sum()]

    n, squares, size = np.sum(_tasks(spark, shards, measure), axis=0)
    shared.destroy()
    scale = max(float(np.sqrt(max(squares / n - (size / n) ** 2, 0.0))), size / n, 1e-9)

    def sums(theta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        def one(i: int) -> np.ndarray:
            store, place = open_store(folder)
            out = np.zeros(6)
            for batch in _batches(store, f"{place}/raw-{i}"):
                x, y = batch.column("raw").to_numpy(), batch.column("label").to_numpy()
                gradient, curve = labelled.platt_sums(x / scale, y, np.ones(len(x)), theta)
                out += np.concatenate([gradient, curve.ravel()])
            return out

        found = np.sum(_tasks(spark, shards, one, LIGHT_TASKS), axis=0)
        return found[:2], found[2:].reshape(2, 2)

    theta = labelled.newton(sums)
    slope, intercept = model.slope, model.intercept = float(theta[0] / scale), float(theta[1])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = open_store(folder)
        for ids in batches:
            for i in ids.column(0).to_pylist():
                for batch in _batches(store, f"{place}/raw-{i}"):
                    scores = labelled.logistic(slope * batch.column("raw").to_numpy() + intercept)
                    yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("label"), pa.array(np.searchsorted(GRID, scores, "right"))], names=["lang", "label", "passed"])

    counts = spark.range(0, shards, 1, min(shards, LIGHT_TASKS)).mapInArrow(passed, "lang string, label int, passed long").where("lang != ''").groupBy("lang", "label", "passed").agg(F.count("*").alias("n"))
    by_class = [F.sum(F.when(F.col("label") == k, F.col("n")).otherwise(0)) for k in (0, 1)]
    for r in counts.groupBy("lang").agg(F.collect_list(F.struct("label", "passed", "n")).alias("counts"), F.least(*by_class).alias("fewest")).where(F.col("fewest") >= LEAST_ROWS).collect():
        n_passed = np.zeros((2, len(GRID) + 1), np.int64)
        for k, at, n in r["counts"]:
            n_passed[k, at] = n
        model.thresholds[r["lang"]] = best_threshold(n_passed)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    """Fits the network to three quarters of all labelled rows, calibration and thresholds to the rest."""
    spark, usable = docs.sparkSession, usable_labels(labels, label)
    folder = new_folder(spark, "toxicity")
    n_rows = docs.select("doc_id").join(usable.distinct().hint("merge"), "doc_id").count()
    counts = write_shards(training_rows(docs, usable, max(1, round(n_rows / SHARD_ROWS))), folder).toArrow()
    words = pc.equal(counts["what"], "word")
    used = np.sort(counts.filter(words)["item"].to_numpy())
    n = {(r["what"], r["item"]): r["n"] for r in counts.filter(pc.invert(words)).to_pylist()}
    shards = 1 + max((k for what, k in n if what == "shard"), default=0)
    trains, total = (np.array([sum(n.get((x, k), 0) for x in what) for k in (0, 1)]) for what in (("trains",), ("trains", "calibrates")))
    if total.min() < 4 or trains.min() < 1:
        share = float(total[1] / max(1, total.sum()))
        none = {w: np.zeros((w, DIM, FILTERS), np.float32) for w in WIDTHS}
        return ToxicityModel(np.zeros(SLOTS, np.int32), np.zeros((1, DIM), np.float32), none, {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}, np.zeros(FILTERS * len(WIDTHS), np.float32), 0.0, 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    trainer = Trainer(used, trains.sum() / (2 * trains))
    for epoch in range(EPOCHS):
        run_epoch(spark, trainer, folder, shards, epoch)
    model = trainer.model
    model.out_bias = float(trainer.out_bias[0])
    calibrate(spark, model, folder, shards)
    return model


def best_threshold(n_passed: np.ndarray) -> float:
    """The threshold of GRID with the fewest errors, by label and number of thresholds that rows reach; of equal ones that nearest 0.5."""
    below = np.cumsum(n_passed[:, :-1], axis=1)  # by threshold, the rows that do not reach it
    wrong = n_passed[0].sum() - below[0] + below[1]
    least = GRID[wrong == wrong.min()]
    return float(least[np.abs(least - 0.5).argmin()])


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, threshold (of the language) and flagged for every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in text_chunks(batches, "text", CHUNK):
            scores = shared.value.scores(texts)
            limits = np.array([shared.value.thresholds.get(x or "", THRESHOLD) for x in chunk.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(scores), pa.array(limits), pa.array(scores >= limits)], names=["doc_id", "score", "threshold", "flagged"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(run, f"doc_id {kind}, score double, threshold double, flagged boolean")


def reject_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents, all columns as they were, whose score is below their language's threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    lang = docs.columns.index("lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, texts in text_chunks(batches, "text", CHUNK):
            limits = np.array([shared.value.thresholds.get(str(x or ""), THRESHOLD) for x in chunk.column(lang).to_pylist()])
            yield chunk.filter(pc.invert(pa.array(shared.value.scores(texts) >= limits)))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the held-out fold are not learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(labelled.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "threshold", "flagged")
