"""Quality classifier by compression: zstandard dictionaries from good and from bad labelled text.

A text is cut into blocks of BLOCK_BYTES. Each block is compressed with either dictionary; the summed
sizes' normalised difference, (bad - good) / (bad + good), tells which kind of text it resembles. A
logistic curve, fitted to training rows that the dictionaries have not seen, makes it a probability.

Defined results: null and empty texts have difference 0; without labels of both classes every score
is the share of label 1 among the labels (0.5 without any); each row is scored, repeated or not;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkquill.llm import labelled
from sparkquill.llm.common import table, text_chunks

BLOCK_BYTES = 2048
DICTIONARY_BYTES = 64 << 10
#: Labelled rows that training reads at most; a third of them fit the curve.
TRAIN_ROWS = 6000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


@dataclass
class CompressionModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    level: int = 3

    def compressors(self) -> tuple:
        import zstandard

        def one(data: bytes):
            if not data:
                return zstandard.ZstdCompressor(self.level, write_content_size=False)
            held = zstandard.ZstdCompressionDict(data)
            held.precompute_compress(self.level)
            return zstandard.ZstdCompressor(dict_data=held, write_content_size=False, write_dict_id=False)

        return one(self.good), one(self.bad)

    def differences(self, texts: list[str | None], both: tuple) -> np.ndarray:
        out, (good, bad) = np.zeros(len(texts)), both
        for i, text in enumerate(texts):
            if text:
                data = text.encode("utf-8", "surrogatepass")
                blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
                a, b = sum(len(good.compress(x)) for x in blocks), sum(len(bad.compress(x)) for x in blocks)
                out[i] = (b - a) / (b + a)
        return out

    def scores(self, texts: list[str | None], both: tuple) -> np.ndarray:
        return labelled.logistic(self.slope * self.differences(texts, both) + self.intercept)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = TRAIN_ROWS) -> CompressionModel:
    """Dictionaries from two thirds of the sample, the curve from the rest."""
    import zstandard

    found, counts = labelled.sample(docs, labels, label, FOLDS, HELD_OUT, rows)
    share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
    flat = CompressionModel(b"", b"", 0.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    of = {k: [t for y, _, t in found if y == k] for k in (0, 1)}
    if min(map(len, of.values())) < 6:
        return flat
    made = {}
    for k, texts in of.items():
        data = [x.encode("utf-8", "surrogatepass") for i, x in enumerate(texts) if i % 3]
        blocks = [x[j : j + BLOCK_BYTES] for x in data for j in range(0, len(x), BLOCK_BYTES)]
        try:
            made[k] = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, blocks)) // 4)), blocks).as_bytes()
        except zstandard.ZstdError:  # too little text to find segments: the text itself is the dictionary
            made[k] = b"".join(blocks)[-DICTIONARY_BYTES:]
    model = CompressionModel(made[1], made[0], 0.0, 0.0)
    rest = [(k, x) for k, texts in of.items() for i, x in enumerate(texts) if i % 3 == 0]
    y = np.array([k for k, _ in rest])
    model.slope, model.intercept = labelled.platt(model.differences([x for _, x in rest], model.compressors()), y, labelled.class_weights(y, counts))
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = shared.value.compressors()
        for chunk, texts in text_chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(shared.value.scores(texts, both))], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the held-out fold are not learned from."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(labelled.fold("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
