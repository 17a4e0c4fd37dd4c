"""A training corpus from raw documents in five stages, each calling one operator of sparkquill.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept, which is written as
Parquet to the shared folder and read again. All stages but the last return the columns of documents.

1. toxicity: documents whose score reaches their language's threshold go.
2. near_dedup: of each group of near copies the document with the smallest doc_id stays.
3. decontamination: documents that hold a benchmark window go.
4. mixing: words are drawn from the sources towards the target weights; a document comes once for
   each pass over its source that takes of it, with the words that were taken.
5. token_planes: ids in bit-plane files; returns per row doc_id, start, n_tokens, ids_crc32.

Defined results: null and empty texts are scored like any other, are no near copies, hold no window
and are taken no words of, so they end with mixing; a null lang has the threshold 0.5; a null source
is a source of its own; a null doc_id is never the smallest of a group and comes first in the token
files. Of rows that repeat doc_id and text one stays (near_dedup). An empty table gives an empty
table of the same columns. Extra columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkquill.llm import dart_minhash, fm_decontaminate, source_mix, token_planes, toxicity_cnn
from sparkquill.llm.common import table, written


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity_cnn.reject_toxic(docs, toxicity_cnn.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dart_minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed_documents(docs, source_mix.mix(docs, whole_rows=True))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return token_planes.token_files(docs, token_planes.default_tokenizer())


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_planes", token_ids),
]

#: Training a network and similarity groups cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
