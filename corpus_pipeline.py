"""From raw documents to packed training sequences, in five stages.

Each stage takes the session, the documents that its predecessor kept and the folder of the
tables, and returns a DataFrame: all but the last the columns of `documents`. `run` writes each
result to the shared folder and reads it back, so that a lost executor repeats one stage at most.

Rows: null and empty texts pass the first three stages (they are neither toxic, nor copies of
other texts, nor repeat a passage; equal empty texts are copies) and are worth no words to the
mix. A repeated row is a document of its own until near-dedup leaves one. An empty table gives an
empty result. Extra columns are carried through to the packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from warpsift.llm import mixing, neardup, packing, sentences, toxicity
from warpsift.llm.common import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn toxicity from the labels (training fold only); documents scored toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.learn(docs, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of equal or near-equal documents the one with the smallest id stays."""
    return neardup.keep_one(docs)


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The columns under numbers, so that none clashes with those of an operator."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names))


def _named(out: DataFrame, at: dict[str, str]) -> DataFrame:
    return out.select(*[F.col(n).alias(c) for c, n in at.items()])


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences covered by a span that stands elsewhere before go; the document stays."""
    inner, at = _numbered(docs)
    out = sentences.dedup_spans(inner, at["text"], at["doc_id"])
    if "n_chars" in at:
        n = at["n_chars"]
        changed = F.length(at["text"]).cast(docs.schema["n_chars"].dataType)
        out = out.withColumn(n, F.when(F.col("n_removed") > 0, changed).otherwise(F.col(n)))
    return _named(out, at)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    inner, at = _numbered(docs)
    key = inner.withColumn("text_hash", F.xxhash64(at["text"]))
    mixed = mixing.mix(key, mixing.words_of(F.col(at["text"])), F.array(at["source"]),
                       [at["doc_id"], "text_hash"])
    return _named(mixing.repeat_rows(mixed), at)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(packing.cut_documents(docs))


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_spans),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack_sequences),
]

#: A trained classifier, signatures and a tokenizer have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
