"""A training corpus in five stages: reject toxic texts, keep one of each near-duplicate class,
redact secrets, mix the sources, encode.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all its predecessor kept; all but the
last return the columns of ``documents``.  ``run`` writes each stage's rows to the shared folder as Parquet
and reads them again as the next one's.  Empty tables give empty ones, any text may be null or very long, and rows may repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewalk.llm import mixing, pieces, queries, secrets, simhash, toxicity
from tidewalk.llm.common import cut, importable


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones among them, scores below 0.5; null and blank texts stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.reject(docs, toxicity.fit(docs, labels))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: five-word shingles, a similarity of 0.8 or more.

    Candidates are told apart by SimHash fingerprints and their pivot distances, survivors by the shingles themselves.  Null texts and those without
    words are one class; of repeated rows one stays.
    """
    return simhash.deduplicate(docs, width=5, similarity=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a marker; values that many sources share are left as examples.  Null texts stay null."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of smaller sources up to twice, by temperature, in the order of the block permutations.

    The rows are dealt out by their place, so the order is that of the files written and of the rows in them; a document and its repetition are far apart.
    """
    return mixing.in_order(mixing.mix(docs, max_epochs=2.0)).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, source, n_tokens, ids_sha256, decoded_sha256, ids``, a row for each row; null texts have no ids."""
    return pieces.round_trip(docs, pieces.read_model(queries.TOKENIZER), keep=("source",), ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash near-dedup", keep_one_of_each),
    ("secret scans", redact_secrets),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: SQL has none of the classifier, the fingerprints or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    importable(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
