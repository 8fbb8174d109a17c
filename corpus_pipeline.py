"""Five stages from raw documents to encoded training data, each one operator's decisions applied.

Every stage reads what the one before kept, as Parquet, and all but the last return the columns
of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import lean_batches, shared_folder
from tallyspark.llm.language_id import UNKNOWN, identify_along, trained_on
from tallyspark.llm.ngram_join import near_duplicates
from tallyspark.llm.source_mix import mix_sources
from tallyspark.llm.surrogates import TEST_KEY, replace_entities
from tallyspark.llm.word_bpe import encode_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if no language takes this share of its words.
LEAST_SCORE = 0.35


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a clear language; ``lang`` becomes the predicted one. Those rejected go.

    The field is trained on the stage's own input. Without any label nothing can be learned, and
    then every document with a letter stays as it is.
    """
    lean_batches(spark)
    field = trained_on(docs)
    if field is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}")).select(*COLUMNS)
    rows = docs.select("text", F.struct("doc_id", "source", "n_chars").alias("rest"))
    kept = identify_along(rows, field).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("rest.doc_id", "text", F.col("lang_pred").alias("lang"), "rest.source", "rest.n_chars")


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id.

    Empty texts link with nothing and stay; of rows that repeat the kept id, all with that id stay.
    """
    lean_batches(spark)
    groups = near_duplicates(docs)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its personal data become surrogates, and ``n_chars`` is counted anew."""
    lean_batches(spark)
    return replace_entities(docs.select(*COLUMNS), TEST_KEY).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks, by whole and partial passes."""
    return mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document's ids and decoded text."""
    import public_tokenizers

    lean_batches(spark)
    return encode_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_duplicate),
    ("pii_surrogates", personal_data),
    ("source_mix", source_mix),
    ("bpe_coding", encoding),
]

#: The trained classifier, the permutations and the merges are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
