"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.  All but the last keep
the columns of ``documents``: doc_id, text, lang, source, n_chars.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm import langid, mixing, nearcopies, packing, quality
from kinweave.llm.common import delete, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.3 or more)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, labels)
    return quality.annotate(docs, model, threshold=0.3, only_kept=True).select(*COLUMNS)


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the classifier knows: not ``und``, with 65 % of their n-grams among those learned.

    A share so low is another script or spelling; clean documents of a few words
    with a secret or an address in them know 79 % and more.
    """
    model = langid.train(docs)
    return langid.annotate(docs, model, min_score=0.3, min_known=0.65, only_kept=True).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near copies.

    Linked are SimHash fingerprints that differ in two bits at most, as in
    ``op7_simhash``, and texts of a five-word Jaccard similarity of 0.8 or more.
    """
    return nearcopies.deduplicate(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; documents repeat, or are cut, as the mix takes their words."""
    return mixing.mixed_documents(docs).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, placed in sequences of 4096 tokens at most."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", keep_good),
    ("language", keep_known_language),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Trained models and a tokenizer: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    What lies between them is written below the checkpoint folder; a table is
    deleted once the next one is written.
    """
    at = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            now = f"{at}/{i}-{name}"
            docs.write.parquet(now)
            docs = spark.read.parquet(now)
            if before is not None:
                delete(spark, before)
            before = now
    return docs
