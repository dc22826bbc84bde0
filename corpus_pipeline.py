"""Four stages over documents: toxic ones go, of near copies one stays, personal data is replaced, and the rest is packed.

In every stage a null text counts as an empty one, texts are read whole however long they are, each row is judged by itself also where
ids are null or repeated, columns beyond those of documents are handed on whatever their names, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm.common import free_name, stage_folder, table
from newsloom.llm.packing import pack
from newsloom.llm.pii import pseudonymise
from newsloom.llm.queries import tokenizer_path
from newsloom.llm.simhash import keep_first
from newsloom.llm.toxicity import score, train

TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs whose toxicity score is under TOXIC, by a model fitted on the labelled ones.

    Null and empty texts are not toxic; rows of one text stay or go together. Without labels of both kinds all stay.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    name = free_name("score", docs.columns)
    return score(docs, model, keep=name).where(F.col(name) < TOXIC).drop(name)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those near an earlier one: of each group of near copies one row stays.

    Groups of SimHash fingerprints within two bits, as op10 finds them, are held against the shingles of the texts. At 0.8 edits mostly
    change more bits than two, so buckets of MinHash keys are held against them as well; neither search stands in for the other.
    It is that of the smallest id, rows without an id last; of rows of one id that of the text with the smallest hash; of rows alike in
    both any. All null, empty and blank texts are copies of each other, so one of them stays.
    """
    return keep_first(docs)


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with surrogates for personal data, the same for an entity in all texts, and n_chars counted anew.

    Null texts stay null; no row goes.
    """
    return pseudonymise(docs)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document's ids lies in the sequences.

    A null or empty text is one piece of the end's id. Pieces of one length are ordered by id and start, ties by their ids' checksum.
    """
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_dedup", drop_copies), ("pii_surrogates", replace_personal_data), ("packing", pack_tokens)]

#: No stage can be said in SQL: trained models, hashes of a library, surrogates and tokenizers. Tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the documents; each one's result is written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = stage_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{folder}/{k}_{name}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
