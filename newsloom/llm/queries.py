"""The queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ball_kmeans import ball_kmeans
from .ball_kmeans import oracle_sql as kmeans_sql
from .byte_bpe import encode
from .common import table
from .embedding_dedup import near_duplicate_vectors
from .fill_middle import fill_in_middle, restored
from .fill_middle import oracle_sql as fill_middle_sql
from .fingerprint import fingerprints
from .license_scan import oracle_sql as license_sql
from .license_scan import recognise
from .packing import pack
from .pii import pseudonymise
from .sentence_pieces import encode as encode_pieces
from .simhash import near_duplicates
from .token_counts import count_tokens
from .toxicity import fold_of, score, train
from .url_filter import Rule, judge

TOKEN_LIMIT = 1024
URL_RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; the installed package has it on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, kinds_col="kinds")
    return found.select("doc_id", "text", F.size("kinds").cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("kinds")), " ").alias("kinds"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold_of("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognise(table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), URL_RULES)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return found.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), decoded="text")
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans(table(spark, sf_dir, "embeddings"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = (op1_embedding_dedup, op2_sentencepiece, op3_pii_surrogates, op4_toxicity, op5_packing, op6_license_scan, op7_url_filter, op8_token_counts, op9_fingerprint, op10_simhash_dedup, op11_byte_bpe, op12_ball_kmeans, op13_fill_middle)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corpus_pipeline import run

    return run(spark, sf_dir)


def queries() -> dict:
    return {q.__name__: q for q in (*QUERIES, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": license_sql(), "op12_ball_kmeans": kmeans_sql(), "op13_fill_middle": fill_middle_sql()}
