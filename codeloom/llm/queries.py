"""The registered queries of this subpackage, each over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import exact_dedup, lexical_search, minhash_dedup, mixing, packing, quality, suffix_dedup, token_counts, topk, url_filter, warc, whitening, word_repeats
from codeloom.llm._common import shared_folder, table

TOKENIZER = "byte_bpe_50k"
#: Bytes of a worker's table of pieces where one operator has the executor for itself.
HELD = 200 << 20


def tokenizer_path(suffix: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{TOKENIZER}.{suffix}")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_groups(table(spark, sf_dir, "documents"), width=3, per_cent=85, bands=16)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("json"), budget=512, held=HELD)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.write_archives(table(spark, sf_dir, "pages"), shared_folder(spark, "warc"))
    return warc.read_archives(spark, folder)


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), tokenizer_path("json"), held=HELD)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("json"), held=HELD)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeats.remove_repeated_words(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_minhash_dedup, op2_suffix_dedup, op3_url_filter, op4_quality, op5_token_counts, op6_exact_dedup, op7_warc, op8_topk, op9_mixing, op10_packing, op11_whitening, op12_lexical_search, op13_word_repeats]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_url_filter": url_filter.op3_sql(), "op6_exact_dedup": exact_dedup.OP6_SQL, "op7_warc": warc.OP7_SQL, "op8_topk": topk.OP8_SQL, "op12_lexical_search": lexical_search.OP12_SQL}
