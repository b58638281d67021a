"""The operators as named queries over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import nearest, oracle_sql as ann_sql
from .bpe import bpe_digests
from .infill import infill_digests, oracle_sql as infill_sql
from .lang_id import identify
from .lm_score import score_documents
from .media import media_digests
from .mixing import mix, quality_domain
from .near_dedup import near_duplicates
from .pii import find_pii
from .pivots import oracle_sql as pivots_sql, top_products
from .substring_dedup import repeated_passages
from .url_filter import judge, oracle_sql as url_filter_sql
from .whitening import whitening

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary file of the production query; it comes with the environment, never with this repository."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id", quality_domain().alias("domain"))
    return mix(table(spark, sf_dir, "documents"), labelled)


def op2_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def op10_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_digests(table(spark, sf_dir, "documents"))


def op13_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_langid": op2_langid,
    "op3_pii": op3_pii,
    "op4_substrings": op4_substrings,
    "op5_bpe": op5_bpe,
    "op6_ann": op6_ann,
    "op7_urlfilter": op7_urlfilter,
    "op8_minhash": op8_minhash,
    "op9_media": op9_media,
    "op10_lmscore": op10_lmscore,
    "op11_whitening": op11_whitening,
    "op12_infill": op12_infill,
    "op13_topk": op13_topk,
}

ORACLES: dict[str, str] = {
    "op6_ann": ann_sql(),
    "op7_urlfilter": url_filter_sql(),
    "op12_infill": infill_sql(),
    "op13_topk": pivots_sql(),
}
