"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.llm import alignment, bpe, decontaminate, html_text, neighbours, pii, quality_model, quality_rules, revisits, sharding, simhash, token_counts, vector_codes
from tickloom.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    docs = lambda spark, d: table(spark, d, "documents")
    return {
        "op1_sampled_splitters": lambda spark, d: sharding.shard_documents(docs(spark, d)),
        "op2_deobfuscation": lambda spark, d: pii.digest_documents(docs(spark, d)),
        "op3_boosted_trees": lambda spark, d: quality_model.digest_documents(docs(spark, d), table(spark, d, "labels")),
        "op4_line_cleaning": lambda spark, d: quality_rules.digest_documents(docs(spark, d)),
        "op5_html_layout": lambda spark, d: html_text.digest_pages(table(spark, d, "pages")),
        "op6_revisits": lambda spark, d: revisits.digest_revisits(table(spark, d, "pages")),
        "op7_token_counts": lambda spark, d: token_counts.count_documents(docs(spark, d), tokenizer_file("piece_bpe_32k.model")),
        "op8_suffix_arrays": lambda spark, d: decontaminate.digest_documents(docs(spark, d), table(spark, d, "benchmark")),
        "op9_simhash": lambda spark, d: simhash.digest_documents(docs(spark, d)),
        "op10_trie_bpe": lambda spark, d: bpe.digest_documents(docs(spark, d), tokenizer_file("byte_bpe_50k.json")),
        "op11_norm_of_sum_codes": lambda spark, d: vector_codes.digest_vectors(table(spark, d, "embeddings")),
        "op12_interval_groups": lambda spark, d: alignment.digest_documents(docs(spark, d), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")),
        "op13_learned_partitions": lambda spark, d: neighbours.digest_neighbours(table(spark, d, "embeddings")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_line_cleaning": quality_rules.SQL, "op6_revisits": revisits.SQL, "op8_suffix_arrays": decontaminate.SQL, "op11_norm_of_sum_codes": vector_codes.SQL}
