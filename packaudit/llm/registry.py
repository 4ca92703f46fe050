"""The operators' queries over the given tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packaudit.llm import (credentials, decontaminate, langid, licenses, mixing, packing, pages, prefixes, quality, runs, sharding, simhash,
                           vectors)

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers  # only packing needs the vocabulary files
    return packing.read_spec(public_tokenizers.path(TOKENIZER))


QUERIES = {
    "op1_license_scan": lambda s, d: licenses.scan(table(s, d, "documents")),
    "op2_vector_neardup": lambda s, d: vectors.near_duplicates(table(s, d, "embeddings")),
    "op3_language_id": lambda s, d: langid.languages(table(s, d, "documents")),
    "op4_sharding": lambda s, d: sharding.shard(table(s, d, "documents")),
    "op5_secret_scan": lambda s, d: credentials.report(table(s, d, "documents")),
    "op6_quality": lambda s, d: quality.qualities(table(s, d, "documents"), table(s, d, "labels")),
    "op7_simhash": lambda s, d: simhash.near_duplicates(table(s, d, "documents")),
    "op8_packing": lambda s, d: packing.pack(table(s, d, "documents"), tokenizer()),
    "op9_decontamination": lambda s, d: decontaminate.report(table(s, d, "documents"), table(s, d, "benchmark")),
    "op10_main_text": lambda s, d: pages.extract(table(s, d, "pages")),
    "op11_periodic_runs": lambda s, d: runs.report(table(s, d, "documents")),
    "op12_source_mix": lambda s, d: mixing.mix(table(s, d, "documents")),
    "op13_prefix_trie": lambda s, d: prefixes.report(table(s, d, "conversations")),
}
ORACLE = {
    "op1_license_scan": licenses.oracle(),
    "op2_vector_neardup": vectors.oracle(),
    "op9_decontamination": decontaminate.oracle(),
}
