"""The registered queries of this package, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.plans.table_queries.base import Query

from . import align, exact, mixing, near, packing, pii, rules, runs, setjoin, sharding, substring, tokens, urls


def of(name: str, digest: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: digest(read(spark, sf_dir, name))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_probminhash": Query(of("documents", near.near_copies)),
    "op2_weak_pii": Query(of("documents", pii.find_personal_data)),
    "op3_poisson_mixing": Query(
        of("documents", lambda d: mixing.mix_sources(d).select("doc_id", "text", "source", "copies", "copy", "shuffle_key")),
        mixing.MIX_SQL,
    ),
    "op4_token_counts": Query(of("documents", tokens.count_tokens)),
    "op5_grace_dedup": Query(of("documents", exact.exact_copies), exact.EXACT_SQL),
    "op6_feistel_shards": Query(of("documents", sharding.shard_digest)),
    "op7_bloom_urls": Query(of("pages", urls.url_digest), urls.URL_SQL),
    "op8_binary_packing": Query(of("documents", packing.packing_digest)),
    "op9_suffix_automata": Query(of("documents", substring.remove_repeats), substring.REPEATS_SQL),
    "op10_quality_rules": Query(
        lambda spark, sf_dir: rules.quality_digest(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    ),
    "op11_skipping_jaccard": Query(of("documents", setjoin.similar_sets), setjoin.SETS_SQL),
    "op12_galloping_alignment": Query(of("documents", align.alignment_digest)),
    "op13_square_runs": Query(of("documents", runs.runs_digest)),
}
