"""The queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnwright.llm import bpe, branches, curriculum, langid, licenses, minhash, negatives, packing, quality, sharding, toxicity, vectors, wavelet


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).drop("queue")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.link(table(spark, sf_dir, "embeddings"))


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.read_shards(wavelet.write_shards(table(spark, sf_dir, "documents")))


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op11_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.mixed(table(spark, sf_dir, "documents"))


def op12_branch_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return branches.merged(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_toxicity": op4_toxicity,
    "op5_sharding": op5_sharding,
    "op6_license_scan": op6_license_scan,
    "op7_minhash_dedup": op7_minhash_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_wavelet_shards": op9_wavelet_shards,
    "op10_bpe_round_trip": op10_bpe_round_trip,
    "op11_curriculum_mix": op11_curriculum_mix,
    "op12_branch_merge": op12_branch_merge,
    "op13_hard_negatives": op13_hard_negatives,
}

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))

ORACLES: dict[str, str] = {
    "op1_quality_rules": rf"""
with d as (
  select row_number() over () as rid, doc_id, coalesce(text, '') as t,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
win as (
  select rid, i, count(*) over (partition by rid, k) as c from (
    select rid, i, ws[i:i + 4] as k from (
      select rid, ws, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5))),
rep as (
  select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from win where c > 1) group by rid),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words,
    cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
    cast(length(t) - length(translate(t, '#*$%&|<>', '')) as bigint) as n_symbols,
    cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
    cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) in ({_STOP}))) as stops, len(ls) as n_lines
  from d left join rep using (rid)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
  and word_chars / n_words between 1.5 and 20.0
  and n_symbols / word_chars <= 0.06
  and (n_words < 100 or stops / n_words >= 0.005)
  and (n_words < 20 or n_lines = 0 or n_dup_lines / n_lines <= 0.5)
  and (n_words < 50 or n_lines / n_words <= 0.6) as kept
from b
""",
    "op6_license_scan": licenses.duckdb_sql(),
    "op11_curriculum_mix": curriculum.duckdb_sql(),
    "op12_branch_merge": branches.duckdb_sql(),
    "op13_hard_negatives": negatives.duckdb_sql(),
}
