"""The queries of this folder: each applies one operator, as in production, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import language, lm, mixing, neardup, packing, passages, sharding, toxicity, vectors
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.exact_top_k(table(spark, sf_dir, "embeddings"))


def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents")).drop("thash")


def queries():
    return {
        "op1_toxicity": op1_toxicity,
        "op2_language": op2_language,
        "op3_repeated_passages": op3_repeated_passages,
        "op4_lm_score": op4_lm_score,
        "op5_exact_top_k": op5_exact_top_k,
        "op6_nearest": op6_nearest,
        "op7_mix_sources": op7_mix_sources,
        "op8_pack": op8_pack,
        "op9_shard": op9_shard,
        "op10_near_duplicates": op10_near_duplicates,
    }


#: Each query against all other vectors, in full.
TOP_K_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) q
  from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
)
select a.vec_id as query_id, cast(row_number() over (partition by a.vec_id order by list_dot_product(a.q, b.q) desc, b.vec_id) as integer) as "rank",
       b.vec_id as vec_id, cast(list_dot_product(a.q, b.q) as bigint) as score
from v a join v b on a.vec_id <> b.vec_id and len(a.q) = len(b.q)
where a.vec_id % 50 = 0
qualify "rank" <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_top_k": TOP_K_SQL}
