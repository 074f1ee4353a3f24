"""Memories, edges and turns from the star-schema and text tables, by plain arithmetic on ids; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed import DAY, EDGE_TYPES, MEMORY_TYPES
from ..functions.scoring import NOBODY

BASE, HOUR = 1_700_000_000_000_000, 3_600_000_000
NOW = BASE + 2000 * HOUR


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tag(text: str, n: int) -> str:
    return f"CASE WHEN doc_id % {n} = 0 THEN {text} END"


_TAGS = ["lang", "source", _tag("'scope:always'", 37), _tag("concat('scope:project:p', CAST(doc_id % 5 AS STRING))", 3), _tag("concat('entity:e', CAST(doc_id % 23 AS STRING))", 7), _tag("concat('entity_type:t', CAST(doc_id % 4 AS STRING))", 7), _tag("'turn'", 13)]


def memories(spark: SparkSession, sf_dir: str, vectors: bool = True) -> DataFrame:
    """One memory for each document; the vector of the same id, or an empty one."""
    docs = table(spark, sf_dir, "documents")
    out = docs.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("agent_id"),
        F.when(F.col("doc_id") % 8 == 0, NOBODY).otherwise(F.concat(F.lit("u"), F.col("doc_id") % 8)).alias("user_id"),
        F.element_at(F.array(*map(F.lit, MEMORY_TYPES)), (F.col("doc_id") % 6 + 1).cast("int")).alias("memory_type"),
        F.coalesce("text", F.lit("")).alias("content"),
        F.when(F.col("doc_id") % 5 == 0, F.col("lang")).alias("context"),
        (F.lit(BASE) + F.col("doc_id") * HOUR).alias("created_at"),
        (F.lit(BASE) + F.col("doc_id") * HOUR + F.col("doc_id") % 10 * DAY).alias("accessed_at"),
        (F.col("doc_id") % 7).alias("access_count"),
        (F.col("doc_id") % 100 / 100).alias("salience"),
        (F.col("doc_id") * 7 % 100 / 100).alias("confidence"),
        F.array_compact(F.array(*[F.expr(t) for t in _TAGS])).alias("tags"),
        F.when(F.col("doc_id") % 3 == 0, F.lit(BASE) + F.col("doc_id") * HOUR).alias("valid_from"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(BASE) + F.col("doc_id") * HOUR + 30 * DAY).alias("valid_until"),
    )
    if not vectors:
        return out
    vec = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return out.join(vec, "id", "left").withColumn("embedding", F.coalesce("embedding", F.array().cast("array<float>")))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id -> id div 2, and every fourth id from 50 on -> id mod 50."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"))

    def kinds(shift: int):
        return F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("source") + shift) % 8 + 1).cast("int")).alias("edge_type")

    start = F.lit(BASE) + F.col("source") * HOUR
    rest = [((F.col("source") % 10 + 1) / 10).alias("weight"), start.alias("created_at"), F.lit(None).cast("long").alias("valid_from"), F.when(F.col("source") % 9 == 0, start + 10 * DAY).alias("valid_until")]
    a = d.where("source >= 1").select("source", F.floor(F.col("source") / 2).alias("target"), kinds(0), *rest)
    b = d.where("source >= 50 AND source % 4 = 0").select("source", (F.col("source") % 50).alias("target"), kinds(3), *rest)
    return a.union(b)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def _list(x: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in x) + "]"


MEMORIES_SQL = f"""m AS (
  SELECT doc_id AS id, source AS agent_id, CASE WHEN doc_id % 8 = 0 THEN 'nil' ELSE concat('u', doc_id % 8) END AS user_id,
         {_list(MEMORY_TYPES)}[doc_id % 6 + 1] AS memory_type, coalesce(text, '') AS content, CASE WHEN doc_id % 5 = 0 THEN lang END AS context,
         {BASE} + doc_id * {HOUR} AS created_at, {BASE} + doc_id * {HOUR} + doc_id % 10 * {DAY} AS accessed_at, doc_id % 7 AS access_count,
         (doc_id % 100) / 100.0::DOUBLE AS salience, (doc_id * 7 % 100) / 100.0::DOUBLE AS confidence,
         list_filter([{", ".join(t.replace("STRING", "VARCHAR") for t in _TAGS)}], lambda x: x IS NOT NULL) AS tags,
         CASE WHEN doc_id % 3 = 0 THEN {BASE} + doc_id * {HOUR} END AS valid_from, CASE WHEN doc_id % 11 = 0 THEN {BASE} + doc_id * {HOUR} + 30 * {DAY} END AS valid_until,
         coalesce(e.embedding, []) AS embedding
  FROM documents LEFT JOIN embeddings e ON doc_id = vec_id)"""
EDGES_SQL = f"""e AS (
  SELECT *, {BASE} + source * {HOUR} AS created_at, ((source % 10) + 1) / 10.0::DOUBLE AS weight, CASE WHEN source % 9 = 0 THEN {BASE} + source * {HOUR} + 10 * {DAY} END AS valid_until
  FROM (SELECT doc_id AS source, doc_id // 2 AS target, {_list(EDGE_TYPES)}[doc_id % 8 + 1] AS edge_type FROM documents WHERE doc_id >= 1
        UNION ALL SELECT doc_id, doc_id % 50, {_list(EDGE_TYPES)}[(doc_id + 3) % 8 + 1] FROM documents WHERE doc_id >= 50 AND doc_id % 4 = 0))"""
TURNS_SQL = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role <> 'system')"
