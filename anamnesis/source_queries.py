"""Queries of files that a model reads, hashed vectors, neighbours and weighted fusion, with their SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import graph, retrieval
from .queries import VECTOR, VECTOR_SQL, cos_sql, mem, query
from .sources import model_atoms, providers
from .sources import tables as T

AT = T.BASE + 300 * T.HOUR
DIMENSION = 32


@query("SELECT target, edge_type, weight FROM e WHERE source = 100", edges=True)
def outgoing(spark, d):
    return graph.outgoing(T.edges(spark, d), 100).select("target", "edge_type", "weight")


@query("SELECT source, edge_type, weight FROM e WHERE target = 9", edges=True)
def incoming(spark, d):
    return graph.incoming(T.edges(spark, d), 9).select("source", "edge_type", "weight")


@query(f"SELECT target, edge_type FROM e WHERE source = 63 AND (valid_until IS NULL OR {AT} < valid_until)", edges=True)
def outgoing_valid(spark, d):
    return graph.outgoing(T.edges(spark, d), 63, AT).select("target", "edge_type")


@query(f"SELECT source, edge_type FROM e WHERE target = 9 AND (valid_until IS NULL OR {AT} < valid_until)", edges=True)
def incoming_valid(spark, d):
    return graph.incoming(T.edges(spark, d), 9, AT).select("source", "edge_type")


@query(f"""AND near AS (SELECT id, 1 - {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64),
far AS (SELECT id, 1 + {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64),
runs AS (SELECT id, 1.0::DOUBLE AS w, row_number() OVER (ORDER BY round(x, 9), id) - 1 AS rank FROM near QUALIFY rank < 10
UNION ALL SELECT id, 0.4::DOUBLE, row_number() OVER (ORDER BY round(x, 9), id) - 1 AS rank FROM far QUALIFY rank < 30),
s AS (SELECT id, sum(w / (60 + rank)) AS score FROM runs GROUP BY id) SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 25""")
def weighted_rrf(spark, d):
    m = mem(spark, d, True)
    runs = [retrieval.nearest(m, v, k).select("id", (-F.col("distance")).alias("score")) for v, k in ((VECTOR, 10), ([-x for x in VECTOR], 30))]
    return retrieval.merged(runs, 25, [1.0, 0.4]).select("id", F.round("score", 6).alias("score"))


@query()
def agent_file_chunks(spark, d):
    files = T.table(spark, d, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("value"))
    return model_atoms.chunks(files)


@query("""AND a AS (SELECT conv_id, turn, role, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS content, turn % 2 = 0 AS named FROM t )
SELECT conv_id, turn, 0 AS part, role AS section, left(content, list_max(list_filter(range(1, 1801), lambda k: strlen(left(content, k)) <= 1800))) AS content, CASE turn % 3 WHEN 0 THEN 'procedural' WHEN 1 THEN 'anti_pattern' ELSE 'semantic' END AS memory_type, concat('section:', role, CASE WHEN named THEN ',trigger:reply-style' ELSE '' END) AS tags FROM a WHERE strlen(content) >= 12
UNION ALL SELECT conv_id, turn, 1, '', concat('as ', role), 'semantic', 'mode-exemplar:reply-style' FROM a WHERE strlen(content) >= 12 AND named""")
def model_answers(spark, d):
    """Each turn as the one element of an answer with prose around it; every fifth answer is cut off inside its next element."""
    kinds = F.element_at(F.array(F.lit("procedural"), F.lit("anti_pattern"), F.lit("fact")), (F.col("turn") % 3 + 1).cast("int"))
    trigger = F.when(F.col("turn") % 2 == 0, F.lit(" Reply/Style! ")).otherwise("always")
    examples = F.array(F.concat(F.lit("as "), "role"), F.lit("no"))
    item = F.to_json(F.struct(F.col("text").alias("content"), kinds.alias("type"), F.col("role").alias("section"), trigger.alias("trigger"), examples.alias("exemplars")))
    end = F.when(F.col("turn") % 5 == 0, F.lit(', {"content": "cut of')).otherwise("]\n```")
    answers = T.turns(spark, d).select("conv_id", "turn", F.concat(F.lit("Here:\n```json\n["), item, end).alias("answer"))
    return model_atoms.atoms(answers, ["conv_id", "turn"], "answer").withColumn("tags", F.array_join("tags", ",")).drop("place")


@query()
def hash_vectors(spark, d):
    rows = T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return providers.cache_keys(providers.embedded(rows, "text", providers.FnvEmbedder(DIMENSION)), "text", "hash").drop("text")


@query("""AND o AS (SELECT doc_id AS id, lower(source) AS s, doc_id % 4 AS k FROM documents)
SELECT id, CASE k WHEN 0 THEN concat(s, '-x') WHEN 1 THEN NULL WHEN 2 THEN s ELSE NULL END AS trigger, concat('{"id": ', id, '}') AS body FROM o""")
def answer_parts(spark, d):
    """Trigger names and fenced bodies as models give them."""
    k, s = F.col("doc_id") % 4, F.col("source")
    raw = F.when(k == 0, F.concat(F.lit("--"), F.upper(s), F.lit(" / X"))).when(k == 1, F.lit("ALWAYS")).when(k == 2, s).otherwise(F.repeat(F.lit("long "), 12))
    body = F.concat(F.when(k < 2, F.lit(" ```json\n")).otherwise("```"), F.lit('{"id": '), "doc_id", F.lit("}\n```\n"))
    return T.table(spark, d, "documents").select(F.col("doc_id").alias("id"), model_atoms.trigger_slug(raw).alias("trigger"), providers.unfenced(body).alias("body"))
