"""The queries of the engine's own operators, each with its SQL where SQL can express it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixed
from .functions import text
from .operators import analytics, graph, lifecycle, retrieval, scans
from .plans.compile import run as run_query
from .sources import tables as T
from .sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
NOW = T.NOW
VECTOR = [round(math.sin(i + 1), 3) for i in range(64)]
TEXT = "the tion and ouen house then ation"
VECTOR_SQL = "(CAST([" + ", ".join(str(v) for v in VECTOR) + "] AS DOUBLE[]))"


def query(sql: str | None = None, edges: bool = False, recursive: bool = False):
    """Registers a query under its function's name; the SQL sees m (memories), and e (edges), t (turns)."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            head = T.MEMORIES_SQL + (", " + T.EDGES_SQL if edges or " e " in sql or " e)" in sql else "") + (", " + T.TURNS_SQL if " t " in sql or " t," in sql else "")
            body = sql.strip()
            SQL[f.__name__] = f"WITH {'RECURSIVE ' * recursive}{head}{', ' + body[4:].strip() if body.startswith('AND ') else ' ' + body}"
        return f

    return add


def mem(spark, d, vectors=False):
    return T.memories(spark, d, vectors)


def q_list(x: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in x)


def has_any(column: str, needles: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '" + n.replace("'", "''") + "')" for n in needles) + ")"


TOKENS_SQL = "list_filter(list_transform(string_split_regex({0}, '[^\\p{{L}}\\p{{N}}'']+'), lambda w: lower(regexp_replace(w, '^''+|''+$', '', 'g'))), lambda w: strlen(w) >= 2 AND w NOT IN (" + q_list(fixed.STOP_WORDS).replace("{", "{{") + "))"
FRAME_SQL = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
DECAYED_SQL = f"least(1.0, greatest(0.01, salience * pow(2.0, -(greatest(0, {NOW} - accessed_at) / {float(fixed.HALF_LIFE)})) + 0.1 * ln(1.0 + access_count)))"
VALID_SQL = "(coalesce({0}valid_from, 0) <= {1} AND ({0}valid_until IS NULL OR {1} < {0}valid_until))"
DOT_SQL = "list_sum(list_transform(range(1, len({0}) + 1), lambda i: {0}[i]::DOUBLE * {1}[i]::DOUBLE))"


def cos_sql(a: str, b: str) -> str:
    return f"({DOT_SQL.format(a, b)} / (sqrt({DOT_SQL.format(a, a)}) * sqrt({DOT_SQL.format(b, b)})))"


# --- scans and predicates -------------------------------------------------------------------------------------------


@query("SELECT id FROM m WHERE list_has_all(tags, ['en', 'src1'])")
def tag_scan_and(spark, d):
    return scans.with_all_tags(mem(spark, d), ["en", "src1"]).select("id")


@query("SELECT id FROM m WHERE list_has_any(tags, ['de', 'scope:always'])")
def tag_scan_or(spark, d):
    return scans.with_any_tag(mem(spark, d), ["de", "scope:always"]).select("id")


@query("SELECT DISTINCT tag FROM (SELECT unnest(tags) AS tag FROM m) WHERE starts_with(tag, 'scope:')")
def tag_vocabulary(spark, d):
    return scans.tag_vocabulary(mem(spark, d), "scope:")


@query("SELECT id FROM m WHERE list_has_any(tags, [x for x in tags if starts_with(x, 'entity:')])")
def entity_memories(spark, d):
    return scans.tagged_like(mem(spark, d), "entity:").select("id")


@query(f"SELECT id, created_at FROM m WHERE created_at BETWEEN {T.BASE + 100 * T.HOUR} AND {T.BASE + 400 * T.HOUR}")
def temporal_range(spark, d):
    return scans.created_between(mem(spark, d), T.BASE + 100 * T.HOUR, T.BASE + 400 * T.HOUR).select("id", "created_at")


@query("SELECT id, created_at FROM m WHERE NOT list_contains(tags, 'turn') ORDER BY created_at DESC, id DESC LIMIT 25")
def latest_n(spark, d):
    return scans.newest(mem(spark, d), 25, ["turn"]).select("id", "created_at")


@query("SELECT id, created_at FROM m WHERE (created_at, id) > (SELECT (created_at, id) FROM m WHERE id = 100) ORDER BY created_at, id LIMIT 25")
def keyset_page(spark, d):
    return scans.oldest(mem(spark, d), 25, after=100).select("id", "created_at")


@query("SELECT id, salience FROM m ORDER BY salience DESC, id LIMIT 30")
def top_salience(spark, d):
    return scans.most_salient(mem(spark, d), 30).select("id", "salience")


@query("SELECT id FROM (SELECT * FROM m ORDER BY id LIMIT 100 OFFSET 50) WHERE memory_type = 'semantic' AND contains(lower(content), 'the')")
def list_page(spark, d):
    return scans.listed(mem(spark, d), 50, 100, memory_type="semantic", text="the").select("id")


@query("SELECT id, memory_type FROM m WHERE id IN (3, 14, 15, 92)")
def point_lookup(spark, d):
    return scans.by_id(mem(spark, d), [3, 14, 15, 92]).select("id", "memory_type")


@query("SELECT id, user_id, agent_id FROM m WHERE user_id = 'u3' AND agent_id = 'src3'")
def owner_browse(spark, d):
    return mem(spark, d).where("user_id = 'u3' AND agent_id = 'src3'").select("id", "user_id", "agent_id")


@query("SELECT id, CASE WHEN id % 10 = 0 THEN 1.0 ELSE salience END AS salience FROM m WHERE id % 17 <> 0")
def update_and_delete(spark, d):
    m = mem(spark, d).select("id", "salience")
    kept = scans.deleted(m, m.where("id % 17 = 0"))
    return scans.patched(kept, m.where("id % 10 = 0").select("id", F.lit(1.0).alias("salience")))


@query("SELECT id, CASE WHEN context IS NULL OR context = '' THEN strlen(content) ELSE strlen(context) + 1 + strlen(content) END AS bytes FROM m")
def indexed_text(spark, d):
    return mem(spark, d).select("id", F.octet_length(text.indexed_text(F.col("context"), F.col("content"))).cast("long").alias("bytes"))


# --- query language ---------------------------------------------------------------------------------------------------


@query("SELECT id, 0.0::DOUBLE AS score FROM m WHERE memory_type = 'semantic' ORDER BY salience DESC, id LIMIT 15")
def recall_type_filter(spark, d):
    return run_query('RECALL MEMORIES WHERE type = "semantic" ORDER BY salience DESC LIMIT 15', mem(spark, d), None, NOW)


@query("SELECT id, 0.0::DOUBLE AS score FROM m WHERE (list_contains(tags, 'en') AND NOT contains(lower(content), 'there') OR salience > 0.9) AND confidence >= 0.2 ORDER BY id LIMIT 50")
def recall_bool_tree(spark, d):
    return run_query('RECALL WHERE (tag = "en" AND NOT content CONTAINS "There" OR salience > 0.9) AND confidence >= 0.2 LIMIT 50', mem(spark, d), None, NOW)


@query(f"SELECT id, 0.0::DOUBLE AS score FROM m WHERE memory_type IN ('episodic', 'correction') AND {VALID_SQL.format('', T.BASE + 500 * T.HOUR)} ORDER BY created_at DESC, id LIMIT 40")
def recall_as_of(spark, d):
    return run_query(f'RECALL WHERE type IN ["episodic", "correction"] ORDER BY created DESC LIMIT 40 AS OF {T.BASE + 500 * T.HOUR}', mem(spark, d), None, NOW)


@query(f"""AND k AS (SELECT *, 1 - {cos_sql('embedding', VECTOR_SQL)} AS dist FROM m WHERE len(embedding) = 64 AND list_contains(tags, 'en')),
n AS (SELECT * FROM k ORDER BY round(dist, 9), id LIMIT 10)
SELECT id, round(0.7 * (1 - dist) + 0.3 * {DECAYED_SQL}, 6) AS score FROM n""")
def recall_near(spark, d):
    return run_query(f'RECALL NEAR [{", ".join(map(str, VECTOR))}] WHERE tag = "en" LIMIT 10', mem(spark, d, True), None, NOW).select("id", F.round("score", 6).alias("score"))


# --- vector, text and hybrid retrieval -----------------------------------------------------------------------------------


@query(f"SELECT id, round(1 - {cos_sql('embedding', VECTOR_SQL)}, 6) AS distance FROM m WHERE len(embedding) = 64 ORDER BY round(1 - {cos_sql('embedding', VECTOR_SQL)}, 9), id LIMIT 20")
def knn_cosine(spark, d):
    return retrieval.nearest(mem(spark, d, True), VECTOR, 20).select("id", F.round("distance", 6).alias("distance"))


@query(f"AND k AS (SELECT id, sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(embedding[i]::DOUBLE - {VECTOR_SQL}[i], 2)))) AS x FROM m WHERE len(embedding) = 64) SELECT id, round(x, 6) AS distance FROM k ORDER BY round(x, 9), id LIMIT 20")
def knn_euclidean(spark, d):
    return retrieval.nearest(mem(spark, d, True), VECTOR, 20, "euclidean").select("id", F.round("distance", 6).alias("distance"))


@query(f"AND k AS (SELECT id, -{DOT_SQL.format('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64) SELECT id, round(x, 6) AS distance FROM k ORDER BY round(x, 9), id LIMIT 20")
def knn_dot(spark, d):
    return retrieval.nearest(mem(spark, d, True), VECTOR, 20, "dot").select("id", F.round("distance", 6).alias("distance"))


@query(f"AND k AS (SELECT id, 1 - {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64 AND list_has_all(tags, ['en'])) SELECT id, round(x, 6) AS distance FROM k ORDER BY round(x, 9), id LIMIT 20")
def knn_filtered(spark, d):
    return retrieval.nearest(scans.with_all_tags(mem(spark, d, True), ["en"]), VECTOR, 20).select("id", F.round("distance", 6).alias("distance"))


BM25_SQL = f"""toks AS (SELECT id, {TOKENS_SQL.format("CASE WHEN context IS NULL OR context = '' THEN content ELSE concat(context, chr(10), content) END")} AS w FROM m),
lens AS (SELECT id, len(w) AS len FROM toks),
stat AS (SELECT count(*) AS n, avg(len) AS av FROM lens),
asked AS (SELECT w AS term, count(*) AS times FROM (SELECT unnest({TOKENS_SQL.format("'" + TEXT + "'")}) AS w) GROUP BY w),
tf AS (SELECT id, w AS term, count(*) AS tf FROM (SELECT id, unnest(w) AS w FROM toks) JOIN asked ON asked.term = w GROUP BY id, w),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT id, sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / av))) AS score
       FROM tf JOIN asked USING (term) JOIN df USING (term) JOIN lens USING (id) CROSS JOIN stat GROUP BY id)"""


@query(f"AND {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_top_k(spark, d):
    return retrieval.bm25(mem(spark, d), TEXT, 20).select("id", F.round("score", 6).alias("score"))


@query(f"AND {BM25_SQL} SELECT id, round(score, 6) AS score FROM bm JOIN m USING (id) WHERE memory_type = 'semantic' ORDER BY round(score, 9) DESC, id LIMIT 20")
def bm25_filtered(spark, d):
    m = mem(spark, d)
    return retrieval.bm25(m, TEXT, 20, m.where("memory_type = 'semantic'")).select("id", F.round("score", 6).alias("score"))


@query(f"AND toks AS (SELECT id, unnest({TOKENS_SQL.format('content')}) AS term FROM m) SELECT term, count(*) AS tf, count(DISTINCT id) AS df FROM toks GROUP BY term")
def posting_statistics(spark, d):
    p = mem(spark, d).select("id", F.explode(text.tokens(F.col("content"))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    return p.groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


def hybrid_sql(fetch: int, where: str = "true") -> str:
    return f"""near AS (SELECT id, row_number() OVER (ORDER BY round(x, 9), id) - 1 AS rank FROM (SELECT id, 1 - {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64 AND {where}) QUALIFY rank < {fetch}),
{BM25_SQL}, lex AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) - 1 AS rank FROM bm WHERE id IN (SELECT id FROM m WHERE {where}) QUALIFY rank < {fetch}),
rrf AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf FROM (SELECT * FROM near UNION ALL SELECT * FROM lex) GROUP BY id),
hy AS (SELECT id, 0.7 * rrf + 0.05 * salience + 0.01 AS score FROM rrf JOIN m USING (id))"""


@query(f"AND {hybrid_sql(40)} SELECT id, round(score, 6) AS score FROM hy")
def hybrid_rrf(spark, d):
    return retrieval.hybrid(mem(spark, d, True), VECTOR, TEXT, 40).select("id", F.round("score", 6).alias("score"))


@query(f"""AND {BM25_SQL}, near AS (SELECT id, -(1 - {cos_sql('embedding', VECTOR_SQL)}) AS c FROM m WHERE len(embedding) = 64 ORDER BY round(-c, 9), id LIMIT 40),
lex AS (SELECT id, score AS c FROM bm ORDER BY round(score, 9) DESC, id LIMIT 40),
both_legs AS (SELECT id, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) AS s FROM near UNION ALL SELECT id, (c - min(c) OVER ()) / (max(c) OVER () - min(c) OVER ()) FROM lex)
SELECT id, round(sum(s) + 0.1 * any_value(salience), 6) AS score FROM both_legs JOIN m USING (id) GROUP BY id""")
def hybrid_magnitude(spark, d):
    return retrieval.magnitude(mem(spark, d, True), VECTOR, TEXT, 40).select("id", F.round("score", 6).alias("score"))


@query(f"""AND {hybrid_sql(120)}, hits AS (SELECT * FROM hy ORDER BY round(score, 9) DESC, id LIMIT 30),
bad AS (SELECT DISTINCT target FROM e WHERE edge_type IN ('supersedes', 'contradicts') AND (valid_until IS NULL OR {NOW} < valid_until)),
sc AS (SELECT id, 0.7 * score + 0.3 * {DECAYED_SQL} AS score, [substring(x, 15) for x in tags if starts_with(x, 'scope:project:')][1] AS project
       FROM hits JOIN m USING (id) WHERE id NOT IN (SELECT target FROM bad) AND user_id IN ('u1', 'nil') AND {VALID_SQL.format('', NOW)}),
fin AS (SELECT id, CASE WHEN project IS NULL OR project = 'p1' THEN score ELSE 0.5 * score END AS score FROM sc)
SELECT id, round(score, 6) AS score FROM fin ORDER BY round(score, 9) DESC, id LIMIT 10""", edges=True)
def hybrid_recall_scoped(spark, d):
    ask = retrieval.Recall(VECTOR, TEXT, 10, NOW, user="u1", project="p1")
    return retrieval.recall(mem(spark, d, True), T.edges(spark, d), ask).select("id", F.round("score", 6).alias("score"))


def recall_sql(where: str = "true", at: int = NOW, owner: str = "true", project: str = "NULL") -> str:
    return f"""AND {hybrid_sql(120, where)}, hits AS (SELECT * FROM hy ORDER BY round(score, 9) DESC, id LIMIT 30),
bad AS (SELECT DISTINCT target FROM e WHERE edge_type IN ('supersedes', 'contradicts') AND (valid_until IS NULL OR {at} < valid_until)),
sc AS (SELECT id, 0.7 * score + 0.3 * {DECAYED_SQL} AS score, [substring(x, 15) for x in tags if starts_with(x, 'scope:project:')][1] AS project
       FROM hits JOIN m USING (id) WHERE id NOT IN (SELECT target FROM bad) AND {owner} AND {VALID_SQL.format('', at)})
SELECT id, round(CASE WHEN {project} IS NULL OR project IS NULL OR project = {project} THEN score ELSE 0.5 * score END, 6) AS score FROM sc ORDER BY 2 DESC, id LIMIT 10"""


@query(recall_sql("list_has_all(tags, ['en'])"), edges=True)
def recall_all_tags(spark, d):
    ask = retrieval.Recall(VECTOR, TEXT, 10, NOW, tags=("en",))
    return retrieval.recall(mem(spark, d, True), T.edges(spark, d), ask).select("id", F.round("score", 6).alias("score"))


@query(recall_sql(f"list_has_any(tags, ['fr', 'scope:project:p1']) AND created_at BETWEEN {T.BASE + 10 * T.HOUR} AND {T.BASE + 900 * T.HOUR}", T.BASE + 600 * T.HOUR, "user_id IN ('u1', 'u2', 'u3', 'nil') AND user_id IN ('u3', 'nil')", "'p2'"), edges=True)
def recall_any_tag_as_of(spark, d):
    ask = retrieval.Recall(VECTOR, TEXT, 10, NOW, at=T.BASE + 600 * T.HOUR, user="u3", project="p2", tags=("fr", "scope:project:p1"), any_tag=True, start=T.BASE + 10 * T.HOUR, end=T.BASE + 900 * T.HOUR)
    return retrieval.recall(mem(spark, d, True), T.edges(spark, d), ask).select("id", F.round("score", 6).alias("score"))


@query(f"""AND near AS (SELECT id, row_number() OVER (ORDER BY round(x, 9), id) - 1 AS rank FROM (SELECT id, 1 - {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64) QUALIFY rank < 120),
hits AS (SELECT id, 0.7 * (1.0::DOUBLE / (60 + rank)) + 0.05 * salience + 0.01 AS score FROM near JOIN m USING (id) ORDER BY round(0.7 * (1.0::DOUBLE / (60 + rank)) + 0.05 * salience + 0.01, 9) DESC, id LIMIT 30),
bad AS (SELECT DISTINCT target FROM e WHERE edge_type IN ('supersedes', 'contradicts') AND (valid_until IS NULL OR {NOW} < valid_until))
SELECT id, round(0.7 * score + 0.3 * {DECAYED_SQL}, 6) AS score FROM hits JOIN m USING (id) WHERE id NOT IN (SELECT target FROM bad) AND agent_id IN ('src1', 'nil') AND {VALID_SQL.format('', NOW)} ORDER BY 2 DESC, id LIMIT 10""", edges=True)
def recall_similar(spark, d):
    ask = retrieval.Recall(VECTOR, None, 10, NOW, agent="src1")
    return retrieval.recall(mem(spark, d, True), T.edges(spark, d), ask).select("id", F.round("score", 6).alias("score"))


@query(f"""AND near AS (SELECT id, 1 - {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64),
neg AS (SELECT id, 1 + {cos_sql('embedding', VECTOR_SQL)} AS x FROM m WHERE len(embedding) = 64),
runs AS (SELECT id, row_number() OVER (ORDER BY round(x, 9), id) - 1 AS rank FROM near QUALIFY rank < 30 UNION ALL SELECT id, row_number() OVER (ORDER BY round(x, 9), id) - 1 AS rank FROM neg QUALIFY rank < 30),
s AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS score FROM runs GROUP BY id)
SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, id LIMIT 20""")
def multi_query_rrf(spark, d):
    m = mem(spark, d, True)
    runs = [retrieval.nearest(m, v, 30).select("id", (-F.col("distance")).alias("score")) for v in (VECTOR, [-x for x in VECTOR])]
    return retrieval.merged(runs, 20).select("id", F.round("score", 6).alias("score"))


@query(f"""AND near AS (SELECT id, {cos_sql('embedding', VECTOR_SQL)} AS sim FROM m WHERE len(embedding) = 64 ORDER BY round(1 - sim, 9), id LIMIT 50),
k AS (SELECT id, created_at, sim, list_has_any({FRAME_SQL.format('content')}, ['edes', 'then', 'ation']) AS shared, memory_type FROM near JOIN m USING (id)),
s AS (SELECT id, created_at, (sim + CASE WHEN shared THEN 0.5 ELSE 0 END) * CASE memory_type WHEN 'episodic' THEN 0.3 WHEN 'semantic' THEN 0.5 WHEN 'reasoning' THEN 0.7 ELSE 1 END AS score FROM k WHERE sim >= 0.3 OR shared)
SELECT id, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, created_at DESC, id DESC LIMIT 10""")
def recall_for_action(spark, d):
    return retrieval.for_action(mem(spark, d, True), VECTOR, "edes then ation", 10).select("id", F.round("score", 6).alias("score"))


@query(f"""AND {BM25_SQL}, hits AS (SELECT * FROM bm ORDER BY round(score, 9) DESC, id LIMIT 30)
SELECT id, round(0.5 * score + 0.5 * len(list_intersect(list_distinct({TOKENS_SQL.format('content')}), list_distinct({TOKENS_SQL.format("'" + TEXT + "'")}))) / len(list_distinct({TOKENS_SQL.format("'" + TEXT + "'")})), 6) AS score FROM hits JOIN m USING (id)""")
def lexical_rerank(spark, d):
    m = mem(spark, d)
    return retrieval.lexical_rerank(retrieval.bm25(m, TEXT, 30), m, TEXT).select("id", F.round("score", 6).alias("score"))


@query()
def mmr_select(spark, d):
    m = mem(spark, d, True)
    hits = retrieval.nearest(m, VECTOR, 40).select("id", (1 - F.col("distance")).alias("score"))
    return analytics.diversified(hits, m, 10, 0.7)


@query(f"""AND h AS (SELECT id, {cos_sql('embedding', VECTOR_SQL)} AS score FROM m WHERE len(embedding) = 64 ORDER BY round(1 - {cos_sql('embedding', VECTOR_SQL)}, 9), id LIMIT 48),
r AS (SELECT id, score, max(score) OVER () AS best, memory_type, [substring(x, 15) for x in tags if starts_with(x, 'scope:project:')][1] AS project FROM h JOIN m USING (id) WHERE NOT list_has_any(tags, ['turn', 'scope:always'])),
f AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS k FROM r WHERE project IS NULL OR project = 'p1' OR (memory_type <> 'episodic' AND score >= 0.8 * best))
SELECT id, round(score, 6) AS score, k AS place FROM f WHERE k <= 3 OR score >= 0.55 * best ORDER BY k LIMIT 12""")
def inject_select(spark, d):
    m = mem(spark, d, True)
    hits = retrieval.nearest(m, VECTOR, 48).select("id", (1 - F.col("distance")).alias("score"))
    return analytics.injected(hits, m, VECTOR, "p1", 12).select("id", F.round("score", 6).alias("score"), F.col("place").cast("long").alias("place"))


@query(f"""AND h AS (SELECT id, {cos_sql('embedding', VECTOR_SQL)} AS score FROM m WHERE len(embedding) = 64 ORDER BY round(1 - score, 9), id LIMIT 20),
r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS k, lead(score) OVER (ORDER BY score DESC, id) AS nx FROM h),
f AS (SELECT *, CASE WHEN nx > 0 AND score / nx >= 1.02 THEN score / nx END AS f FROM r)
SELECT id, round(score, 6) AS score FROM f WHERE (SELECT max(f) FROM f) IS NULL OR k <= (SELECT k FROM f WHERE f IS NOT NULL ORDER BY f DESC, k LIMIT 1)""")
def knee_cutoff(spark, d):
    hits = retrieval.nearest(mem(spark, d, True), VECTOR, 20).select("id", (1 - F.col("distance")).alias("score"))
    return analytics.knee(hits, 1.02).select("id", F.round("score", 6).alias("score"))


# --- graph -----------------------------------------------------------------------------------------------------------------


def bfs_sql(types: str = "", depth: int = 4, start: str = "SELECT 150 AS id") -> str:
    where = f"WHERE edge_type IN ({types})" if types else ""
    return f"""g AS (SELECT DISTINCT source, target FROM e {where}), walk AS (SELECT id, 0 AS depth FROM ({start}) UNION SELECT g.target, depth + 1 FROM walk JOIN g ON g.source = walk.id WHERE depth < {depth}),
near AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"""


@query(f"AND {bfs_sql()} SELECT id, depth FROM near", edges=True, recursive=True)
def bfs(spark, d):
    return run_query("TRAVERSE 150 DEPTH 4", None, T.edges(spark, d), NOW)


@query(f"AND {bfs_sql(q_list(['part_of', 'derived', 'before', 'contradicts']), 5)} SELECT id, depth FROM near", edges=True, recursive=True)
def bfs_filtered(spark, d):
    e = T.edges(spark, d)
    return graph.reachable(e, graph.known(e, [150]), 5, ["part_of", "derived", "before", "contradicts"])


@query(f"AND {bfs_sql('', 3)} SELECT source, target, edge_type FROM e WHERE source IN (SELECT id FROM near) AND target IN (SELECT id FROM near)", edges=True, recursive=True)
def subgraph(spark, d):
    e = T.edges(spark, d)
    return graph.subgraph(e, graph.known(e, [150]), 3).select("source", "target", "edge_type")


@query("""AND g AS (SELECT DISTINCT source, target FROM e), walk AS (SELECT 187::BIGINT AS id, [187::BIGINT] AS path UNION ALL
SELECT g.target, list_append(path, g.target) FROM walk JOIN g ON g.source = walk.id WHERE len(path) <= 6 AND NOT list_contains(path, g.target))
SELECT array_to_string(path, '>') AS path, len(path) - 1 AS steps FROM walk WHERE id = 2 ORDER BY len(path), walk.path LIMIT 1""", edges=True, recursive=True)
def shortest_path(spark, d):
    p = graph.shortest_path(T.edges(spark, d), 187, 2, 6)
    return p.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"), (F.size("path") - 1).cast("long").alias("steps"))


@query("""AND c AS (SELECT source, target FROM e WHERE edge_type = 'contradicts'), s AS (SELECT source, target FROM e WHERE edge_type = 'supports'),
fr AS (SELECT source AS f FROM s WHERE target = 10 UNION SELECT target FROM s WHERE source = 10)
SELECT DISTINCT id FROM (SELECT target AS id FROM c WHERE source = 10 UNION SELECT source FROM c WHERE target = 10 UNION SELECT target FROM c WHERE source IN (SELECT f FROM fr)) WHERE id <> 10""", edges=True)
def contradictions(spark, d):
    return graph.contradictions(T.edges(spark, d), 10)


@query(f"AND {bfs_sql(q_list(['supersedes']), 20, 'SELECT 93 AS id')} SELECT id FROM near WHERE depth > 0", edges=True, recursive=True)
def superseded_closure(spark, d):
    return graph.superseded_by(T.edges(spark, d), 93)


@query("""AND f AS (SELECT source, arg_min(target, (created_at, target)) AS target FROM e WHERE edge_type = 'supersedes' GROUP BY source),
w AS (SELECT 0 AS depth, 93::BIGINT AS id, [93::BIGINT] AS path UNION ALL SELECT depth + 1, target, list_append(path, target) FROM w JOIN f ON source = id WHERE depth < 10 AND NOT list_contains(path, target))
SELECT depth::BIGINT AS depth, id FROM w""", edges=True, recursive=True)
def supersession_history(spark, d):
    return graph.history(T.edges(spark, d), 93, 10).withColumn("depth", F.col("depth").cast("long"))


@query()
def belief_propagation(spark, d):
    return graph.believed(T.edges(spark, d), mem(spark, d).select("id", "confidence"), 96).select("id", F.round("confidence", 6).alias("confidence"))


@query(f"""AND g AS (SELECT DISTINCT source, target FROM (SELECT source, target, edge_type FROM e UNION ALL SELECT target, source, edge_type FROM e WHERE source % 20 = 0) WHERE edge_type IN ({q_list(["part_of", "derived", "caused", "supports", "before"])})),
w AS (SELECT source AS f, target AS l, [source] AS path FROM g WHERE source <= target UNION ALL SELECT f, g.target, list_append(path, l) FROM w JOIN g ON g.source = l WHERE f <> l AND g.target >= f AND NOT list_contains(path, l) AND len(path) < 4)
SELECT DISTINCT array_to_string(list_sort(path), '>') AS nodes FROM w WHERE f = l""", edges=True, recursive=True)
def detect_cycles(spark, d):
    e = T.edges(spark, d)
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), "edge_type", "weight", "created_at", "valid_from", "valid_until").where("target % 20 = 0")
    return graph.cycles(e.union(back), ["part_of", "derived", "caused", "supports", "before"], 4).select(F.array_join(F.transform("nodes", lambda x: x.cast("string")), ">").alias("nodes"))


@query("SELECT edge_type, count(*) AS n FROM e GROUP BY edge_type", edges=True)
def edge_type_counts(spark, d):
    return graph.type_counts(T.edges(spark, d))


@query(f"SELECT count(*) FILTER (edge_type = 'contradicts') AS contradicts, count(*) FILTER (edge_type = 'supersedes') AS supersedes FROM e WHERE valid_until IS NULL OR {T.BASE + 300 * T.HOUR} < valid_until", edges=True)
def conflict_counts(spark, d):
    return graph.valid(T.edges(spark, d), T.BASE + 300 * T.HOUR).agg(F.count_if(F.col("edge_type") == "contradicts").alias("contradicts"), F.count_if(F.col("edge_type") == "supersedes").alias("supersedes"))


@query("SELECT source, target, edge_type, CASE WHEN source = 100 AND target = 50 THEN least(1.0, weight + 0.25) ELSE weight END AS weight FROM e WHERE edge_type <> 'before' AND source <> 60 AND target <> 60", edges=True)
def edge_mutations(spark, d):
    e = graph.strengthened(graph.without_types(T.edges(spark, d), ["before"]), 100, 50, 0.25)
    return graph.without_node(e, spark.createDataFrame([(60,)], "id long")).select("source", "target", "edge_type", "weight")


@query("""SELECT source, target, edge_type, valid_until FROM e UNION ALL
SELECT n.s, n.t, n.k, NULL FROM (VALUES (100::BIGINT, 50::BIGINT, 'supports'), (99, 49, 'contradicts'), (100, 999999, 'related'), (7, 8, 'related')) n(s, t, k)
WHERE s IN (SELECT id FROM m) AND t IN (SELECT id FROM m) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.source = n.s AND x.target = n.t AND x.edge_type = n.k AND x.valid_until IS NULL)""", edges=True)
def edge_inserts(spark, d):
    e = T.edges(spark, d)
    new = spark.createDataFrame([(100, 50, "supports"), (99, 49, "contradicts"), (100, 999999, "related"), (7, 8, "related")], "source long, target long, edge_type string")
    new = new.withColumns({"weight": F.lit(1.0), "created_at": F.lit(NOW), "valid_from": F.lit(None).cast("long"), "valid_until": F.lit(None).cast("long")})
    return graph.added(e, new, mem(spark, d)).select("source", "target", "edge_type", "valid_until")


# --- deduplication, inference, lifecycle -----------------------------------------------------------------------------------


PAIRS_SQL = f"""v AS (SELECT user_id, agent_id, id, embedding FROM m WHERE len(embedding) = 64),
sim AS (SELECT a.id AS a, b.id AS b, {cos_sql('a.embedding', 'b.embedding')} AS similarity FROM v a JOIN v b ON a.user_id = b.user_id AND a.agent_id = b.agent_id AND a.id < b.id)"""


@query(f"AND {PAIRS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM sim WHERE similarity >= 0.2")
def similar_pairs(spark, d):
    return lifecycle.similar_pairs(mem(spark, d, True), 0.2).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT a.id AS a, b.id AS b FROM m a JOIN m b ON a.user_id = b.user_id AND a.agent_id = b.agent_id AND a.id < b.id AND trim(a.content) = trim(b.content) WHERE list_contains(a.tags, 'scope:always') AND list_contains(b.tags, 'scope:always')")
def duplicate_rules(spark, d):
    return lifecycle.duplicate_rules(mem(spark, d, True))


@query(f"""AND {PAIRS_SQL}, s AS (SELECT id, list_distinct({FRAME_SQL.format('content')}) AS w, coalesce([x for x in tags if x = 'scope:global' or starts_with(x, 'scope:project:')][1], '') AS scope FROM m),
k AS (SELECT a AS id, b AS other, similarity FROM sim UNION ALL SELECT b, a, similarity FROM sim),
n AS (SELECT k.id, k.other FROM k JOIN s x ON x.id = k.id JOIN s y ON y.id = k.other AND x.scope = y.scope WHERE similarity >= 0.1 QUALIFY row_number() OVER (PARTITION BY k.id ORDER BY round(similarity, 9) DESC, k.other) <= 5)
SELECT DISTINCT least(n.id, other) AS a, greatest(n.id, other) AS b FROM n JOIN s x ON x.id = n.id JOIN s y ON y.id = n.other WHERE len(list_intersect(x.w, y.w)) / len(list_distinct(x.w || y.w)) >= 0.05""")
def duplicate_pairs(spark, d):
    return lifecycle.duplicates(mem(spark, d, True), 0.1, 0.05)


@query(f"AND {PAIRS_SQL} SELECT a, b, round(similarity, 6) AS similarity FROM sim JOIN m x ON x.id = a JOIN m y ON y.id = b WHERE similarity >= 0.25 AND x.content <> y.content")
def interference_pairs(spark, d):
    m = mem(spark, d, True)
    return analytics.interference(m, lifecycle.similar_pairs(m, 0.25)).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query()
def write_inference(spark, d):
    return lifecycle.write_actions(mem(spark, d, True), 0.1)


@query(f"""AND {PAIRS_SQL}, ep AS (SELECT id FROM m WHERE memory_type = 'episodic' AND {NOW} - created_at > {fixed.DAY}),
p AS (SELECT a, b, similarity FROM sim WHERE a IN (SELECT id FROM ep) AND b IN (SELECT id FROM ep) AND similarity > 0.1), u AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
r(id, c) AS (SELECT a, a FROM u UNION SELECT r.id, u.b FROM r JOIN u ON u.a = r.c), l AS (SELECT id, min(c) AS component FROM r GROUP BY id),
mean AS (SELECT component, avg(similarity) AS similarity FROM p JOIN l ON l.id = p.a GROUP BY component)
SELECT component, n, round(similarity, 6) AS similarity FROM (SELECT component, count(*) AS n FROM l GROUP BY component HAVING count(*) >= 2) JOIN mean USING (component)""", recursive=True)
def consolidation_candidates(spark, d):
    m = mem(spark, d, True).withColumn("access_count", F.col("access_count") + 3)
    return lifecycle.clusters(m, 0.1, 2, NOW, written).select("component", "n", F.round("similarity", 6).alias("similarity"))


@query(f"SELECT id, round({DECAYED_SQL}, 6) AS salience FROM m")
def decay_scores(spark, d):
    return lifecycle.decay(mem(spark, d), NOW).select("id", F.round("salience", 6).alias("salience"))


def decision_sql(salience: str) -> str:
    return f"SELECT id, CASE WHEN memory_type <> 'episodic' THEN 'keep' WHEN {salience} < 0.05 AND {NOW} - created_at > 30 * {fixed.DAY} AND access_count < 2 THEN 'delete' WHEN {salience} < 0.1 AND {NOW} - created_at > 7 * {fixed.DAY} THEN 'archive' ELSE 'keep' END AS decision FROM m"


@query(decision_sql(DECAYED_SQL))
def archival_decisions(spark, d):
    return lifecycle.decisions(mem(spark, d), NOW)


@query(decision_sql("salience"))
def archival_stored(spark, d):
    return lifecycle.decisions(mem(spark, d), NOW, False)


SENTENCE_SQL = "list_filter(list_transform(string_split(p, '.'), lambda s: trim(s)), lambda s: s <> '')"
FILLED_SQL = "trim(regexp_replace(list_reduce([s] || [" + q_list(fixed.FILLERS) + "], lambda t, f: CASE WHEN position(f IN lower(t)) > 0 THEN substring(t, 1, position(f IN lower(t)) - 1) || substring(t, position(f IN lower(t)) + length(f)) ELSE t END), '\\s+', ' ', 'g'))"


@query(f"""AND k AS (SELECT id, content, flatten(list_transform(string_split(content, chr(10) || chr(10)), lambda p: list_filter({SENTENCE_SQL}, lambda s, i: i = 1 OR {has_any('lower(s)', fixed.KEY_WORDS)}))) AS k FROM m),
c AS (SELECT id, content, array_to_string(list_distinct(list_filter(list_transform(k, lambda s: {FILLED_SQL}), lambda s: s <> '')), '. ') AS c FROM k)
SELECT id, length(c) AS length, round(strlen(c) / greatest(strlen(content), 1), 6) AS ratio FROM c""")
def compress(spark, d):
    return lifecycle.compressed(mem(spark, d)).select("id", F.length("content").cast("long").alias("length"), F.round("ratio", 6).alias("ratio"))


FACTS_SQL = "f AS (" + " UNION ALL ".join(
    f"SELECT id, confidence, trim(substring(s, 1, position('{p}' IN lower(s)) - 1)) AS subject, '{n}' AS predicate, trim(substring(s, position('{p}' IN lower(s)) + {len(p)})) AS object FROM s WHERE contains(lower(s), '{p}')"
    for p, n in fixed.FACT_PATTERNS
) + ")"
SENTENCES_SQL = "s AS (SELECT id, confidence, trim(unnest(string_split(content, '.'))) AS s FROM m)"


@query(f"AND {SENTENCES_SQL}, {FACTS_SQL} SELECT id, subject, predicate, object FROM f WHERE subject <> '' AND object <> ''")
def extract_facts(spark, d):
    return lifecycle.facts(mem(spark, d)).select("id", "subject", "predicate", "object")


@query(f"AND {SENTENCES_SQL}, {FACTS_SQL} SELECT id, subject, predicate, object FROM f WHERE subject <> '' AND object <> '' QUALIFY row_number() OVER (PARTITION BY lower(subject), predicate, lower(object) ORDER BY id, subject, object) = 1")
def dedup_facts(spark, d):
    return lifecycle.distinct_facts(lifecycle.facts(mem(spark, d))).select("id", "subject", "predicate", "object")


@query(f"""AND {SENTENCES_SQL}, {FACTS_SQL}, k AS (SELECT DISTINCT lower(subject) AS subject, predicate, lower(object) AS o FROM f WHERE subject <> '' AND object <> '')
SELECT x.subject, x.predicate, x.o AS a, y.o AS b FROM k x JOIN k y ON x.subject = y.subject AND x.predicate = y.predicate AND x.o < y.o""")
def contradicting_facts(spark, d):
    return lifecycle.contradicting_facts(lifecycle.facts(mem(spark, d)))


@query("""AND gone AS (SELECT id FROM m WHERE agent_id = 'src2' UNION SELECT unnest([1, 5, 999999]))
SELECT (SELECT count(*) FROM gone) AS memories, (SELECT count(*) FROM e WHERE source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)) AS edges""", edges=True)
def forget_plan(spark, d):
    return lifecycle.forget_plan(mem(spark, d), T.edges(spark, d), [1, 5, 999999], "src2")


@query("SELECT id, salience FROM (SELECT * FROM m WHERE list_contains(tags, 'scope:always') QUALIFY row_number() OVER (PARTITION BY trim(content) ORDER BY salience DESC, id) = 1) ORDER BY salience DESC, id LIMIT 10")
def pruned_rules(spark, d):
    return lifecycle.pruned_rules(mem(spark, d), 10)


def versions(spark, d):
    o = T.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("memory"), F.col("o_orderpriority").alias("agent"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"), F.col("o_orderkey").alias("version"), F.col("o_totalprice").alias("confidence"))


VERSIONS_SQL = "ver AS (SELECT o_custkey AS memory, o_orderpriority AS agent, epoch_us(o_orderdate) AS ts, o_orderkey AS version, o_totalprice AS confidence FROM orders)"


@query(f"AND {VERSIONS_SQL}, hit AS (SELECT DISTINCT a.memory, a.agent, a.ts FROM ver a JOIN ver b ON a.memory = b.memory AND a.agent <> b.agent AND abs(a.ts - b.ts) <= {3 * fixed.DAY}) SELECT memory, count(*) AS versions FROM hit GROUP BY memory")
def concurrent_conflicts(spark, d):
    return lifecycle.concurrent(versions(spark, d), 3 * fixed.DAY)


@query(f"AND {VERSIONS_SQL} SELECT memory, arg_max(version, (ts, version)) AS version FROM ver GROUP BY memory")
def latest_version(spark, d):
    return lifecycle.resolved(versions(spark, d), "keep_latest")


@query(f"AND {VERSIONS_SQL} SELECT memory, arg_max(version, (confidence, ts, version)) AS version FROM ver GROUP BY memory")
def most_confident_version(spark, d):
    return lifecycle.resolved(versions(spark, d), "keep_highest_confidence")


@query(f"""AND {VERSIONS_SQL}, v AS (SELECT memory, ts, row_number() OVER (PARTITION BY memory ORDER BY ts, version) AS version FROM ver), a AS (SELECT c_custkey AS memory, 820454400000000 + c_custkey % 1000 * {fixed.DAY} AS t FROM customer)
SELECT a.memory, a.t, max(v.version) AS version FROM a LEFT JOIN v ON v.memory = a.memory AND v.ts <= a.t GROUP BY a.memory, a.t""")
def version_as_of(spark, d):
    v = versions(spark, d).withColumn("version", F.row_number().over(Window.partitionBy("memory").orderBy("at", "version")).cast("long"))
    asks = T.table(spark, d, "customer").select(F.col("c_custkey").alias("memory"), (F.lit(820_454_400_000_000) + F.col("c_custkey") % 1000 * fixed.DAY).alias("t"))
    return lifecycle.version_at(v, asks)


# --- statistics, context, conversations ----------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (user_id = 'nil' AND agent_id = 'nil') AS everyone, count(*) FILTER (list_contains(tags, 'scope:always')) AS always FROM m WHERE NOT list_contains(tags, 'turn')")
def scope_counts(spark, d):
    return analytics.scope_counts(mem(spark, d), ["turn"])


@query("""AND r AS (SELECT * FROM m WHERE NOT list_contains(tags, 'turn')),
x AS (SELECT 'type' AS axis, memory_type AS name FROM r UNION ALL SELECT 'user', user_id FROM r WHERE user_id <> 'nil' UNION ALL SELECT 'agent', agent_id FROM r UNION ALL SELECT 'pair', concat_ws('|', user_id, agent_id) FROM r
UNION ALL SELECT 'project', [substring(x, 15) for x in tags if starts_with(x, 'scope:project:')][1] FROM r UNION ALL SELECT 'month', strftime(make_timestamp(created_at), '%Y-%m') FROM r)
SELECT axis, name, count(*) AS n FROM x WHERE name IS NOT NULL GROUP BY axis, name""")
def grouped_scope_counts(spark, d):
    return analytics.grouped_counts(mem(spark, d), ["turn"])


@query(f"AND h AS (SELECT {DECAYED_SQL} AS h, access_count FROM m) SELECT CAST(least(floor(h * 5), 4) AS BIGINT) AS bucket, count(*) AS n, round(avg(h), 6) AS mean, CAST(sum(access_count) AS BIGINT) AS accesses FROM h GROUP BY 1")
def stats_snapshot(spark, d):
    return analytics.health(mem(spark, d), NOW)


@query("SELECT DISTINCT user_id, agent_id FROM m")
def owner_pairs(spark, d):
    return analytics.owner_pairs(mem(spark, d))


def context_hits(m):
    return m.orderBy(F.desc("salience"), "id").limit(40).select("id", F.col("salience").alias("score"))


@query("""AND h AS (SELECT id, row_number() OVER (ORDER BY salience DESC, id) AS k, CAST(ceil(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) * 13 / 10) AS BIGINT) AS cost FROM m QUALIFY k <= 40),
w(k, room, took) AS (SELECT 0::BIGINT, 4096::BIGINT, false UNION ALL SELECT h.k, CASE WHEN cost <= room THEN room - cost ELSE room END, cost <= room FROM w JOIN h ON h.k = w.k + 1)
SELECT id, row_number() OVER (ORDER BY k) - 1 AS place, cost FROM w JOIN h USING (k) WHERE took""", recursive=True)
def context_window(spark, d):
    out = analytics.packed(context_hits(mem(spark, d)).join(mem(spark, d).select("id", "content"), "id"), 4096)
    return out.withColumn("place", F.col("place").cast("long"))


@query("""AND h AS (SELECT id, memory_type, salience, salience AS score FROM m ORDER BY salience DESC, id LIMIT 40)
SELECT id, CASE WHEN memory_type IN ('anti_pattern', 'correction') THEN 'opening' WHEN score >= 0.8 AND salience >= 0.7 THEN 'critical' WHEN score >= 0.5 THEN 'primary' WHEN score >= 0.2 THEN 'supporting' ELSE 'closing' END AS zone FROM h""")
def context_zones(spark, d):
    rows = context_hits(mem(spark, d)).join(mem(spark, d), "id")
    return rows.select("id", analytics.zone(F.col("memory_type"), F.col("score"), F.col("salience")).alias("zone"))


@query("SELECT id, CAST(ceil(len(list_filter(string_split_regex(content, '\\s+'), lambda w: w <> '')) * 13 / 10) AS BIGINT) AS tokens FROM m")
def token_estimates(spark, d):
    return mem(spark, d).select("id", text.estimate_tokens(F.col("content")).alias("tokens"))


@query("SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' ELSE 'unchanged' END AS change FROM (SELECT id FROM m WHERE id % 2 = 0) a FULL JOIN (SELECT id FROM m WHERE id % 3 = 0) b ON a.id = b.id")
def context_delta(spark, d):
    m = mem(spark, d)
    return analytics.delta(m.where("id % 2 = 0"), m.where("id % 3 = 0"))


TOPIC_SQL = "tp AS (SELECT conv_id, turn, lower(trim(regexp_replace(CASE WHEN length(text) > 100 THEN substring(text, 1, 100) || '...' ELSE text END, '\\s+', ' ', 'g'))) AS topic FROM t WHERE role = 'user'), tr AS (SELECT source, target, count(*) AS n FROM (SELECT lag(topic) OVER (PARTITION BY conv_id ORDER BY turn) AS source, topic AS target FROM tp) WHERE source IS NOT NULL GROUP BY source, target)"


@query(f"AND {TOPIC_SQL} SELECT source, target, n FROM tr -- t ")
def topic_transitions(spark, d):
    return analytics.transitions(analytics.topics(T.turns(spark, d)))


@query(f"AND {TOPIC_SQL} SELECT source, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS rank, target, n FROM tr QUALIFY rank <= 3 -- t ")
def next_topic(spark, d):
    return analytics.predicted(analytics.transitions(analytics.topics(T.turns(spark, d))), 3).withColumn("rank", F.col("rank").cast("long"))


def action_sql() -> str:
    table = ", ".join(f"('{k}', '{a}')" for k, a in fixed.ACTIONS)
    return f"SELECT conv_id, turn, k AS keyword, a AS action, substring(trim(list_filter(string_split(lower(text), '.'), lambda s: contains(s, k))[1]), 1, 200) AS detail FROM t , (VALUES {table}) x(k, a) WHERE contains(lower(text), k)"


@query(action_sql())
def detect_actions(spark, d):
    return analytics.actions(T.turns(spark, d))


@query(f"""AND w AS (SELECT conv_id, turn, lower(text) AS low, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS w FROM t )
SELECT conv_id, turn, round((len(list_filter(w, lambda x: {has_any('x', fixed.POSITIVE)})) - len(list_filter(w, lambda x: {has_any('x', fixed.NEGATIVE)}))) / greatest(len(w), 1), 6) AS sentiment,
{has_any('low', fixed.CORRECTIONS)} AS correction, {has_any('low', fixed.SPECULATION)} AS speculation FROM w""")
def actions_sentiment(spark, d):
    return analytics.moods(T.turns(spark, d))


@query("""AND sig(signal, intensity, triggers) AS (VALUES (1, 0.9::DOUBLE, ['the', 'tion']), (2, 0.5::DOUBLE, ['und', 'der', 'zzz'])),
w AS (SELECT conv_id, turn, list_distinct(list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM t ),
h AS (SELECT conv_id, turn, signal, intensity, len(triggers) AS n, len(list_filter(triggers, lambda g: len(list_filter(w, lambda x: contains(x, g))) > 0)) AS hit FROM w, sig)
SELECT conv_id, turn, signal, round(hit / n * intensity, 6) AS score FROM h WHERE hit > 0""")
def pain_warnings(spark, d):
    signals = spark.createDataFrame([(1, 0.9, ["the", "tion"]), (2, 0.5, ["und", "der", "zzz"])], "signal int, intensity double, triggers array<string>")
    return analytics.pains(F.broadcast(signals), T.turns(spark, d))


@query("""AND r AS (SELECT user_id, agent_id, id, [substring(x, 8) for x in tags if starts_with(x, 'entity:')][1] AS entity FROM m),
c AS (SELECT entity, id AS a, lead(id) OVER (PARTITION BY user_id, agent_id, entity ORDER BY id) AS b FROM r WHERE entity IS NOT NULL)
SELECT a, b, entity FROM c WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e WHERE edge_type = 'related' AND least(source, target) = a AND greatest(source, target) = b)""", edges=True)
def entity_links(spark, d):
    return analytics.entity_links(mem(spark, d), T.edges(spark, d))


@query("""SELECT [substring(x, 13) for x in tags if starts_with(x, 'entity_type:')][1] AS category, count(*) AS members, count(DISTINCT [substring(x, 8) for x in tags if starts_with(x, 'entity:')][1]) AS entities
FROM m WHERE [substring(x, 13) for x in tags if starts_with(x, 'entity_type:')][1] IS NOT NULL GROUP BY 1 HAVING count(*) >= 2""")
def entity_communities(spark, d):
    return analytics.communities(mem(spark, d))


@query(r"""AND g AS (SELECT conv_id, turn, unnest(list_distinct(regexp_extract_all(text, '(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)+)', 1) || regexp_extract_all(text, '"([^"]{2,40})"', 1))) AS term FROM t )
SELECT conv_id, turn, term FROM g WHERE lower(trim(regexp_replace(term, '\s+', ' ', 'g'))) <> 'the'""".replace("\\\\", "\\"))
def knowledge_gaps(spark, d):
    known = spark.createDataFrame([("the",)], "name string")
    return analytics.gaps(T.turns(spark, d), known)


@query(r"SELECT name, min(name) OVER (PARTITION BY lower(trim(regexp_replace(name, '\s+', ' ', 'g')))) AS canonical, 1.0::DOUBLE AS confidence FROM (SELECT DISTINCT p_name AS name FROM part)")
def entity_resolution(spark, d):
    names = T.table(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    aliases = names.groupBy(text.normal(F.col("name")).alias("alias")).agg(F.min("name").alias("canonical"), F.lit(1.0).alias("confidence"))
    return analytics.resolved_names(names, aliases)


# --- streams ---------------------------------------------------------------------------------------------------------------


@query(f"""AND conv AS (SELECT conv_id AS session, string_agg(text, ' ' ORDER BY turn) AS text FROM t GROUP BY conv_id),
f AS (SELECT item_id AS fact, text AS stated, list_filter(string_split_regex(lower(text), '\\s+'), lambda w: strlen(w) >= 3) AS w FROM benchmark),
r AS (SELECT session, fact, len(list_filter(w, lambda x: contains(lower(conv.text), x))) / len(w) AS ratio, contains(lower(conv.text), lower(stated)) AS verbatim, {has_any('lower(conv.text)', fixed.NEGATIONS)} AS negated FROM conv, f WHERE len(w) > 0),
k AS (SELECT session, fact, CASE WHEN ratio > 0.5 AND NOT verbatim AND negated THEN 'contradiction' WHEN ratio > 0.8 THEN 'reinforcement' END AS kind FROM r)
SELECT session, fact, kind FROM k WHERE kind IS NOT NULL -- t """)
def stream_alerts(spark, d):
    from .streaming.alerts import alerts

    t = T.turns(spark, d).groupBy(F.col("conv_id").alias("session")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    facts = T.table(spark, d, "benchmark").select(F.col("item_id").alias("fact"), F.col("text").alias("stated"))
    return alerts(t, facts)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_activity(spark, d):
    from .streaming.alerts import activity

    return activity(T.table(spark, d, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))
