"""Queries of the upkeep operators and of others that stand beside them, each with its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import analytics, graph, lifecycle, upkeep
from .queries import NOW, PAIRS_SQL, TOPIC_SQL, cos_sql, mem, query
from .sources import tables as T
from .sources.scratch import written

SCOPE_SQL = "coalesce(list_filter(x.tags, lambda s: s = 'scope:global' OR starts_with(s, 'scope:project:'))[1], '')"


@query(
    f"""AND {PAIRS_SQL}, p AS (SELECT a, b FROM sim WHERE similarity >= 0.25 UNION SELECT b, a FROM sim WHERE similarity >= 0.25),
r(id, c) AS (SELECT a, a FROM p UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.c), l AS (SELECT id, min(c) AS component FROM r GROUP BY id),
g AS (SELECT component, arg_min(m.id, m.created_at) AS id, count(*) - 1 AS forgotten, sum(access_count)::BIGINT AS access_count, max(salience) AS salience, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags
FROM l JOIN m ON m.id = l.id GROUP BY component) SELECT id, forgotten, access_count, salience, tags FROM g""",
    recursive=True,
)
def merged_duplicates(spark, d):
    m = mem(spark, d, True)
    return upkeep.merged(m, lifecycle.similar_pairs(m, 0.25), written).withColumn("tags", F.array_join("tags", ","))


@query(
    f"""AND {PAIRS_SQL}, sc AS (SELECT x.id, {SCOPE_SQL} AS scope FROM m x), ce AS (SELECT least(source, target) AS a, greatest(source, target) AS b FROM e WHERE edge_type IN ('contradicts', 'supersedes'))
SELECT sim.a, sim.b, round(similarity, 6) AS similarity FROM sim JOIN sc x ON x.id = sim.a JOIN sc y ON y.id = sim.b AND x.scope = y.scope ANTI JOIN ce ON ce.a = sim.a AND ce.b = sim.b WHERE similarity >= 0.1 AND similarity < 0.995""",
    edges=True,
)
def conflict_candidates(spark, d):
    m = mem(spark, d, True)
    return upkeep.conflict_candidates(m, T.edges(spark, d), 0.1).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT agent_id, count(*) AS memories, sum(strlen(content))::BIGINT AS bytes, round(greatest(count(*) / 1000.0::DOUBLE, sum(strlen(content)) / 1000000.0::DOUBLE) * 100, 4) AS percent, count(*) < 1000 AND sum(strlen(content)) < 1000000 AS can_write FROM m GROUP BY agent_id")
def quota_usage(spark, d):
    return upkeep.usage(mem(spark, d), 1000, 1_000_000)


@query("""SELECT n_name AS space, s_name AS agent, w AS wanted, coalesce(s_suppkey % 25 = n_nationkey AND s_suppkey < 25, false) OR CASE s_suppkey % 4 WHEN 0 THEN w = 'read' WHEN 1 THEN w = 'write' WHEN 2 THEN w <> 'admin' ELSE true END AND s_nationkey = n_nationkey AS allowed
FROM nation JOIN supplier ON s_suppkey % 5 = n_nationkey % 5, (VALUES ('read'), ('write'), ('read_write'), ('admin')) v(w)""")
def space_access(spark, d):
    n, s = T.table(spark, d, "nation"), T.table(spark, d, "supplier")
    wanted = F.explode(F.array(*map(F.lit, upkeep.GRANTS)))
    pairs = n.join(s, F.col("s_suppkey") % 5 == F.col("n_nationkey") % 5)
    asks = pairs.select(F.col("n_name").alias("space"), F.col("s_name").alias("agent"), wanted.alias("wanted"))
    own = s.where("s_suppkey < 25").join(n, F.col("s_suppkey") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("space"), F.col("s_name").alias("owner"))
    kind = F.element_at(F.array(*map(F.lit, upkeep.GRANTS)), (F.col("s_suppkey") % 4 + 1).cast("int"))
    entries = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("space"), F.col("s_name").alias("agent"), kind.alias("permission"))
    return upkeep.allowed(asks, own, entries)


@query("""AND n AS (SELECT unnest(['n1', 'n2', 'n3']) AS node),
b AS (SELECT id, node, list_transform(string_split(node || chr(31) || id, ''), lambda c: ascii(c)::UHUGEINT) AS bytes FROM m CROSS JOIN n),
h AS (SELECT id, node, list_reduce(list_prepend(14695981039346656037::UHUGEINT, bytes), lambda x, y: xor(x, y) * 1099511628211::UHUGEINT % 18446744073709551616::UHUGEINT) AS weight FROM b)
SELECT id AS key, arg_max(node, weight) AS node FROM h GROUP BY id""")
def rendezvous_owner(spark, d):
    return upkeep.rendezvous(mem(spark, d).select(F.col("id").alias("key")), ["n1", "n2", "n3"])


@query(f"""AND v AS (SELECT a.id, a.embedding AS x, b.embedding AS y, a.id % 3 = 0 AS related FROM m a JOIN m b ON b.id = a.id + 1 WHERE len(a.embedding) = 64 AND len(b.embedding) = 64),
s AS (SELECT related, {cos_sql('x', 'y')} AS similarity FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY related ORDER BY similarity) - 1 AS k, count(*) OVER (PARTITION BY related) AS n FROM s),
h AS (SELECT max(similarity) FILTER (related AND k = floor((n - 1) * 0.25::DOUBLE + 0.5)) AS p25, max(similarity) FILTER (NOT related AND k = floor((n - 1) * 0.95::DOUBLE + 0.5)) AS p95 FROM k)
SELECT round(p25, 6) AS p25, round(p95, 6) AS p95, round(greatest(p25 - 0.05, p95 + 0.02), 6) AS dedup FROM h""")
def calibrated_thresholds(spark, d):
    from .functions.vector import cosine

    m = mem(spark, d, True).where(F.size("embedding") > 0)
    both = m.select((F.col("id") + 1).alias("id"), F.col("embedding").alias("x"), (F.col("id") % 3 == 0).alias("related")).join(m.select("id", F.col("embedding").alias("y")), "id")
    out = upkeep.thresholds(both.select("related", cosine(F.col("x"), F.col("y")).alias("similarity")))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(f"AND {TOPIC_SQL} SELECT source, target, n - 1 + CASE WHEN n > 1 THEN 2 ELSE 0 END AS n FROM tr WHERE n > 1 -- t ")
def reinforced_transitions(spark, d):
    tr = analytics.transitions(analytics.topics(T.turns(spark, d)))
    return upkeep.reinforced(tr, tr.where("n > 1"))


@query("SELECT user_id, agent_id, id, substring(content, 1, 300) AS fact FROM m WHERE memory_type IN ('semantic', 'procedural') AND confidence >= 0.5 AND len(list_filter(tags, lambda s: starts_with(s, 'entity:') OR starts_with(s, 'community'))) = 0 QUALIFY row_number() OVER (PARTITION BY user_id, agent_id ORDER BY id) <= 100")
def profile_facts(spark, d):
    return upkeep.profile_facts(mem(spark, d))


@query(f"SELECT id, created_at FROM m WHERE memory_type = 'episodic' AND created_at > {T.BASE + 40 * T.HOUR} AND NOT list_contains(tags, 'source:enrichment')")
def enrichment_candidates(spark, d):
    return upkeep.enrichment_candidates(mem(spark, d), T.BASE + 40 * T.HOUR)


@query("AND k AS (SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS batch FROM t ) SELECT conv_id, batch, count(*) AS turns, min(turn) AS first, max(turn) AS last FROM k GROUP BY conv_id, batch")
def conversation_batches(spark, d):
    return upkeep.batches(T.turns(spark, d), 3)


@query("AND k AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) SELECT conv_id, turn, 'User: ' || text || CASE WHEN nr = 'assistant' THEN chr(10) || 'Assistant: ' || nt ELSE '' END AS content FROM k WHERE role = 'user' -- t ")
def episodic_turns(spark, d):
    return upkeep.episodes(T.turns(spark, d))


@query("SELECT id, concat_ws('|', 'M', memory_type, printf('%.2f', salience), content, 'tags:' || array_to_string(tags, ',')) AS line FROM m")
def serialized_compact(spark, d):
    return upkeep.served(mem(spark, d))


@query("SELECT id, '- **' || memory_type || '** ' || content || CASE WHEN len(tags) > 0 THEN ' _(' || array_to_string(tags, ',') || ')_' ELSE '' END AS line FROM m")
def serialized_structured(spark, d):
    return upkeep.served(mem(spark, d), "structured")


@query("SELECT id, CASE WHEN id % 3 <> 0 THEN '[NEW] ' || content WHEN id % 2 <> 0 THEN '[REMOVED] ' || id ELSE '[UNCHANGED] ' || id END AS line FROM m WHERE id % 3 = 0 OR id % 2 = 0")
def delta_text(spark, d):
    m = mem(spark, d)
    return upkeep.delta_lines(analytics.delta(m.where("id % 3 = 0"), m.where("id % 2 = 0")), m)


@query("SELECT id, access_count + 1 AS access_count, CASE WHEN id % 10 / 10.0::DOUBLE >= 0.6 THEN least(1.0::DOUBLE, salience + 0.05) ELSE salience END AS salience, id % 10 / 10.0::DOUBLE >= 0.6 AS used FROM m")
def injection_outcomes(spark, d):
    m = mem(spark, d)
    return upkeep.outcomes(m, m.select("id", (F.col("id") % 10 / 10).alias("reply")))


@query(f"SELECT id, CASE WHEN id % 4 = 0 THEN 1.0::DOUBLE ELSE salience END AS salience, CASE WHEN id % 4 = 0 THEN {NOW} ELSE accessed_at END AS accessed_at FROM m")
def decay_reset(spark, d):
    m = mem(spark, d)
    return upkeep.refreshed(m, m.where("id % 4 = 0").select("id"), NOW).select("id", "salience", "accessed_at")


@query()
def consolidated_memories(spark, d):
    m = mem(spark, d, True)
    out = lifecycle.consolidated(m, lifecycle.components(lifecycle.similar_pairs(m, 0.25), written))
    return out.select("component", F.sha2("content", 256).alias("content"), "confidence", F.transform("embedding", lambda v: F.round(v, 6)).alias("embedding"))


@query("""AND k AS (SELECT *, max(created_at) OVER w AS last_at, first_value(target) OVER (PARTITION BY source, edge_type ORDER BY created_at DESC, target DESC) AS last_target FROM e WINDOW w AS (PARTITION BY source, edge_type))
SELECT source, target, edge_type, CASE WHEN target = last_target AND created_at = last_at THEN weight ELSE 0.1 END AS weight, CASE WHEN target = last_target AND created_at = last_at THEN valid_until ELSE least(coalesce(valid_until, last_at), last_at) END AS valid_until FROM k""", edges=True)
def edge_states(spark, d):
    return graph.latest_states(T.edges(spark, d)).select("source", "target", "edge_type", "weight", "valid_until")


@query("SELECT p_partkey, regexp_replace(substring(regexp_replace(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 12), '-+$', '') AS slug FROM part")
def section_slugs(spark, d):
    return T.table(spark, d, "part").select("p_partkey", text.slug(F.concat("p_name", F.lit(" / "), "p_type"), 12).alias("slug"))


@query(r"""AND w AS (SELECT id, list_distinct(list_filter(string_split_regex(lower(content), '[^\p{L}\p{N}]+'), lambda s: strlen(s) > 3)) AS w FROM m)
SELECT y.id, round(CASE WHEN len(y.w) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(y.w, x.w)) / len(y.w) END, 6) AS covered FROM w x JOIN w y ON y.id = x.id + 1""")
def entailment(spark, d):
    m = mem(spark, d)
    both = m.select((F.col("id") + 1).alias("id"), F.col("content").alias("c")).join(m.select("id", "content"), "id")
    return both.select("id", F.round(upkeep.covered(F.col("content"), F.col("c")), 6).alias("covered"))
