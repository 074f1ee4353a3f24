"""Queries of the turn, cache, entity and space operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import fixed
from .operators import analytics, lifecycle, retrieval, turns
from .queries import BM25_SQL, NOW, TEXT, TOPIC_SQL, VECTOR, VECTOR_SQL, cos_sql, has_any, mem, query
from .sources import tables as T

FIRST_ENTITY = "[substring(x, 8) for x in tags if starts_with(x, 'entity:')][1]"


# --- edges, inferences, forgetting


@query("SELECT source, target, edge_type, weight FROM e WHERE edge_type IN ('contradicts', 'supersedes')", edges=True)
def conflict_edges(spark, d):
    return turns.conflict_edges(T.edges(spark, d))


@query("SELECT source, target, edge_type FROM e WHERE NOT (source = 100 AND target = 50)", edges=True)
def edge_pair_removed(spark, d):
    return turns.without_pair(T.edges(spark, d), 100, 50).select("source", "target", "edge_type")


@query("SELECT count(*) AS n FROM (SELECT id FROM m UNION SELECT source FROM e UNION SELECT target FROM e )", edges=True)
def node_count(spark, d):
    return turns.nodes(mem(spark, d), T.edges(spark, d)).agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN id % 6 = 1 THEN {NOW} ELSE valid_until END AS valid_until FROM m")
def invalidated(spark, d):
    m = mem(spark, d)
    return turns.invalidated(m, m.where("id % 6 = 1").select("id"), NOW).select("id", "valid_until")


ACTIONS_SQL = "a AS (SELECT CASE id % 4 WHEN 0 THEN 'relate' WHEN 1 THEN 'supersede' WHEN 2 THEN 'invalidate' ELSE 'invalidate_new' END AS action, id, id - 3 AS other, (id % 10) / 10.0::DOUBLE AS weight FROM m WHERE id > 3 AND id % 5 = 0)"
NEW_EDGES_SQL = f"""{ACTIONS_SQL}, ne AS (SELECT CASE WHEN action = 'invalidate_new' THEN other ELSE id END AS source, CASE WHEN action = 'invalidate_new' THEN id ELSE other END AS target, CASE WHEN action = 'relate' THEN 'related' ELSE 'supersedes' END AS edge_type,
CASE WHEN action = 'relate' THEN weight ELSE 1.0 END AS weight FROM a)"""


def actions(m):
    kind = F.element_at(F.array(*map(F.lit, ["relate", "supersede", "invalidate", "invalidate_new"])), (F.col("id") % 4 + 1).cast("int"))
    return m.where("id > 3 AND id % 5 = 0").select(kind.alias("action"), "id", (F.col("id") - 3).alias("other"), (F.col("id") % 10 / 10).alias("weight"))


@query(f"""AND {NEW_EDGES_SQL} SELECT source, target, edge_type, weight FROM e UNION ALL SELECT ne.* FROM ne
WHERE source IN (SELECT id FROM m) AND target IN (SELECT id FROM m) AND NOT EXISTS (SELECT 1 FROM e x WHERE x.source = ne.source AND x.target = ne.target AND x.edge_type = ne.edge_type AND x.valid_until IS NULL)""", edges=True)
def applied_edges(spark, d):
    m = mem(spark, d)
    return turns.applied(m, T.edges(spark, d), actions(m), NOW)[1].select("source", "target", "edge_type", "weight")


@query(f"AND {ACTIONS_SQL}, gone AS (SELECT CASE action WHEN 'invalidate' THEN other ELSE id END AS id FROM a WHERE action IN ('invalidate', 'invalidate_new')) SELECT id, CASE WHEN id IN (SELECT id FROM gone) THEN {NOW} ELSE valid_until END AS valid_until FROM m")
def applied_validity(spark, d):
    m = mem(spark, d)
    return turns.applied(m, T.edges(spark, d), actions(m), NOW)[0].select("id", "valid_until")


@query("SELECT 'memory' AS kind, id AS a, 0 AS b FROM m WHERE agent_id <> 'src2' UNION ALL SELECT 'edge', source, target FROM e WHERE source NOT IN (SELECT id FROM m WHERE agent_id = 'src2') AND target NOT IN (SELECT id FROM m WHERE agent_id = 'src2')", edges=True)
def forgotten(spark, d):
    m = mem(spark, d)
    left, e = turns.forgotten(m, T.edges(spark, d), m.where("agent_id = 'src2'"))
    return left.select(F.lit("memory").alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b")).union(e.select(F.lit("edge"), "source", "target"))


@query("""AND gone AS (SELECT id FROM m WHERE agent_id = 'src2' UNION SELECT unnest([1, 5, 999999]))
SELECT 'FORGET REQUEST at timestamp 7' || chr(10) || 'Reason: asked' || chr(10) || 'Agent: src2' || chr(10) || 'Specific IDs: 3' || chr(10) || 'Result: ' || (SELECT count(*) FROM gone) || ' memories, ' || (SELECT count(*) FROM e WHERE source IN (SELECT id FROM gone) OR target IN (SELECT id FROM gone)) || ' edges, 0 facts deleted' || chr(10) AS log""", edges=True)
def forget_audit(spark, d):
    plan = lifecycle.forget_plan(mem(spark, d), T.edges(spark, d), [1, 5, 999999], "src2")
    return turns.audit_log(plan, 7, "asked", "src2", 3)


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE len(tags) END AS n FROM m")
def tags_cleared(spark, d):
    m = mem(spark, d)
    return turns.untagged(m, m.where("id % 7 = 0")).select("id", F.size("tags").cast("long").alias("n"))


@query("SELECT 'type' AS axis, memory_type AS name, count(*) AS n FROM m WHERE id % 4 <> 1 AND NOT list_contains(tags, 'turn') GROUP BY memory_type")
def counts_applied(spark, d):
    """Counts of three quarters of the memories, after a quarter came and another went."""
    m = mem(spark, d)
    old, new, gone = (analytics.grouped_counts(m.where(w), ["turn"]) for w in ("id % 4 < 3 AND id % 4 <> 0 OR id % 4 = 0", "id % 4 = 3", "id % 4 = 1"))
    return turns.applied_counts(old, new, gone).where("axis = 'type'")


@query("SELECT id FROM m WHERE salience < 0.05")
def needs_archival(spark, d):
    return mem(spark, d).where(F.col("salience") < 0.05).select("id")


@query("SELECT o_custkey AS memory, o_orderkey AS version, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders")
def version_history(spark, d):
    from pyspark.sql import Window

    o = T.table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("memory"), F.col("o_orderkey").alias("version"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("place"))


# --- context of a turn


TOP_SQL = f"hits AS (SELECT id, {cos_sql('embedding', VECTOR_SQL)} AS score FROM m WHERE len(embedding) = 64 ORDER BY round(1 - {cos_sql('embedding', VECTOR_SQL)}, 9), id LIMIT 10)"


def top(m):
    return retrieval.nearest(m, VECTOR, 10).select("id", (1 - F.col("distance")).alias("score"))


@query(f"AND {TOP_SQL} SELECT id, round(score, 6) AS score FROM hits UNION ALL SELECT id, 0.85::DOUBLE FROM m WHERE list_contains(tags, 'scope:always') AND user_id IN ('u1', 'nil') AND id NOT IN (SELECT id FROM hits)")
def turn_context(spark, d):
    m = mem(spark, d, True)
    return turns.turn_context(top(m), m, "u1", None).select("id", F.round("score", 6).alias("score"))


@query(f"""AND {BM25_SQL}, top AS (SELECT id, score FROM bm ORDER BY round(score, 9) DESC, id LIMIT 200),
named AS (SELECT id FROM m WHERE len([x for x in tags if x IN ('entity:tell', 'entity:me', 'entity:of', 'entity:e1', 'entity:and', 'entity:e22')]) > 0),
reached AS (SELECT DISTINCT target FROM e WHERE edge_type = 'derived' AND source IN (SELECT id FROM named))
SELECT id, round(score + CASE WHEN id IN (SELECT target FROM reached) THEN 0.15 ELSE 0 END, 6) AS score FROM top""", edges=True)
def entity_boost(spark, d):
    m = mem(spark, d)
    return turns.boosted(retrieval.bm25(m, TEXT, 200), m, T.edges(spark, d), "Tell me of E1 and e22").select("id", F.round("score", 6).alias("score"))


MODES_SQL = f"""mm AS (SELECT id, embedding, user_id, valid_from, valid_until, CASE WHEN id % 5 = 0 THEN 'a' WHEN id % 5 = 1 THEN 'b' END AS rule, CASE WHEN id % 7 = 2 THEN 'b' END AS exemplar FROM m WHERE len(embedding) = 64 OR id % 5 < 2)"""


@query(f"""AND {MODES_SQL}, v AS (SELECT *, CASE WHEN len(embedding) = 64 THEN {cos_sql('embedding', 'qv')} END AS near FROM mm, (SELECT embedding AS qv FROM m WHERE id = 5) WHERE (coalesce(valid_from, 0) <= {NOW} AND (valid_until IS NULL OR {NOW} < valid_until))),
md AS (SELECT 'a' AS mode, (SELECT max(near) FROM v WHERE rule = 'a') AS act UNION ALL SELECT 'b', (SELECT max(near) FROM v WHERE exemplar = 'b'))
SELECT v.id, round(act, 6) AS activation FROM v JOIN md ON rule = mode WHERE act >= 0.40 ORDER BY round(act, 9) DESC, v.id LIMIT 4""")
def rule_activation(spark, d):
    """Two modes, one with exemplars; the query is the vector of a rule of the other, which is so active."""
    m = mem(spark, d, True).where("size(embedding) = 64 OR id % 5 < 2")
    tags = F.filter(F.array(F.when(F.col("id") % 5 == 0, "trigger:a").when(F.col("id") % 5 == 1, "trigger:b"), F.when(F.col("id") % 7 == 2, "mode-exemplar:b")), lambda t: t.isNotNull())
    asked = list(m.where("id = 5").select("embedding").first()[0])
    return turns.activated_rules(m.withColumn("tags", tags), asked, NOW).select("id", F.round("activation", 6).alias("activation"))


@query("SELECT x.id AS a, y.id AS b, 'Note: Memory A: \"' || x.content || '\" (created ' || x.created_at || '), Memory B: \"' || y.content || '\" (created ' || y.created_at || '). Do not confuse.' AS note FROM m x JOIN m y ON y.id = x.id + 1 WHERE x.id % 3 = 0")
def disambiguation(spark, d):
    m = mem(spark, d)
    return turns.disambiguation(m, m.where("id % 3 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))


def zone_case() -> str:
    return "CASE zone " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in turns.ZONE_LABELS.items()) + " END"


@query(f"AND z AS (SELECT id, CASE WHEN memory_type IN ('anti_pattern', 'correction') THEN 'opening' WHEN salience >= 0.8 THEN 'critical' WHEN salience >= 0.5 THEN 'primary' WHEN salience >= 0.2 THEN 'supporting' ELSE 'closing' END AS zone FROM m) SELECT id, {zone_case()} AS label FROM z")
def zone_labels(spark, d):
    z = analytics.zone(F.col("memory_type"), F.col("salience"), F.col("salience"))
    table = F.create_map(*[F.lit(x) for kv in turns.ZONE_LABELS.items() for x in kv])
    return mem(spark, d).select("id", F.element_at(table, z).alias("label"))


# --- trajectory


@query("SELECT conv_id, turn FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 -- t ")
def recent_turns(spark, d):
    return turns.recent_turns(T.turns(spark, d), 3).select("conv_id", "turn")


@query(f"""AND {TOPIC_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM tp),
r AS (SELECT conv_id, string_agg(topic, ' → ' ORDER BY turn) AS ts FROM k WHERE k BETWEEN 2 AND 4 GROUP BY conv_id)
SELECT conv_id, 'You were working on: ' || topic || ' Status: Completed.' || coalesce(' Recent trajectory: ' || ts, '') AS resume FROM k LEFT JOIN r USING (conv_id) WHERE k = 1 -- t """)
def resume_context(spark, d):
    return turns.resume_context(analytics.topics(T.turns(spark, d)))


@query(f"""AND {TOPIC_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM tp),
lr AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS rank, target FROM tr),
p AS (SELECT conv_id, 0 AS a, rank AS b, target AS topic FROM k JOIN lr ON topic = source WHERE k = 1 AND rank <= 3
  UNION ALL SELECT conv_id, 2, 0, topic || ' (continued)' FROM k WHERE k = 1 UNION ALL SELECT conv_id, 3, 0, topic || ' (revisit)' FROM k WHERE k = 2),
f AS (SELECT conv_id, topic, min((a, b)) AS ab FROM p GROUP BY conv_id, topic)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY ab, topic) AS place, topic FROM f QUALIFY place <= 3 -- t """)
def predicted_topics(spark, d):
    topics = analytics.topics(T.turns(spark, d))
    learned = analytics.predicted(analytics.transitions(topics), 3)
    return turns.next_topics(topics, learned).withColumn("place", F.col("place").cast("long"))


@query(f"AND {TOPIC_SQL} SELECT topic FROM (SELECT source AS topic FROM tr UNION SELECT target FROM tr UNION SELECT 'billing') -- t ")
def known_topics(spark, d):
    aliases = spark.createDataFrame([("invoices", "billing")], "alias string, canonical string")
    return turns.known_topics(analytics.transitions(analytics.topics(T.turns(spark, d))), aliases)


@query(f"AND {TOPIC_SQL} SELECT topic, max(conv_id * 1000 + turn) AS seen FROM tp WHERE topic NOT IN (SELECT source FROM tr) GROUP BY topic ORDER BY seen DESC, topic LIMIT 20 -- t ")
def pending_topics(spark, d):
    topics = analytics.topics(T.turns(spark, d))
    known = analytics.transitions(topics).select(F.col("source").alias("topic")).distinct()
    none = spark.createDataFrame([], "alias string, canonical string")
    return turns.pending_topics(topics.withColumn("seen", F.col("conv_id") * 1000 + F.col("turn")), known, none, 20)


ACTION_KEYS = [k for k, _ in fixed.ACTIONS]


@query(f"SELECT conv_id, turn, 'Unconfirmed: ' || substring(text, 1, 300) AS content, 0.3::DOUBLE AS confidence FROM t WHERE {has_any('lower(text)', [*fixed.SPECULATION, 'the'])} AND {has_any('lower(text)', ACTION_KEYS)}")
def ghost_memories(spark, d):
    """With one frequent word as a further sign of speculation, for the table's turns hardly speculate."""
    t = T.turns(spark, d)
    return turns.ghosts(t, [*fixed.SPECULATION, "the"], analytics.actions(t)).drop("tags")


# --- speculative cache


WORDS_SQL = "list_distinct(list_filter(string_split_regex(lower({0}), '\\s+'), lambda w: w <> ''))"
CACHE_SQL = f"""c AS (SELECT topic, min(conv_id) AS created_at, max(turn) AS last_accessed, 0 AS hit_count FROM tp GROUP BY topic),
q AS (SELECT conv_id AS ask, topic AS query FROM tp WHERE turn > 1),
j AS (SELECT ask, c.topic, created_at, len(list_intersect({WORDS_SQL.format('query')}, {WORDS_SQL.format('c.topic')})) / len(list_distinct({WORDS_SQL.format('query')} || {WORDS_SQL.format('c.topic')})) AS score FROM q, c),
h AS (SELECT ask, topic, score FROM j WHERE score > 0.5 QUALIFY row_number() OVER (PARTITION BY ask ORDER BY score DESC, created_at, topic) = 1)"""


def cache_of(topics):
    return topics.groupBy("topic").agg(F.min("conv_id").alias("created_at"), F.max("turn").alias("last_accessed"), F.lit(0).cast("long").alias("hit_count"))


def asks_of(topics):
    return topics.where("turn > 1").select(F.col("conv_id").alias("ask"), F.col("topic").alias("query"))


@query(f"AND {TOPIC_SQL}, {CACHE_SQL} SELECT ask, topic, round(score, 6) AS score FROM h -- t ")
def cache_hits(spark, d):
    topics = analytics.topics(T.turns(spark, d))
    return turns.cache_hits(asks_of(topics), cache_of(topics)).select("ask", "topic", F.round("score", 6).alias("score"))


@query(f"""AND {TOPIC_SQL}, {CACHE_SQL}, n AS (SELECT topic, count(*) AS n FROM h GROUP BY topic),
u AS (SELECT c.topic, created_at, CASE WHEN n > 0 THEN 1000 ELSE last_accessed END AS last_accessed, hit_count + coalesce(n, 0) AS hit_count FROM c LEFT JOIN n USING (topic) WHERE 1000 - created_at <= 990)
SELECT * FROM u ORDER BY last_accessed DESC, created_at DESC, topic LIMIT 50 -- t """)
def cache_after_hits(spark, d):
    topics = analytics.topics(T.turns(spark, d))
    cache = cache_of(topics)
    kept = turns.without_stale(turns.accessed(cache, turns.cache_hits(asks_of(topics), cache), 1000), 990, 1000)
    return turns.without_least_recent(kept, 50)


@query(f"AND {TOPIC_SQL}, {CACHE_SQL} SELECT (SELECT count(*) FROM h) AS hits, (SELECT count(*) FROM q) - (SELECT count(*) FROM h) AS misses, (SELECT count(*) FROM c) AS size -- t ")
def cache_stats(spark, d):
    topics = analytics.topics(T.turns(spark, d))
    return turns.cache_stats(asks_of(topics), turns.cache_hits(asks_of(topics), cache_of(topics)), cache_of(topics))


# --- phantoms and pains


@query(r"""AND w AS (SELECT p_partkey, regexp_replace(trim(x), '[.,;:!?]+$', '') AS t FROM part, (VALUES (p_name), (lower(p_name)), (p_type || '. ' || p_brand), ('k=' || p_name), (p_brand || '!'), (lower(split_part(p_name, ' ', 1)))) v(x))
SELECT p_partkey, t AS term, length(regexp_replace(t, '[^\p{L}]', '', 'g')) >= 2 AND length(t) <= 40 AND NOT contains(t, '=') AND NOT regexp_matches(t, '[.,;:] ')
AND NOT (len(list_filter(string_split_regex(t, '\s+'), lambda s: s <> '')) = 1 AND regexp_matches(t, '^\p{Ll}')) AS entity FROM w""")
def entity_like(spark, d):
    forms = F.array("p_name", F.lower("p_name"), F.concat("p_type", F.lit(". "), "p_brand"), F.concat(F.lit("k="), "p_name"), F.concat("p_brand", F.lit("!")), F.lower(F.element_at(F.split("p_name", " "), 1)))
    rows = T.table(spark, d, "part").select("p_partkey", F.explode(forms).alias("x"))
    return rows.select("p_partkey", F.regexp_replace(F.trim("x"), "[.,;:!?]+$", "").alias("term"), turns.entity_like(F.col("x")).alias("entity"))


PHANTOMS_SQL = "p AS (SELECT p_partkey AS id, p_name AS reference, p_size AS priority, p_partkey % 3 = 0 OR p_partkey % 10 = 1 AS resolved FROM part)"


def phantoms(spark, d):
    p = T.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("reference"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 3 == 0).alias("resolved"))
    return turns.resolved_phantoms(p, p.where("id % 10 = 1"))


@query(f"AND {PHANTOMS_SQL} SELECT id, priority FROM p WHERE NOT resolved")
def active_phantoms(spark, d):
    return turns.active_phantoms(phantoms(spark, d)).select("id", "priority")


@query(f"AND {PHANTOMS_SQL} SELECT id, 'WARNING: User referenced ''' || reference || ''' but no details stored. Consider asking.' AS line FROM p WHERE NOT resolved ORDER BY priority DESC, id LIMIT 5")
def phantom_warnings(spark, d):
    return turns.phantom_lines(phantoms(spark, d))


PAINS_SQL = f"p AS (SELECT s_suppkey AS signal, s_name AS description, (s_suppkey % 17) / 16.0::DOUBLE * exp(-2e-13::DOUBLE * greatest(0, {NOW} - ({T.BASE} + s_suppkey * {T.HOUR}))) AS intensity, [s_name, 'x'] AS triggers FROM supplier)"


def pains(spark, d):
    s = T.table(spark, d, "supplier")
    rows = s.select(F.col("s_suppkey").alias("signal"), F.col("s_name").alias("description"), (F.col("s_suppkey") % 17 / 16).alias("intensity"), F.array("s_name", F.lit("x")).alias("triggers"), (F.lit(T.BASE) + F.col("s_suppkey") * T.HOUR).alias("created_at"), F.lit(2e-13).alias("decay_rate"))
    return turns.decayed_pains(rows, NOW)


@query(f"AND {PAINS_SQL} SELECT signal, round(intensity, 9) AS intensity FROM p")
def pain_decay(spark, d):
    return pains(spark, d).select("signal", F.round("intensity", 9).alias("intensity"))


@query(f"AND {PAINS_SQL} SELECT signal, printf('CAUTION: %s (pain: %.2f). Triggers: [%s]', description, intensity, array_to_string(triggers, ', ')) AS line FROM p ORDER BY intensity DESC, signal LIMIT 5")
def pain_lines(spark, d):
    return turns.pain_lines(pains(spark, d))


# --- entities, enrichment, spaces


@query(f"SELECT DISTINCT user_id, agent_id, trim(lower(substring(x, 8))) AS entity FROM (SELECT user_id, agent_id, unnest(tags) AS x FROM m) WHERE starts_with(x, 'entity:')")
def entity_names(spark, d):
    return turns.entity_names(mem(spark, d))


@query("AND f AS (SELECT least(a, b) AS a, greatest(a, b) AS b FROM (SELECT n_name AS a, r_name AS b FROM nation JOIN region ON n_nationkey % 5 = r_regionkey) WHERE a <> b) SELECT r_name AS a, n_name AS b FROM region, nation WHERE EXISTS (SELECT 1 FROM f WHERE f.a = least(r_name, n_name) AND f.b = greatest(r_name, n_name))")
def known_different(spark, d):
    n, r = T.table(spark, d, "nation"), T.table(spark, d, "region")
    marked = turns.marked_different(n.join(r, F.col("n_nationkey") % 5 == F.col("r_regionkey")).select(F.col("n_name").alias("a"), F.col("r_name").alias("b")))
    asks = n.select("n_name").crossJoin(F.broadcast(r.select("r_name"))).select(F.col("r_name").alias("a"), F.col("n_name").alias("b"))  # 25 x 5 names
    return turns.known_different(asks, marked)


@query("SELECT id, least(confidence, 0.7::DOUBLE) AS confidence, array_to_string(tags || ['source:enrichment'], ',') AS tags FROM m WHERE memory_type = 'semantic'")
def enrichment_stored(spark, d):
    m = mem(spark, d)
    rows, _ = turns.enriched(m.where("memory_type = 'semantic'"), m.select("id", (F.col("id") - 1).alias("source")), NOW)
    return rows.select("id", "confidence", F.array_join("tags", ",").alias("tags"))


@query("SELECT id AS source, id - 1 AS target, 'derived' AS edge_type, 0.8::DOUBLE AS weight FROM m WHERE memory_type = 'semantic'")
def enrichment_edges(spark, d):
    m = mem(spark, d)
    return turns.enriched(m.where("memory_type = 'semantic'"), m.select("id", (F.col("id") - 1).alias("source")), NOW)[1].drop("created_at")


@query("SELECT user_id, agent_id, max(created_at) AS created_at FROM m WHERE list_contains(tags, 'scope:always') GROUP BY user_id, agent_id")
def profile_owners(spark, d):
    """Standing rules stand in for profiles."""
    m = mem(spark, d).withColumn("tags", F.transform("tags", lambda t: F.when(t == "scope:always", "user_profile").otherwise(t)))
    return turns.profile_owners(m)


@query("SELECT id, content || CASE WHEN id % 2 = 0 THEN ' [entities: ' || agent_id || ']' ELSE '' END || CASE WHEN len(tags) > 0 THEN ' [topics: ' || array_to_string(tags, ', ') || ']' ELSE '' END AS key FROM m")
def embedding_keys(spark, d):
    none = F.array().cast("array<string>")
    return mem(spark, d).select("id", turns.embedding_key(F.col("content"), F.when(F.col("id") % 2 == 0, F.array("agent_id")).otherwise(none), F.col("tags"), none).alias("key"))


@query("""AND old AS (SELECT n_name AS space, s_name AS agent, 'read' AS permission FROM supplier JOIN nation ON s_nationkey = n_nationkey),
nw AS (SELECT n_name AS space, s_name AS agent, 'admin' AS permission FROM supplier JOIN nation ON s_suppkey % 25 = n_nationkey),
g AS (SELECT * FROM nw UNION ALL SELECT * FROM old WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.space = old.space AND nw.agent = old.agent))
SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 4 = 0 AND s_name = agent)""")
def space_grants(spark, d):
    s, n = T.table(spark, d, "supplier"), T.table(spark, d, "nation")

    def entries(on, kind):
        return s.join(n, on).select(F.col("n_name").alias("space"), F.col("s_name").alias("agent"), F.lit(kind).alias("permission"))

    both = turns.granted(entries(F.col("s_nationkey") == F.col("n_nationkey"), "read"), entries(F.col("s_suppkey") % 25 == F.col("n_nationkey"), "admin"))
    return turns.revoked(both, both.join(s.where("s_suppkey % 4 = 0").select(F.col("s_name").alias("agent")), "agent"))


@query("SELECT DISTINCT n_name AS space FROM nation, supplier WHERE s_name = (SELECT min(s_name) FROM supplier) AND (s_suppkey % 25 = n_nationkey OR s_nationkey = n_nationkey)")
def agent_spaces(spark, d):
    s, n = T.table(spark, d, "supplier"), T.table(spark, d, "nation")
    owners = s.join(n, F.col("s_suppkey") % 25 == F.col("n_nationkey")).select(F.col("n_name").alias("space"), F.col("s_name").alias("owner"))
    entries = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("space"), F.col("s_name").alias("agent"), F.lit("read").alias("permission"))
    none = entries.limit(0)
    owners, made = turns.created_spaces(owners.limit(0), none, owners)
    return turns.spaces_of(owners, turns.granted(made, entries), s.agg(F.min("s_name")).collect()[0][0])
