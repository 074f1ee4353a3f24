"""Turns and what they leave behind: context of a turn, trajectory, speculative cache, phantoms and pains, entity upkeep,
rule activation, applied inferences, forgetting, spaces (of D11-D31, K2-K66, T2-T15, I7, Q18, L3-L23, G18-G32, F19-F31).

State is a table that goes in and comes out; instants are given. Null ids or names match nothing; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import first_tag, valid_at, visible
from ..functions.vector import cosine, literal
from ..sources.scratch import written
from . import analytics, graph

# Labels of the zones, in their order.
ZONE_LABELS = {"opening": "⚠️ Warnings & Corrections", "critical": "🎯 Critical Context", "primary": "📋 Primary Context", "supporting": "📎 Supporting Context", "closing": "🔁 Summary & Reinforcement"}
STANDING, CACHED, BOOST, GATE, RULES = 0.85, 0.9, 0.15, 0.40, 4


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of `new`, and those of `old` whose keys it does not have; both of one schema, `new` without repeated keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


# --- edges and applied inferences


def without_pair(e: DataFrame, source: int, target: int) -> DataFrame:
    """All edges from source to target go."""
    return e.where(~((F.col("source") == source) & (F.col("target") == target)))


def conflict_edges(e: DataFrame) -> DataFrame:
    return e.where(F.col("edge_type").isin("contradicts", "supersedes")).select("source", "target", "edge_type", "weight")


def nodes(m: DataFrame, e: DataFrame) -> DataFrame:
    """Registered nodes: the memories, and ends of edges."""
    return m.select("id").union(e.select("source")).union(e.select("target")).distinct()


def invalidated(m: DataFrame, ids: DataFrame, at: int) -> DataFrame:
    """Sets valid_until of the rows named in ids (id)."""
    gone = ids.select("id", F.lit(True).alias("_gone")).distinct()
    return m.join(gone, "id", "left").withColumn("valid_until", F.when(F.col("_gone"), F.lit(at)).otherwise(F.col("valid_until"))).drop("_gone")


def applied(m: DataFrame, e: DataFrame, actions: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Memories and edges after inferred actions (action, id, other, weight): `relate` adds a related edge of that weight,
    `supersede` and `invalidate` a supersedes edge from id to other, `invalidate_new` one from other to id, and the
    invalidated end of the last two ends now. An open edge that exists already is not added again."""
    a = actions.where("id IS NOT NULL AND other IS NOT NULL")
    back = F.col("action") == "invalidate_new"
    ends = a.where("action IN ('invalidate', 'invalidate_new')").select(F.when(back, F.col("id")).otherwise(F.col("other")).alias("id"))
    kind = F.when(F.col("action") == "relate", "related").when(F.col("action").isin("supersede", "invalidate", "invalidate_new"), "supersedes")
    new = a.select(F.when(back, F.col("other")).otherwise(F.col("id")).alias("source"), F.when(back, F.col("id")).otherwise(F.col("other")).alias("target"), kind.alias("edge_type"), F.when(kind == "related", F.col("weight")).otherwise(1.0).alias("weight")).where("edge_type IS NOT NULL")
    new = new.groupBy("source", "target", "edge_type").agg(F.max("weight").alias("weight"))
    new = new.withColumns({"created_at": F.lit(now), "valid_from": F.lit(None).cast("long"), "valid_until": F.lit(None).cast("long")})
    return invalidated(m, ends, now), graph.added(e, new, m)


def forgotten(m: DataFrame, e: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Memories and edges without the ids and all that touches them."""
    gone = ids.select("id").distinct()
    return m.join(gone, "id", "left_anti"), graph.without_node(e, gone)


def audit_log(plan: DataFrame, at: int, reason: str, agent: str | None, named: int) -> DataFrame:
    """The text of a forget request over its plan (memories, edges): log."""
    head = f"FORGET REQUEST at timestamp {at}\nReason: {reason}\n" + (f"Agent: {agent}\n" if agent else "") + (f"Specific IDs: {named}\n" if named else "")
    return plan.select(F.concat(F.lit(head), F.format_string("Result: %d memories, %d edges, 0 facts deleted\n", "memories", "edges")).alias("log"))


def untagged(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Clears the tags of the named rows."""
    named = ids.select("id", F.lit(True).alias("_named")).distinct()
    return m.join(named, "id", "left").withColumn("tags", F.when(F.col("_named"), F.array().cast("array<string>")).otherwise(F.col("tags"))).drop("_named")


def applied_counts(counts: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Grouped counts (axis, name, n) after rows came and went, given their own grouped counts; groups of none vanish."""
    signed = counts.unionByName(added).unionByName(removed.withColumn("n", -F.col("n")))
    return signed.groupBy("axis", "name").agg(F.sum("n").alias("n")).where("n > 0")


# --- context of a turn


def turn_context(hits: DataFrame, m: DataFrame, user: str | None, agent: str | None) -> DataFrame:
    """What a turn is answered with: the recalled rows (id, score), and the owner's standing rules that are not among them."""
    rules = m.where(F.array_contains("tags", "scope:always") & visible(F.col("user_id"), user) & visible(F.col("agent_id"), agent))
    return hits.select("id", "score").union(rules.join(F.broadcast(hits), "id", "left_anti").select("id", F.lit(STANDING)))


def boosted(hits: DataFrame, m: DataFrame, e: DataFrame, query: str) -> DataFrame:
    """id, score: BOOST more for rows that a derived edge reaches from a memory whose entity is a word of the query."""
    words = F.filter(text.token_set(F.lit(query)), lambda w: F.octet_length(w) >= 2)
    named = m.where(F.arrays_overlap("tags", F.transform(words, lambda w: F.concat(F.lit("entity:"), w)))).select(F.col("id").alias("source"))
    reached = e.where("edge_type = 'derived'").join(named, "source", "left_semi").select(F.col("target").alias("id"), F.lit(BOOST).alias("more")).distinct()
    return hits.join(reached, "id", "left").select("id", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))


def activated_rules(m: DataFrame, query: list[float], now: int, user: str | None = None, agent: str | None = None) -> DataFrame:
    """Rules of the modes (tag trigger:x) that the query activates: by the nearest of the mode's exemplars (mode-exemplar:x), or
    of its rules where it has none, at GATE or more; the RULES most activated: id, activation."""
    mine = m.where(visible(F.col("user_id"), user) & visible(F.col("agent_id"), agent) & valid_at(F.col("valid_from"), F.col("valid_until"), now))
    near = F.when(F.size("embedding") > 0, cosine(F.col("embedding"), literal(query)))

    def tagged(rows: DataFrame, prefix: str) -> DataFrame:
        tags = F.array_distinct(F.filter("tags", lambda t: F.startswith(t, F.lit(prefix))))
        return rows.select("id", near.alias("near"), F.explode(tags).alias("tag")).select("id", "near", F.substring(F.col("tag"), F.lit(len(prefix) + 1), F.length("tag")).alias("mode"))

    rules = tagged(mine, "trigger:")
    # a mode has exemplars if anybody's rows have the tag, visible or not
    has = tagged(m, "mode-exemplar:").select("mode").distinct().withColumn("has", F.lit(True))
    by_rule = rules.groupBy("mode").agg(F.max("near").alias("r"))
    by_exemplar = tagged(mine, "mode-exemplar:").groupBy("mode").agg(F.max("near").alias("x"))
    mode = by_rule.join(has, "mode", "left").join(by_exemplar, "mode", "left").select("mode", F.when(F.col("has"), F.col("x")).otherwise(F.col("r")).alias("activation")).where(F.col("activation") >= GATE)
    best = rules.join(mode, "mode").groupBy("id").agg(F.max("activation").alias("activation"))
    return best.orderBy(F.desc(F.round("activation", 9)), "id").limit(RULES)


def disambiguation(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """A note for each confusable pair (a, b): a, b, note."""
    c = m.select("id", "content", "created_at")
    both = pairs.select("a", "b").join(c.toDF("a", "ca", "wa"), "a").join(c.toDF("b", "cb", "wb"), "b")
    note = F.format_string('Note: Memory A: "%s" (created %d), Memory B: "%s" (created %d). Do not confuse.', "ca", "wa", "cb", "wb")
    return both.select("a", "b", note.alias("note"))


def separated(hits: DataFrame, pairs: DataFrame) -> DataFrame:
    """Reorders a bounded ranking (id, place) so that, where it can be, no pair (a, b) stands side by side: id, place. The next row
    that does not conflict with the last one goes first; if there is none, the conflicting one."""
    mine = pairs.join(F.broadcast(hits.select(F.col("id").alias("a"))), "a", "left_semi").join(F.broadcast(hits.select(F.col("id").alias("b"))), "b", "left_semi").select("a", "b")
    rows = hits.select("id", "place", F.lit(None).cast("long").alias("a"), F.lit(None).cast("long").alias("b")).union(mine.select(F.lit(None).cast("long"), F.lit(None).cast("int"), "a", "b"))

    def run(p):
        import pandas as pd

        conflicts = {frozenset(x) for x in p.loc[p.a.notna(), ["a", "b"]].astype("int64").itertuples(index=False, name=None)}
        left = p[p.id.notna()].sort_values("place").id.astype("int64").tolist()
        out: list[int] = []
        while left:
            fit = next((i for i, x in enumerate(left) if not out or frozenset((out[-1], x)) not in conflicts), 0)
            out.append(left.pop(fit))
        return pd.DataFrame({"id": out, "place": range(len(out))})

    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "id long, place int")


# --- trajectory


def recent_turns(t: DataFrame, most: int = 100) -> DataFrame:
    """The last turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return t.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).drop("k")


def resume_context(topics: DataFrame) -> DataFrame:
    """Text to resume each conversation with, from its topics (conv_id, turn, topic): the last, then the three before it."""
    last = recent_turns(topics, 4).groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "topic"))), lambda x: x["topic"]).alias("ts"))
    before = F.slice("ts", 1, F.size("ts") - 1)
    body = F.concat(F.lit("You were working on: "), F.element_at("ts", -1), F.lit(" Status: Completed."))
    return last.select("conv_id", F.when(F.size("ts") > 1, F.concat(body, F.lit(" Recent trajectory: "), F.array_join(before, " → "))).otherwise(body).alias("resume"))


def next_topics(topics: DataFrame, learned: DataFrame, questions: DataFrame | None = None, most: int = 3) -> DataFrame:
    """Predictions for each conversation: what followed its last topic (learned: source, rank, target), its open questions
    (conv_id, place, question), the last topic continued, the one before revisited; distinct: conv_id, place, topic."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    ends = topics.withColumn("k", F.row_number().over(w))
    last, before = ends.where("k = 1").select("conv_id", "topic"), ends.where("k = 2").select("conv_id", "topic")
    parts = last.join(learned.where(F.col("rank") <= most), F.col("topic") == F.col("source")).select("conv_id", F.lit(0).alias("a"), F.col("rank").cast("long").alias("b"), F.col("target").alias("topic"))
    if questions is not None:
        parts = parts.union(last.select("conv_id").join(questions, "conv_id").select("conv_id", F.lit(1), F.col("place").cast("long"), "question"))
    parts = parts.union(last.select("conv_id", F.lit(2), F.lit(0).cast("long"), F.concat("topic", F.lit(" (continued)"))))
    parts = parts.union(before.select("conv_id", F.lit(3), F.lit(0).cast("long"), F.concat("topic", F.lit(" (revisit)"))))
    first = parts.groupBy("conv_id", "topic").agg(F.min(F.struct("a", "b")).alias("at"))
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("at", "topic"))
    return first.select("conv_id", k.alias("place"), "topic").where(F.col("place") <= most)


def known_topics(tr: DataFrame, aliases: DataFrame) -> DataFrame:
    """All labels: both ends of the transitions, and canonical names."""
    return tr.select(F.col("source").alias("topic")).union(tr.select("target")).union(aliases.select("canonical")).distinct()


def pending_topics(topics: DataFrame, known: DataFrame, aliases: DataFrame, most: int) -> DataFrame:
    """The latest distinct topics (topic, seen) that are neither known nor aliased."""
    new = topics.join(known, "topic", "left_anti").join(aliases.select(F.col("alias").alias("topic")), "topic", "left_anti")
    return new.groupBy("topic").agg(F.max("seen").alias("seen")).orderBy(F.desc("seen"), "topic").limit(most)


def ghosts(t: DataFrame, speculation: list[str], actions: DataFrame) -> DataFrame:
    """Unconfirmed memories of turns that speculate and name an action: conv_id, turn, content, confidence, tags."""
    rows = t.where(text.contains_any(F.lower("text"), speculation)).join(actions.select("conv_id", "turn").distinct(), ["conv_id", "turn"], "left_semi")
    return rows.select("conv_id", "turn", F.concat(F.lit("Unconfirmed: "), F.substring("text", 1, 300)).alias("content"), F.lit(0.3).alias("confidence"), F.array(F.lit("ghost-memory"), F.lit("unconfirmed")).alias("tags"))


# --- speculative cache: topic, created_at, last_accessed, hit_count, ids


def cache_hits(asks: DataFrame, cache: DataFrame, least: float = 0.5) -> DataFrame:
    """For each ask (ask, query) the cached topic with the most words in common, above `least`; ties to the older entry, then the
    lesser topic: ask, topic, score. A query with the very words of a topic scores 1, which no other topic exceeds, and finds it
    by its word set. Only the other queries are compared: texts meet by the rarest of their words, of which two texts that are
    similar enough must share one: n - ceil(least x n) + 1 of n words."""
    words = F.array_sort(F.array_distinct(text.words(F.lower("text"))))
    asked = asks.select(F.col("query").alias("text")).distinct().withColumn("words", words).where(F.size("words") > 0)
    held = cache.select(F.col("topic").alias("text"), "created_at").withColumn("words", words).where(F.size("words") > 0)
    eldest = held.where(F.lit(least) < 1).groupBy("words").agg(F.min(F.struct("created_at", "text")).alias("e"))
    told = written(asked.join(eldest, "words", "left"), "told")
    best = told.where("e IS NOT NULL").select(F.col("text").alias("query"), F.col("e.text").alias("topic"), F.lit(1.0).alias("score"), F.col("e.created_at").alias("created_at"))
    first = [F.desc("score"), F.col("created_at"), F.col("topic")]
    rest = told.where("e IS NULL")
    if not rest.isEmpty():
        best = best.union(_most_alike(rest.select("text", "words"), held, least, first))
    every = asks.join(best, "query")  # an ask may have several queries
    return every.withColumn("k", F.row_number().over(Window.partitionBy("ask").orderBy(*first))).where("k = 1").select("ask", "topic", "score")


def _most_alike(asked: DataFrame, held: DataFrame, least: float, first: list[Column]) -> DataFrame:
    """For each asked text (text, words) the first of the held ones (text, words, created_at) above `least`: query, topic, score,
    created_at."""
    each = asked.withColumn("asked", F.lit(True)).union(held.select("text", "words").distinct().withColumn("asked", F.lit(False)))
    each = each.select("text", "asked", F.explode("words").alias("w"))
    count = each.groupBy("w").agg(F.count("*").alias("c"))
    order = each.join(count, "w").groupBy("text", "asked").agg(F.array_sort(F.collect_list(F.struct("c", "w"))).alias("ws"))
    most = F.size("ws") - F.ceil(F.size("ws") * F.lit(least)).cast("int") + 1
    rare = written(order.select("text", "asked", F.transform("ws", lambda x: x["w"]).alias("words"), F.explode(F.slice("ws", 1, most)).alias("x")).select("text", "asked", "words", F.col("x.w").alias("w")), "rare")
    q = rare.where("asked").select(F.col("text").alias("query"), F.col("words").alias("a"), "w")
    c = rare.where("NOT asked").select(F.col("text").alias("topic"), F.col("words").alias("b"), "w")
    short = F.least(F.size("a"), F.size("b")) >= least * F.greatest(F.size("a"), F.size("b"))
    near = q.join(c, "w").where(short).select("query", "topic", text.jaccard(F.col("a"), F.col("b")).alias("score")).where(F.col("score") > least).distinct()
    met = near.join(held.select(F.col("text").alias("topic"), "created_at"), "topic")
    ranked = met.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy(*first)))
    return ranked.where("k = 1").select("query", "topic", "score", "created_at")


def accessed(cache: DataFrame, hits: DataFrame, now: int) -> DataFrame:
    """The cache after hits: counted and touched."""
    n = hits.groupBy("topic").agg(F.count("*").alias("_n"))
    out = cache.join(n, "topic", "left")
    return out.withColumns({"hit_count": F.col("hit_count") + F.coalesce("_n", F.lit(0)), "last_accessed": F.when(F.col("_n") > 0, F.lit(now)).otherwise(F.col("last_accessed"))}).drop("_n").select(*cache.columns)


def without_stale(cache: DataFrame, age: int, now: int) -> DataFrame:
    return cache.where(F.lit(now) - F.col("created_at") <= age)


def without_least_recent(cache: DataFrame, most: int) -> DataFrame:
    """The `most` entries accessed last, ties to the newer, then the lesser topic."""
    return cache.orderBy(F.desc("last_accessed"), F.desc("created_at"), "topic").limit(most)


def cache_stats(asks: DataFrame, hits: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: hits, misses, size."""
    a, h = asks.agg(F.count("*").alias("asks")), hits.agg(F.count("*").alias("hits"))
    return a.join(h).join(cache.agg(F.count("*").alias("size"))).select("hits", (F.col("asks") - F.col("hits")).alias("misses"), "size")  # one row each


# --- phantoms and pains


def entity_like(term: Column) -> Column:
    """Two letters or more, 40 characters or fewer, no `=` and no punctuation inside, and not a lone word in lower case."""
    t = F.regexp_replace(F.trim(term), r"[.,;:!?]+$", "")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    inner = F.contains(t, F.lit("=")) | F.regexp_like(t, F.lit(r"[.,;:] "))
    lone = (F.size(text.words(t)) == 1) & F.regexp_like(t, F.lit(r"^\p{Ll}"))
    return (letters >= 2) & (F.length(t) <= 40) & ~inner & ~lone


def active_phantoms(p: DataFrame) -> DataFrame:
    """Unresolved ones, most urgent first; ties by id."""
    return p.where("NOT resolved").orderBy(F.desc("priority"), "id")


def resolved_phantoms(p: DataFrame, ids: DataFrame) -> DataFrame:
    done = ids.select("id", F.lit(True).alias("_done")).distinct()
    return p.join(done, "id", "left").withColumn("resolved", F.col("resolved") | F.coalesce("_done", F.lit(False))).drop("_done").select(*p.columns)


def phantom_lines(p: DataFrame, most: int = 5) -> DataFrame:
    return active_phantoms(p).limit(most).select("id", F.format_string("WARNING: User referenced '%s' but no details stored. Consider asking.", "reference").alias("line"))


def pain_lines(signals: DataFrame, most: int = 5) -> DataFrame:
    """The strongest signals as text: signal, line."""
    line = F.format_string("CAUTION: %s (pain: %.2f). Triggers: [%s]", F.col("description"), F.col("intensity"), F.array_join("triggers", ", "))
    return signals.orderBy(F.desc("intensity"), "signal").limit(most).select("signal", line.alias("line"))


def decayed_pains(signals: DataFrame, now: int) -> DataFrame:
    """Intensities fade exponentially with the microseconds since they were recorded."""
    age = F.greatest(F.lit(0), F.lit(now) - F.col("created_at"))
    return signals.withColumn("intensity", analytics.pain_decayed(F.col("intensity"), F.col("decay_rate"), age))


# --- entities, enrichment, summaries, profiles


def marked_different(pairs: DataFrame) -> DataFrame:
    """Negative pairs of names (a, b), ordered, once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()


def known_different(asks: DataFrame, different: DataFrame) -> DataFrame:
    """The asks (a, b) in either order that are marked as different."""
    low = asks.select("a", "b", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    return low.join(different.toDF("x", "y"), ["x", "y"], "left_semi").select("a", "b")


def unresolved_names(resolved: DataFrame) -> DataFrame:
    """Names that resolve only to themselves, and that nothing else resolves to."""
    own = text.normal(F.col("name"))
    others = resolved.where(F.col("canonical") != own).select(F.lower("canonical").alias("k")).distinct()
    return resolved.where(F.lower("canonical") == own).select("name", own.alias("k")).join(others, "k", "left_anti").select("name")


def entity_contexts(m: DataFrame) -> DataFrame:
    """What is known of each entity of an owner: the first 300 bytes of its first memory, then more of others, joined by ' | ',
    while under 300 bytes, up to 500: user_id, agent_id, entity, context. Only the first rows of an entity can matter, for
    each adds three bytes or more; so 100 of them are taken."""
    rows = m.select("user_id", "agent_id", F.trim(F.lower(first_tag(F.col("tags"), "entity:"))).alias("entity"), "id", text.byte_prefix(F.col("content"), 500).alias("c")).where("entity IS NOT NULL")
    owner = ["user_id", "agent_id", "entity"]
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy(*owner).orderBy("id"))).where("k <= 100")
    held = rows.groupBy(*owner).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cs"))
    first = text.byte_prefix(F.element_at("cs", 1), 300)

    def more(s: Column, c: Column) -> Column:
        joined = F.concat(s, F.lit(" | "))
        return F.when(F.octet_length(s) < 300, F.concat(joined, text.byte_prefix(c, F.lit(500) - F.octet_length(joined)))).otherwise(s)

    return held.select(*owner, F.aggregate(F.slice("cs", 2, 100), first, more).alias("context"))


def entity_names(m: DataFrame) -> DataFrame:
    return m.select("user_id", "agent_id", F.explode(F.filter("tags", lambda t: F.startswith(t, F.lit("entity:")))).alias("t")).select("user_id", "agent_id", F.trim(F.lower(F.substring(F.col("t"), F.lit(8), F.length("t")))).alias("entity")).distinct()


def enriched(new: DataFrame, sources: DataFrame, now: int, most: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Enrichment memories with capped confidence and their tag, and a derived edge of weight 0.8 from each to each of its
    sources (sources: id, source)."""
    tag = F.lit("source:enrichment")
    rows = new.withColumn("confidence", F.least("confidence", F.lit(most))).withColumn("tags", F.when(F.array_contains("tags", "source:enrichment"), F.col("tags")).otherwise(F.concat("tags", F.array(tag))))
    edges = sources.join(new.select("id"), "id", "left_semi").select(F.col("id").alias("source"), F.col("source").alias("target"), F.lit("derived").alias("edge_type"), F.lit(0.8).alias("weight"), F.lit(now).alias("created_at"))
    return rows, edges


def summaries(m: DataFrame, tag: str) -> DataFrame:
    """Rows of one kind of summary (community_summary, user_profile)."""
    return m.where(F.array_contains("tags", tag))


def profile_owners(m: DataFrame) -> DataFrame:
    """Owners with a profile, the newest first: user_id, agent_id, created_at."""
    return summaries(m, "user_profile").groupBy("user_id", "agent_id").agg(F.max("created_at").alias("created_at")).orderBy(F.desc("created_at"), "user_id", "agent_id")


def embedding_key(content: Column, entities: Column, tags: Column, context: Column) -> Column:
    """What an extracted memory is embedded by: its text and, where there are any, its entities, topics and context."""
    out = content
    for name, values in (("entities", entities), ("topics", tags), ("context", context)):
        out = F.concat(out, F.when(F.size(values) > 0, F.concat(F.lit(f" [{name}: "), F.array_join(values, ", "), F.lit("]"))).otherwise(""))
    return out


# --- spaces: space, agent, permission; owners: space, owner


def granted(entries: DataFrame, new: DataFrame) -> DataFrame:
    return upserted(entries, new, ["space", "agent"])


def revoked(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone.select("space", "agent").distinct(), ["space", "agent"], "left_anti")


def created_spaces(owners: DataFrame, entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New spaces (space, owner), whose owners become their admins."""
    return owners.unionByName(new), granted(entries, new.select("space", F.col("owner").alias("agent"), F.lit("admin").alias("permission")))


def spaces_of(owners: DataFrame, entries: DataFrame, agent: str) -> DataFrame:
    """Spaces that the agent owns or is listed in."""
    return owners.where(F.col("owner") == agent).select("space").union(entries.where(F.col("agent") == agent).select("space")).distinct()
