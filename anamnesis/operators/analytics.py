"""Aggregates, context assembly, conversation analytics and injection (of A1-A12, X1-X13,
K1-K66, T1-T16, I1-I7; the README lists what is known to be missing)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import ACTIONS, CORRECTIONS, NEGATIVE, POSITIVE, SPECULATION
from ..functions import text
from ..functions.scoring import NOBODY, decayed, first_tag
from ..functions.vector import cosine


def month(at: Column) -> Column:
    return F.date_format(F.timestamp_micros(at), "yyyy-MM")


def scope_counts(m: DataFrame, hidden: list[str]) -> DataFrame:
    """One row: total, everyone's, always, of rows without hidden tags."""
    rows = m.where(~F.arrays_overlap("tags", F.array(*map(F.lit, hidden))))
    shared = (F.col("user_id") == NOBODY) & (F.col("agent_id") == NOBODY)
    return rows.agg(F.count("*").alias("total"), F.count_if(shared).alias("everyone"), F.count_if(F.array_contains("tags", "scope:always")).alias("always"))


def grouped_counts(m: DataFrame, hidden: list[str]) -> DataFrame:
    """Counts by type, user, agent, owner pair, project and month in one pass: axis, name, n."""
    rows = m.where(~F.arrays_overlap("tags", F.array(*map(F.lit, hidden))))
    project = first_tag(F.col("tags"), "scope:project:")
    axes = F.array(*[F.struct(F.lit(a).alias("axis"), c.alias("name")) for a, c in (("type", F.col("memory_type")), ("user", F.when(F.col("user_id") != NOBODY, F.col("user_id"))), ("agent", F.when(F.col("agent_id") != NOBODY, F.col("agent_id"))), ("pair", F.concat_ws("|", "user_id", "agent_id")), ("project", project), ("month", month(F.col("created_at"))))])
    return rows.select(F.explode(axes).alias("x")).where("x.name IS NOT NULL").groupBy("x.axis", "x.name").agg(F.count("*").alias("n"))


def health(m: DataFrame, now: int) -> DataFrame:
    """Histogram of decayed salience in five buckets: bucket, n, mean, accesses."""
    h = decayed(F.col("salience"), F.col("accessed_at"), F.col("access_count"), now)
    return m.select(h.alias("h"), "access_count").groupBy(F.least(F.floor(F.col("h") * 5), F.lit(4)).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.round(F.avg("h"), 6).alias("mean"), F.sum("access_count").alias("accesses"))


def owner_pairs(m: DataFrame) -> DataFrame:
    return m.select("user_id", "agent_id").distinct()


# The order of the zones, and their shares of the budget.
ZONES = {"opening": 0.10, "critical": 0.25, "primary": 0.35, "supporting": 0.20, "closing": 0.10}


def zone(kind: Column, score: Column, salience: Column) -> Column:
    return F.when(kind.isin("anti_pattern", "correction"), "opening").when((score >= 0.8) & (salience >= 0.7), "critical").when(score >= 0.5, "primary").when(score >= 0.2, "supporting").otherwise("closing")


def packed(hits: DataFrame, budget: int) -> DataFrame:
    """Greedy packing of a bounded hit list (id, score, content), best first; what does not fit is passed over: id, place, cost."""
    rows = hits.select(F.struct((-F.round("score", 9)).alias("s"), "id", text.estimate_tokens(F.col("content")).alias("cost")).alias("r"))
    start = "named_struct('left', CAST({0} AS BIGINT), 'kept', CAST(array() AS array<struct<id:bigint,cost:bigint>>))".format(budget)
    fold = f"aggregate(rows, {start}, (a, r) -> IF(r.cost <= a.left, named_struct('left', a.left - r.cost, 'kept', concat(a.kept, array(named_struct('id', r.id, 'cost', r.cost)))), a), a -> a.kept)"
    kept = rows.agg(F.array_sort(F.collect_list("r")).alias("rows")).select(F.posexplode(F.expr(fold)).alias("place", "k"))
    return kept.select(F.col("k.id").alias("id"), "place", F.col("k.cost").alias("cost"))


def context(hits: DataFrame, m: DataFrame, budget: int) -> DataFrame:
    """The context window: packed rows with their zone and compact line, in zone order."""
    rows = packed(hits.join(m.select("id", "content"), "id"), budget).join(m.drop("embedding"), "id").join(hits.select("id", "score"), "id")
    z = zone(F.col("memory_type"), F.col("score"), F.col("salience"))
    line = F.format_string("M|%s|%.2f|%s|tags:%s", F.col("memory_type"), F.col("salience"), F.col("content"), F.array_join("tags", ","))
    return rows.select("id", "place", "cost", z.alias("zone"), line.alias("line"))


def delta(before: DataFrame, now: DataFrame) -> DataFrame:
    """What changed between two id sets: id, change (added, removed, unchanged)."""
    a, b = before.select("id", F.lit(1).alias("a")).distinct(), now.select("id", F.lit(1).alias("b")).distinct()
    return a.join(b, "id", "full").select("id", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("change"))


def diversified(hits: DataFrame, m: DataFrame, k: int, lam: float) -> DataFrame:
    """Maximal marginal relevance over a bounded hit list (id, score): id, place; relevance is min-max normalised, ties by place in the list."""
    import numpy as np
    import pandas as pd

    rows = hits.join(m.select("id", "embedding"), "id")

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        span = p.score.max() - p.score.min()
        rel = ((p.score - p.score.min()) / span if span else p.score * 0 + 1).to_numpy()
        d = max((len(e) for e in p.embedding), default=1) or 1
        v = np.array([np.asarray(e, float) if len(e) == d else np.zeros(d) for e in p.embedding])
        v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        chosen: list[int] = []
        near = np.full(len(p), -np.inf)
        while len(chosen) < min(k, len(p)):
            gain = lam * rel - (1 - lam) * np.where(np.isinf(near), 0.0, near)
            gain[chosen] = -np.inf
            i = int(np.argmax(gain))
            chosen.append(i)
            near = np.maximum(near, v @ v[i])
        return pd.DataFrame({"id": p.id.iloc[chosen].to_numpy(), "place": range(len(chosen))})

    return rows.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(run, "id long, place int")


def topics(t: DataFrame) -> DataFrame:
    """Topic of each user turn: its first 100 characters, and '...' where more follow, normalised."""
    cut = F.when(F.length("text") > 100, F.concat(F.substring("text", 1, 100), F.lit("..."))).otherwise(F.col("text"))
    return t.where("role = 'user'").select("conv_id", "turn", text.normal(cut).alias("topic"))


def transitions(topic: DataFrame) -> DataFrame:
    """Counts of topic to topic within conversations: source, target, n."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return topic.select(F.lag("topic").over(w).alias("source"), F.col("topic").alias("target")).where("source IS NOT NULL").groupBy("source", "target").agg(F.count("*").alias("n"))


def predicted(tr: DataFrame, n: int) -> DataFrame:
    """The n likeliest next topics, ties by name: source, rank, target, n."""
    w = Window.partitionBy("source").orderBy(F.desc("n"), "target")
    return tr.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n).select("source", "rank", "target", "n")


def actions(t: DataFrame) -> DataFrame:
    """Action keywords in each turn, with the first sentence that has them, 200 characters: conv_id, turn, action, detail."""
    low = F.lower("text")
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(a).alias("action")) for k, a in ACTIONS])
    hit = t.select("conv_id", "turn", low.alias("low"), F.explode(table).alias("x")).where(F.contains("low", F.col("x.k")))
    detail = F.expr("substring(trim(get(filter(split(low, '[.]'), s -> contains(s, x.k)), 0)), 1, 200)")
    return hit.select("conv_id", "turn", F.col("x.k").alias("keyword"), F.col("x.action").alias("action"), detail.alias("detail"))


def sentiment(words: Column) -> Column:
    """(positive - negative words) / words; a word counts where it contains an entry."""

    def count(entries: list[str]) -> Column:
        return F.size(F.filter(words, lambda w: text.contains_any(w, entries)))

    return (count(POSITIVE) - count(NEGATIVE)) / F.greatest(F.size(words), F.lit(1))


def moods(t: DataFrame) -> DataFrame:
    low = F.lower("text")
    return t.select("conv_id", "turn", F.round(sentiment(text.words(low)), 6).alias("sentiment"), text.contains_any(low, CORRECTIONS).alias("correction"), text.contains_any(low, SPECULATION).alias("speculation"))


def pains(signals: DataFrame, t: DataFrame) -> DataFrame:
    """Pain signals (signal, intensity, triggers) that turns set off: conv_id, turn, signal, score = share of matched triggers x
    intensity. Signals are few; the check of their number is the caller's, who broadcasts them."""
    words = F.array_distinct(text.words(F.lower("text")))
    both = t.select("conv_id", "turn", words.alias("w")).join(signals)
    hits = F.size(F.filter("triggers", lambda g: F.exists("w", lambda x: F.contains(x, g))))
    return both.where(hits > 0).select("conv_id", "turn", "signal", F.round(hits / F.size("triggers") * F.col("intensity"), 6).alias("score"))


def pain_decayed(intensity: Column, rate: Column, age: Column) -> Column:
    return intensity * F.exp(-rate * age)


def interference(m: DataFrame, pairs: DataFrame) -> DataFrame:
    """Similar pairs (a, b, similarity) whose texts differ."""
    c = m.select("id", F.xxhash64("content").alias("h"), F.length("content").alias("l"))
    return pairs.join(c.toDF("a", "ha", "la"), "a").join(c.toDF("b", "hb", "lb"), "b").where("ha <> hb OR la <> lb").select("a", "b", "similarity")


def entity_links(m: DataFrame, e: DataFrame) -> DataFrame:
    """Consecutive memories of one owner and entity that no edge links yet: a, b, entity. (Linking each to the next gives the
    same groups as all pairs, and grows with the group rather than with its square.)"""
    rows = m.select("user_id", "agent_id", "id", first_tag(F.col("tags"), "entity:").alias("entity")).where("entity IS NOT NULL")
    w = Window.partitionBy("user_id", "agent_id", "entity").orderBy("id")
    chain = rows.select("entity", F.col("id").alias("a"), F.lead("id").over(w).alias("b")).where("b IS NOT NULL")
    linked = e.where("edge_type = 'related'").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"))
    return chain.join(linked, ["a", "b"], "left_anti").select("a", "b", "entity")


def communities(m: DataFrame, least: int = 2) -> DataFrame:
    """Entities by type: category, members, entities."""
    rows = m.select(first_tag(F.col("tags"), "entity_type:").alias("category"), first_tag(F.col("tags"), "entity:").alias("entity")).where("category IS NOT NULL")
    return rows.groupBy("category").agg(F.count("*").alias("members"), F.countDistinct("entity").alias("entities")).where(F.col("members") >= least)


def resolved_names(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """name -> canonical: by alias, else by a canonical name that has all the name's words (0.7, or 0.5 if several do, ties to
    more aliases, fewer letters, the lesser), else itself: name, canonical, confidence."""
    n = names.select("name", text.normal(F.col("name")).alias("key"))
    exact = n.join(aliases.select(F.col("alias").alias("key"), "canonical", "confidence"), "key", "left")
    rest = exact.where("canonical IS NULL").select("name", "key", F.explode(F.split("key", " ")).alias("word"), F.size(F.split("key", " ")).alias("need"))
    known = aliases.groupBy("canonical").agg(F.count("*").alias("refs")).select("canonical", "refs", F.explode(F.array_distinct(F.split(F.lower("canonical"), " "))).alias("word"))
    match = rest.join(known, "word").groupBy("name", "need", "canonical", "refs").agg(F.countDistinct("word").alias("got")).where("got >= need")
    w = Window.partitionBy("name")
    best = match.withColumn("several", F.count("*").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("refs"), F.length("canonical"), "canonical"))).where("k = 1")
    rule = best.select(F.col("name").alias("n2"), F.col("canonical").alias("c2"), F.when(F.col("several") > 1, 0.5).otherwise(0.7).alias("f2"))
    out = exact.join(rule, F.col("name") == F.col("n2"), "left")
    return out.select("name", F.coalesce("canonical", "c2", "key").alias("canonical"), F.coalesce("confidence", "f2", F.lit(1.0)).alias("confidence"))


def gaps(t: DataFrame, known: DataFrame) -> DataFrame:
    """Capitalised runs and quoted terms of turns that no known entity (name, normalised) covers: conv_id, turn, term."""
    caps = F.regexp_extract_all("text", F.lit(r"(\p{Lu}[\p{L}\p{N}]+(?: \p{Lu}[\p{L}\p{N}]+)+)"), 1)
    quoted = F.regexp_extract_all("text", F.lit(r'"([^"]{2,40})"'), 1)
    terms = t.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(caps, quoted))).alias("term"))
    return terms.withColumn("name", text.normal(F.col("term"))).join(known, "name", "left_anti").select("conv_id", "turn", "term")


def knee(hits: DataFrame, ratio: float = 2.0) -> DataFrame:
    """Cuts a bounded ranking (id, score) at the first largest fall of adjacent scores, if it is `ratio` or more: id, score."""
    w = Window.orderBy(F.desc("score"), "id")
    rows = hits.withColumns({"k": F.row_number().over(w), "next": F.lead("score").over(w)})
    fall = F.when((F.col("next") > 0) & (F.col("score") / F.col("next") >= ratio), F.col("score") / F.col("next"))
    cut = rows.agg(F.max_by("k", F.struct(fall.alias("f"), -F.col("k"))).alias("at"), F.max(fall).alias("f"))
    return rows.join(F.broadcast(cut)).where("f IS NULL OR k <= at").select("id", "score")


def injected(hits: DataFrame, m: DataFrame, query: list[float], project: str, k: int) -> DataFrame:
    """Selection for injection from a bounded hit list: rows tagged turn or scope:always go; other projects' rows stay only if not
    episodic and with cosine of 0.8 of the best or more; after the first three, cosine of 0.55 of the best; then the
    best k: id, score, place."""
    from ..functions.vector import literal

    rows = hits.join(m.select("id", "memory_type", "tags", "embedding"), "id").withColumn("c", cosine(F.col("embedding"), literal(query)))
    rows = rows.where(~F.arrays_overlap("tags", F.array(F.lit("turn"), F.lit("scope:always"))))
    every = Window.partitionBy(F.lit(0))
    mine = first_tag(F.col("tags"), "scope:project:")
    rows = rows.withColumns({"best": F.max("c").over(every), "other": mine.isNotNull() & (mine != project)})
    rows = rows.where(~F.col("other") | ((F.col("memory_type") != "episodic") & (F.col("c") >= 0.8 * F.col("best"))))
    rows = rows.withColumn("k", F.row_number().over(every.orderBy(F.desc(F.round("score", 9)), "id")))
    rows = rows.where((F.col("k") <= 3) | (F.col("c") >= 0.55 * F.col("best")))
    return rows.orderBy("k").limit(k).select("id", "score", F.col("k").alias("place"))
