"""Merging, model candidates, quotas, access, calibration, profiles, episodes and serving text (D3, D15, D17, A10, A11,
F24-F30, R34, R35, K14-K16, K25, K41, K44, K46, T6, X7, X9, X10, I5, L6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scoring import scope_key
from ..functions.text import FNV_BASIS, FNV_PRIME
from .lifecycle import components, similar_pairs

# What each permission of a space grants.
GRANTS = {"read": ["read"], "write": ["write"], "read_write": ["read", "write", "read_write"], "admin": ["read", "write", "read_write", "admin"]}


def merged(m: DataFrame, pairs: DataFrame, written) -> DataFrame:
    """One row for each group of duplicate pairs (a, b): id (the oldest stays), forgotten (rows that go), access_count (sum),
    salience (most), tags (all, sorted). Tags are made distinct before they are gathered."""
    rows = m.select("id", "created_at", "access_count", "salience", "tags").join(components(pairs, written), "id")
    one = rows.groupBy("component").agg(F.min_by("id", F.struct("created_at", "id")).alias("id"), (F.count("*") - 1).alias("forgotten"), F.sum("access_count").alias("access_count"), F.max("salience").alias("salience"))
    tags = rows.select("component", F.explode("tags").alias("tag")).distinct().groupBy("component").agg(F.array_sort(F.collect_list("tag")).alias("tags"))
    return one.join(tags, "component", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).drop("component")


def conflict_candidates(m: DataFrame, e: DataFrame, low: float = 0.72, high: float = 0.995) -> DataFrame:
    """Pairs (a, b, similarity) of one owner for a judge: low <= similarity < high, one scope, no conflict edge between them yet.
    Only rows of one scope meet."""
    near = similar_pairs(m.withColumn("scope", F.coalesce(scope_key(F.col("tags")), F.lit(""))), low, block=("user_id", "agent_id", "scope"))
    edges = e.where("edge_type IN ('contradicts', 'supersedes')").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return near.where(F.col("similarity") < high).join(edges, ["a", "b"], "left_anti")


def covered(source: Column, survivor: Column) -> Column:
    """The share of a source's distinct words of four bytes or more that the survivor has; 1 where there are none."""

    def long_words(c: Column) -> Column:
        return F.filter(text.token_set(c), lambda w: F.octet_length(w) > 3)

    need = long_words(source)
    return F.when(F.size(need) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(need, long_words(survivor))) / F.size(need))


def usage(m: DataFrame, rows: int, size: int) -> DataFrame:
    """Use of each agent's quota: agent_id, memories, bytes, percent (of the tighter limit), can_write."""
    used = m.groupBy("agent_id").agg(F.count("*").alias("memories"), F.sum(F.octet_length("content")).alias("bytes"))
    share = F.greatest(F.col("memories") / F.lit(rows), F.col("bytes") / F.lit(size)) * 100
    return used.select("agent_id", "memories", "bytes", F.round(share, 4).alias("percent"), ((F.col("memories") < rows) & (F.col("bytes") < size)).alias("can_write"))


def allowed(asks: DataFrame, spaces: DataFrame, entries: DataFrame) -> DataFrame:
    """Whether asks (space, agent, wanted) are granted: to the space's owner (space, owner), and by an entry (space, agent,
    permission) that satisfies what is wanted. Unknown spaces grant nothing."""
    table = F.create_map(*[x for k, v in GRANTS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    given = entries.select("space", "agent", F.explode(F.try_element_at(table, F.col("permission"))).alias("wanted")).distinct().withColumn("entry", F.lit(True))
    rows = asks.join(spaces, "space", "left").join(given, ["space", "agent", "wanted"], "left")
    return rows.select("space", "agent", "wanted", (F.coalesce(F.col("owner") == F.col("agent"), F.lit(False)) | F.coalesce("entry", F.lit(False))).alias("allowed"))


def rendezvous(keys: DataFrame, nodes: list[str]) -> DataFrame:
    """The node of the highest hash for each key (highest random weight; ties: the later name): key, node, null for a null key
    or without nodes. The hash is FNV-1a of the node's name, byte 0x1F and the key's text, the same on every machine. Nodes
    are few, and given by name, so their part of the hash is a constant."""
    if not nodes:
        return keys.select("key", F.lit(None).cast("string").alias("node"))

    def weight(node: str) -> Column:
        state = FNV_BASIS
        for byte in node.encode() + b"\x1f":
            state = (state ^ byte) * FNV_PRIME % 2**64
        return text.fnv_from(F.col("key").cast("string"), state)

    best = F.array_max(F.array(*[F.struct(weight(n).alias("w"), F.lit(n).alias("node")) for n in nodes]))
    return keys.select("key", F.when(F.col("key").isNotNull(), best["node"]).alias("node"))


def thresholds(probes: DataFrame) -> DataFrame:
    """Thresholds from probe pairs (similarity, related): one row of p25 of the related, p95 of the others (nearest rank,
    round((n - 1) q)), and dedup = max(p25 - 0.05, p95 + 0.02). Ranks come from one ordered pass over each kind, which
    a calibration's probe set bounds."""
    w = Window.partitionBy("related").orderBy("similarity")
    ranked = probes.select("related", "similarity", (F.row_number().over(w) - 1).alias("k"), F.count("*").over(Window.partitionBy("related")).alias("n"))
    q = F.when(F.col("related"), 0.25).otherwise(0.95)
    hit = ranked.where(F.col("k") == F.floor((F.col("n") - 1) * q + 0.5))
    row = hit.agg(F.max(F.when(F.col("related"), F.col("similarity"))).alias("p25"), F.max(F.when(~F.col("related"), F.col("similarity"))).alias("p95"))
    return row.withColumn("dedup", F.greatest(F.col("p25") - 0.05, F.col("p95") + 0.02))


def reinforced(tr: DataFrame, seen: DataFrame, least: int = 1) -> DataFrame:
    """Transitions (source, target, n) after a decay by one, and two more for each that was seen again; fewer than `least` go."""
    more = seen.select("source", "target", F.lit(2).alias("n"))
    rows = tr.select("source", "target", (F.col("n") - 1).alias("n")).unionByName(more)
    return rows.groupBy("source", "target").agg(F.sum("n").cast("long").alias("n")).where(F.col("n") >= least)


def profile_facts(m: DataFrame, most: int = 100) -> DataFrame:
    """Facts for each owner's profile: semantic or procedural, confidence of 0.5 or more, no entity or community tag; the
    first `most` by id, 300 characters of each: user_id, agent_id, id, fact."""
    rows = m.where(F.col("memory_type").isin("semantic", "procedural") & (F.col("confidence") >= 0.5) & ~F.exists("tags", lambda t: F.startswith(t, F.lit("entity:")) | F.startswith(t, F.lit("community"))))
    w = Window.partitionBy("user_id", "agent_id").orderBy("id")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most).select("user_id", "agent_id", "id", F.substring("content", 1, 300).alias("fact"))


def enrichment_candidates(m: DataFrame, since: int) -> DataFrame:
    """Episodic rows newer than the last run that enrichment did not make: id, created_at."""
    return m.where((F.col("memory_type") == "episodic") & (F.col("created_at") > since) & ~F.array_contains("tags", "source:enrichment")).select("id", "created_at")


def batches(t: DataFrame, n: int) -> DataFrame:
    """Turns of each conversation in chunks of n: conv_id, batch, turns, first, last."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.withColumn("batch", F.floor((F.row_number().over(w) - 1) / n))
    return rows.groupBy("conv_id", "batch").agg(F.count("*").alias("turns"), F.min("turn").alias("first"), F.max("turn").alias("last"))


def episodes(t: DataFrame) -> DataFrame:
    """An episodic text for each user turn, with the assistant's next turn if it answers at once: conv_id, turn, content."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = t.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next"), F.lead("text").over(w).alias("answer"))
    reply = F.when(F.col("next") == "assistant", F.concat(F.lit("\nAssistant: "), F.col("answer"))).otherwise("")
    return rows.where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("User: "), F.col("text"), reply).alias("content"))


def served(m: DataFrame, layout: str = "compact") -> DataFrame:
    """Each memory as a line (compact) or as Markdown (structured): id, line."""
    tags = F.array_join("tags", ",")
    if layout == "compact":
        line = F.concat_ws("|", F.lit("M"), "memory_type", F.format_string("%.2f", "salience"), "content", F.concat(F.lit("tags:"), tags))
    else:
        line = F.concat(F.lit("- **"), F.col("memory_type"), F.lit("** "), F.col("content"), F.when(F.size("tags") > 0, F.concat(F.lit(" _("), tags, F.lit(")_"))).otherwise(""))
    return m.select("id", line.alias("line"))


def delta_lines(changes: DataFrame, m: DataFrame) -> DataFrame:
    """A line for each change (id, change): new rows with their text, others by id: id, line."""
    rows = changes.join(m.select("id", "content"), "id", "left")
    new = F.concat(F.lit("[NEW] "), F.coalesce("content", F.lit("")))
    return rows.select("id", F.when(F.col("change") == "added", new).otherwise(F.concat(F.lit("["), F.upper("change"), F.lit("] "), F.col("id").cast("string"))).alias("line"))


def outcomes(m: DataFrame, shown: DataFrame, least: float = 0.6) -> DataFrame:
    """After an injection (id, reply: its cosine with the answer): access_count + 1, and salience + 0.05, 1 at most, where the
    reply used the row: id, access_count, salience, used."""
    rows = m.join(shown, "id").withColumn("used", F.col("reply") >= least)
    return rows.select("id", (F.col("access_count") + 1).alias("access_count"), F.when(F.col("used"), F.least(F.lit(1.0), F.col("salience") + 0.05)).otherwise(F.col("salience")).alias("salience"), "used")


def refreshed(m: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Decay begins anew for the given ids: salience 1, accessed now."""
    hit = ids.select("id", F.lit(True).alias("_hit")).distinct()
    rows = m.join(hit, "id", "left")
    return rows.withColumn("salience", F.when(F.col("_hit"), 1.0).otherwise(F.col("salience"))).withColumn("accessed_at", F.when(F.col("_hit"), F.lit(now)).otherwise(F.col("accessed_at"))).drop("_hit")
