"""Vector, text and hybrid retrieval (of R1-R37)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..fixed import RRF_K
from ..functions import text, vector
from ..functions.scoring import decayed, first_tag, valid_at, visible
from ..sources.scratch import written

K1, B = 1.2, 0.75


def nearest(m: DataFrame, query: list[float], k: int, metric: str = "cosine") -> DataFrame:
    """The k nearest rows with vectors of the query's dimension, exactly: id, distance; ties by id."""
    q = vector.literal(query)
    measure = {"cosine": vector.cosine_distance, "euclidean": vector.euclidean, "dot": lambda a, b: -vector.dot(a, b)}[metric]
    return m.where(F.size("embedding") == len(query)).select("id", measure(F.col("embedding"), q).alias("distance")).orderBy(F.round("distance", 9), "id").limit(k)


def term_counts(m: DataFrame, terms: list[str]) -> DataFrame:
    """id, len (tokens of the indexed text) and t0, t1, ... (how often each term occurs): each text is tokenised once, and what
    reaches the shuffle is one row for each memory."""
    words = m.select("id", F.explode_outer(text.tokens(text.indexed_text(F.col("context"), F.col("content")))).alias("w"))
    return words.groupBy("id").agg(F.count("w").alias("len"), *[F.count_if(F.col("w") == t).alias(f"t{i}") for i, t in enumerate(terms)])


def bm25(m: DataFrame, query: str, k: int | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """id, score. A repeated query term counts repeatedly; statistics are of all rows, also where candidates restrict the result.

    Only counts of the query's terms are kept, in one pass over the texts. An empty query, or one of stop words, gives no rows.
    """
    spark = m.sparkSession
    asked = [r[0] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(text.tokens(F.col("q")))).collect()]
    times: dict[str, int] = {}
    for t in asked:
        times[t] = times.get(t, 0) + 1
    if not times:
        return m.limit(0).select("id", F.lit(0.0).alias("score"))
    docs = written(term_counts(m, list(times)), "terms")
    stats = docs.agg(F.count("*").alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(times))])
    both = docs.join(F.broadcast(stats))  # one row
    score: Column = F.lit(0.0)
    for i, n in enumerate(times.values()):
        tf, df = F.col(f"t{i}"), F.col(f"d{i}")
        idf = F.log((F.col("n") - df + 0.5) / (df + 0.5) + 1)
        score = score + n * idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    hit = both.where(sum((F.col(f"t{i}") for i in range(len(times))), F.lit(0)) > 0).select("id", score.alias("score"))
    if candidates is not None:
        hit = hit.join(candidates.select("id"), "id", "left_semi")
    return hit.orderBy(F.desc(F.round("score", 9)), "id").limit(k) if k else hit


def ranked(df: DataFrame, *order: Column) -> DataFrame:
    """Adds `rank`, from 0, to a bounded top-k."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def hybrid(m: DataFrame, query_vector: list[float], query_text: str | None, fetch: int, pool: DataFrame | None = None) -> DataFrame:
    """Reciprocal-rank fusion of both legs' top rows: id, score = 0.7 rrf + 0.05 salience + 0.01. Candidates are the rows of
    `pool`, if given; word statistics are of all rows nevertheless."""
    legs = ranked(nearest(m if pool is None else pool, query_vector, fetch), F.round("distance", 9), F.col("id")).select("id", "rank")
    if query_text:
        legs = legs.union(ranked(bm25(m, query_text, fetch, pool), F.desc(F.round("score", 9)), F.col("id")).select("id", "rank"))
    fused = legs.groupBy("id").agg(F.sum(1 / (RRF_K + F.col("rank"))).alias("rrf"))
    return m.select("id", "salience").join(F.broadcast(fused), "id").select("id", (0.7 * F.col("rrf") + 0.05 * F.coalesce("salience", F.lit(0.5)) + 0.02 * 0.5).alias("score"))


def magnitude(m: DataFrame, query_vector: list[float], query_text: str, fetch: int, weights: tuple[float, float, float] = (1.0, 1.0, 0.1)) -> DataFrame:
    """The other fusion: closeness and BM25 scores, each min-max normalised over its leg (a constant leg is all 1), and salience."""
    every = Window.partitionBy()

    def unit(c: str) -> Column:
        low, high = F.min(c).over(every), F.max(c).over(every)
        return F.when(high == low, 1.0).otherwise((F.col(c) - low) / (high - low))

    near = nearest(m, query_vector, fetch).select("id", (-F.col("distance")).alias("c")).select("id", (weights[0] * unit("c")).alias("s"))
    lexical = bm25(m, query_text, fetch).select("id", (weights[1] * unit("score")).alias("s"))
    both = near.union(lexical).groupBy("id").agg(F.sum("s").alias("s"))
    return m.select("id", "salience").join(F.broadcast(both), "id").select("id", (F.col("s") + weights[2] * F.col("salience")).alias("score"))


@dataclass(frozen=True)
class Recall:
    """What a recall asks for; at and now are instants in microseconds."""

    vector: list[float]
    text: str | None
    k: int
    now: int
    at: int | None = None
    user: str | None = None
    agent: str | None = None
    project: str | None = None
    tags: tuple[str, ...] = ()
    any_tag: bool = False
    start: int | None = None
    end: int | None = None


def superseded(edges: DataFrame, at: int) -> DataFrame:
    """Targets of a Supersedes or Contradicts edge that is valid at the instant."""
    return edges.where(F.col("edge_type").isin("supersedes", "contradicts") & valid_at(F.col("valid_from"), F.col("valid_until"), at)).select(F.col("target").alias("id")).distinct()


def recall(m: DataFrame, edges: DataFrame, ask: Recall) -> DataFrame:
    """Hybrid recall: candidates by tags and time, fusion of 12 k rows a leg into 3 k, less superseded, hidden and invalid
    rows, then 0.7 x fused + 0.3 x decayed salience, halved for other projects; the best k: id, score."""
    at = ask.now if ask.at is None else ask.at
    pool = None
    if ask.tags:
        wanted = F.array(*map(F.lit, ask.tags))
        pool = m.where(F.arrays_overlap("tags", wanted) if ask.any_tag else F.forall(wanted, lambda t: F.array_contains(F.col("tags"), t)))
    if ask.start is not None and ask.end is not None:
        pool = (m if pool is None else pool).where(F.col("created_at").between(ask.start, ask.end))
    hits = hybrid(m, ask.vector, ask.text, 12 * ask.k, pool).orderBy(F.desc(F.round("score", 9)), "id").limit(3 * ask.k)
    rows = m.drop("embedding", "content").join(F.broadcast(hits), "id")
    rows = rows.join(superseded(edges, at), "id", "left_anti")
    rows = rows.where(visible(F.col("user_id"), ask.user) & visible(F.col("agent_id"), ask.agent) & valid_at(F.col("valid_from"), F.col("valid_until"), at))
    score = 0.7 * F.col("score") + 0.3 * decayed(F.col("salience"), F.col("accessed_at"), F.col("access_count"), ask.now)
    if ask.project is not None:
        mine = first_tag(F.col("tags"), "scope:project:")
        score = F.when(mine.isNull() | (mine == ask.project), score).otherwise(0.5 * score)
    return rows.select("id", score.alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(ask.k)


def merged(runs: list[DataFrame], k: int, weights: list[float] | None = None) -> DataFrame:
    """Several rankings (id, score) by weighted reciprocal rank: id, score."""
    out = None
    for r, w in zip(runs, weights or [1.0] * len(runs), strict=True):
        part = ranked(r, F.desc(F.round("score", 9)), F.col("id")).select("id", (w / (RRF_K + F.col("rank"))).alias("s"))
        out = part if out is None else out.union(part)
    return out.groupBy("id").agg(F.sum("s").alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(k)


# Weight of each memory type for actions, in the order of the types.
ACTION_WEIGHTS = {"episodic": 0.3, "semantic": 0.5, "procedural": 1.0, "anti_pattern": 1.0, "reasoning": 0.7, "correction": 1.0}


def for_action(m: DataFrame, query_vector: list[float], action: str, k: int) -> DataFrame:
    """Of the 5 k nearest, those with similarity 0.3 or a shared keyword: (similarity + 0.5 if shared) x type weight."""
    near = nearest(m, query_vector, 5 * k)
    wanted = text.keywords(F.lit(action))
    rows = m.select("id", "memory_type", "created_at", text.keywords(F.col("content")).alias("kw")).join(F.broadcast(near), "id")
    shared, sim = F.arrays_overlap("kw", wanted), 1 - F.col("distance")
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in ACTION_WEIGHTS.items() for x in kv]), F.col("memory_type"))
    kept = rows.where((sim >= 0.3) | shared).select("id", "created_at", ((sim + F.when(shared, 0.5).otherwise(0.0)) * weight).alias("score"))
    return kept.orderBy(F.desc(F.round("score", 9)), F.desc("created_at"), F.desc("id")).limit(k).select("id", "score")


def lexical_rerank(hits: DataFrame, m: DataFrame, query: str) -> DataFrame:
    """0.5 x score + 0.5 x share of the query's distinct tokens that the text has."""
    q = F.array_distinct(text.tokens(F.lit(query)))
    rows = m.select("id", text.tokens(F.col("content")).alias("toks")).join(F.broadcast(hits), "id")
    share = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect("toks", q)) / F.size(q))
    return rows.select("id", (0.5 * F.col("score") + 0.5 * share).alias("score"))

