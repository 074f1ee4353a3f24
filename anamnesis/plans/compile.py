"""Statements to lazy DataFrames (Q11-Q21): one builder; Catalyst picks the access path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import decayed, valid_at
from ..operators import graph, retrieval
from .language import All_, Any_, Consolidate, Forget, Leaf, Not, QueryError, Recall, Relate, Traverse, parse

COLUMNS = {"agent": "agent_id", "space": "space_id", "salience": "salience", "confidence": "confidence", "created": "created_at", "accessed": "accessed_at"}
ORDERS = {"salience": "salience", "confidence": "confidence", "created": "created_at", "accessed": "access_count"}


def predicate(c) -> Column:
    """Column of a condition. `content` tests case-insensitive substrings; `tag` tests membership."""
    if isinstance(c, Any_):
        out = predicate(c.of[0])
        for x in c.of[1:]:
            out = out | predicate(x)
        return out
    if isinstance(c, All_):
        out = predicate(c.of[0])
        for x in c.of[1:]:
            out = out & predicate(x)
        return out
    if isinstance(c, Not):
        return ~predicate(c.of)
    if c.op == "~>":
        raise QueryError("~> stands alone or in a pure AND")
    if c.op == "IN":
        out = F.lit(False)
        for v in c.value:
            out = out | predicate(Leaf(c.field, "=", v))
        return out
    if c.field == "content":
        hit = F.contains(F.lower("content"), F.lit(str(c.value).lower()))
        return ~hit if c.op == "!=" else hit
    if c.field == "tag":
        hit = F.array_contains("tags", str(c.value))
        return ~hit if c.op == "!=" else hit
    if c.field == "type":
        if c.op not in ("=", "!=", "CONTAINS"):
            raise QueryError("types have no order")
        hit = F.col("memory_type") == str(c.value).lower()
        return ~hit if c.op == "!=" else hit
    col, v = F.col(COLUMNS[c.field]), F.lit(c.value)
    if c.op in ("=", "CONTAINS"):
        return F.abs(col - v) < 2.22e-16 if isinstance(c.value, float) else col == v
    return {"!=": col != v, ">": col > v, "<": col < v, ">=": col >= v, "<=": col <= v}[c.op]


def _similar(c) -> tuple[str | None, object]:
    """Takes the one ~> leaf out of a pure AND."""
    parts = c.of if isinstance(c, All_) else (c,) if c is not None else ()
    found = [x for x in parts if isinstance(x, Leaf) and x.op == "~>"]
    if not found:
        return None, c
    if len(found) > 1 or any(not isinstance(x, Leaf) for x in parts):
        raise QueryError("one ~> only, in a pure AND")
    rest = tuple(x for x in parts if x is not found[0])
    return str(found[0].value), All_(rest) if len(rest) > 1 else rest[0] if rest else None


def compile_recall(q: Recall, m: DataFrame, now: int, embed=None) -> DataFrame:
    """id, score (0 without NEAR or ~>). Filters apply before the nearest rows are taken; score = 0.7 x (1 - distance) + 0.3 x decayed salience."""
    text, where = _similar(q.where)
    rows = m if where is None else m.where(predicate(where))
    if q.as_of is not None:
        rows = rows.where(valid_at(F.col("valid_from"), F.col("valid_until"), q.as_of))
    near = q.near
    if text is not None:
        if embed is None:
            raise QueryError("~> needs an embedder")
        near = embed(text)
    if near is not None:
        hits = retrieval.nearest(rows, near, q.limit)
        fresh = decayed(F.col("salience"), F.col("accessed_at"), F.col("access_count"), now)
        rows = rows.join(F.broadcast(hits), "id").withColumn("score", 0.7 * (1 - F.col("distance")) + 0.3 * fresh)
        order = [F.desc(F.round("score", 9)), F.col("id")]
    else:
        rows, order = rows.withColumn("score", F.lit(0.0)), [F.col("id")]
    if q.order and q.order[0] in ORDERS:
        col = F.col(ORDERS[q.order[0]])
        order = [col.desc() if q.order[1] else col.asc(), F.col("id")]
    return rows.orderBy(*order).limit(q.limit).select("id", "score")


def run(query: str, m: DataFrame, e: DataFrame, now: int, embed=None) -> DataFrame:
    """A read gives its rows; a write gives the table that it changes: RELATE the edges, FORGET the memories; CONSOLIDATE the
    memories that qualify."""
    q = parse(query)
    if isinstance(q, Recall):
        return compile_recall(q, m, now, embed)
    if isinstance(q, Traverse):
        return graph.reachable(e, graph.known(e, [int(q.start)]), q.depth, [q.edge_type] if q.edge_type else None)
    if isinstance(q, Relate):
        new = e.sparkSession.createDataFrame([(int(q.source), int(q.target), q.edge_type, q.weight, now, None, None)], "source long, target long, edge_type string, weight double, created_at long, valid_from long, valid_until long")
        return graph.added(e, new, m)
    if isinstance(q, Forget):
        return m.where(F.col("id") != int(q.id))
    if isinstance(q, Consolidate):
        return m.where(predicate(All_(tuple(q.where)))) if len(q.where) > 1 else m.where(predicate(q.where[0])) if q.where else m
    raise QueryError("unknown statement")
