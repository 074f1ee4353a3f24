"""Scans and predicates over memories (S1-S46 of the survey): all are filters, projections and bounded top-n."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_all_tags(m: DataFrame, tags: list[str]) -> DataFrame:
    """No tags asked for: no rows."""
    return m.where(F.forall(F.array(*map(F.lit, tags)), lambda t: F.array_contains(F.col("tags"), t))) if tags else m.limit(0)


def with_any_tag(m: DataFrame, tags: list[str]) -> DataFrame:
    return m.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else m.limit(0)


def without_tags(m: DataFrame, tags: list[str]) -> DataFrame:
    return m.where(~F.arrays_overlap("tags", F.array(*map(F.lit, tags)))) if tags else m


def tag_vocabulary(m: DataFrame, prefix: str = "") -> DataFrame:
    return m.select(F.explode("tags").alias("tag")).where(F.startswith("tag", F.lit(prefix))).distinct()


def created_between(m: DataFrame, start: int, end: int) -> DataFrame:
    """Both ends belong."""
    return m.where(F.col("created_at").between(start, end))


def newest(m: DataFrame, n: int, skip: list[str] = (), after: int | None = None) -> DataFrame:
    """Newest n without skipped tags; `after` is the last id of the page before (keyset cursor, ties by id)."""
    return _page(m, n, skip, after, False)


def oldest(m: DataFrame, n: int, skip: list[str] = (), after: int | None = None) -> DataFrame:
    return _page(m, n, skip, after, True)


def _page(m: DataFrame, n: int, skip: list[str], after: int | None, ascending: bool) -> DataFrame:
    m = without_tags(m, list(skip))
    if after is not None:
        mark = m.sparkSession.createDataFrame([(after,)], "cursor long")
        at = m.join(F.broadcast(mark), F.col("id") == F.col("cursor"), "left_semi").select(F.col("created_at").alias("c_at"), F.col("id").alias("c_id"))
        now, was = F.struct("created_at", "id"), F.struct("c_at", "c_id")
        m = m.join(F.broadcast(at), (now > was) if ascending else (now < was)).drop("c_at", "c_id")
    order = [F.col("created_at"), F.col("id")] if ascending else [F.desc("created_at"), F.desc("id")]
    return m.orderBy(*order).limit(n)


def most_salient(m: DataFrame, n: int) -> DataFrame:
    return m.orderBy(F.desc("salience"), "id").limit(n)


def listed(m: DataFrame, offset: int, limit: int, agent: str | None = None, memory_type: str | None = None, text: str | None = None) -> DataFrame:
    """A page by id; filters apply to the page, after offset and limit."""
    page = m.orderBy("id").offset(offset).limit(limit)
    for column, value in (("agent_id", agent), ("memory_type", memory_type)):
        if value is not None:
            page = page.where(F.col(column) == value)
    return page.where(F.contains(F.lower("content"), F.lit(text.lower()))) if text is not None else page


def by_id(m: DataFrame, ids: list[int]) -> DataFrame:
    return m.where(F.col("id").isin(ids))


def tagged_like(m: DataFrame, prefix: str) -> DataFrame:
    return m.where(F.exists("tags", lambda t: F.startswith(t, F.lit(prefix))))


def upsert(m: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of the same id are replaced."""
    return m.join(rows.select("id"), "id", "left_anti").unionByName(rows.select(*m.columns))


def deleted(m: DataFrame, ids: DataFrame) -> DataFrame:
    return m.join(ids.select("id"), "id", "left_anti")


def patched(m: DataFrame, patch: DataFrame) -> DataFrame:
    """patch: id and some columns of m; its non-null values replace those of m."""
    names = [c for c in patch.columns if c != "id"]
    p = patch.select("id", *[F.col(c).alias(f"_{c}") for c in names])
    return m.join(p, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in names}).drop(*[f"_{c}" for c in names])
