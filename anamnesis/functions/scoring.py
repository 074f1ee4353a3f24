"""Salience, validity, visibility and archival as Column expressions. Instants are microseconds, always given."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import DAY, HALF_LIFE

NOBODY = "nil"


def decayed(salience: Column, accessed: Column, count: Column, now: int | Column) -> Column:
    """clamp(salience x 2^(-age / half-life) + 0.1 ln(1 + accesses), 0.01, 1)."""
    age = F.greatest(F.lit(0), F.lit(now) - accessed) / HALF_LIFE
    return F.least(F.lit(1.0), F.greatest(F.lit(0.01), salience * F.pow(F.lit(2.0), -age) + 0.1 * F.log(1.0 + count)))


def valid_at(start: Column, end: Column, t: int | Column) -> Column:
    """Half-open; an open end is open."""
    return (F.coalesce(start, F.lit(0)) <= F.lit(t)) & (end.isNull() | (F.lit(t) < end))


def visible(owner: Column, scope: str | None) -> Column:
    return F.lit(True) if scope is None else owner.isin(scope, NOBODY)


def archival(memory_type: Column, salience: Column, created: Column, count: Column, now: int) -> Column:
    age = F.lit(now) - created
    return F.when(memory_type != "episodic", "keep").when((salience < 0.05) & (age > 30 * DAY) & (count < 2), "delete").when((salience < 0.1) & (age > 7 * DAY), "archive").otherwise("keep")


def first_tag(tags: Column, prefix: str) -> Column:
    """What follows the prefix in the first tag that has it, or null."""
    return F.get(F.transform(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), lambda t: F.substring(t, F.lit(len(prefix) + 1), F.length(t))), 0)


def scope_key(tags: Column) -> Column:
    """The first of scope:global and scope:project:*."""
    return F.get(F.filter(tags, lambda t: (t == "scope:global") | F.startswith(t, F.lit("scope:project:"))), 0)
