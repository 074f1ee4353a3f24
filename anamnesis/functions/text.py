"""Text as Column expressions: tokens, slugs, budgets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed import FILLERS, STOP_WORDS


def tokens(text: Column) -> Column:
    """Ranking tokens: runs of letters, digits and quotes, quotes trimmed, lower-cased, of two bytes or more, no stop words."""
    raw = F.transform(F.split(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}']+"), lambda w: F.lower(F.regexp_replace(w, "^'+|'+$", "")))
    return F.filter(raw, lambda w: (F.octet_length(w) >= 2) & ~w.isin(STOP_WORDS))


def frame_tokens(text: Column) -> Column:
    """Letters-and-digits tokens, lower-cased, in order."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def token_set(text: Column) -> Column:
    return F.array_distinct(frame_tokens(text))


def keywords(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(frame_tokens(text), lambda w: F.length(w) >= least))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets held as arrays; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def estimate_tokens(text: Column) -> Column:
    """ceil(1.3 x words)."""
    return F.ceil(F.size(words(text)) * F.lit(13) / F.lit(10)).cast("long")


def contains_any(text: Column, needles: list[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | F.contains(text, F.lit(n))
    return out


def without_fillers(text: Column) -> Column:
    """Cuts the first occurrence of each filler, in order, inside words too; then collapses white space."""
    def cut(t: Column, filler: Column) -> Column:
        at = F.call_function("locate", filler, F.lower(t))
        return F.when(at > 0, F.concat(F.substring(t, F.lit(1), at - 1), F.substring(t, at + F.length(filler), F.length(t)))).otherwise(t)

    return F.trim(F.regexp_replace(F.aggregate(F.array(*map(F.lit, FILLERS)), text, cut), r"\s+", " "))


def slug(text: Column, most: int = 48) -> Column:
    """ASCII letters and digits, lower-cased, other runs as one dash; cut and trimmed."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.regexp_replace(F.substring(s, 1, most), "-+$", "")


def byte_prefix(text: Column, most: int | Column) -> Column:
    """The longest prefix of whole characters within so many bytes: found by halving, 16 steps for up to 65,535 bytes."""
    most = F.lit(most)
    cut = F.substring(text, F.lit(1), most)

    def halve(at: Column, step: Column) -> Column:
        to = at + step
        return F.when(F.octet_length(F.substring(cut, F.lit(1), to)) <= most, to).otherwise(at)

    whole = F.octet_length(cut) <= most
    steps = F.array(*[F.lit(1 << k) for k in range(15, -1, -1)])
    return F.when(most <= 0, F.lit("")).when(whole, cut).otherwise(F.substring(cut, F.lit(1), F.aggregate(steps, F.lit(0), halve)))


def indexed_text(context: Column, content: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) == "", content).otherwise(F.concat(context, F.lit("\n"), content))


def normal(text: Column) -> Column:
    """Lower-cased with single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


# Offset basis and prime of the 64-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv_from(c: Column, state: int) -> Column:
    """FNV-1a, begun at a state, of a text's bytes: the upper and the lower 32 bits of the hash, so that no product overflows."""
    digits, low = F.hex(F.encode(c, "UTF-8")), (1 << 32) - 1
    size = F.octet_length(c)
    places = F.when(size > 0, F.sequence(F.lit(1), F.greatest(size, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    bytes_ = F.transform(places, lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))

    def step(h: Column, b: Column) -> Column:
        # the prime is 2^40 and its lower bits: the former moves the lower half into the upper one by 8 bits
        x = h["lo"].bitwiseXOR(b)
        product = x * (FNV_PRIME & low)
        upper = h["hi"] * (FNV_PRIME & low) + F.shiftleft(x, 8) + F.shiftright(product, 32)
        return F.struct(upper.bitwiseAND(F.lit(low)).alias("hi"), product.bitwiseAND(F.lit(low)).alias("lo"))

    return F.aggregate(bytes_, F.struct(F.lit(state >> 32).cast("long").alias("hi"), F.lit(state & low).cast("long").alias("lo")), step)
