"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter holds one bitmask of languages at each position; the AND of an n-gram's positions is the
set of all languages that contain it. Per-language counts of a text, corrected for each language's rate of false
positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, mix, written

N = 4
#: Labelled texts of each language that the filters are built from, at most about so many, chosen by a hash of the id.
SAMPLE = 6000
#: Positions of the filter: a power of two, at least LEAST and so many for each n-gram of the largest language; positions
#: of each n-gram.
LEAST, ROOM, HASHES, SHIFT = 1 << 19, 12, 3, 21
#: Pieces in which parts of the filter are put together.
CHUNKS = 64
#: An n-gram belongs to a language where it is at least so frequent as this share of its frequency anywhere.
SHARE = 0.3


@lru_cache(1)
def fold_table() -> np.ndarray:
    """Lower-cased letters; 0x20 for every other code point."""
    out = np.full(0x110000, 0x20, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, n-gram hashes, row of each, whether a row has a letter) by blocks."""
    spaced = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
    table = fold_table()
    for lo, hi, data, offsets in blocks(spaced):
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        point = table[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
        row = np.repeat(np.arange(hi - lo, dtype=np.int32), np.diff(np.searchsorted(lead, offsets)))
        letters = np.bincount(row[point != 0x20], minlength=hi - lo) > 0
        kept = np.ones(len(point), bool)
        kept[1:] = (point[1:] != 0x20) | (point[:-1] != 0x20) | (row[1:] != row[:-1])
        point, row = point[kept].astype(np.uint64), row[kept]
        n = max(0, len(point) - N + 1)
        h = np.zeros(n, np.uint64)
        for j in range(N):
            h = h * np.uint64(0x100000001B3) + point[j : j + n]
        inside = row[:n] == row[N - 1 :] if n else np.zeros(0, bool)
        yield lo, hi, mix(h[inside]), row[:n][inside], letters


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # of languages, by position
    false_positive: np.ndarray  # rate, by language

    def lookup(self, h: np.ndarray) -> np.ndarray:
        last = np.uint64(len(self.masks) - 1)
        got = self.masks[h & last]
        for k in range(1, HASHES):
            got = got & self.masks[(h >> np.uint64(SHIFT * k)) & last]
        return got

    def scores(self, h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """Expected true n-grams, of each text and language."""
        found = self.lookup(h)
        total = np.bincount(row, minlength=rows).astype(float)
        out = np.zeros((rows, len(self.languages)))
        for l, fp in enumerate(self.false_positive):
            word, bit = divmod(l, 64)
            hits = np.bincount(row, weights=(found[:, word] >> np.uint64(bit)) & np.uint64(1), minlength=rows)
            out[:, l] = np.maximum(0.0, (hits - total * fp) / (1.0 - fp))
        return out


def positions(most: int) -> int:
    """Positions of a filter whose largest language has so many n-grams."""
    return max(LEAST, 1 << (ROOM * most - 1).bit_length()) if most else LEAST


def mark(masks: np.ndarray, l: int, h: np.ndarray) -> None:
    """Sets the bit of language l at the positions of n-grams h."""
    word, bit = divmod(l, 64)
    for k in range(HASHES):
        masks[(h >> np.uint64(SHIFT * k)) & np.uint64(len(masks) - 1), word] |= np.uint64(1 << bit)


def closed(languages: list[str], masks: np.ndarray) -> LanguageFilter:
    """The filter with each language's rate of false positives, from its share of set bits."""
    fills = np.array([((masks[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1)).mean() for l in range(len(languages))])
    return LanguageFilter(languages, masks, np.minimum(fills**HASHES, 0.99))


def build(languages: list[str], members: list[np.ndarray]) -> LanguageFilter:
    """A filter of these n-grams of each language."""
    masks = np.zeros((positions(max(map(len, members), default=0)), max(1, -(-len(languages) // 64))), np.uint64)
    for l, h in enumerate(members):
        mark(masks, l, h)
    return closed(languages, masks)


def fit(docs: DataFrame, training: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE) -> LanguageFilter:
    """Filters from a bounded sample (about `sample` texts of each language) of the training rows with text and language.

    A filter holds every n-gram of its language's texts but those that are SHARE times or less as frequent in it as in some
    other language. Only the filter itself reaches the driver.
    """
    rows = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(F.col(lang_col)).count().collect()}
    languages = sorted(sizes)
    if not languages:
        return build([], [])
    million = 1_000_000
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(million))
    most = F.element_at(F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(int(million * min(1.0, sample / sizes[l])) + 1))]), F.col(lang_col))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang = np.array(batch.column(0).to_pylist(), object)
            for lo, hi, h, row, _ in grams(batch.column(1)):
                for l in set(lang[lo:hi]):
                    name, n = np.unique(h[(lang[lo:hi] == l)[row]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([l] * len(name), pa.string()), pa.array(name.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    counted = rows.where(draw < most).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = written(counted, "grams")
    totals = {r[0]: r[1] for r in counted.groupBy("lang").agg(F.sum("n")).collect()}
    number = F.element_at(F.create_map(*[x for i, l in enumerate(languages) for x in (F.lit(l), F.lit(i))]), F.col("lang"))
    total = F.element_at(F.create_map(*[x for l in languages for x in (F.lit(l), F.lit(float(totals.get(l, 1))))]), F.col("lang"))
    shared = counted.select("gram", F.struct((F.col("n") / total).alias("rate"), number.alias("l")).alias("p")).groupBy("gram").agg(F.collect_list("p").alias("ps"), F.max("p.rate").alias("best"))
    kept = shared.select("gram", F.explode(F.filter("ps", lambda p: p["rate"] >= SHARE * F.col("best"))).alias("p")).select("gram", F.col("p.l").alias("l"))
    kept = written(kept, "members")
    held = {r[0]: r[1] for r in kept.groupBy("l").count().collect()}
    shape = (positions(max(held.values(), default=0)), max(1, -(-len(languages) // 64)))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = np.zeros(shape, np.uint64)
        for batch in batches:
            h, l = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for i in np.unique(l).tolist():
                mark(masks, i, h[l == i])
        for c, piece in enumerate(np.split(masks, CHUNKS)):
            yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([piece.tobytes()], pa.binary())], names=["chunk", "part"])

    def either(t: pa.Table) -> pa.Table:
        out = None
        for p in t.column("part"):
            p = np.frombuffer(p.as_buffer(), np.uint64)
            out = p if out is None else out | p
        return pa.table({"chunk": t.column("chunk").slice(0, 1), "part": pa.array([out.tobytes()], pa.binary())})

    merged = kept.coalesce(8).mapInArrow(part, "chunk long, part binary").groupBy("chunk").applyInArrow(either, "chunk long, part binary")
    raw = {r[0]: r[1] for r in merged.collect()}  # the filter, piece by piece
    masks = np.concatenate([np.frombuffer(raw[c], np.uint64) for c in range(CHUNKS)]).reshape(shape) if raw else np.zeros(shape, np.uint64)
    return closed(languages, masks)


def predict(docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text.

    Returns id, lang_pred, score (the winner's share of all languages' corrected counts). `und` with score 0 where the
    text is null or has no letter, or where no language was learned. A text without a known n-gram gets the first
    language, score 0; ties go to the smaller name. Repeated rows are judged each.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, h, row, letters in grams(batch.column(1)):
                names, score = ["und"] * (hi - lo), np.zeros(hi - lo)
                if m.languages:
                    s = m.scores(h, row, hi - lo)
                    best = s.argmax(axis=1)
                    total = s.sum(axis=1)
                    score = np.where(letters & (total > 0), s.max(axis=1) / np.maximum(total, 1e-300), 0.0)
                    names = [m.languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(names, pa.string()), pa.array(score)], names=[id_col, "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, lang_pred string, score double")
