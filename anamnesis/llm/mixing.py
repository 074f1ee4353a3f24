"""Mixing sources to target weights.

The words of each source are packed into blocks of a fixed length, documents end to end. A source's target gives it
a number of slots; the slots are dealt to output shards by a multinomial draw, conditioned on the sources' totals, so
that the totals come out exactly. The j-th slot of a source takes block P(j mod n) of pass j div n, where P is a keyed
permutation of the source's n blocks, another for each pass. Slots and blocks are joined by (source, block).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, fresh, mapped, words, written
from .feistel import invert, permute

BLOCK_WORDS = 256
#: Slots of a shard at least, and shards at most: what the driver holds is bounded by SHARDS x sources.
SHARD_SLOTS, SHARDS = 4096, 2048
#: Documents of a bucket of the running sums, about.
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Source:
    index: int
    name: str | None
    size: int
    target: float
    blocks: int
    slots: int
    last: int  # words of the last slot


def share_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """total, shared by weight; none above `most` times its size, the excess reshared by weight until none is above."""
    caps = [most * s for s in sizes]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * weights[i] / weight > caps[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / weight
            break
        for i in full:
            out[i] = caps[i]
            open_.discard(i)
            left -= caps[i]
    return out


def _slots(size: int, target: float, block: int, key: int) -> tuple[int, int, int]:
    """(blocks, slots, words of the last slot) so that the slots hold target words, rounded."""
    n, want = -(-size // block), int(round(target))
    if not size or not want:
        return n, 0, 0
    passes, rest = divmod(want, size)
    if not rest:
        tail = size - (n - 1) * block
        return n, passes * n, tail if int(permute(np.array([n - 1]), n, key + passes - 1)[0]) == n - 1 else block
    short = n * block - size  # words that the last block lacks
    place = int(invert(np.array([n - 1]), n, key + passes)[0])
    q = -(-rest // block)
    if place < q:
        q = max(place + 1, -(-(rest + short) // block))
    held = q * block - (short if place < q else 0)
    width = block - short if place == q - 1 else block
    return n, passes * n + q, width - (held - rest)


def source_key(seed: int, index: int) -> int:
    return (seed * 1_000_003 + index) << 20


def plan(sized: DataFrame, weights: tuple[float, ...], scale: float, most: float, block: int, seed: int) -> list[Source]:
    """Sources by code point, null last; a row for each source reaches the driver."""
    rows = sorted(sized.groupBy("source").agg(F.sum("size").alias("size")).collect(), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    sizes = [r[1] for r in rows]
    targets = share_targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], scale * sum(sizes), most)
    return [Source(i, r[0], r[1], t, *_slots(r[1], t, block, source_key(seed, i))) for i, (r, t) in enumerate(zip(rows, targets, strict=True))]


def placed(sized: DataFrame, sources: list[Source], documents: int) -> DataFrame:
    """Adds source_index and start, the words of the same source before the document. Documents are ordered by a bucket
    of a hash and then by id, and running sums are taken of buckets and within buckets, so no task holds a source."""
    spark = sized.sparkSession
    named = spark.createDataFrame([(s.name, s.index) for s in sources], "source string, source_index int")
    buckets = max(16, documents // BUCKET_ROWS)
    rows = sized.join(F.broadcast(named), sized["source"].eqNullSafe(named["source"])).drop(named["source"]).withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    inner = Window.partitionBy("source_index", "bucket").orderBy("doc_id", "copy").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_index", "bucket").agg(F.sum("size").alias("held"))
    before = sums.select("source_index", "bucket", F.coalesce(F.sum("held").over(Window.partitionBy("source_index").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return rows.join(before, ["source_index", "bucket"]).withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(inner), F.lit(0))).drop("bucket", "base")


def deal(counts: list[int], seed: int) -> np.ndarray:
    """Slots of each shard (row) and source (column): a multinomial draw for each shard, given the sources' totals."""
    total = sum(counts)
    per = max(SHARD_SLOTS, -(-total // SHARDS))
    shards = max(1, -(-total // per))
    rng, left, out = np.random.default_rng(seed), np.array(counts, np.int64), []
    for s in range(shards):
        size = min(per, int(left.sum()))
        out.append(_hypergeometric(rng, left, size))
        left = left - out[-1]
    return np.array(out, np.int64).reshape(shards, len(counts))


def _hypergeometric(rng: np.random.Generator, left: np.ndarray, size: int) -> np.ndarray:
    """Multivariate hypergeometric by its marginals; numbers beyond the generator's limit use the normal limit, clipped."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for i, have in enumerate(left.tolist()):
        others = rest - have
        if not others:
            got = size
        elif rest < 10**9:
            got = int(rng.hypergeometric(have, others, size))
        else:
            p = have / rest
            got = int(round(rng.normal(size * p, (size * p * (1 - p) * (rest - size) / max(1, rest - 1)) ** 0.5)))
        got = min(have, size, max(got, size - others, 0))
        out[i], size, rest = got, size - got, others
    return out


def draw(spark, sources: list[Source], block: int, seed: int) -> DataFrame:
    """A row for each slot: shard, slot (place in the shard), source_index, turn (pass over the source), block, words (of the block, from its start)."""
    dealt = deal([s.slots for s in sources], seed)
    before = np.cumsum(dealt, axis=0) - dealt

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"].tolist():
                n = int(dealt[shard].sum())
                done = 0
                for s in sources:
                    have = int(dealt[shard, s.index])
                    for lo in range(0, have, 1 << 18):
                        j = before[shard, s.index] + np.arange(lo, min(have, lo + (1 << 18)), dtype=np.int64)
                        taken = np.empty(len(j), np.int64)
                        for p in np.unique(j // s.blocks):
                            at = j // s.blocks == p
                            taken[at] = permute(j[at] % s.blocks, s.blocks, source_key(seed, s.index) + int(p))
                        size = np.minimum(block, s.size - taken * block)
                        size[j == s.slots - 1] = s.last
                        place = permute(done + np.arange(len(j)), n, source_key(seed + 1, shard))
                        done += len(j)
                        yield pd.DataFrame({"shard": np.int64(shard), "slot": place, "source_index": np.int32(s.index), "turn": j // s.blocks, "block": taken, "words": size})

    shards = len(dealt)
    return spark.range(0, shards, 1, min(shards, 256)).mapInPandas(run, "shard long, slot long, source_index int, turn long, block long, words long")


@dataclass
class Mixture:
    sources: list[Source]
    documents: DataFrame  # doc_id, copy, size, source_index, start
    slots: DataFrame
    block: int

    def pieces(self) -> DataFrame:
        """Parts of documents by block: doc_id, copy, source_index, block, begin and end (words of the block), skip (words of the document before)."""
        b = self.block
        spans = self.documents.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((F.col("start") + F.col("size") - 1) / b))))
        first = F.col("block") * b
        return spans.select("doc_id", "copy", "source_index", "block", F.greatest(F.col("start") - first, F.lit(0)).alias("begin"), F.least(F.col("start") + F.col("size") - first, F.lit(b)).alias("end"), F.greatest(first - F.col("start"), F.lit(0)).alias("skip"))

    def taken(self) -> DataFrame:
        """What the mix takes: doc_id, copy, shard, slot, turn, skip, words; blocks and slots are joined by index."""
        # the slots' size is unknown to the planner, which would broadcast them
        joined = self.pieces().join(self.slots.hint("merge"), ["source_index", "block"])
        got = F.least(F.col("end"), F.col("words")) - F.col("begin")
        return joined.select("doc_id", "copy", "shard", "slot", "turn", "skip", got.alias("words")).where("words > 0")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), scale: float = 1.5, most: float = 2.0, block: int = BLOCK_WORDS, seed: int = 0, sizes: Column | None = None) -> Mixture:
    """Plan a mixture of doc_id, text, source. A null text has no words; rows that repeat an id are told apart by `copy`
    (a running number of equal rows' texts), and each counts. Sources weigh `weights`, repeating, by code point, null last."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long") if sizes is None else sizes
    sized = docs.select("doc_id", F.col("source"), size.alias("size"), F.xxhash64("text").alias("sign"))
    sized = written(sized, "sizes")
    again = Window.partitionBy("doc_id").orderBy("sign", "size", "source")
    repeats = sized.groupBy("doc_id").count().where("count > 1").limit(1).count()
    sized = sized.withColumn("copy", F.row_number().over(again) if repeats else F.lit(1)).drop("sign")
    sources = plan(sized, weights, scale, most, block, seed)
    return Mixture(sources, placed(sized, sources, sized.count()), draw(docs.sparkSession, sources, block, seed), block)


def mix_counts(m: Mixture) -> DataFrame:
    """Words that the mix takes of each document: doc_id, copy, size, source_size, target, taken."""
    spark = m.documents.sparkSession
    named = spark.createDataFrame([(s.index, s.size, float(s.target)) for s in m.sources], "source_index int, source_size long, target double")
    sums = m.taken().groupBy(F.col("doc_id").alias("d"), F.col("copy").alias("c")).agg(F.sum("words").alias("taken"))
    rows = m.documents.join(F.broadcast(named), "source_index")
    return rows.join(sums, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")), "left").select("doc_id", "copy", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, m: Mixture) -> DataFrame:
    """The mixture as documents: for each pass over its source that takes words of a document, the runs of taken words,
    as rows with the document's columns, the run as text and its length as n_chars (if there is one). Rows of one id are
    told apart as in mix()."""
    spans = m.taken().groupBy("doc_id", "copy").agg(F.sort_array(F.collect_list(F.struct("turn", "skip", "words"))).alias("spans"))
    sign = F.struct(F.xxhash64("text"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)), F.col("source"))
    repeats = m.documents.where("copy > 1").limit(1).count()
    own_copy, its_id, its_copy, its_spans = (fresh(docs.columns, x) for x in ("_copy", "_its_id", "_its_copy", "_its_spans"))
    rows = docs.withColumn(own_copy, F.row_number().over(Window.partitionBy("doc_id").orderBy(sign)) if repeats else F.lit(1))
    spans = spans.select(F.col("doc_id").alias(its_id), F.col("copy").alias(its_copy), F.col("spans").alias(its_spans))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(own_copy) == F.col(its_copy))).select(*docs.columns, its_spans)
    at, names = docs.columns.index("text"), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(at)):
                starts, ends = words(data, offsets)
                first = np.searchsorted(starts, offsets[:-1])
                raw, texts, owner = data.tobytes(), [], []
                for i, parts in enumerate(batch.column(len(names)).slice(lo, hi - lo).to_pylist()):
                    runs: list[list[int]] = []
                    for p in parts:
                        if runs and runs[-1][0] == p["turn"] and runs[-1][2] == p["skip"]:
                            runs[-1][2] += p["words"]
                        else:
                            runs.append([p["turn"], p["skip"], p["skip"] + p["words"]])
                    for _, a, b in runs:
                        texts.append(raw[starts[first[i] + a] : ends[first[i] + b - 1]].decode("utf-8", "replace"))
                        owner.append(lo + i)
                kept = batch.take(pa.array(owner, pa.int64()))
                columns = [kept.column(j) for j in range(len(names))]
                columns[at] = pa.array(texts, pa.string())
                if "n_chars" in names:
                    j = names.index("n_chars")
                    columns[j] = pa.array([len(t) for t in texts], pa.int64()).cast(kept.column(j).type)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return mapped(joined, run, docs.schema)
