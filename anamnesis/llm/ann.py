"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample is cut into balanced parts; a small classifier learns a vector's parts from the
parts of its neighbours. Every row is indexed in its most probable part; a query goes to its several most probable
parts, whose rows are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Distinct vectors that the graph is built on, chosen by a hash of the vector: about SAMPLE, and PER_PART for each part.
SAMPLE, PER_PART = 8000, 32
#: Parts for each root of the number of distinct vectors, and parts at most; larger parts are searched in blocks of
#: BLOCK_ROWS rows and QUERY_ROWS queries.
SPREAD, PARTS, BLOCK_ROWS, QUERY_ROWS = 0.25, 1024, 20_000, 50_000
NEIGHBOURS = 12
HIDDEN = 128
#: Recall that the number of probed parts is chosen for: on the sample's held-out rows by mass alone, then on so many
#: queries at most, which the router has not seen, against their exact neighbours among all rows.
RECALL, CHECKS = 0.985, 200
MASSES = (0.5, 0.7, 0.8, 0.9, 0.95, 0.97, 0.98, 0.99, 0.995, 0.999, 0.9999, 2.0)  # 2.0: all parts


@dataclass
class Router:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0  # probability that the probed parts cover

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def probes(p: np.ndarray, mass: float, sizes: np.ndarray, least: int) -> np.ndarray:
    """Which parts each row probes: the most probable, until they cover `mass` and hold `least` rows."""
    order = np.argsort(-p, axis=1, kind="stable")
    ranked = np.take_along_axis(p, order, 1)
    held = sizes[order]
    short = ((ranked.cumsum(axis=1) - ranked) < mass) | ((held.cumsum(axis=1) - held) < least)
    out = np.zeros(p.shape, bool)
    np.put_along_axis(out, order, short, 1)
    return out & (sizes > 0)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row, by inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        s = x[lo : lo + 1024] @ x.T
        s[np.arange(len(s)), lo + np.arange(len(s))] = -np.inf
        out[lo : lo + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Cut the graph into parts of nearly equal size: halving along main directions, then moves towards the part where
    most neighbours are, while that part has room."""
    label = np.zeros(len(x), np.int64)

    def halve(rows: np.ndarray, first: int, n: int) -> None:
        if n == 1:
            label[rows] = first
            return
        y = x[rows] - x[rows].mean(axis=0)
        d = rng.standard_normal(x.shape[1])
        for _ in range(8):
            d = y.T @ (y @ d)
            d /= np.linalg.norm(d) + 1e-30
        order = rows[np.argsort(y @ d, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        halve(order[:cut], first, left)
        halve(order[cut:], first + left, n - left)

    halve(np.arange(len(x)), 0, parts)
    room = int(np.ceil(1.05 * len(x) / parts)) + 1
    both = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.reshape(-1)]), np.concatenate([graph.reshape(-1), np.repeat(np.arange(len(x)), graph.shape[1])])
    for _ in range(12):
        votes = np.zeros((len(x), parts), np.float32)
        np.add.at(votes, (both[0], label[both[1]]), 1)
        gain = votes - votes[np.arange(len(x)), label][:, None]
        to = gain.argmax(axis=1)
        size = np.bincount(label, minlength=parts)
        moved = 0
        for i in np.argsort(-gain.max(axis=1), kind="stable"):
            if gain[i, to[i]] <= 0:
                break
            if size[to[i]] < room:
                size[label[i]] -= 1
                size[to[i]] += 1
                label[i] = to[i]
                moved += 1
        if moved < len(x) // 200:
            break
    return label


def train(x: np.ndarray, target: np.ndarray, rng: np.random.Generator, epochs: int = 25, batch: int = 256) -> Router:
    """A one-hidden-layer classifier by Adam on soft targets."""
    shapes = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, target.shape[1]), (target.shape[1],)]
    p = [rng.standard_normal(s) * (2 / s[0]) ** 0.5 if len(s) > 1 else np.zeros(s) for s in shapes]
    m, v, t = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], 0
    for epoch in range(epochs):
        rate = 3e-3 * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            rows = order[lo : lo + batch]
            h = np.maximum(x[rows] @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            d = (z / z.sum(axis=1, keepdims=True) - target[rows]) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for i, g in enumerate((x[rows].T @ dh, dh.sum(axis=0), h.T @ d, d.sum(axis=0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*p)


def fit(x: np.ndarray, parts: int, k: int, seed: int = 0) -> Router:
    """Cut, train, and choose the probed mass on rows that the classifier has not seen."""
    rng = np.random.default_rng(seed)
    if parts == 1 or len(x) < 4 * parts:
        d = x.shape[1]
        return Router(np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), MASSES[-1])
    graph = neighbour_graph(x, NEIGHBOURS)
    label = balanced_parts(x, graph, parts, rng)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.arange(len(x)), label), 1.0)
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), label[graph.reshape(-1)]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    held = rng.random(len(x)) < 0.15
    router = train(x[~held], target[~held], rng)
    p = router.probabilities(x)
    own = p.argmax(axis=1)
    # without the floor of rows: the index's parts hold more rows than the sample's, so that fewer of them reach it
    router.mass = covering(p[held], own[neighbour_graph(x, k)[held]].tolist(), np.bincount(own, minlength=parts), 0, MASSES[0])
    return router


def covering(p: np.ndarray, near: list[list[int]], sizes: np.ndarray, least: int, lowest: float) -> float:
    """The least mass from `lowest` by which rows of probabilities `p` reach RECALL of the parts in `near`, those of their neighbours."""
    who = np.repeat(np.arange(len(near)), [len(n) for n in near])
    part = np.array([i for n in near for i in n], np.int64)
    return next((m for m in MASSES if m >= lowest and (not len(who) or probes(p, m, sizes, least)[who, part].mean() >= RECALL)), MASSES[-1])


def usable(column: str) -> Column:
    """Neither null nor empty nor zero, and without null or non-finite components."""
    c = F.col(column)
    ok = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.coalesce(c.isNotNull() & ok & F.exists(c, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def search(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 0) -> DataFrame:
    """The k nearest rows found for each row that `queries` marks, by largest inner product in double precision.

    Returns query_id, rank (from 1), id, score; nearest first, ties to the smaller id; a query is no candidate of its
    own. Vectors that are null, empty, zero or that hold null or non-finite components take no part, nor do those of
    another dimension than the most common one (ties to the smaller). Equal vectors are searched once, whatever their
    number: a candidate vector carries its k + 1 smallest ids. An empty table gives an empty result. Repeated rows with
    one id count as one.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(usable("v") & F.col("id").isNotNull())
    dims = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    d = dims[0]["d"] if dims else 1
    rows = rows.where(F.size("v") == d).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(7), "v")})
    # the k + 1 smallest ids of each distinct vector: the limit within a group is applied before the shuffle
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("n") <= k + 1)
    distinct = written(ranked.groupBy("h1", "h2").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.min_by("v", "id").alias("v")), "vectors")
    asked = rows.where("asks").select("id", "h1", "h2").distinct()
    total = distinct.count()
    parts = int(min(PARTS, max(1, SPREAD * total**0.5)))
    asking = asked.select("h1", "h2").distinct()
    # the first by their hashes, which say nothing of the vectors
    checks = distinct.join(asking, ["h1", "h2"], "left_semi").select("h1", "h2", "v").orderBy("h1", "h2").limit(CHECKS).toPandas() if parts > 1 else None
    share = min(1.0, 1.0 * max(SAMPLE, PER_PART * parts) / max(1, total))
    sample = distinct.where(F.pmod(F.xxhash64("h1", "h2", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000) + 1).orderBy("h1", "h2").select("h1", "h2", "v").toPandas() if parts > 1 else None
    if parts > 1:
        seen = set(zip(checks.h1, checks.h2))
        sample = sample[[key not in seen for key in zip(sample.h1, sample.h2)]]
    router = fit(np.array(sample.v.tolist(), np.float64) if parts > 1 else np.zeros((1, d)), parts, k, seed)
    shared = spark.sparkContext.broadcast(router)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = shared.value.probabilities(_matrix(b.column(3), d)).argmax(axis=1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own.astype(np.int32))], names=["h1", "h2", "ids", "v", "part"])

    kind = vectors.schema[id_col].dataType.simpleString()
    form = vectors.schema[vector_col].dataType.simpleString()
    index = written(distinct.select("h1", "h2", "ids", "v").mapInArrow(assign, f"h1 long, h2 long, ids array<{kind}>, v {form}, part int"), "index")
    counts = {r[0]: r[1] for r in index.groupBy("part").count().collect()}  # a row for each part
    sizes = np.array([counts.get(i, 0) for i in range(len(router.b2))])
    split = np.maximum(1, -(-sizes // BLOCK_ROWS))
    least = 4 * (k + 1)
    mass = router.mass
    if len(sizes) > 1 and len(checks):
        asks = np.array(checks.v.tolist(), np.float64)
        sent = spark.sparkContext.broadcast(asks)

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """The k + 1 best rows of each check in these batches: check, less, h1, h2, part."""
            best = None
            for b in batches:
                for lo in range(0, b.num_rows, 4096):
                    c = b.slice(lo, 4096)
                    s = -(sent.value @ _matrix(c.column(2), d).T)
                    more = [s, *[np.broadcast_to(c.column(i).to_numpy(zero_copy_only=False), s.shape) for i in (0, 1, 3)]]
                    best = more if best is None else [np.concatenate(x, axis=1) for x in zip(best, more)]
                    if best[0].shape[1] > k + 1:
                        top = np.argpartition(best[0], k, axis=1)[:, : k + 1]
                        best = [np.take_along_axis(x, top, 1) for x in best]
            if best is not None:
                who = np.repeat(np.arange(len(best[0]), dtype=np.int32), best[0].shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(who), *[pa.array(np.ascontiguousarray(x).reshape(-1)) for x in best]], names=["check", "less", "h1", "h2", "part"])

        found = index.select("h1", "h2", "v", "part").mapInArrow(nearest, "check int, less double, h1 long, h2 long, part int")
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("check").orderBy("less", "h1", "h2"))).where(F.col("n") <= k + 1)
        near: list[list[int]] = [[] for _ in asks]
        for r in found.orderBy("check", "n").collect():
            if (r.h1, r.h2) != (checks.h1[r.check], checks.h2[r.check]) and len(near[r.check]) < k:
                near[r.check].append(r.part)
        mass = covering(router.probabilities(asks), near, sizes, least, mass)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                c = b.slice(lo, 2048)
                x = _matrix(c.column(2), d)
                who, part = np.nonzero(probes(shared.value.probabilities(x), mass, sizes, least))
                times = split[part]
                who, part = np.repeat(who, times), np.repeat(part, times)
                block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays([c.column(0).take(pa.array(who)), c.column(1).take(pa.array(who)), c.column(2).take(pa.array(who)), pa.array(part.astype(np.int32)), pa.array(block.astype(np.int32))], names=["h1", "h2", "v", "part", "block"])

    wanted = written(index.join(asking, ["h1", "h2"], "left_semi").select("h1", "h2", "v").mapInArrow(route, f"h1 long, h2 long, v {form}, part int, block int"), "wanted")
    routed = {r[0]: r[1] for r in wanted.where("block = 0").groupBy("part").count().collect()}  # a row for each part
    crowd = [max(1, -(-routed.get(i, 0) // QUERY_ROWS)) for i in range(len(sizes))]

    def of_part(values) -> Column:
        return F.element_at(F.array(*[F.lit(int(x)) for x in values]), F.col("part") + 1)

    wanted = wanted.withColumn("turn", F.pmod(F.xxhash64("h1", "h2"), of_part(crowd)).cast("int"))
    held = index.withColumn("block", F.pmod(F.xxhash64("h2", "h1"), of_part(split)).cast("int"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), of_part(crowd) - 1)))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"h1": [], "h2": [], "found": []}
        if left.num_rows and right.num_rows:
            q, x = _matrix(left.column("v"), d), _matrix(right.column("v"), d)
            ids = right.column("ids").to_pylist()
            first = np.array([i[0] for i in ids])
            for lo in range(0, len(q), 512):
                s = q[lo : lo + 512] @ x.T
                top = np.argpartition(-s, k, axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.tile(np.arange(s.shape[1]), (len(s), 1))
                last = np.take_along_axis(s, top, 1).min(axis=1)
                for i, row in enumerate(s):
                    at = np.flatnonzero(row >= last[i])  # with all ties of the last
                    at = at[np.lexsort((first[at], -row[at]))][: k + 1]
                    out["found"].append(sorted(((-row[j], n) for j in at for n in ids[j]))[: k + 1])
            out["h1"], out["h2"] = left.column("h1").to_pylist(), left.column("h2").to_pylist()
        found = [[{"less": a, "id": n} for a, n in f] for f in out["found"]]
        return pa.table({"h1": pa.array(out["h1"], pa.int64()), "h2": pa.array(out["h2"], pa.int64()), "found": pa.array(found, pa.list_(pa.struct([("less", pa.float64()), ("id", right.schema.field("ids").type.value_type)])))})

    near = wanted.groupBy("part", "block", "turn").cogroup(held.groupBy("part", "block", "turn")).applyInArrow(score, f"h1 long, h2 long, found array<struct<less: double, id: {kind}>>")
    best = near.groupBy("h1", "h2").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, k + 1).alias("found"))
    others = asked.join(best, ["h1", "h2"]).select(F.col("id").alias("query_id"), F.slice(F.filter("found", lambda f: f["id"] != F.col("id")), 1, k).alias("found"))
    flat = others.select("query_id", F.posexplode("found").alias("p", "f"))
    return flat.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("f.id").alias(id_col), (-F.col("f.less")).alias("score"))
