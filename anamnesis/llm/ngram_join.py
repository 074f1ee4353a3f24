"""n-gram Jaccard join by rare-first prefix filtering, verified exactly.

Texts with equal sets are one class from the start. Over all documents a fixed-size counting sketch tells rare shingles
from frequent ones, which gives one order of all shingles, rarest first. Two sets that link share a shingle of their
prefixes in that order; prefixes are joined by shingle, in packed arrays. The pairs that this join suggests pass length,
positional and suffix bounds before both sets are brought together and intersected.

Only the components are returned, so pairs that are known to be in one component need no comparing, and no step hands
on all pairs of a list. Classes of long lists are first compared with one pivot of theirs. Then each bucket of lists
looks at all its open pairs through the bounds and hands on a spanning forest of them, likeliest first; these are
compared. What is still open after that falls into families, again found from spanning forests; the sets of a family are
brought together and all its open pairs intersected there, large families by pairs of blocks. Intersections are counted
on the full 64-bit hashes of shingles; equal sets are told by 128 bits. No list is cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, mapped, mix, word_hashes, written
from .components import components

N = 5
#: Counters of the sketch of document frequencies, of 4 bytes; chunks in which partial sketches are summed.
SKETCH, CHUNKS = 1 << 18, 64
#: Postings of a bucket, about, and of one list before it is split into blocks, by the sketch's estimate.
BUCKET, HOT = 1_500_000, 50_000
#: Lists of more classes first try a pivot, and are split into pairs of blocks of half as many by their measured length.
LONG = 4096
#: Lists of up to so many classes of a bucket are looked at together.
SHORT = 64
#: Pairs that one step looks at.
PAIRS = 200_000
#: Cells of a set's parity sketch: at least so many, and two for each member.
CELLS = 512
#: Members of the sets of a family that one task holds, about.
FAMILY = 4_000_000
#: Bits of the filter that tells which texts a round needs; more classes only make it let more pass.
BLOOM = 1 << 24

_COEFFICIENTS = [np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64)) for k in range(N)]


def sets_of(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, shingle hashes, bounds): the sorted distinct shingles of row i are hashes[bounds[i]:bounds[i + 1]]."""
    for lo, hi, data, offsets in blocks(column):
        w, row = word_hashes(data, offsets)
        rows = hi - lo
        size = np.bincount(row, minlength=rows)
        first = np.concatenate([[0], np.cumsum(size)])
        count = np.where(size >= N, size - N + 1, np.minimum(size, 1))
        n = max(0, len(w) - N + 1)
        every = np.zeros(n, np.uint64)
        for k in range(N):
            every += w[k : k + n] * _COEFFICIENTS[k]
        every = mix(every)
        out, bounds = [], [0]
        for i in range(rows):
            a = first[i]
            if size[i] >= N:
                s = every[a : a + count[i]].copy()
                s.sort()
                fresh = np.ones(len(s), bool)
                np.not_equal(s[1:], s[:-1], out=fresh[1:])
                out.append(s[fresh])
            elif size[i]:
                short = np.full(1, size[i], np.uint64)
                for k in range(size[i]):
                    short += w[a + k : a + k + 1] * _COEFFICIENTS[k]
                out.append(mix(short))
            else:
                out.append(every[:0])
            bounds.append(bounds[-1] + len(out[-1]))
        yield lo, hi, np.concatenate(out) if out else every[:0], np.array(bounds)


def names_of(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set: sums of differently mixed members."""
    n = np.diff(bounds).astype(np.uint64)
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(salt)))])
        out.append(mix(total[bounds[1:]] - total[bounds[:-1]] + n * np.uint64(salt)))
    return out[0], out[1]


def keys_of(c: np.ndarray, d: np.ndarray, clashing: np.ndarray) -> np.ndarray:
    """One key for each set: its first name, or, where several sets share that, a mixture of both names."""
    return np.where(np.isin(c, clashing), mix(c ^ mix(d)), c)


def parities_of(h: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """Of each set, whether each of its sketch's cells has an odd number of members: sets differ in at least as many
    members as their sketches differ in cells."""
    out = []
    for i in range(len(bounds) - 1):
        members = h[bounds[i] : bounds[i + 1]]
        cells = max(CELLS, 1 << (2 * len(members) - 1).bit_length()) if len(members) else CELLS
        out.append(np.packbits(np.bincount(((members >> np.uint64(8)) & np.uint64(cells - 1)).astype(np.int64), minlength=cells).astype(np.uint8) & 1).tobytes())
    return out


class Sketches:
    """Parity sketches of rows, folded to each length at which rows of similar sizes may have to be compared."""

    def __init__(self, parts: list[bytes], percent: int):
        length = np.array([len(p) for p in parts], np.int64)
        self.level = np.log2(np.maximum(length, 1)).astype(np.int64)
        reach = int(np.ceil(np.log2(100 / percent))) + 1
        self.at, self.bits = {}, {}
        for lv in np.unique(self.level).tolist():
            rows = np.flatnonzero((self.level >= lv) & (self.level <= lv + reach))
            self.at[lv] = np.zeros(len(parts), np.int64)
            self.at[lv][rows] = np.arange(len(rows))
            self.bits[lv] = np.empty((len(rows), (1 << lv) // 8), np.uint64)
            for own in np.unique(self.level[rows]).tolist():
                some = np.flatnonzero(self.level[rows] == own)
                raw = np.frombuffer(b"".join(parts[i] for i in rows[some]), np.uint64).reshape(len(some), -1, (1 << lv) // 8)
                self.bits[lv][some] = np.bitwise_xor.reduce(raw, axis=1)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Cells in which the sketches of the rows i and j differ."""
        out = np.zeros(len(i), np.int64)
        level = np.minimum(self.level[i], self.level[j])
        for lv in np.unique(level).tolist():
            m = np.flatnonzero(level == lv)
            at, bits = self.at[lv], self.bits[lv]
            for lo in range(0, len(m), PAIRS):
                some = m[lo : lo + PAIRS]
                out[some] = np.bitwise_count(bits[at[i[some]]] ^ bits[at[j[some]]]).sum(axis=1, dtype=np.int64)
        return out


def least_overlap(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of these sizes link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return n - -(-percent * n // 100) + 1


def profile(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of documents (kind 0: id, n, c, d, the names of its set, and its parity sketch) and partial sketches (kind 1: n is the chunk)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, kind = np.zeros(SKETCH, np.uint32), None
        for batch in batches:
            kind = batch.schema.field(0).type
            for lo, hi, h, bounds in sets_of(batch.column(1)):
                sketch += np.bincount((h & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
                c, d = names_of(h, bounds)
                n = hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), batch.column(0).slice(lo, n), pa.array(np.diff(bounds)), pa.array(c.view(np.int64)), pa.array(d.view(np.int64)), pa.array(parities_of(h, bounds), pa.binary())], names=["kind", "id", "n", "c", "d", "part"])
        if kind is not None:
            parts = [x.tobytes() for x in np.split(sketch, CHUNKS)]
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(CHUNKS, np.int32)), pa.nulls(CHUNKS, kind), pa.array(np.arange(CHUNKS)), *[pa.array(np.zeros(CHUNKS, np.int64))] * 2, pa.array(parts, pa.binary())], names=["kind", "id", "n", "c", "d", "part"])

    form = docs.schema[id_col].dataType.simpleString()
    return written(mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")), run, f"kind int, id {form}, n long, c long, d long, part binary"), "profile")


def _merge(parts: DataFrame, how) -> dict[int, bytes]:
    """Combine arrays of bytes by chunk; fixed-size results reach the driver."""

    def run(t: pa.Table) -> pa.Table:
        total = None
        for p in t.column("part").to_pylist():
            total = how(total, p)
        return pa.table({"n": pa.array([t.column("n")[0].as_py()], pa.int64()), "part": pa.array([total.tobytes()], pa.binary())})

    return {r[0]: r[1] for r in parts.select("n", "part").groupBy("n").applyInArrow(run, "n long, part binary").collect()}


def rarity(profiled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each counter, coarse and logarithmic, how far each is above the noise)."""

    def add(total, p):
        p = np.frombuffer(p, np.uint32).astype(np.int64)
        return p if total is None else total + p

    got = _merge(profiled.where("kind = 1"), add)
    count = np.concatenate([np.frombuffer(got[k], np.int64) for k in sorted(got)]) if got else np.zeros(SKETCH, np.int64)
    excess = np.maximum(0, count - 2 * int(count.mean() + 1))
    return np.minimum(65535, np.log2(np.maximum(count, 1)) * 1500).astype(np.uint16), excess


def postings(docs: DataFrame, ranks: np.ndarray, excess: np.ndarray, clashing: np.ndarray, buckets: int, percent: int, text_col: str) -> DataFrame:
    """Prefixes, packed: a row for each task, flush and bucket. Equal sets of a task are sent once."""
    shared = docs.sparkSession.sparkContext.broadcast((ranks, excess))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, above = shared.value
        seen: set[int] = set()
        held, size = [], 0

        def flush():
            lists, c, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
            to = ((lists >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            cut = np.searchsorted(to[order], np.arange(buckets + 1))
            parts, names = [], []
            for b in range(buckets):
                rows = order[cut[b] : cut[b + 1]]
                if len(rows):
                    names.append(b)
                    parts.append(b"".join(x[rows].tobytes() for x in (lists, c, n, at)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.array(names, np.int32)), pa.array(parts, pa.binary())], names=["bucket", "part"])

        for batch in batches:
            for lo, hi, h, bounds in sets_of(batch.column(0)):
                c = keys_of(*names_of(h, bounds), clashing)
                slot = (h & np.uint64(SKETCH - 1)).astype(np.int64)
                key = rank[slot].astype(np.uint64) << np.uint64(48) | h >> np.uint64(16)
                for i in range(hi - lo):
                    a, b = int(bounds[i]), int(bounds[i + 1])
                    n = b - a
                    if not n or int(c[i]) in seen:
                        continue
                    seen.add(int(c[i]))
                    p = n - -(-percent * n // 100) + 1
                    first = np.argsort(key[a:b], kind="stable")[:p]
                    token, at = h[a:b][first], np.arange(p, dtype=np.uint32)
                    split = above[slot[a:b][first]] // HOT + 1
                    if split.max() > 1:
                        token, at = _split(token, at, split, c[i])
                    held.append((token, np.full(len(token), c[i]), np.full(len(token), n, np.uint32), at))
                    size += len(token)
                if size > 400_000:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return mapped(docs.select(F.col(text_col).alias("t")), run, "bucket int, part binary")


def _split(token: np.ndarray, at: np.ndarray, split: np.ndarray, c: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Lists of very frequent shingles become lists of two blocks of classes each; a class goes to all that hold its block."""
    own = np.uint64(c) % split.astype(np.uint64)
    who = np.repeat(np.arange(len(token)), split)
    other = (np.arange(len(who)) - np.repeat(np.cumsum(split) - split, split)).astype(np.uint64)
    a, b = np.minimum(own[who], other), np.maximum(own[who], other)
    name = np.where(split[who] > 1, mix(token[who] + a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)), token[who])
    return name, at[who]


def _unpack(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    out = [[], [], [], []]
    for p in parts:
        n = len(p) // 24
        for k, (kind, lo, width) in enumerate(((np.uint64, 0, 8), (np.uint64, 8, 8), (np.uint32, 16, 4), (np.uint32, 20, 4))):
            out[k].append(np.frombuffer(p, kind, n, lo * n))
    return tuple(np.concatenate(x) for x in out)


def shared_lists(packed: DataFrame) -> DataFrame:
    """A row for each list with two classes or more: width, and packed list, c, n, at. Lists with the same classes are
    kept once, with the earliest places: only there can a pair's first common shingle be."""

    def run(t: pa.Table) -> pa.Table:
        lists, c, n, at = _unpack(t.column("part").to_pylist())
        order = np.lexsort((c, lists))
        lists, c, n, at = lists[order], c[order], n[order], at[order]
        same = np.zeros(len(lists), bool)
        same[1:] = (lists[1:] == lists[:-1]) & (c[1:] == c[:-1])
        lists, c, n, at = (x[~same] for x in (lists, c, n, at))
        edge = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1], [True]]))
        width = np.diff(edge)
        signs = []
        for salt in (0x27BB2EE687B0B0FD, 0x6C62272E07BB0143):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(c ^ np.uint64(salt)))])
            signs.append(total[edge[1:]] - total[edge[:-1]])
        place = np.add.reduceat(at.astype(np.int64), edge[:-1])
        many = np.flatnonzero(width > 1)
        many = many[np.lexsort((place[many], signs[1][many], signs[0][many]))]
        fresh = np.ones(len(many), bool)
        fresh[1:] = (signs[0][many][1:] != signs[0][many][:-1]) | (signs[1][many][1:] != signs[1][many][:-1])
        kept = many[fresh]
        parts = [b"".join(x[edge[k] : edge[k + 1]].tobytes() for x in (lists, c, n, at)) for k in kept.tolist()]
        return pa.table({"s": pa.array(signs[0][kept].view(np.int64)), "t": pa.array(signs[1][kept].view(np.int64)), "width": pa.array(width[kept]), "place": pa.array(place[kept]), "part": pa.array(parts, pa.binary())})

    each = packed.groupBy("bucket").applyInArrow(run, "s long, t long, width long, place long, part binary")
    return written(each.groupBy("s", "t", "width").agg(F.min_by("part", "place").alias("part")).select("width", "part"), "lists")


def _within_bounds(n: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether the postings i and j of one list can be of classes that link: by length, and by what follows this shingle."""
    need = least_overlap(n[i], n[j], percent)
    return (np.minimum(n[i], n[j]) >= need) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= need)


def pivots(lists: DataFrame, percent: int) -> DataFrame:
    """For each class of a long list, the smallest class that heads one of these and that it could link with by length and place: x, y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                _, c, n, at = _unpack([part])
                n, at, first = n.astype(np.int64), at.astype(np.int64), np.zeros(len(n), np.int64)
                may = np.flatnonzero(_within_bounds(n, at, np.arange(len(n)), first, percent) & (c != c[0]))
                yield pa.RecordBatch.from_arrays([pa.array(c[may].view(np.int64)), pa.array(np.full(len(may), c[0]).view(np.int64))], names=["x", "y"])

    # unsigned order is lost in the signed column; any fixed choice will do
    return mapped(lists.where(F.col("width") > LONG).select("part"), run, "x long, y long").groupBy("x").agg(F.min("y").alias("y"))


def open_lists(lists: DataFrame, percent: int) -> DataFrame:
    """A row for each class of each list that has a class there with which it could link by length and place: list, c, n, at.
    Long lists keep all; a very long one becomes a list for every two of its blocks."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size = [], 0
            for part in batch.column(0).to_pylist():
                name, c, n, at = _unpack([part])
                split = -(-2 * len(c) // LONG)
                if len(c) > LONG:
                    own = c % np.uint64(split)
                    for other in range(split):
                        a, b = np.minimum(own, np.uint64(other)), np.maximum(own, np.uint64(other))
                        yield flat([(mix(name + a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)), c, n, at)], whole=False)
                    continue
                held.append((name, c, n, at))
                size += len(c)
                if size > 50_000:
                    yield flat(held)
                    held, size = [], 0
            if held:
                yield flat(held)

    def flat(held, whole=True):
        name, c, n, at = (np.concatenate(x) for x in zip(*held, strict=True))
        n, at = n.astype(np.int64), at.astype(np.int64)
        if not whole:  # the other rows of these lists come in other batches
            return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(c.view(np.int64)), pa.array(n), pa.array(at)], names=["list", "c", "n", "at"])
        edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
        width = np.repeat(np.diff(edge), np.diff(edge))
        may = width > SHORT
        short = np.flatnonzero(~may)
        for d in range(1, SHORT):
            i = short[short + d < len(name)]
            i = i[name[i] == name[i + d]]
            if not len(i):
                break
            i = i[_within_bounds(n, at, i, i + d, percent)]
            may[i] = may[i + d] = True
        return pa.RecordBatch.from_arrays([pa.array(name[may].view(np.int64)), pa.array(c[may].view(np.int64)), pa.array(n[may]), pa.array(at[may])], names=["list", "c", "n", "at"])

    return mapped(lists.select("part"), rows, "list long, c long, n long, at long")


def still_open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of lists with classes of several components, with their components k. labels: c, k."""
    named = rows.join(labels, "c")
    mixed = named.groupBy("list").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a <> b").select("list")
    return written(named.join(mixed, "list", "left_semi"), "left")


class Forest:
    """Sets joined by edges; only edges that join two of them are kept."""

    def __init__(self, n: int):
        self.up, self.kept = list(range(n)), []

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def add(self, a: list[int], b: list[int]) -> int:
        before = len(self.kept)
        for x, y in zip(a, b, strict=True):
            r, s = self.root(x), self.root(y)
            if r != s:
                self.up[max(r, s)] = min(r, s)
                self.kept.append((x, y))
        return len(self.kept) - before


def forest(left: DataFrame, classes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Of the pairs of classes in one list and different components that pass length, positional and parity bounds, a
    spanning forest for each bucket, the likeliest links first: x, y. At most one row fewer than a bucket's classes."""
    left = left.join(classes.select("c", F.col("parity").alias("p")), "c").withColumn("bucket", F.pmod(F.xxhash64("list"), F.lit(8 * buckets)))

    def run(t: pa.Table) -> pa.Table:
        name, c, n, at, k = (t.column(x).to_numpy() for x in ("list", "c", "n", "at", "k"))
        order = np.lexsort((c, name))
        name, c, n, at, k = name[order], c[order], n[order], at[order], k[order]
        parts = t.column("p").to_pylist()
        sketches = Sketches([parts[i] for i in order.tolist()], percent)
        names, who = np.unique(c, return_inverse=True)
        joined = Forest(len(names))
        edge = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1], [True]]))
        width = np.repeat(np.diff(edge), np.diff(edge))

        def passing(i, j):
            """Those pairs that may link, and how far apart they are: cells that differ, as a share of what is allowed."""
            ok = (k[i] != k[j]) & _within_bounds(n, at, i, j, percent)
            i, j = i[ok], j[ok]
            spare = n[i] + n[j] - 2 * least_overlap(n[i], n[j], percent)
            far = sketches.apart(i, j)
            ok = far <= spare
            return i[ok], j[ok], far[ok] / np.maximum(spare[ok], 1)

        short, found = np.flatnonzero(width <= SHORT), []
        for d in range(1, SHORT):  # short lists, all together
            i = short[short + d < len(name)]
            i = i[name[i] == name[i + d]]
            if not len(i):
                break
            found.append(passing(i, i + d))
        if found:
            i, j, far = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(far, kind="stable")
            pair = who[i[order]] * len(names) + who[j[order]]
            _, first = np.unique(pair, return_index=True)
            order = order[np.sort(first)]
            joined.add(who[i[order]].tolist(), who[j[order]].tolist())
        size = np.diff(edge)
        for at_list in sorted(np.flatnonzero(size > SHORT).tolist(), key=lambda e: -size[e]):
            lo, hi = int(edge[at_list]), int(edge[at_list + 1])
            while True:  # each part joins the one nearest to it, until none is near enough
                root = np.array([joined.root(x) for x in who[lo:hi].tolist()])
                _, of, held = np.unique(root, return_inverse=True, return_counts=True)
                rest, step = np.flatnonzero(of != held.argmax()), max(1, PAIRS // (hi - lo))
                best = []
                for a in range(0, len(rest), step):
                    i, j = (z.reshape(-1) for z in np.meshgrid(rest[a : a + step], np.arange(hi - lo), indexing="ij"))
                    ok = of[i] != of[j]
                    i, j, far = passing(i[ok] + lo, j[ok] + lo)
                    order = np.lexsort((far, i))
                    first = np.concatenate([[True], i[order][1:] != i[order][:-1]]) if len(i) else np.zeros(0, bool)
                    best.append(tuple(z[order][first] for z in (i, j, far)))
                if not best:
                    break
                i, j, far = (np.concatenate(x) for x in zip(*best, strict=True))
                order = np.argsort(far, kind="stable")
                if not joined.add(who[i[order]].tolist(), who[j[order]].tolist()):
                    break
        x, y = (np.array([p[z] for p in joined.kept], np.int64) for z in (0, 1))
        return pa.table({"x": pa.array(names[x]), "y": pa.array(names[y])})

    pairs = left.groupBy("bucket").applyInArrow(run, "x long, y long")
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def sets_for(docs: DataFrame, wanted: DataFrame, clashing: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """wanted (c, id and more) with the members of c's set, made from the text of id; one filter pass over the documents."""
    spark = docs.sparkSession

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = np.zeros(BLOOM, bool)
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64)
            flags[(h % np.uint64(BLOOM)).astype(np.int64)] = True
        packed = np.split(np.packbits(flags), CHUNKS)
        use = [k for k in range(CHUNKS) if packed[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(np.array(use, np.int64)), pa.array([packed[k].tobytes() for k in use], pa.binary())], names=["n", "part"])

    def either(total, p):
        p = np.frombuffer(p, np.uint8)
        return p.copy() if total is None else total | p

    got = _merge(wanted.select(F.xxhash64("id").alias("h")).distinct().coalesce(8).mapInArrow(bits, "n long, part binary"), either)
    blank = bytes(BLOOM // 8 // CHUNKS)
    filter_ = spark.sparkContext.broadcast(np.frombuffer(b"".join(got.get(k, blank) for k in range(CHUNKS)), np.uint8))
    form = docs.schema[id_col].dataType.simpleString()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (batch.column(2).to_numpy().view(np.uint64) % np.uint64(BLOOM)).astype(np.int64)
            may = filter_.value[at >> 3] << (at & 7).astype(np.uint8) & 0x80  # the first of eight bits is the highest
            part = batch.filter(pa.array(may > 0))
            for lo, hi, h, bounds in sets_of(part.column(1)):
                c = keys_of(*names_of(h, bounds), clashing)
                members = [h[bounds[i] : bounds[i + 1]].tobytes() for i in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(lo, hi - lo), pa.array(c.view(np.int64)), pa.array(members, pa.binary())], names=["id", "c", "members"])

    made = mapped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col)).alias("h")), sets, f"id {form}, c long, members binary")
    return wanted.join(made, (wanted["c"] == made["c"]) & wanted["id"].eqNullSafe(made["id"])).select(*[wanted[x] for x in wanted.columns if x != "id"], made["members"])


def compare(docs: DataFrame, classes: DataFrame, pairs: DataFrame, clashing: np.ndarray, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Intersects the sets of each pair: the pairs that link, x, y. classes: c, id of one document."""
    owners = classes.select("c", "id")
    crowd = pairs.groupBy("y").agg(F.floor(F.count("*") / 256).alias("salts"))
    pairs = written(pairs.join(crowd, "y").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts") + 1)).select("x", "y", "salt"), "pairs")
    asks = pairs.select(F.col("x").alias("c"), F.col("y").alias("to"), "salt", F.lit(False).alias("head")).union(pairs.select(F.col("y"), F.col("y"), "salt", F.lit(True)).distinct())
    wanted = written(asks.join(owners, "c").select("c", "to", "salt", "head", "id"), "wanted")

    def run(t: pa.Table) -> pa.Table:
        head, c = t.column("head").to_pylist(), t.column("c").to_pylist()
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in t.column("members")]
        own = next((s for s, yes in zip(sets, head, strict=True) if yes), None)
        x = []
        for s, yes, name in zip(sets, head, c, strict=True):
            if not yes and own is not None:
                need = int(least_overlap(np.int64(len(s)), np.int64(len(own)), percent))
                if min(len(s), len(own)) >= need and _suffix_bound(s, own) >= need and _overlap(s, own) >= need:
                    x.append(name)
        y = t.column("to")[0].as_py()
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array([y] * len(x), pa.int64())})

    return written(sets_for(docs, wanted, clashing, id_col, text_col).groupBy("to", "salt").applyInArrow(run, "x long, y long").distinct(), "links")


def _suffix_bound(a: np.ndarray, b: np.ndarray) -> int:
    """An upper bound of the intersection: both sets cut at the same 16 places, the smaller part of each counts."""
    cuts = np.arange(1, 16, dtype=np.uint64) << np.uint64(60)
    return int(np.minimum(np.diff(np.concatenate([[0], np.searchsorted(a, cuts), [len(a)]])), np.diff(np.concatenate([[0], np.searchsorted(b, cuts), [len(b)]]))).sum())


def _overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def settle(docs: DataFrame, classes: DataFrame, edges: DataFrame, whole: DataFrame, clashing: np.ndarray, percent: int, id_col: str, text_col: str) -> DataFrame:
    """All links between different components within the families that `edges` span, as a spanning forest for each task: x, y.

    A family is held by a task, sets and all, up to about FAMILY members; a larger one becomes blocks, and every two
    blocks a task.
    """
    families = components(edges.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("node").alias("c"), F.col("component").alias("family"))
    known = families.join(classes.select("c", "n", "id"), "c").join(whole.select("c", "k"), "c")
    split = known.groupBy("family").agg(F.ceil(F.sum("n") * 2 / F.lit(FAMILY)).cast("int").alias("split"))
    split = split.withColumn("split", F.when(F.col("split") <= 2, 1).otherwise(F.col("split")))
    own = F.pmod(F.xxhash64("c"), F.col("split")).cast("int")
    dealt = known.join(split, "family").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    wanted = written(dealt.select("c", "id", "family", "k", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own"), "families")

    def run(t: pa.Table) -> pa.Table:
        c, k, own = (t.column(x).to_numpy() for x in ("c", "k", "own"))
        sets = [np.frombuffer(m.as_buffer(), np.uint64) for m in t.column("members")]
        cross = t.column("a")[0].as_py() != t.column("b")[0].as_py()
        n = np.array([len(s) for s in sets], np.int64)
        held = np.concatenate(sets)
        order = np.argsort(held, kind="stable")
        holder = np.repeat(np.arange(len(sets)), n)[order]
        held = held[order]
        labels, of = np.unique(k, return_inverse=True)
        joined, x, y = Forest(len(labels)), [], []
        for i, s in enumerate(sets):
            lo, hi = np.searchsorted(held, s, "left"), np.searchsorted(held, s, "right")
            reach = np.repeat(lo - np.concatenate([[0], np.cumsum(hi - lo)[:-1]]), hi - lo) + np.arange((hi - lo).sum())
            shared = np.bincount(holder[reach], minlength=len(sets))
            may = np.flatnonzero((shared >= least_overlap(n, n[i], percent)) & (k != k[i]) & (np.arange(len(sets)) > i) & (not cross or own != own[i]))
            for j in may.tolist():
                if joined.add([of[i]], [of[j]]):
                    x.append(int(c[i]))
                    y.append(int(c[j]))
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    return written(sets_for(docs, wanted, clashing, id_col, text_col).groupBy("family", "a", "b").applyInArrow(run, "x long, y long"), "links")


def merged(whole: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (c, k) after new links: only links between different components are followed."""
    k = whole.select("c", "k")
    apart = links.join(k.toDF("x", "a"), "x").join(k.toDF("y", "b"), "y").where("a <> b").select("a", "b")
    return written(whole.join(components(apart).withColumnRenamed("node", "k"), "k", "left").select("c", F.coalesce("component", "k").alias("k")), "labels")


def near_duplicates(docs: DataFrame, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of the links between documents whose sets of 5-word shingles have a Jaccard similarity of percent / 100 or more.

    Words: A-Z lower-cased, `[^\\x20\\x09-\\x0D]+` of the whole text. Fewer than five words are one shingle. Null, empty
    and blank texts have an empty set and link with nothing. Returns a row for each row: id, n_shingles, component_id
    (the smallest id reachable, its own included; a null id is never the smallest unless alone). Repeated rows link with
    each other. An empty table gives an empty table. Other columns, whatever their names, are left aside.
    """
    profiled = profile(docs, id_col, text_col)
    rows = profiled.where("kind = 0")
    pairs_of_names = rows.where("n > 0").groupBy("c").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b")
    # first names that several sets share: of m sets m * m / 2^65 are expected, about ten of 2 * 10^10
    clashing = np.array([r[0] for r in pairs_of_names.select("c").collect()], np.int64).view(np.uint64)
    if len(clashing):

        def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                key = keys_of(b.column(3).to_numpy().view(np.uint64), b.column(4).to_numpy().view(np.uint64), clashing)
                yield b.set_column(3, "c", pa.array(key.view(np.int64)))

        rows = written(rows.mapInArrow(rename, rows.schema), "renamed")
    classes = written(rows.where("n > 0").groupBy("c").agg(F.min("id").alias("id"), F.max("n").alias("n"), F.first("part").alias("parity")), "classes")
    ranks, excess = rarity(profiled)
    total = rows.agg(F.sum(F.col("n") + 4)).collect()[0][0] or 0
    buckets = int(max(24, total // 4 // BUCKET))
    lists = shared_lists(postings(docs, ranks, excess, clashing, buckets, percent, text_col))
    whole = classes.select("c", F.col("c").alias("k"))
    if lists.where(F.col("width") > LONG).limit(1).count():
        whole = merged(whole, compare(docs, classes, pivots(lists, percent), clashing, percent, id_col, text_col))
    left = still_open(open_lists(lists, percent), whole)
    likely = written(forest(left, classes, percent, buckets), "likely")
    whole = merged(whole, compare(docs, classes, likely, clashing, percent, id_col, text_col))
    # a pair that is still open passed the bounds before, so that both of its classes are in that forest
    near = likely.select(F.col("x").alias("c")).union(likely.select("y")).distinct()
    left = still_open(left.drop("k").join(near, "c", "left_semi"), whole)
    spanned = written(forest(left, classes, percent, buckets), "spanned")
    if spanned.limit(1).count():
        whole = merged(whole, settle(docs, classes, spanned, whole, clashing, percent, id_col, text_col))
    whole = whole.join(classes.select("c", "id"), "c")
    least = whole.groupBy("k").agg(F.min("id").alias("component_id"))
    found = whole.join(least, "k").select("c", "component_id")
    full, blank = rows.where("n > 0"), rows.where("n = 0")
    out = full.join(found, "c").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.union(blank.select("id", "n", "id"))
