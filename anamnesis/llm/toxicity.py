"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

A string is described by its subsequences of three letters within SPAN letters, each occurrence weighing DECAY for every
letter it spans, so that gaps and inserted characters cost little. Words, and runs of single letters read as one word,
are the instances; sentences' and documents' labels say which words can bear the label. The machine is trained on kernel
values with a few landmark words (Nystroem's map); as the kernel is an inner product, the trained machine is one weight
for each subsequence, and a word is scored by the sum of its occurrences' weights: the same value as with the landmarks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, labelled_sample, mapped, row_of, span_hashes, words, written

SPAN, DECAY, SYMBOLS = 7, 0.6, 64
#: Symbol that stands before a string.
BEGIN = 63
#: Stands before a part that goes on within a string, and so has no beginning; no word holds this blank.
MORE = "\x0b"
#: Letters of one instance; a longer word is read in overlapping parts.
WIDTH = 24
#: Labelled texts of each label that are learned from, at most about; clean words of the first training (later ones add
#: counterexamples from all words of those texts); landmarks.
SAMPLE, WORDS, LANDMARKS = 5000, 12_000, 400
MEMO = 1 << 20
#: Rounds of choosing witnesses and training again.
ROUNDS = 5
# Characters often put in place of a letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


@lru_cache(1)
def symbol_table() -> np.ndarray:
    """Symbol of each code point: 1-26 for a-z, 27-62 for other letters and digits by residue, 0 for what is passed over."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalnum():
            low = ch.lower()
            out[c] = ord(low) - 96 if len(low) == 1 and "a" <= low <= "z" else 27 + (ord(low[0]) * 7 + 5) % 36
    for a, b in LOOKALIKES.items():
        out[ord(a)] = ord(b) - 96
    return out


PATTERNS = [(j, k) for k in range(2, SPAN) for j in range(1, k)]


def norms(length: np.ndarray) -> np.ndarray:
    """Length of the description of a string of so many letters, were its subsequences distinct, and of one of five
    letters besides: so short strings, which have few subsequences, get small values rather than one large one."""
    total = np.zeros(WIDTH + 1)
    for _, k in PATTERNS:
        total += DECAY ** (2 * (k + 1)) * np.maximum(0, np.arange(WIDTH + 1) - k)
    return np.sqrt(total + total[5])[length]


def matrix(strings: list[str] | str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, one row of WIDTH for each part, letters of each part, string of each part) of newline-separated strings."""
    text = "\n" + (strings if isinstance(strings, str) else "\n".join(strings))
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    stop = points == 10
    sym = symbol_table()[points]
    sym[stop] = BEGIN
    sym[:-1][stop[:-1] & (points[1:] == ord(MORE))] = 0
    owner = np.cumsum(stop) - 1
    keep = sym > 0
    sym, owner = sym[keep], owner[keep]
    n = int(stop.sum())
    size = np.bincount(owner, minlength=n)
    first = np.cumsum(size) - size
    step = WIDTH // 2
    parts = np.maximum(1, -(-(size - WIDTH) // step) + 1)
    who = np.repeat(np.arange(n), parts)
    nth = np.arange(len(who)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = first[who] + nth * step
    length = np.minimum(WIDTH, np.maximum(0, size[who] - nth * step))
    at = begin[:, None] + np.arange(WIDTH)[None, :]
    inside = np.arange(WIDTH)[None, :] < length[:, None]
    grid = np.where(inside, sym[np.minimum(at, max(0, len(sym) - 1))] if len(sym) else 0, 0).astype(np.int32)
    return grid, length, who


def occurrences(grid: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Codes of the occurrences of each pattern of gaps (0: none), and their weight."""
    for j, k in PATTERNS:
        a, b, c = grid[:, : WIDTH - k], grid[:, j : WIDTH - k + j], grid[:, k:]
        yield np.where(c > 0, (a * SYMBOLS + b) * SYMBOLS + c, 0), DECAY ** (k + 1)


def pieces(word: str) -> list[str]:
    """The overlapping parts that `matrix` cuts a string of letters and digits into: each is an instance of its own."""
    if len(word) < WIDTH:
        return [word]
    return [word[: WIDTH - 1]] + [MORE + word[at - 1 : at - 1 + WIDTH] for at in range(WIDTH // 2, len(word) + 1 - WIDTH // 2, WIDTH // 2)]


def describe(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dense descriptions would be large; this gives (rows, codes, weights) of all occurrences of strings of one part each."""
    grid, length, who = matrix(strings)
    if len(grid) != len(strings):
        raise ValueError(f"a string of more than {WIDTH} letters is to be cut into pieces first")
    scale = 1 / norms(length)
    rows, codes, weights = [], [], []
    for code, weight in occurrences(grid):
        r, p = np.nonzero(code)
        rows.append(r.astype(np.int32))
        codes.append(code[r, p])
        weights.append((weight * scale[r]).astype(np.float32))
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


@dataclass
class Machine:
    weights: np.ndarray  # of each subsequence
    bias: float
    calibration: tuple[float, float, float] = (1.0, 0.0, 0.0)
    memo: tuple = field(default=(), repr=False)

    def score(self, text: str) -> np.ndarray:
        """Margins of newline-separated strings."""
        grid, length, who = matrix(text)
        total = np.zeros(len(grid))
        for code, weight in occurrences(grid):
            total += weight * self.weights[code].sum(axis=1)
        total = total / norms(length) + self.bias
        out = np.full(int(who[-1]) + 1, -np.inf)
        np.maximum.at(out, who, total)
        return out

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Margins of words; those met before are looked up, the distinct others are scored together."""
        if not self.memo:
            self.memo = (np.zeros(MEMO, np.uint64), np.zeros(MEMO, np.float32))
        names, values = self.memo
        name = span_hashes(data, starts, ends)
        slot = (name & np.uint64(MEMO - 1)).astype(np.int64)
        out = values[slot]
        new = np.flatnonzero(names[slot] != name)
        if len(new):
            _, one, back = np.unique(name[new], return_index=True, return_inverse=True)
            one = new[one]
            raw = data.tobytes()
            made = np.concatenate([self.score(b"\n".join(raw[a:b] for a, b in zip(starts[o].tolist(), ends[o].tolist(), strict=True)).decode("utf-8", "replace")) for o in np.array_split(one, -(-len(one) // 16384))]).astype(np.float32)
            out[new] = made[back]
            names[slot[one]] = name[one]
            held = names[slot[one]] == name[one]
            values[slot[one][held]] = made[held]
        return out

    def texts(self, data: np.ndarray, offsets: np.ndarray, keep: int = 2) -> tuple[np.ndarray, list]:
        """The two largest margins of the instances of each text (floor -3), and the instances' (row, margin, word span)."""
        starts, ends = words(data, offsets)
        rows = len(offsets) - 1
        row = row_of(offsets, starts)
        margin = self.words(data, starts, ends) if len(starts) else np.zeros(0, np.float32)
        lone = np.flatnonzero(_letters(data, starts, ends) == 1)
        if len(lone) > 2:  # runs of single letters are read as one word
            cut = np.flatnonzero((np.diff(lone) != 1) | (np.diff(row[lone]) != 0)) + 1
            runs = [r for r in np.split(lone, cut) if len(r) > 2]
            if runs:
                raw = data.tobytes()
                spelled = [b"".join(raw[starts[i] : ends[i]] for i in r).decode("utf-8", "replace") for r in runs]
                margin = margin.copy()
                margin[[r[0] for r in runs]] = self.score("\n".join(spelled))
        top = np.full((rows, keep), -3.0)
        if len(starts):
            order = np.lexsort((-margin, row))
            r, m = row[order], margin[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            ok = nth < keep
            top[r[ok], nth[ok]] = np.maximum(m[ok], -3.0)
        return top, (row, margin, starts, ends)

    def probability(self, top: np.ndarray) -> np.ndarray:
        a, b, c = self.calibration
        return 1 / (1 + np.exp(-np.clip(a * top[:, 0] + b * top[:, 1] + c, -50, 50)))


def _plain(word: bytes) -> str:
    """The letters and digits of a word, in lower case."""
    return "".join(c for c in word.decode("utf-8", "replace").lower() if c.isalnum())


def _letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return total[ends] - total[starts]


def nystroem(landmarks: list[str], strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kernel values of strings and landmarks, codes of the landmarks' subsequences, descriptions of the landmarks by code)."""
    rows, codes, weights = describe(landmarks)
    known = np.unique(codes)
    z = np.zeros((len(landmarks), len(known)), np.float32)
    np.add.at(z, (rows, np.searchsorted(known, codes)), weights)
    out = np.zeros((len(strings), len(landmarks)), np.float32)
    step = max(1, 4_000_000 // max(1, len(known)))
    for lo in range(0, len(strings), step):
        part = strings[lo : lo + step]
        rows, codes, weights = describe(part)
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        hit = known[at] == codes
        x = np.zeros((len(part), len(known)), np.float32)
        np.add.at(x, (rows[hit], at[hit]), weights[hit])
        out[lo : lo + step] = x @ z.T
    return out, known, z


def train(landmarks: list[str], strings: list[str], labels: np.ndarray, importance: np.ndarray, cost: float = 1e4, steps: int = 60) -> Machine:
    """Squared-hinge machine on Nystroem features, folded into weights of subsequences."""
    x, known, z = nystroem(landmarks, strings)
    values, vectors = np.linalg.eigh((z @ z.T).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-5 * values.max()))) @ vectors.T
    parts = [slice(lo, lo + 4096) for lo in range(0, len(x), 4096)]
    for p in parts:  # in place: the driver's memory is small
        x[p] = x[p] @ root
    y = np.where(labels > 0, 1.0, -1.0)
    share = importance / np.array([importance[y == s].sum() + 1e-12 for s in (1.0, -1.0)])[(y < 0).astype(int)] / 2
    ridge = np.append(np.full(x.shape[1], 1 / cost), 1e-9)
    w = np.zeros(x.shape[1] + 1)

    def margins(w):
        return y * np.concatenate([x[p] @ w[:-1] + w[-1] for p in parts])

    def loss(w):
        return (share * np.maximum(0, 1 - margins(w)) ** 2).sum() + (ridge * w * w).sum()

    now = loss(w)
    for _ in range(steps):  # Newton steps on the rows within the margin
        inside = margins(w) < 1
        h, g = np.diag(ridge), np.zeros(len(w))
        for p in parts:
            a = np.column_stack([x[p][inside[p]], np.ones(int(inside[p].sum()))]).astype(float)
            t = share[p][inside[p]]
            h = h + (a * t[:, None]).T @ a
            g = g + a.T @ (t * y[p][inside[p]])
        step = np.linalg.solve(h, g) - w
        rate = 1.0
        while rate > 1e-4 and loss(w + rate * step) > now:
            rate /= 2
        w = w + rate * step
        before, now = now, loss(w)
        if before - now <= 1e-9 * before:
            break
    w, b = w[:-1], w[-1]
    out = np.zeros(SYMBOLS**3, np.float32)
    out[known] = (root @ w) @ z
    return Machine(out, float(b))


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Machine:
    """Learns from a bounded sample (about `sample` texts of each label) of labelled rows that `training` admits."""
    spark = docs.sparkSession
    some = labelled_sample(docs, labels, training, id_col, text_col, label_col, sample)
    sizes = {r[0]: r[1] for r in some.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Machine(np.zeros(SYMBOLS**3, np.float32), -1.0, (0.0, 0.0, 50.0 if sizes.get(1) else -50.0))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = batch.column(1).to_numpy()
            for lo, _, data, offsets in blocks(batch.column(0)):
                starts, ends = words(data, offsets)
                row = row_of(offsets, starts)
                name = span_hashes(data, starts, ends)
                _, one = np.unique(name + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_index=True)
                raw = data.tobytes()
                text = [_plain(raw[a:b]) for a, b in zip(starts[one].tolist(), ends[one].tolist(), strict=True)]
                cut = sorted({(r, p) for r, t in zip(row[one].tolist(), text, strict=True) for p in pieces(t)})
                label = y[lo + np.array([r for r, _ in cut], np.int64)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([p for _, p in cut], pa.string()), pa.array(label)], names=["word", "y"])

    counted = mapped(some.select("t", "y"), distinct, "word string, y int").where("length(word) > 2").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"))
    counted = written(counted, "words")
    n1, n0 = sizes[1], sizes[0]
    # a word marks toxic texts where chance would hardly give any word so uneven a share: n KL(share of the word, share
    # of all) >= log of the number of words
    base = n1 / (n1 + n0)
    seen_in = F.col("bad") + F.col("good")
    uneven = F.col("bad") * F.log(F.greatest(F.col("bad"), F.lit(1e-9)) / seen_in / base) + F.col("good") * F.log(F.greatest(F.col("good"), F.lit(1e-9)) / seen_in / (1 - base))
    ranked = counted.withColumns({"z": uneven, "over": F.col("bad") / seen_in > base})
    least = float(np.log(max(2, counted.count())))
    marked = ranked.where(F.col("over") & (F.col("bad") > 2 * base * seen_in / (1 + base)) & (F.col("z") >= least)).orderBy(F.desc("z"), "word").toPandas()
    clean = ranked.where((F.col("good") >= 1) & ~(F.col("over") & (F.col("z") >= least / 2))).orderBy(F.xxhash64("word"), "word").limit(WORDS).toPandas()
    if not len(marked) or not len(clean):
        return Machine(np.zeros(SYMBOLS**3, np.float32), -1.0, (0.0, 0.0, float(np.log(n1 / n0))))
    bad_marks = _spread(marked.word.tolist(), LANDMARKS // 2)
    landmarks = bad_marks + clean.sort_values(["good", "word"], ascending=[False, True]).word.tolist()[: LANDMARKS // 4]
    strings, y = marked.word.tolist() + clean.word.tolist(), np.r_[np.ones(len(marked)), np.zeros(len(clean))]
    importance = np.r_[np.sqrt(marked.bad.to_numpy(float)), np.sqrt(clean.good.to_numpy(float))]
    machine = train(landmarks, strings, y, importance)

    met: dict[str, tuple[float, float, float]] = {}
    for _ in range(ROUNDS):  # witnesses: the most toxic words of each toxic text, and those of clean texts as counterexamples
        shared = spark.sparkContext.broadcast(machine)

        def witnesses(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                label = batch.column(1).to_numpy()
                for lo, hi, data, offsets in blocks(batch.column(0)):
                    _, (row, margin, starts, ends) = shared.value.texts(data, offsets)
                    order = np.lexsort((-margin, row))
                    nth = np.arange(len(order)) - np.searchsorted(row[order], row[order])
                    pick = order[nth < np.where(label[lo + row[order]] == 1, 2, 8)]
                    raw = data.tobytes()
                    text, y, m = [], [], []
                    for a, b, toxic, value in zip(starts[pick].tolist(), ends[pick].tolist(), label[lo + row[pick]].tolist(), margin[pick].tolist(), strict=True):
                        cut, values = pieces(_plain(raw[a:b])), [value]
                        if len(cut) > 1:  # a toxic text's word is borne out by its most toxic part, a clean one's by none
                            values = shared.value.score("\n".join(cut)).tolist()
                            if toxic:
                                values, cut = map(list, zip(max(zip(values, cut, strict=True)), strict=True))
                        text, y, m = text + cut, y + [toxic] * len(cut), m + values
                    yield pa.RecordBatch.from_arrays([pa.array(text, pa.string()), pa.array(y, pa.int32()), pa.array(m, pa.float64())], names=["word", "y", "margin"])

        seen = mapped(some.select("t", "y"), witnesses, "word string, y int, margin double").groupBy("word").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good"), F.max("margin").alias("margin")).toPandas()
        seen = seen[seen.word.str.len() > 2]
        hard = seen[(seen.good > 0) & (seen.good * n1 >= 0.2 * seen.bad * n0)]
        sure = seen[(seen.bad > 0) & (seen.good == 0) & (seen.margin > 0.5)]
        met.update({w: (g, 2.0 * g**0.5, m) for w, g, m in zip(hard.word, hard.good.astype(float), hard.margin, strict=True)})
        found = dict(zip(sure.word, np.sqrt(sure.bad.astype(float)), strict=True))
        more = strings + list(found) + list(met)
        marks = np.r_[y, np.ones(len(found)), np.zeros(len(met))]
        weight = np.r_[importance, list(found.values()), [w for _, w, _ in met.values()]]
        # the counterexamples that come nearest stand as landmarks too
        near = sorted(met, key=lambda w: (-(met[w][2] + 1) * met[w][1], w))
        machine = train(bad_marks + _spread(near, LANDMARKS // 2), more, marks, weight)
    shared = spark.sparkContext.broadcast(machine)

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                top, _ = shared.value.texts(data, offsets)
                yield pa.RecordBatch.from_arrays([pa.array(top[:, 0]), pa.array(top[:, 1]), batch.column(1).slice(lo, hi - lo)], names=["a", "b", "y"])

    kind = some.schema["y"].dataType.simpleString()
    t = mapped(some.select("t", "y"), tops, f"a double, b double, y {kind}").toPandas()
    # the sample's shares are not those of the labels: half-way between the two on the scale of odds
    shares = _sizes(labels, training, label_col)
    tilt = (shares[0] / max(1, shares[1]) * n1 / n0) ** 0.5
    machine.calibration = _logistic(t[["a", "b"]].to_numpy(), t.y.to_numpy(float), np.where(t.y > 0, 1.0, tilt))
    return machine


def _spread(ranked: list[str], n: int) -> list[str]:
    """The first words of the ranking that are not nearly one chosen before."""
    k, _, _ = nystroem(ranked[: 4 * n], ranked[: 4 * n])
    own = np.sqrt(np.maximum(np.diag(k), 1e-12))
    k = k / own[:, None] / own[None, :]
    chosen: list[int] = []
    for i in range(len(k)):
        if len(chosen) < n and (not chosen or k[i, chosen].max() < 0.9):
            chosen.append(i)
    return [ranked[i] for i in chosen]


def _sizes(labels: DataFrame, training: Column, label_col: str) -> tuple[int, int]:
    rows = {r[0]: r[1] for r in labels.where(training & F.col(label_col).isin(0, 1)).groupBy(label_col).count().collect()}
    return rows.get(0, 0), rows.get(1, 0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3) -> tuple[float, float, float]:
    """Logistic regression of two margins, by Newton steps."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(3)
    share = weight / weight.sum()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (share * (p - y)) + penalty * w
        h = (a * (share * p * (1 - p))[:, None]).T @ a + (penalty + 1e-9) * np.eye(3)
        step = np.linalg.solve(h, g)
        w = w - step / max(1.0, np.abs(step).max() / 5)
    return float(w[0]), float(w[1]), float(w[2])


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Toxicity of every whole text: id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts have no instance and get the floor's score. Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                top, _ = shared.value.texts(data, offsets)
                p = shared.value.probability(top)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return mapped(docs.select(F.col(id_col), F.col(text_col)), run, f"`{id_col}` {kind}, score double, predicted int")


def keep_clean(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores below the threshold."""
    shared, at = docs.sparkSession.sparkContext.broadcast(machine), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(at)):
                top, _ = shared.value.texts(data, offsets)
                yield batch.slice(lo, hi - lo).filter(pa.array(shared.value.probability(top) < threshold))

    return mapped(docs, run, docs.schema)
