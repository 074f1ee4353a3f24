"""Quality by attention-based multiple-instance learning.

Every passage of a text is encoded; gated attention weights are learned from documents' labels alone; the score is that
of the weighted sum of the encoded passages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, labelled_sample, row_of, span_hashes, words

#: Words of a passage.
PASSAGE = 64
#: Labelled texts of each label that are learned from, with all their passages, at most about.
SAMPLE = 4000
#: Bytes of one text whose passages are described at a time, about.
PIECE = 1 << 21
ENCODED, GATES, EPOCHS, BATCH = 24, 16, 30, 64

# Byte classes: 0 lower-case letters, 1 capitals, 2 digits, 3 blanks, 4 line ends, 5 beyond ASCII, 6 other controls, then each mark.
_MARKS = [c for c in range(0x21, 0x7F) if not chr(c).isalnum()]
_CLASS = np.full(256, 6, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[[0x20, 0x09]] = 3
_CLASS[[0x0A, 0x0D]] = 4
_CLASS[128:] = 5
_CLASS[_MARKS] = 7 + np.arange(len(_MARKS))
CLASSES = 7 + len(_MARKS)
LENGTHS = 8
FEATURES = CLASSES + LENGTHS + 5


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, its row), in order. A text without words has one passage of zeros."""
    rows = len(offsets) - 1
    starts, ends = words(data, offsets)
    if rows == 1 and len(data) > PIECE and len(starts) > PASSAGE:  # a long text, by pieces of whole passages
        step = PASSAGE * max(1, int(len(starts) * PIECE / len(data)) // PASSAGE)
        cuts = [0, *starts[step::step].tolist(), len(data)]
        pieces = [passages(data[a:b], np.array([0, b - a]))[0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return np.concatenate(pieces), np.zeros(sum(map(len, pieces)), np.int64)
    row = row_of(offsets, starts)
    size = np.bincount(row, minlength=rows)
    count = np.maximum(1, -(-size // PASSAGE))
    base = np.cumsum(count) - count
    owner = np.repeat(np.arange(rows), count)
    out = np.zeros((len(owner), FEATURES))
    if not len(starts):
        return out, owner
    nth = np.arange(len(starts)) - (np.cumsum(size) - size)[row]
    passage = base[row] + nth // PASSAGE
    # bytes belong to the passage of the last word that began, and leading bytes to the first
    began = np.searchsorted(starts, np.arange(len(data)), "right") - 1
    of_row = np.repeat(np.arange(rows), np.diff(offsets))
    own = np.maximum(base[of_row], np.where(began >= 0, passage[began], 0))
    out[:, :CLASSES] = np.bincount(own * CLASSES + _CLASS[data], minlength=len(owner) * CLASSES).reshape(-1, CLASSES)
    out[:, :CLASSES] /= np.maximum(1, out[:, :CLASSES].sum(axis=1, keepdims=True))
    width = ends - starts
    held = np.bincount(passage, minlength=len(owner))
    out[:, CLASSES : CLASSES + LENGTHS] = np.bincount(passage * LENGTHS + np.minimum(LENGTHS - 1, width // 3), minlength=len(owner) * LENGTHS).reshape(-1, LENGTHS) / np.maximum(1, held)[:, None]
    mixed = span_hashes(data, starts, ends) + passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    different = np.bincount(passage[np.unique(mixed, return_index=True)[1]], minlength=len(owner))
    last = data[ends - 1]
    marked = ~((_CLASS[last] == 0) | (_CLASS[last] == 1) | (_CLASS[last] == 2) | (_CLASS[last] == 5))
    capital = (_CLASS[data[starts]] == 1) & (_CLASS[data[np.minimum(starts + 1, len(data) - 1)]] == 1)
    col = CLASSES + LENGTHS
    out[:, col] = different / np.maximum(1, held)
    out[:, col + 1] = np.bincount(passage, weights=marked, minlength=len(owner)) / np.maximum(1, held)
    out[:, col + 2] = np.bincount(passage, weights=capital, minlength=len(owner)) / np.maximum(1, held)
    out[:, col + 3] = np.bincount(passage, weights=np.minimum(width, 100), minlength=len(owner)) / np.maximum(1, held) / 10
    out[:, col + 4] = np.log1p(held) / 5
    return out, owner


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    p: list[np.ndarray]  # encoder, gates, scorer

    def forward(self, x: np.ndarray, owner: np.ndarray, rows: int):
        w, b, v, u, g, s, c = self.p
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w + b)
        tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
        e = (tv * su) @ g
        top = np.full(rows, -np.inf)
        np.maximum.at(top, owner, e)
        a = np.exp(e - top[owner])
        a = a / np.bincount(owner, weights=a, minlength=rows)[owner]
        z = np.zeros((rows, h.shape[1]))
        np.add.at(z, owner, a[:, None] * h)
        y = 1 / (1 + np.exp(-np.clip(z @ s + c, -40, 40)))
        return x, h, tv, su, a, z, y


def fit_bags(x: np.ndarray, owner: np.ndarray, y: np.ndarray, seed: int = 0) -> Model:
    """Trains encoder, attention and scorer together, on balanced log loss, by Adam."""
    rng = np.random.default_rng(seed)
    scale = x.std(axis=0) + 1e-3
    p = [rng.standard_normal((x.shape[1], ENCODED)) / x.shape[1] ** 0.5, np.zeros(ENCODED), rng.standard_normal((ENCODED, GATES)) / 5, rng.standard_normal((ENCODED, GATES)) / 5, rng.standard_normal(GATES) / 4, rng.standard_normal(ENCODED) / 5, np.zeros(1)]
    model = Model(x.mean(axis=0), scale, p)
    m, v, t = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p], 0
    first = np.searchsorted(owner, np.arange(len(y) + 1))
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).mean() * len(y)), 0.5 / max(1, (y <= 0).mean() * len(y))) * len(y)
    for epoch in range(EPOCHS):
        rate = 5e-3 * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        order = rng.permutation(len(y))
        for lo in range(0, len(y), BATCH):
            bags = order[lo : lo + BATCH]
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in bags])
            own = np.repeat(np.arange(len(bags)), first[bags + 1] - first[bags])
            xs, h, tv, su, a, z, out = model.forward(x[at], own, len(bags))
            w_, b_, v_, u_, g_, s_, c_ = p
            d = (out - y[bags]) * weight[bags] / len(bags)
            dz = d[:, None] * s_[None, :]
            dh = a[:, None] * dz[own]
            da = (dz[own] * h).sum(axis=1)
            de = a * (da - np.bincount(own, weights=a * da, minlength=len(bags))[own])
            dtv, dsu = de[:, None] * su * g_ * (1 - tv**2), de[:, None] * tv * g_ * su * (1 - su)
            dh += dtv @ v_.T + dsu @ u_.T
            dx = dh * (1 - h**2)
            grads = [xs.T @ dx + 1e-4 * w_, dx.sum(axis=0), h.T @ dtv, h.T @ dsu, (tv * su).T @ de, z.T @ d + 1e-4 * s_, np.array([d.sum()])]
            t += 1
            for i, gr in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * gr
                v[i] = 0.999 * v[i] + 0.001 * gr * gr
                p[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return model


def fit(docs: DataFrame, labels: DataFrame, training: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Model | float:
    """Learns from a bounded sample (about `sample` texts of each label, all passages of each) of labelled rows that
    `training` admits; of conflicting labels of one id the largest counts, null labels and null texts are left out. With labels of one kind only, that label as a constant score; without any, 0.5."""
    some = labelled_sample(docs, labels, training, id_col, text_col, label_col, sample)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(0)):
                x, owner = passages(data, offsets)
                out = []
                for i in range(hi - lo):
                    a, b = np.searchsorted(owner, [i, i + 1])
                    out.append(x[a:b].astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1).slice(lo, hi - lo)], names=["x", "y"])

    kind = some.schema["y"].dataType.simpleString()
    rows = some.mapInArrow(encode, f"x binary, y {kind}").orderBy(F.xxhash64("x"), "y").collect()
    y = np.array([r["y"] for r in rows], float)
    if not len(y) or y.min() == y.max():
        return float(y[0]) if len(y) else 0.5
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in rows]
    return fit_bags(np.concatenate(bags).astype(float), np.repeat(np.arange(len(bags)), [len(b) for b in bags]), y)


def score(docs: DataFrame, model: Model | float, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Quality of every whole text: id, score (0 to 1), predicted (1 if score >= threshold).

    Null, empty and blank texts are one passage without words. Repeated rows are scored each; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                n = hi - lo
                y = np.full(n, m) if isinstance(m, float) else m.forward(*passages(data, offsets), n)[-1]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(y), pa.array((y >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
