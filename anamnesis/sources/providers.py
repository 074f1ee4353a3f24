"""What callers plug in (F5-F14, F32-F38), and deterministic stand-ins that need no network."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import FNV_BASIS, FNV_PRIME


class Embedder(Protocol):
    dimension: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class Judge(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class HashEmbedder:
    """Byte i adds (byte - 96) / 32 to dimension i mod d; unit length."""

    def __init__(self, dimension: int = 64):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, t in enumerate(texts):
            raw = (np.frombuffer(t.encode(), np.uint8).astype(float) - 96) / 32
            out[i] = np.bincount(np.arange(len(raw)) % self.dimension, weights=raw, minlength=self.dimension)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def fnv(state: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """FNV-1a of each text from each of the states: texts x states. Byte i of all texts that have one is mixed in at once."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    flat, sizes = np.frombuffer(b"".join(texts[i] for i in order), np.uint8), np.array([len(texts[i]) for i in order], np.int64)
    starts, prime = np.cumsum(sizes) - sizes, np.uint64(FNV_PRIME)
    h = np.repeat(state[None, :], len(texts), axis=0)
    active = len(texts)
    for at in range(int(sizes.max(initial=0))):
        while sizes[active - 1] <= at:
            active -= 1
        h[:active] ^= flat[starts[:active] + at].astype(np.uint64)[:, None]
        h[:active] *= prime
    out = np.empty_like(h)
    out[order] = h
    return out


class FnvEmbedder:
    """Dimension i is FNV-1a of i (eight bytes, the low one first) and the text, spread over [-1, 1]; unit length."""

    def __init__(self, dimension: int = 384):
        self.dimension = dimension

    def __call__(self, texts: list[str]) -> np.ndarray:
        basis = np.array([FNV_BASIS], np.uint64)
        states = fnv(basis, [i.to_bytes(8, "little") for i in range(self.dimension)])[:, 0]
        out = (fnv(states, [t.encode() for t in texts]) / 2.0**64 * 2 - 1).astype(np.float32)
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=np.zeros_like(out), where=n > 0)


def cache_keys(df: DataFrame, text_col: str, model: str, out: str = "key") -> DataFrame:
    """Adds the key of a text's cached vector: FNV-1a of the model's name, byte 255 and the text, as a signed long; null is empty."""

    @F.pandas_udf("long")
    def run(p: pd.Series) -> pd.Series:
        state = fnv(np.array([FNV_BASIS], np.uint64), [model.encode() + b"\xff"])[0]
        return pd.Series(fnv(state, [t.encode() for t in p.fillna("")])[:, 0].view(np.int64))

    return df.withColumn(out, run(F.col(text_col)))


def unfenced(c: Column) -> Column:
    """Without a code fence around the whole text, and white space."""
    s = F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, "^```(json)?", ""), r"```\z", ""), r"(?U)^\s+|\s+\z", "")


def embedded(df: DataFrame, text_col: str, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """Adds a vector column; Arrow batches reach the embedder, each distinct text of a batch once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for p in parts:
            names = p.fillna("")
            once = names.drop_duplicates()
            known = dict(zip(once, embedder(once.tolist()).astype(np.float32), strict=True))
            yield names.map(known)

    return df.withColumn(out, run(F.col(text_col)))


def judged(df: DataFrame, prompt: Column, judge: Judge, out: str = "verdict") -> DataFrame:
    @F.pandas_udf("string")
    def run(p: pd.Series) -> pd.Series:
        return pd.Series(judge(p.fillna("").tolist()))

    return df.withColumn(out, run(prompt))


def first_json(text: str) -> str | None:
    """The first balanced JSON value in a model's answer, fences and prose around it passed over."""
    for start, opener in ((i, c) for i, c in enumerate(text) if c in "{["):
        try:
            return json.dumps(json.JSONDecoder().raw_decode(text[start:])[0])
        except ValueError:
            continue
    return None


EXTRACTION = "struct<memories: array<struct<content: string, memory_type: string, confidence: double, entities: array<string>, tags: array<string>, context: array<string>, reasoning: string>>, entities: array<struct<name: string, entity_type: string, attributes: map<string, string>>>>"


def extracted(answers: DataFrame, column: str, least: float = 0.5) -> DataFrame:
    """Memories of model answers with enough confidence: the answer's columns, and content, memory_type, confidence, tags."""

    @F.pandas_udf("string")
    def clean(p: pd.Series) -> pd.Series:
        return p.map(lambda t: None if t is None else first_json(t))

    rows = answers.withColumn("x", F.explode(F.from_json(clean(column), EXTRACTION)["memories"]))
    return rows.select(*answers.columns, F.col("x.content").alias("content"), F.col("x.memory_type").alias("memory_type"), F.col("x.confidence").alias("confidence"), F.col("x.tags").alias("tags")).where(F.col("confidence") >= least)
