"""URL filters by a bit-parallel wildcard automaton.

Every rule is a glob. All globs' positions are packed into multiword bit masks; one Shift-And step per
character moves every glob of every URL of a batch at once: D = (D << 1 & B[c]) | (D & S[c]), where B
has the positions that accept the character and S those that stay, being wildcards.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_buffers

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH = 4096


@dataclass(frozen=True)
class Rule:
    """A glob over `.host/path`; `*` runs within a host or path segment, `**` over anything. name and rank tell rules apart: the highest rank wins."""

    glob: str
    verdict: str
    name: str
    rank: int


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """Fits the host and all its subdomains, where the path starts with `path`; a longer host and path rank higher."""
    if "*" in host + path:
        raise ValueError("host and path are literal")
    return Rule(f"*.{host}{path}**", verdict, host + path, len(host) + len(path))


class Automaton:
    def __init__(self, globs: list[str]):
        bits: list[tuple[int, int, bool]] = []  # of each bit: accepted byte or -1 for a start, wildcard kind, final
        for glob in globs:
            items, loops, raw, i = [-1], [0], glob.encode(), 0
            while i < len(raw):
                if raw[i : i + 2] == b"**":
                    loops[-1], i = 2, i + 2
                elif raw[i : i + 1] == b"*":
                    loops[-1], i = max(loops[-1], 1), i + 1
                else:
                    items.append(raw[i])
                    loops.append(0)
                    i += 1
            bits += [(c, w, k == len(items) - 1) for k, (c, w) in enumerate(zip(items, loops, strict=True))]
        self.words = max(1, -(-len(bits) // 64))
        self.accepts = np.zeros((256, self.words), np.uint64)
        self.stays = np.zeros((256, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.finals: list[tuple[int, np.uint64]] = []
        for k, (c, wild, final) in enumerate(bits):
            word, bit = k // 64, np.uint64(1 << (k % 64))
            if c < 0:
                self.start[word] |= bit
            else:
                self.accepts[c, word] |= bit
            if wild:
                self.stays[:, word] |= bit
                if wild == 1:
                    self.stays[ord("/"), word] &= ~bit
            if final:
                self.finals.append((word, bit))

    def matches(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row for each text, a column for each glob: whether it fits the whole text."""
        size = np.diff(offsets)
        order = np.argsort(-size, kind="stable")
        at, size = offsets[:-1][order], size[order]
        live = np.tile(self.start, (len(order), 1))
        longer = len(size) - np.cumsum(np.bincount(size, minlength=1))
        for j in range(int(size[0]) if len(size) else 0):
            k = int(longer[j])
            byte, now = data[at[:k] + j], live[:k]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            live[:k] = moved & self.accepts[byte] | now & self.stays[byte]
        out = np.empty((len(order), len(self.finals)), bool)
        for g, (word, bit) in enumerate(self.finals):
            out[order, g] = (live[:, word] & bit) != 0
        return out


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host and path: see judge_urls."""
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    return df.withColumns({"host": F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER), "path": F.regexp_extract(url, parts, 2)})


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Verdict on every URL.

    Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: then up to `?`, `#` or the end.
    A null URL, or one without `://`, has both empty and fits only globs that fit the empty host. Of the rules that fit,
    the highest rank wins, ties to the earlier in the list. Returns id, host, path, rule (its name, or null), verdict
    (the rule's, or `default`). Repeated rows are judged each; other columns are ignored.
    """
    order = sorted(range(len(rules)), key=lambda i: (-rules[i].rank, i))
    machine = Automaton([rules[i].glob for i in order])
    names = pa.array([rules[i].name for i in order] + [None], pa.string())
    verdicts = pa.array([rules[i].verdict for i in order] + [default], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                data, offsets = text_buffers(part.column(3))
                base = offsets[0]
                hit = machine.matches(data[base : offsets[-1]], offsets - base)
                fits = np.column_stack([hit, np.ones(len(hit), bool)])
                best = pa.array(fits.argmax(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], names.take(best), verdicts.take(best)], names=[id_col, "host", "path", "rule", "verdict"])

    kind = pages.schema[id_col].dataType.simpleString()
    parts = split_url(pages.select(F.col(id_col).alias("i"), F.col(url_col).alias("u")), "u")
    return parts.select("i", "host", "path", F.concat(F.lit("."), "host", "path").alias("canonical")).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
