"""Token counts by compiled finite-state transducers.

Two deterministic machines, composed:

* The *boundary* machine reads character classes and says where a pre-token begins. Its transition
  monoid (all state maps that strings can cause) is closed at compile time, so that a chunk of text is
  one monoid element, chunks compose by table lookup, and a parallel prefix scan gives the state at
  every chunk's start. Chunks of a text are thus run side by side, whatever its length.
* The *merge* machine reads the bytes of a pre-token. After any prefix, the segmentation of the prefix
  ends in the longest vocabulary token that is a suffix and that may follow what stands before it;
  a state is the pending trie node with the last tokens at the positions that a later token can reach
  back to. Its states are finite; they are built when first reached, and every transition is annotated
  with the change of the number of tokens. All pre-tokens of a block step in parallel.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, span_hashes

# Character classes of the boundary machine.
LETTER, NUMBER, SPACE, BLANK, QUOTE, OTHER = range(6)
# The contractions that are tokens of their own after a quote.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
# Code points of Unicode's White_Space besides U+0020.
WHITE = [*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

CHUNK = 128
MAX_STATES = 60_000
#: Slots of the memo of whole pre-tokens, a direct-mapped table of 64-bit names and counts.
MEMO = 1 << 21


@lru_cache(1)
def class_table() -> np.ndarray:
    """Class of every code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, every):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a == len(m[0]) - 1:
                out[a : b + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    out[WHITE] = SPACE
    out[0x20] = BLANK
    out[ord("'")] = QUOTE
    return out


class BoundaryMachine:
    """Reads classes; a transition's annotation is 1 where the character begins a pre-token by what came before.

    What follows matters in two places only, and both are settled one character later by a fix-up on the
    emitted marks: the last white space of a run goes with what follows, if it is U+0020, or stands alone;
    and a lone quote that begins a pre-token takes a contraction's letters.
    """

    # states: kind of the pre-token that the last character belongs to
    START, IN_LETTER, IN_NUMBER, IN_OTHER, IN_SPACE, AFTER_BLANK = range(6)

    def __init__(self):
        s, c = 6, 6
        self.next = np.zeros((s, c), np.uint8)
        self.emit = np.zeros((s, c), np.uint8)  # 2: the blank before the character begins its pre-token
        into = {LETTER: self.IN_LETTER, NUMBER: self.IN_NUMBER, QUOTE: self.IN_OTHER, OTHER: self.IN_OTHER, SPACE: self.IN_SPACE, BLANK: self.AFTER_BLANK}
        for state in range(s):
            for kind in range(c):
                to = self.next[state, kind] = into[kind]
                white = state in (self.IN_SPACE, self.AFTER_BLANK)
                if kind in (SPACE, BLANK):
                    self.emit[state, kind] = not white
                elif state == self.AFTER_BLANK:
                    self.emit[state, kind] = 2
                else:
                    self.emit[state, kind] = state != to
        # The transition monoid: state maps closed under appending a class. Classes 6 to 11 are those of a
        # text's first character, which acts as from START whatever came before.
        names, queue, rows = {bytes(range(s)): 0}, [bytes(range(s))], []
        for m in queue:
            row = []
            for kind in range(2 * c):
                made = bytes(self.next[x if kind < c else self.START, kind % c] for x in m)
                if made not in names:
                    names[made] = len(queue)
                    queue.append(made)
                row.append(names[made])
            rows.append(row)
        self.maps = np.array([list(m) for m in queue], np.uint8)
        self.append = np.array(rows, np.uint8)
        self.compose = np.array([[names[bytes(b[x] for x in a)] for b in queue] for a in queue], np.uint8)

    def states_before(self, kinds: np.ndarray, first: np.ndarray) -> np.ndarray:
        """State before each character; `first` marks characters that begin a text, which reset the machine."""
        n = len(kinds)
        pad = -n % CHUNK
        k = np.concatenate([kinds + np.uint8(6) * first, np.zeros(pad, np.uint8)]).reshape(-1, CHUNK).T.copy()
        m = np.zeros(k.shape[1], np.uint8)
        for row in k:
            m = self.append[m, row]
        # parallel prefix scan over the chunks' state maps
        scan, step = m.copy(), 1
        while step < len(scan):
            scan[step:] = self.compose[scan[:-step], scan[step:]]
            step *= 2
        entry = np.zeros(len(m), np.uint8)
        entry[1:] = self.maps[scan[:-1], self.START]
        out = np.empty_like(k)
        state = entry
        for i, row in enumerate(k):
            out[i] = np.where(row >= 6, np.uint8(self.START), state)
            state = self.next[out[i], row % 6]
        return out.T.reshape(-1)[:n]

    def begins(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Marks of the characters that begin a pre-token, for code points of several texts."""
        n = len(points)
        if not n:
            return np.zeros(0, bool)
        kinds = class_table()[points]
        emit = self.emit[self.states_before(kinds, first), kinds]
        marks = emit == 1
        joined = np.flatnonzero(emit == 2)
        marks[joined - 1] = True
        # a run of white space before other text gives up its last character: a blank joins what follows, others stand alone
        white = (kinds == SPACE) | (kinds == BLANK)
        after = np.flatnonzero(~white[1:] & white[:-1] & ~first[1:]) if n > 1 else np.zeros(0, np.int64)
        marks[after] = True
        # contractions: a quote alone in its pre-token, then the letters
        quote = np.flatnonzero((points == ord("'")) & marks)
        ends = np.ones(n + 3, bool)
        ends[:n] = first
        padded = np.zeros(n + 3, points.dtype)
        padded[:n] = points
        free = ~ends[quote + 1]
        quote = quote[free]
        for text in CONTRACTIONS:
            hit = np.ones(len(quote), bool)
            for j, ch in enumerate(text):
                hit &= (padded[quote + 1 + j] == ord(ch)) & ~ends[quote + 1 + j]
            q = quote[hit]
            marks[q + 1] = False
            tail = q + 1 + len(text)
            tail = tail[(tail < n)]
            same = (kinds[tail] == LETTER) & ~first[tail]
            marks[tail[same]] = True
        return marks


class MergeMachine:
    """The merge transducer of a byte-level vocabulary, determinised on demand."""

    def __init__(self, vocab: dict[str, int], merges: list):
        to_byte = byte_alphabet()
        self.byte_of = to_byte
        self.memo_name = np.zeros(MEMO, np.uint64)
        self.memo_count = np.zeros(MEMO, np.int32)
        self.rank = {}
        for i, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self._raw(a), self._raw(b)] = i
        made = {a + b for a, b in self.rank} | {bytes([c]) for c in range(256)}
        tokens = {self._raw(t) for t in vocab if all(c in to_byte for c in t)} & made
        # only tokens that the merges really make of their own bytes
        self.tokens = {t for t in tokens if len(t) == 1 or self.segment(t) == [t]}
        self.prefixes = {t[:i] for t in self.tokens for i in range(1, len(t) + 1)}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def _raw(self, token: str) -> bytes:
        return bytes(self.byte_of[c] for c in token)

    def segment(self, raw: bytes) -> list[bytes]:
        """Plain merging, for compiling only: the lowest rank first, leftmost first."""
        parts = [raw[i : i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: (self.rank.get((parts[i], parts[i + 1]), 1 << 30), i))
            if (parts[best], parts[best + 1]) not in self.rank:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def may_follow(self, a: bytes, b: bytes) -> bool:
        key = (a, b)
        got = self.follows.get(key)
        if got is None:
            if len(self.follows) > 1_000_000:
                self.follows.clear()
            got = self.follows[key] = self.segment(a + b) == [a, b]
        return got

    def reset(self) -> None:
        """Forget the built states; they are built again when reached."""
        self.names: dict = {}
        self.keys: list = []
        # rows of states, columns of bytes: next state, or -1 while not built
        self.next = np.full((1024, 256), -1, np.int32)
        self.delta = np.zeros((1024, 256), np.int8)
        self.root = self._state(b"", ((b"", 0),))

    def _state(self, tail: bytes, window: tuple) -> int:
        """tail: longest suffix that begins a token. window: (last token, tokens less than now) at len(tail) + 1 positions, oldest first."""
        key = (tail, window)
        got = self.names.get(key)
        if got is None:
            got = self.names[key] = len(self.keys)
            self.keys.append(key)
            if got >= len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return got

    def build(self, state: int, byte: int) -> None:
        tail, window = self.keys[state]
        read = tail + bytes([byte])
        for i in range(len(read)):  # the longest token first
            token = read[i:]
            if token in self.tokens:
                before, less = window[i]
                if before == b"" or self.may_follow(before, token):
                    break
        else:
            raise ValueError("a byte is no token")
        change = 1 - less
        i = 0
        while i < len(read) and read[i:] not in self.prefixes:
            i += 1
        kept = [(t, n + change) for t, n in window[i:]] + [(token, 0)]
        self.next[state, byte] = self._state(read[i:], tuple(kept))
        self.delta[state, byte] = change

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span of bytes. Spans met before are looked up; the distinct others run through the machine."""
        name = span_hashes(data, starts, ends, lower=False)
        slot = (name & np.uint64(MEMO - 1)).astype(np.int64)
        out = self.memo_count[slot]
        new = np.flatnonzero(self.memo_name[slot] != name)
        if len(new):
            _, one, back = np.unique(name[new], return_index=True, return_inverse=True)
            one = new[one]
            made = self.run(data, starts[one], ends[one])
            out[new] = made[back]
            self.memo_name[slot[one]] = name[one]
            held = self.memo_name[slot[one]] == name[one]  # of names that share a slot, one stays
            self.memo_count[slot[one][held]] = made[held]
        return out

    def run(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each span of bytes by the machine; all spans step side by side."""
        if len(self.keys) > MAX_STATES:
            self.reset()
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        at, size = starts[order], size[order]
        total = np.zeros(len(order), np.int32)
        state = np.full(len(order), self.root, np.int32)
        # how many spans are longer than j
        longer = len(size) - np.cumsum(np.bincount(size, minlength=1))
        for j in range(int(size[0]) if len(size) else 0):
            k = int(longer[j])
            byte = data[at[:k] + j]
            now = state[:k]
            to = self.next[now, byte]
            if (to < 0).any():
                miss = np.flatnonzero(to < 0)
                for code in np.unique(now[miss].astype(np.int64) << 8 | byte[miss]).tolist():
                    self.build(code >> 8, code & 255)
                to = self.next[now, byte]
            total[:k] += self.delta[now, byte]
            state[:k] = to
        out = np.empty(len(order), np.int32)
        out[order] = total
        return out


@lru_cache(1)
def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


class Compiled:
    """The composed counter of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.split = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.boundary = BoundaryMachine()
        self.merge = MergeMachine(spec["model"]["vocab"], spec["model"]["merges"])

    def count_block(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text of a block of UTF-8 bytes."""
        rows = len(offsets) - 1
        out = np.zeros(rows, np.int64)
        if not len(data):
            return out
        lead = np.flatnonzero((data & 0xC0) != 0x80)  # the first byte of each character
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        filled = offsets[:-1][offsets[:-1] < offsets[1:]]
        first = np.zeros(len(points), bool)
        first[np.searchsorted(lead, filled)] = True
        dropped = np.zeros(len(points), bool)
        if self.split is not None and all(s.encode() for s in self.special):
            text = data.tobytes()
            for s in self.special:
                raw = s.encode()
                p = text.find(raw)
                while p >= 0:
                    row = int(np.searchsorted(offsets, p, "right")) - 1
                    if p + len(raw) <= offsets[row + 1]:
                        c = int(np.searchsorted(lead, p))
                        if not dropped[c : c + len(s)].any():
                            dropped[c : c + len(s)] = True
                            out[row] += 1
                            first[c] = True
                            if c + len(s) < len(points):
                                first[c + len(s)] = True
                            p += len(raw) - 1
                    p = text.find(raw, p + 1)
        marks = self.boundary.begins(points, first) | first
        keep = np.flatnonzero(marks & ~dropped)
        begin = lead[keep]
        stop_marks = np.flatnonzero(marks)
        after = np.searchsorted(stop_marks, keep) + 1
        end = np.full(len(keep), len(data), np.int64)
        inner = after < len(stop_marks)
        end[inner] = lead[stop_marks[after[inner]]]
        tokens = self.merge.counts(data, begin, end)
        out += np.bincount(np.searchsorted(offsets, begin, "right") - 1, weights=tokens, minlength=rows).astype(np.int64)
        return out


@lru_cache(2)
def compiled(path: str) -> Compiled:
    return Compiled(path)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """Tokens of every whole text.

    Returns id, n_bytes, n_tokens, over_limit (more than `limit` tokens). Null counts as empty: 0 tokens. Equal rows
    are counted each; other columns are ignored; an empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(path)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for lo, hi, data, offsets in blocks(column):
                n = machine.count_block(data, offsets)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
