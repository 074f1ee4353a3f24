"""Shared pieces: scratch tables, splits by checksum, and vectorised views of Arrow text columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
BLOCK_BYTES = 1 << 18
#: Bytes that are hashed at a time, unless one word is longer.
PIECE_BYTES = 1 << 20
#: Bytes of a batch of rows on its way to a Python worker, about, unless one row is longer.
BATCH_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local session gets one of its
    own; on a cluster that would be another folder on each machine, so there it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="anamnesis-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/anamnesis-scratch/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of df: a Parquet table in the shared folder, which outlives any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, unless the session names a size: as Spark comes, a batch
    is 10,000 rows or 64 MB, which the executor's JVM and its Python worker each hold, twice while their buffers grow."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def crc_mod(column: str, m: int) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(m)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(names: list[str], name: str) -> str:
    """`name`, with underscores until no column of these names is called so, whatever the case."""
    taken = {n.lower() for n in names}
    while name.lower() in taken:
        name += "_"
    return name


def labelled_sample(docs: DataFrame, labels: DataFrame, training: Column, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """About `sample` texts of each label, 0 and 1, of the labelled rows that `training` admits: t, y. Of several labels of one id the largest counts."""
    known = labels.where(training & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).alias("y"))
    sizes = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    share = F.when(F.col("y") == 1, F.lit(min(1.0, sample / max(1, sizes.get(1, 0))))).otherwise(F.lit(min(1.0, sample / max(1, sizes.get(0, 0)))))
    some = known.where(F.pmod(F.xxhash64(id_col, F.lit(5)), F.lit(1_000_000)) < share * 1_000_000)
    # about 2 x sample rows of two columns: broadcast, so that no text is shuffled
    return written(docs.select(F.col(id_col), F.col(text_col).alias("t")).join(F.broadcast(some), id_col).select("t", "y").where("t is not null"), "labelled")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, without copying the bytes; null counts as empty. In a text that is not UTF-8
    each invalid sequence counts as U+FFFD."""
    column = column.cast(pa.large_string())
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        raw = column.cast(pa.large_binary()).to_pylist()
        column = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.large_string())
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    return np.frombuffer(data, np.uint8), offsets


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets within those bytes) of runs of rows of about `limit` bytes."""
    data, offsets = text_buffers(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def row_of(offsets: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """The row that holds each (ascending) byte position."""
    return np.searchsorted(offsets, positions, "right") - 1


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that nearby hashes part."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end bytes of the words `[^\\x20\\x09-\\x0D]+`; no word crosses rows."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of ascending byte spans: differences of one running polynomial, shifted to a common origin, then mixed.
    Long texts are taken piece by piece."""
    n = len(data)
    if n > PIECE_BYTES and len(starts) > 1:
        cuts = np.unique(np.searchsorted(starts, np.arange(0, n, PIECE_BYTES // 2)))
        cuts = np.unique(np.concatenate([[0], cuts, [len(starts)]]))
        pieces = [(a, b, starts[a], ends[a:b].max()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return np.concatenate([span_hashes(data[lo:hi], starts[a:b] - lo, ends[a:b] - lo, lower) for a, b, lo, hi in pieces])
    power, inverse = _power_tables(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(((_LOWER[data] if lower else data).astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word with A-Z lower-cased, row of each word)."""
    starts, ends = words(data, offsets)
    return span_hashes(data, starts, ends), row_of(offsets, starts)
