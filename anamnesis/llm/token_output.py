"""Training-order materialisation of token ids.

Every split of the input packs its documents, in order, into sequences of fixed length. A sequence's index is its
split's number times the most sequences that any split could hold, plus its number there; a keyed Feistel permutation
with cycle-walking takes the index to a place in the same domain, and the sequence's global slot is its rank among the
occupied places. Ranges of places go to shards, each of which is written in order at a fixed stride. So texts are
tokenised once, and the only copy on the way is the shuffle to the shards.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import blocks, mapped, scratch_path, written
from .feistel import permute

LENGTH, SHARD_BYTES = 1024, 24 << 20
#: Header of a record: number of tokens that are not padding; then LENGTH ids.
HEADER = 4
END = 50256
#: Splits that the permutation has room for, at least.
SPLITS = 1 << 20


@lru_cache(2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def stride(length: int = LENGTH) -> int:
    return HEADER + 2 * length


def materialise(docs: DataFrame, tokenizer: str, out: str | None = None, length: int = LENGTH, end: int = END, key: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes shards `shard-00000.bin`, ... under `out` (default: a new folder in the shared one) and returns their index.

    A row for each sequence: slot (0 to n - 1, the training order), shard, offset (bytes into the shard's file), n_tokens
    (before padding), n_docs, doc_ids (of the documents with tokens here, in order), path. Ids must be below 65,536. Each
    document ends with `end`; null and empty texts are that token alone. The last sequence of a split is padded with `end`.
    Special strings inside texts are ordinary text. An empty table writes nothing and gives an empty index. A shard's file
    is written under a temporary name and renamed, so a task may run again at any time.
    """
    spark = docs.sparkSession
    out = out or scratch_path(spark, "shards")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    sizes = rows.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.octet_length(F.coalesce("t", F.lit(""))) + 1).alias("n")).agg(F.max("p"), F.sum("n")).collect()[0]
    if sizes[0] is None:
        return spark.createDataFrame([], f"slot long, shard int, offset long, n_tokens int, n_docs int, doc_ids array<{docs.schema[id_col].dataType.simpleString()}>, path string")
    # room for any division of the rows into splits: none holds more than everything (a token is a byte or more)
    most = int(sizes[1]) // length + 1
    splits = max(SPLITS, 4 * (int(sizes[0]) + 1))
    domain = splits * most
    shards = max(1, int(sizes[1] * 0.8) // SHARD_BYTES)  # about 2.5 bytes a token, of 2 bytes
    width = -(-domain // shards)
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, press = encoder(tokenizer), zstandard.ZstdCompressor(level=1)
        split, made = TaskContext.get().partitionId(), 0
        held, ids, total, id_type = [], [], 0, None

        def cut(last: bool):
            nonlocal held, ids, total, made
            stream = np.concatenate(held)
            ends = np.cumsum([len(h) for h in held])
            full = len(stream) // length
            n = full + bool(last and len(stream) % length)
            parts, counts, owners = [], [], []
            for i in range(n):
                piece = stream[i * length : (i + 1) * length]
                a, b = np.searchsorted(ends, [i * length, i * length + len(piece) - 1], "right")
                owners.append(ids[a : b + 1])
                counts.append(len(piece))
                parts.append(press.compress(piece.tobytes()))
            if made + n > most or split >= splits:
                raise ValueError("the documents changed between two readings")
            index = split * most + made + np.arange(n)
            made += n
            place = permute(index, domain, key)
            used = n * length
            rest = int(np.searchsorted(ends, used, "right"))
            left = stream[used:]  # the tokens of documents from `rest` on that no sequence holds yet
            held = np.split(left, ends[rest:-1] - used) if len(left) else []
            ids, total = ids[rest:] if len(left) else [], len(left)
            return pa.RecordBatch.from_arrays([pa.array((place // width).astype(np.int32)), pa.array(place), pa.array(parts, pa.binary()), pa.array(np.array(counts, np.int32)), pa.array(owners, pa.list_(id_type))], names=["shard", "place", "part", "n_tokens", "doc_ids"])

        for batch in batches:
            id_type = batch.schema.field(0).type
            for lo, hi, data, offsets in blocks(batch.column(1)):
                raw, names = data.tobytes(), batch.column(0).slice(lo, hi - lo).to_pylist()
                for i in range(hi - lo):
                    got = code.encode_to_numpy(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"), disallowed_special=())
                    if len(got) and got.max() > 0xFFFF:
                        raise ValueError("token ids of 65,536 or more do not fit the records")
                    tokens = np.empty(len(got) + 1, np.uint16)
                    tokens[:-1], tokens[-1] = got, end
                    held.append(tokens)
                    ids.append(names[i])
                    total += len(tokens)
                if total > 1 << 19:
                    yield cut(False)
        if held:
            yield cut(True)

    packed = mapped(rows, pack, f"shard int, place long, part binary, n_tokens int, doc_ids array<{kind}>")
    # a partition for each range of places, without sampling: the ranges are known
    dealt = packed.repartitionById(shards, "shard").sortWithinPartitions("shard", "place")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        store, base = pafs.FileSystem.from_uri(out)
        store.create_dir(base)
        attempt = TaskContext.get().taskAttemptId()
        shard, sink, done = None, None, 0

        def close():
            if sink is not None:
                sink.close()
                store.move(f"{base}/.{shard}-{attempt}", f"{base}/shard-{shard:05d}.bin")

        for batch in batches:
            ranks, width = [], stride(length)
            for s, part, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if s != shard:
                    close()
                    shard, done = s, 0
                    sink = store.open_output_stream(f"{base}/.{shard}-{attempt}", buffer_size=1 << 20)
                raw = press.decompress(part, max_output_size=2 * length)
                sink.write(np.uint32(n).tobytes() + raw + np.full(length - n, end, np.uint16).tobytes())
                ranks.append(done)
                done += 1
            at = np.array(ranks, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at), pa.array(at * width), batch.column(3), batch.column(4)], names=["shard", "rank", "offset", "n_tokens", "doc_ids"])
        close()

    index = written(mapped(dealt, write, f"shard int, rank long, offset long, n_tokens int, doc_ids array<{kind}>"), "index")
    counts = index.groupBy("shard").agg(F.count("*").alias("n"))  # a row for each shard
    first = counts.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    path = F.concat(F.lit(out + "/shard-"), F.lpad(F.col("shard").cast("string"), 5, "0"), F.lit(".bin"))
    return index.join(F.broadcast(first), "shard").select((F.col("first") + F.col("rank")).alias("slot"), "shard", "offset", "n_tokens", F.size("doc_ids").alias("n_docs"), "doc_ids", path.alias("path"))


def read_sequences(spark: SparkSession, index: DataFrame, start: int, stop: int, length: int = LENGTH) -> Iterator[np.ndarray]:
    """Token ids of the slots start to stop - 1, read in order from the shards: sequentially, and from any slot."""
    for r in index.where((F.col("slot") >= start) & (F.col("slot") < stop)).orderBy("slot").select("path", "offset").toLocalIterator():
        store, path = pafs.FileSystem.from_uri(r["path"])
        with store.open_input_file(path) as f:
            f.seek(r["offset"])
            raw = f.read(stride(length))
        n = int(np.frombuffer(raw, np.uint32, 1)[0])
        yield np.frombuffer(raw, np.uint16, n, HEADER)
