"""Token-ID files: fixed-width bit packing with block offsets.

Documents are range-partitioned and sorted by id; each task packs its documents' ids, every id in the minimum bits of the
vocabulary, into blocks. A block is one self-contained byte string, stored in a row of a Parquet dataset (so that any
store that Spark reaches will do, and a lost or doubled task leaves no stray file):

    "FWB1" | bits u32 | n_docs u32 | n_ids u64 | doc ids i64[n_docs] | ends u64[n_docs] | packed ids

all little-endian; ``ends`` are running counts of ids, so a document's ids are the bit range from its forerunner's end to
its own, and numpy unpacks one document or the whole block at once. Beside it stand the block's first and last doc_id
and the ids of its shard before it, by which a reader finds documents without opening other blocks.

Defined results: a null or empty text has its end id alone; repeated ids are documents of their own, by text; null ids
come first; rows that tie in id and text are one after the other; a text of any length is encoded whole, into a block of
its own if it fills one; an empty table gives an empty dataset; columns of other names are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tokens import encoder

BLOCKS = "shard int, block int, first_doc long, last_doc long, shard_start long, n_docs int, n_ids long, data binary"
_HEAD = struct.Struct("<4sIIQ")
_NULL_ID = -(2**63)


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Each id in ``bits`` bits, the first id in the lowest bits."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    spread = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(spread, bitorder="little").tobytes()


def unpack_bits(data: bytes | memoryview, bits: int, first: int, last: int) -> np.ndarray:
    """Ids first to last (exclusive) of what pack_bits made, touching their bytes only."""
    if bits in (8, 16, 32):
        width = bits // 8
        return np.frombuffer(data, dtype=f"<u{width}", count=last - first, offset=first * width).astype("<u4")
    low, high = first * bits // 8, -(-last * bits // 8)
    spread = np.unpackbits(np.frombuffer(data, np.uint8, high - low, low), bitorder="little")
    at = first * bits - low * 8
    spread = spread[at : at + (last - first) * bits].reshape(-1, bits)
    full = np.zeros((len(spread), 32), np.uint8)
    full[:, :bits] = spread
    return np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()


def make_block(doc_ids: list[int], docs: list[bytes], bits: int) -> tuple[bytes, int]:
    ids = np.frombuffer(b"".join(docs), dtype="<u4")
    ends = np.cumsum([len(d) // 4 for d in docs], dtype=np.uint64)
    head = _HEAD.pack(b"FWB1", bits, len(docs), len(ids))
    return head + np.array(doc_ids, "<i8").tobytes() + ends.astype("<u8").tobytes() + pack_bits(ids, bits), len(ids)


def open_block(data: bytes) -> tuple[np.ndarray, np.ndarray, int, memoryview]:
    """doc ids, bounds (one more than documents), bits and the packed ids of a block."""
    magic, bits, n_docs, _ = _HEAD.unpack_from(data)
    if magic != b"FWB1":
        raise ValueError("not a block of token ids")
    at = _HEAD.size
    doc_ids = np.frombuffer(data, "<i8", n_docs, at)
    bounds = np.concatenate([[0], np.frombuffer(data, "<u8", n_docs, at + 8 * n_docs)]).astype(np.int64)
    return doc_ids, bounds, bits, memoryview(data)[at + 16 * n_docs :]


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, block_ids: int = 1 << 18, id_col: str = "doc_id", text_col: str = "text") -> None:
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        bits = max(enc.vocab_size - 1, end_id).bit_length()
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, held, size = [], [], 0

        def close() -> pa.RecordBatch:
            data, n = make_block([_NULL_ID if d is None else d for d in doc_ids], held, bits)
            row = {"shard": shard, "block": block, "first_doc": doc_ids[0], "last_doc": doc_ids[-1], "shard_start": before, "n_docs": len(held), "n_ids": n, "data": data}
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = enc.encode(text.as_py()) + end
                doc_ids.append(doc)
                held.append(ids)
                size += len(ids) // 4
                if size >= block_ids:
                    yield close()
                    block, before, doc_ids, held, size = block + 1, before + size, [], [], 0
        if held:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, BLOCKS).write.option("compression", "zstd").parquet(path)


def read_ids(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned
    32-bit). ``only`` names a few documents to be read by random access."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    # one row per shard; shards are as many as the writing job's tasks
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"), F.min("first_doc").alias("low"))
    ordered = Window.orderBy(F.col("low").asc_nulls_first(), "shard")
    shards = shards.select("shard", (F.sum("n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    if only is not None:
        near = F.lit(False)
        for doc in only:
            near = near | F.lit(doc).between(F.coalesce("first_doc", F.lit(_NULL_ID)), F.col("last_doc"))
        blocks = blocks.filter(near)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, bounds, bits, packed = open_block(data.as_py())
                keep = np.arange(len(doc_ids)) if only is None else np.flatnonzero(np.isin(doc_ids, only))
                ids = [unpack_bits(packed, bits, bounds[i], bounds[i + 1]).tobytes() for i in keep]
                docs = pa.array(doc_ids[keep], pa.int64(), mask=doc_ids[keep] == _NULL_ID)
                yield pa.RecordBatch.from_arrays(
                    [docs, pa.array(base + bounds[keep], pa.int64()), pa.array(bounds[keep + 1] - bounds[keep], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"]
                )

    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("base") + F.col("shard_start")).alias("base"), "data")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
