"""Removal of repeated passages with suffix arrays: bytes covered by a string of ``LENGTH`` bytes that starts earlier too.

0. Equal documents are folded: all but the first are repeats as a whole and go no further.
1. In every stretch of ``LENGTH`` bytes the least hash of its ``GRAM``-byte strings is the stretch's anchor (the leftmost of
   equals), so that equal stretches have equal anchors. Neighbouring stretches of one anchor are a context. Contexts whose
   anchor occurs nowhere else can't repeat and go no further: only counts of hashes are shuffled for that.
2. The bytes of the other contexts meet by their anchors, in blocks of at most about ``BLOCK_BYTES``. Equal contexts are
   folded: all but the earliest repeat in full, and need no room. A suffix array of the rest is built in two stages: suffixes smaller than
   their successors are sorted directly, the others are induced by scans of the buckets in ascending order. Neighbours with
   ``LENGTH`` common bytes are equal stretches; all but the earliest of each run repeat.
3. An anchor of more than ``HOT`` contexts is dealt over several places by document. What is no repeat at its own place goes
   on stretch by stretch to a second round, where a stretch has one row a place at most.

Repeats are judged on the texts as given. Every comparison is made on bytes; hashes only decide which bytes meet.

Defined results: a null text is empty and has no repeats, like texts shorter than ``LENGTH``; documents are in ascending
order of ids, null first, rows that repeat an id in the order of their files; texts of any length are read in pieces that
overlap by a stretch; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, hot_join, numbered, small_batches, stash, tidy_shuffles

LENGTH = 100
GRAM = 24
#: Bytes of contexts that are sorted at once.
BLOCK_BYTES = 1 << 18
#: Contexts of one anchor that go to one place.
HOT = 4096
#: Bytes of texts that are looked at at once, few enough for a processor's cache; below 2 ** 24, which an anchor's place has to fit.
PIECE = 1 << 17
_PLACE = np.uint64((1 << 24) - 1)
_ANCHOR = "key long, row long, lo long, stretches long"
_CONTEXT = "key long, place long, places long, context binary, doc_id long, row long, lo long"
_MARK = "row long, lo long, hi long, doc_id long, stretch binary"


# ---- anchors


def _pieces(rows: Iterator[tuple[int, bytes]], length: int, size: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, base, bytes), some size bytes in all: texts, or parts of long ones that overlap by length - 1."""
    held: list[tuple[int, int, bytes]] = []
    total = 0
    for row, text in rows:
        for base in range(0, len(text) - length + 1, size):
            piece = text[base : base + size + length - 1]
            if held and total + len(piece) > 2 * size:
                yield held
                held, total = [], 0
            held.append((row, base, piece))
            total += len(piece)
    if held:
        yield held


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all strings of gram bytes in data, from those of powers of two."""
    part, factor, width = data.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    h, done = part, 0
    while True:
        if gram & width:
            n = len(data) - done - width + 1
            h, done = h[:n] * factor + part[done : done + n] if done else part, done + width
        if 2 * width > gram:
            break
        part = part[:-width] * factor + part[width:]
        with np.errstate(over="ignore"):
            factor = factor * factor
        width *= 2
    h = h.copy()
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(values: np.ndarray, window: int) -> np.ndarray:
    width = 1
    while 2 * width <= window:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == window else np.minimum(values[: width - window], values[window - width :])


def anchors(pieces: list[tuple[int, int, bytes]], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, piece, first stretch within it and number of stretches of each context. Pieces have length bytes at least."""
    data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    sizes = np.array([len(p) for _, _, p in pieces])
    hashes = gram_hashes(data, gram)
    least = sliding_min((hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    ends = np.cumsum(sizes)
    valid = np.ones(len(least) + length - 1, bool)
    for end in ends[:-1]:  # stretches over the end of a piece are none
        valid[end - length + 1 : end] = False
    starts = np.flatnonzero(valid[: len(least)])
    at = (least[starts] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    piece = np.searchsorted(ends, starts[first], "right")
    return hashes[at[first]].view(np.int64), piece, starts[first] - (ends - sizes)[piece], np.diff(np.append(first, len(starts)))


def find_anchors(docs: DataFrame, length: int, gram: int, piece: int) -> DataFrame:
    """docs (row, data) as their contexts: key, row, lo (first stretch), stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((row, data.as_buffer().to_pybytes()) for b in batches for row, data in zip(b.column(0).to_pylist(), b.column(1)))
        for pieces in _pieces(rows, length, piece):
            key, place, lo, stretches = anchors(pieces, length, gram)
            row, base = np.array([r for r, _, _ in pieces]), np.array([b for _, b, _ in pieces])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, row[place], lo + base[place], stretches)], names=["key", "row", "lo", "stretches"])

    return docs.select("row", "data").mapInArrow(run, _ANCHOR)


# ---- suffix arrays


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of text (bytes, 0 ends each of its strings) in the order of the suffixes' first depth bytes, at least."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=np.int16(256)))
    unlike = np.where(step != 0, np.arange(n), n - 1)
    smaller = step[np.minimum.accumulate(unlike[::-1])[::-1]] > 0  # than its successor; of equal bytes, as the next unlike one tells
    smaller[text == 0] = True
    direct = np.flatnonzero(smaller & (text > 0))
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    keys = np.lib.stride_tricks.sliding_window_view(padded, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(keys).view(f"S{depth}").ravel(), kind="stable")]
    bounds = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def induce(bucket: np.ndarray, byte: int) -> None:
        before = bucket[bucket > 0] - 1
        before = before[~smaller[before] & (text[before] > byte)]
        order = np.argsort(text[before], kind="stable")
        before = before[order]
        for part in np.split(before, np.flatnonzero(np.diff(text[before])) + 1) if len(before) else ():
            waiting[text[part[0]]].append(part)

    for byte in range(256):
        parts = waiting[byte]
        last = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        while len(last):  # runs of one byte: what comes before, in the same bucket
            last = last[last > 0] - 1
            last = last[(text[last] == byte) & ~smaller[last]]
            parts.append(last)
        own = np.flatnonzero(text == 0) if byte == 0 else direct[bounds[byte] : bounds[byte + 1]]
        bucket = np.concatenate([*parts, own])
        out.append(bucket)
        if len(bucket):
            induce(bucket, byte)
    return np.concatenate(out)


def common(text: np.ndarray, left: np.ndarray, right: np.ndarray, depth: int) -> np.ndarray:
    """Whether the suffixes at left and right (each of depth bytes at least) have depth bytes in common."""
    words = np.ndarray(len(text) - 7, "<u8", np.ascontiguousarray(text).data, strides=(1,))
    alive = np.arange(len(left))
    for at in [*range(0, depth - 7, 8), depth - 8]:
        alive = alive[words[left[alive] + at] == words[right[alive] + at]]
    out = np.zeros(len(left), bool)
    out[alive] = True
    return out


def later_stretches(contexts: list[bytes], order: np.ndarray, los: np.ndarray, length: int) -> list[np.ndarray]:
    """By context, the stretches (counted from its start) that an earlier one equals. order: ranks of the documents; los:
    the contexts' first stretches in them."""
    text = np.frombuffer(b"\0".join([*(c.translate(_UP) for c in contexts), b""]) + b"\0" * 8, np.uint8)[:-8]
    sizes = np.array([len(c) + 1 for c in contexts])
    bounds = np.cumsum(sizes) - sizes
    sa = suffix_array(text, length)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(text)) - bounds[owner]
    sa = sa[offset[sa] <= (sizes - 1 - length)[owner[sa]]]
    if not len(sa):
        return [np.zeros(0, np.int64) for _ in contexts]
    same = common(text, sa[:-1], sa[1:], length)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    when = order[owner[sa]] << 40 | (los[owner[sa]] + offset[sa])
    later = sa[when > np.repeat(np.minimum.reduceat(when, first), np.diff(np.append(first, len(sa))))]
    later.sort()
    return np.split(offset[later], np.searchsorted(owner[later], np.arange(1, len(contexts))))


#: Bytes of UTF-8 end at 0xF4; moved up by one they leave 0 to end a context.
_UP = bytes(min(b + 1, 255) for b in range(256))


def _runs(stretches: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive numbers."""
    if not len(stretches):
        return []
    cut = np.flatnonzero(np.diff(stretches) > 1)
    return list(zip(stretches[np.append(0, cut + 1)].tolist(), stretches[np.append(cut, len(stretches) - 1)].tolist()))


def sort_block(rows: list[tuple], length: int) -> Iterator[tuple[int, int, int, int | None, bytes | None]]:
    """Marks (row, first and last stretch) of a block of unlike _CONTEXT rows, all of their anchors; of anchors with several
    places also the stretches that are no repeats here."""
    docs = {d: i for i, d in enumerate(sorted({(r[4] is not None, r[4] or 0, r[5]) for r in rows}))}
    order = np.array([docs[r[4] is not None, r[4] or 0, r[5]] for r in rows], np.int64)
    found = later_stretches([r[3] for r in rows], order, np.array([r[6] for r in rows], np.int64), length)
    for (_, _, places, context, doc, row, lo), later in zip(rows, found):
        for first, last in _runs(later):
            yield row, lo + first, lo + last, None, None
        if places > 1:
            for i in np.setdiff1d(np.arange(len(context) - length + 1), later).tolist():
                yield row, lo + i, lo + i, doc, context[i : i + length]


def sort_contexts(contexts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    names = [c.split()[0] for c in _MARK.split(", ")]
    types = [*[pa.int64()] * 4, pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def close() -> pa.RecordBatch:
            made = list(sort_block(held, length))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 5, types)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            n, context = batch.num_rows, batch.column("context")
            key, place = (batch.column(c).to_numpy() for c in ("key", "place"))
            new = np.ones(n, bool)
            new[0] = last != (key[0], place[0], context[0].as_py())
            new[1:] = (key[1:] != key[:-1]) | (place[1:] != place[:-1]) | pc.not_equal(context.slice(1), context.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            last = (key[-1], place[-1], context[n - 1].as_py())
            # rows are in order of documents: what equals the context before it repeats in full
            copies = batch.filter(pa.array(~new))
            if copies.num_rows:
                ends = pc.add(copies.column("lo"), pc.subtract(pc.cast(pc.binary_length(copies.column("context")), pa.int64()), length))
                yield pa.RecordBatch.from_arrays([copies.column("row"), copies.column("lo"), ends, *[pa.nulls(copies.num_rows, t) for t in types[3:]]], names=names)
            for row in zip(*[c.to_pylist() for c in batch.filter(pa.array(new)).columns]):
                if held and row[:2] != held[-1][:2] and size >= block_bytes:
                    yield close()
                    held, size = [], 0
                size += len(row[3])
                held.append(row)
        if held:
            yield close()

    rows = contexts.repartition("key", "place").sortWithinPartitions("key", "place", "context", "doc_id", "row", "lo")
    return rows.mapInArrow(run, _MARK)


# ---- documents


def _packed(docs: DataFrame) -> DataFrame:
    """docs (row, doc_id, data) with data compressed, for joins by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(x.as_buffer()) for x in b.column(2)], pa.binary())], names=["row", "doc_id", "packed"])

    return docs.select("row", "doc_id", "data").mapInArrow(run, "row long, doc_id long, packed binary")


def _opened(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    opener = zstandard.ZstdDecompressor()
    return (opener.decompress(x.as_buffer()) if x.is_valid else b"" for x in batch.column(column))


def _copies(docs: DataFrame, length: int) -> DataFrame:
    """row, lo, hi of documents that equal an earlier one: all of their stretches."""
    same = stash(docs.select("row", "doc_id", F.octet_length("data").cast("long").alias("size"), F.unhex(F.sha2("data", 256)).alias("digest")), "repeats-digests")
    firsts = same.groupBy("digest").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("first.row").alias("first"))
    found = hot_join(same.select("row", "size", "digest"), firsts, "digest", "row").filter("row != first")
    found = stash(found.select("row", F.lit(0).cast("long").alias("lo"), (F.col("size") - length).alias("hi")), "repeats-copies")
    discard(same)
    return found


def _met(found: DataFrame, repeated: DataFrame, hot: int) -> DataFrame:
    """found with the counts of repeated anchors. An anchor with over a 10,000th of the rows (so 10,000 anchors at most) is
    dealt over several places."""
    heavy = max(hot, (repeated.agg(F.sum("n")).first()[0] or 0) // 10_000)
    places = F.ceil(F.col("n") / heavy).cast("int")
    dealt = F.broadcast(repeated.filter(F.col("n") > heavy).select("key", places.alias("places")))
    left = found.join(dealt, "key", "left").withColumn("place", F.pmod(F.xxhash64("row"), F.coalesce("places", F.lit(1))).cast("int")).drop("places")
    return left.join(repeated.withColumn("place", F.explode(F.sequence(F.lit(0), places - 1))), ["key", "place"])


def repeated_stretches(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """row, lo, hi: runs of stretches (length bytes from lo on, to those from hi on) that occur earlier. docs: row, doc_id,
    data. What a step has written goes once the next one is written."""
    long = docs.filter(F.octet_length("data") >= length)
    copies = _copies(long, length)
    found = find_anchors(long, length, gram, piece)
    repeated = stash(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeats-anchors")
    lists = F.collect_list(F.struct("key", "n", "lo", "stretches")).alias("contexts")
    live = stash(_met(found, repeated, hot).groupBy("row").agg(lists).join(copies.select("row"), "row", "left_anti"), "repeats-live")
    discard(repeated)
    names = [c.split()[0] for c in _CONTEXT.split(", ")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            lists = batch.column("contexts")
            flat = lists.flatten()
            key, n, lo, stretches = (flat.field(c).to_numpy() for c in ("key", "n", "lo", "stretches"))
            of = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy())
            row, doc = (batch.column(c).take(pa.array(of)) for c in ("row", "doc_id"))
            places = -(-n // hot)
            place = ((row.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)).astype(np.int64) % places
            texts = list(_opened(batch, "packed"))
            cuts = [texts[i][a:b] for i, a, b in zip(of.tolist(), lo.tolist(), (lo + stretches + (length - 1)).tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(place), pa.array(places), pa.array(cuts, pa.binary()), doc, row, pa.array(lo)], names=names)

    contexts = _packed(long).join(live, "row").mapInArrow(cut, _CONTEXT)
    marks = stash(sort_contexts(contexts, length, block_bytes), "repeats-marks")
    discard(live)
    spread = marks.filter("stretch IS NOT NULL")
    earlier = F.row_number().over(Window.partitionBy("stretch").orderBy("doc_id", "row", "lo"))
    second = spread.withColumn("nth", earlier).filter("nth > 1").select("row", "lo", "hi")
    return marks.filter("stretch IS NULL").select("row", "lo", "hi").unionByName(second).unionByName(copies)


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT, block_bytes: int = BLOCK_BYTES, piece: int = PIECE, id_col: str = "doc_id", text_col: str = "text", texts: bool = False) -> DataFrame:
    """One row per document: its bytes, how many are removed in how many runs, and the digest of what is kept (with texts,
    also the kept bytes)."""
    with tidy_shuffles(docs.sparkSession):
        rows = numbered(docs, "repeats-rows", "row", (id_col, text_col))
        rows = rows.select("row", F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"))
        found = repeated_stretches(rows, length, gram, hot, block_bytes, piece)
    marks = found.groupBy("row").agg(F.collect_list(F.struct("lo", "hi")).alias("marks"))

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * texts]
    types = [*[pa.int64()] * 4, pa.string(), *[pa.binary()] * texts]

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 64):
            made = []
            for doc, data, found in zip(batch["doc_id"].to_pylist(), _opened(batch, "packed"), batch["marks"].to_pylist()):
                edges: list[list[int]] = []
                for lo, hi in sorted((m["lo"], m["hi"] + length) for m in found or ()):
                    if edges and lo <= edges[-1][1]:
                        edges[-1][1] = max(hi, edges[-1][1])
                    else:
                        edges.append([lo, hi])
                left = b"".join(data[a:b] for a, b in zip([0, *(hi for _, hi in edges)], [*(lo for lo, _ in edges), len(data)]))
                made.append((doc, len(data), len(data) - len(left), len(edges), hashlib.sha256(left).hexdigest(), *([left] if texts else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], names=names)

    met = _packed(rows).join(marks, "row", "left").select("doc_id", "packed", "marks")
    return met.mapInArrow(keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * texts)
