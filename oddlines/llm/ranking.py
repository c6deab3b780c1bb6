"""Ranked lexical search over hashed max-sketches, exact.

A document's impact of a term, ``(10^9 tf) div (1000 tf + 20 m)``, hangs on the document alone; a query's score is the sum
of its terms' weights times impacts. ``build_index`` folds the impacts of all terms of a document into two rows of
coordinatewise maxima: coordinate h of a row is the greatest impact of the terms hashed to h, rounded up to a byte. A row
has twice as many coordinates as the document has distinct terms, up to a power of two.

``search`` looks a batch of queries up in a block of sketches at once: a term's impact is at most the lesser of its two
coordinates, so the weighted sums are upper bounds. In descending order of bounds documents are scored exactly from their
own terms, until the bound falls below the k-th best score so far. Each task goes on with the scores it has along all its
blocks, and starts from those of a sample of the index, so that it gives out little. Queries are taken in blocks of at most
``BLOCK_TERMS`` terms (one query, if it alone has more), which is all that the driver and a task hold of them.

Defined results: a null or termless text is no document, a null or termless item has no rows; every row of items is a query
of its own, repeated ids included; equal scores go by ascending doc_id, null first; rows that repeat a doc_id are documents
each; texts of any length are indexed whole; an empty table on either side gives an empty result; columns of other names
are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from .shared import small_batches, stash

#: A term is a maximal run of ASCII letters and digits and of characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: By byte of UTF-8: letters A-Z in lower case, other bytes of terms as they are, all else a space.
_FOLD = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))
#: Impacts lie below 10^6 and are kept as bytes, rounded up to multiples of this.
UNIT = 4096
BLOCK_TERMS = 1 << 18
#: One document in so many is searched first, for scores to start from.
SAMPLE = 64
_ROWS = 256
_CELLS = 1 << 22
_NULL_ID = -(2**63)
_INDEX = "doc_id long, m long, terms string, tfs binary, level int, sketch binary"


def coordinates(hashes: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of 32-bit term hashes in the two rows of a sketch of 2 ** level coordinates."""
    x = hashes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    y = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    down = np.uint64(64 - level)
    return (x >> down).astype(np.int64), (y >> down).astype(np.int64)


def impacts(tfs: np.ndarray, m: int | np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tfs) // (1000 * tfs + 20 * m)


def fold(hashes: np.ndarray, values: np.ndarray) -> tuple[int, np.ndarray]:
    """The level and the 2 x 2 ** level maxima (bytes) of a document's term hashes and impacts."""
    level = max(0, len(hashes) - 1).bit_length() + 1
    sketch = np.zeros((2, 1 << level), np.uint8)
    for row, at in zip(sketch, coordinates(hashes, level)):
        np.maximum.at(row, at, (-(-values // UNIT)).astype(np.uint8))
    return level, sketch


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """One row per document with terms: its sketch, its terms and their counts; the number of such documents, and that of
    their terms."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = F.regexp_count("text", F.lit(TERM)).cast("long")
    n_docs, n_terms = rows.select(n.alias("n")).filter("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, _ROWS):
            made = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = (text.as_py() or b"").translate(_FOLD).split()
                if not found:
                    continue
                tf = Counter(found)
                counts = np.fromiter(tf.values(), np.int64, len(tf))
                m = 50 + (50 * len(found) * n_docs) // n_terms
                level, sketch = fold(np.fromiter(map(crc32, tf), np.uint32, len(tf)), impacts(counts, m))
                made.append((doc, m, b" ".join(tf), counts.astype("<u4").tobytes(), level, sketch.tobytes()))
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*made) if made else [[]] * 6, types)]
            columns[2] = columns[2].cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "m", "terms", "tfs", "level", "sketch"])

    return stash(rows.mapInArrow(run, _INDEX), "ranking-index"), n_docs, n_terms


class Queries:
    """A block of queries: per query the terms and weights, and all of them in one line for batched lookups."""

    def __init__(self, queries: list[tuple[int, dict[bytes, int]]]):
        self.ids = np.array([q for q, _ in queries], np.int64)
        self.terms = [terms for _, terms in queries]
        self.starts = np.cumsum([0, *map(len, self.terms)])[:-1]
        self.weights = np.array([w for terms in self.terms for w in terms.values()], np.int64)
        self.hashes = np.array([crc32(t) for terms in self.terms for t in terms], np.uint32)

    def bounds(self, sketches: np.ndarray, level: int) -> np.ndarray:
        """Upper bounds, documents x queries, from sketches (documents x 2 x 2 ** level)."""
        first, second = coordinates(self.hashes, level)
        out = np.empty((len(sketches), len(self.ids)), np.int64)
        step = max(1, _CELLS // len(sketches))
        at = 0
        while at < len(self.ids):  # some queries at a time, so that the lookups of a block stay small
            to = max(at + 1, int(np.searchsorted(self.starts, self.starts[at] + step, "right")) - 1) if self.starts[-1] > self.starts[at] + step else len(self.ids)
            cut = slice(self.starts[at], self.starts[to] if to < len(self.ids) else len(self.hashes))
            most = np.minimum(sketches[:, 0, first[cut]], sketches[:, 1, second[cut]])
            out[:, at:to] = np.add.reduceat(most * self.weights[cut], self.starts[at:to] - self.starts[at], axis=1)
            at = to
        return out * UNIT


class Best:
    """The k best documents of each query of a block, over all blocks of sketches that are offered."""

    def __init__(self, queries: Queries, k: int, least: np.ndarray):
        self.queries, self.k = queries, k
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in queries.ids]
        #: Scores below these can't be among the k best; 0 is no hit.
        self.least = np.maximum(least, 1)
        self.scored = 0

    def offer(self, docs: list[int | None], ms: list[int], terms: list[str], tfs: list[bytes], levels: np.ndarray, sketches: list[bytes]) -> None:
        tables: dict[int, dict[bytes, int]] = {}
        for level in np.unique(levels):
            rows = np.flatnonzero(levels == level)
            held = np.frombuffer(b"".join(sketches[i] for i in rows), np.uint8).reshape(len(rows), 2, 1 << level)
            bounds = self.queries.bounds(held, int(level))
            for q in np.flatnonzero((bounds >= self.least).any(axis=0)):
                heap, weights = self.heaps[q], self.queries.terms[q]
                for i in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[i, q] < self.least[q]:
                        break
                    row = int(rows[i])
                    if row not in tables:
                        tables[row] = dict(zip(terms[row].encode().split(b" "), np.frombuffer(tfs[row], "<u4").tolist()))
                    table, m = tables[row], ms[row]
                    score = sum(w * ((1_000_000_000 * table[t]) // (1000 * table[t] + 20 * m)) for t, w in weights.items() if t in table)
                    self.scored += 1
                    hit = (score, -(_NULL_ID if docs[row] is None else docs[row]))
                    if score < self.least[q]:
                        continue
                    if len(heap) < self.k:
                        heapq.heappush(heap, hit)
                    else:
                        heapq.heappushpop(heap, hit)
                    if len(heap) == self.k:
                        self.least[q] = max(self.least[q], heap[0][0])

    def rows(self) -> pa.RecordBatch:
        found = [(q, score, None if -doc == _NULL_ID else -doc) for q, heap in zip(self.queries.ids.tolist(), self.heaps) for score, doc in heap]
        columns = zip(*found) if found else [[], [], []]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q", "score", "doc_id"])


def _hits(index: DataFrame, queries: Queries, k: int, least: np.ndarray) -> DataFrame:
    """q, rank, doc_id and score of the k best documents of each query in index, but for those below least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(queries, k, least)
        for batch in small_batches(batches, _ROWS):
            docs, ms, terms, tfs, levels, sketches = (c.to_pylist() for c in batch.columns)
            best.offer(docs, ms, terms, tfs, np.array(levels), sketches)
        yield best.rows()

    hits = index.select("doc_id", "m", "terms", "tfs", "level", "sketch").mapInArrow(run, "q long, score long, doc_id long")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "doc_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def _blocks(rows: Iterator[tuple[int, list[tuple[str, int]]]], size: int) -> Iterator[Queries]:
    held: list[tuple[int, dict[bytes, int]]] = []
    terms = 0
    for q, weights in rows:
        if held and terms + len(weights) > size:
            yield Queries(held)
            held, terms = [], 0
        held.append((q, {t.encode(): w for t, w in weights}))
        terms += len(weights)
    if held:
        yield Queries(held)


def search(index: DataFrame, n_docs: int, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """id_col, rank, doc_id, score: the k best documents of each item with a score above 0."""
    spark = index.sparkSession
    asked = stash(items.select(F.col(id_col), F.col(text_col).alias("text")).withColumn("q", F.monotonically_increasing_id()), "ranking-items")
    terms = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(TERM), F.lit(0))
    asked_terms = stash(asked.select("q", F.explode(F.array_distinct(terms)).alias("term")), "ranking-terms")
    held = index.select(F.explode(F.split("terms", " ")).alias("term"))
    df = held.join(asked_terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = asked_terms.join(df, "term").select("q", "term", weight.alias("w")).filter("w > 0")
    per_query = weighted.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("terms"))
    found = None
    sample = index.filter(F.pmod(F.xxhash64("doc_id", "terms"), F.lit(SAMPLE)) == 0)
    for queries in _blocks((tuple(r) for r in stash(per_query, "ranking-queries").toLocalIterator()), block_terms):
        none = np.zeros(len(queries.ids), np.int64)
        kth = dict(_hits(sample, queries, k, none).filter(F.col("rank") == k).select("q", "score").collect())
        hits = _hits(index, queries, k, np.array([kth.get(q, 0) for q in queries.ids.tolist()], np.int64))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], StructType([StructField(c, LongType()) for c in ("q", "score", "doc_id", "rank")]))
    return found.join(asked.select("q", id_col), "q").select(id_col, F.col("rank").cast("int").alias("rank"), "doc_id", "score")
