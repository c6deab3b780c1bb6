"""Exact top-k inner-product search by columnar branch-and-bound.

Candidates are laid out in blocks column by column (dimension-major). For a query, scores are accumulated one group of
dimensions at a time over a whole block; after each group the part still missing lies within plus or minus the product of
the remaining norms (Cauchy-Schwarz). Candidates whose upper bound is below the k-th best lower bound can't be among the
best k and are compacted away, so later columns are read for the survivors only.

The query set meets all rows block by block: every block of queries goes to every block of candidates by an equi-join on
the block's number, each task keeps k hits a query, and a window keeps the best k of those.

Defined results: vectors that are null or hold null or non-finite components and rows with a null id take no part;
shorter vectors count as padded with zeros, empty ones as zeros; rows with the query's own id are not its candidates; rows
of one id are otherwise queries and candidates each, ties go to the smaller id; with fewer than k candidates all are
returned; an empty table gives an empty result; columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stash

_BLOCK = "block long, n int, dims int, ids binary, data binary"


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows (id, v array<long>) as blocks; data is the vertical layout, dims x n doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        ids: list[int] = []
        vectors: list[list[int]] = []

        def close() -> pa.RecordBatch:
            dims = max(1, *map(len, vectors))
            m = np.zeros((len(vectors), dims))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            cols = [[base + made], [len(ids)], [dims], [np.array(ids, "<i8").tobytes()], [np.ascontiguousarray(m.T).astype("<f8").tobytes()]]
            types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["block", "n", "dims", "ids", "data"])

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == size:
                    yield close()
                    made, ids, vectors = made + 1, [], []
        if ids:
            yield close()

    return rows.mapInArrow(run, _BLOCK)


def rest_norms(columns: np.ndarray, group: int) -> np.ndarray:
    """Norms of what is left of each column after each group of rows (dimensions)."""
    squares = np.add.reduceat(columns * columns, np.arange(0, len(columns), group), axis=0)
    after = np.cumsum(squares[::-1], axis=0)[::-1]
    return np.sqrt(np.vstack([after[1:], np.zeros((1, columns.shape[1]))]))


def branch_and_bound(query: np.ndarray, columns: np.ndarray, rest: np.ndarray, ids: np.ndarray, own: int, k: int, group: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the best k columns (ties: smaller id) for one query."""
    alive = np.flatnonzero(ids != own)
    part = np.zeros(len(alive))
    missing = rest_norms(query[:, None], group)[:, 0]
    for g, at in enumerate(range(0, len(query), group)):
        block = columns[at : at + group]
        part = part + query[at : at + group] @ (block if len(alive) == columns.shape[1] else block[:, alive])
        slack = missing[g] * rest[g][alive]
        if len(alive) > k:
            least = np.partition(part - slack, len(alive) - k)[len(alive) - k]
            keep = part + slack >= least - 1e-6
            alive, part = alive[keep], part[keep]
    best = np.lexsort((ids[alive], -part))[:k]
    return ids[alive[best]], np.rint(part[best]).astype(np.int64)


def quantised(vector: str, scale: float) -> Column:
    """array<long> of floor(scale * component), or null where a component is null or not finite."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def top_k(
    rows: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, block_rows: int = 16_384, query_rows: int = 2_048, group: int = 16, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; is_query is a condition on the column ``vec_id``."""
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    candidates = stash(_blocks(own, block_rows), "search-candidates")
    queries = stash(_blocks(own.filter(is_query), query_rows), "search-queries")
    # candidate blocks get the numbers 0 to n - 1; one short row a block meets in one place
    order = candidates.select("block", (F.row_number().over(Window.orderBy("block")) - 1).alias("no"))
    count = F.broadcast(order.agg(F.count("*").alias("n")))
    candidates = candidates.join(F.broadcast(order), "block").drop("block")
    pairs = queries.select("block").crossJoin(count).filter("n > 0").select("block", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("no"))
    dealt = pairs.join(queries.select("block", F.col("ids").alias("q_ids"), F.col("dims").alias("q_dims"), F.col("data").alias("q_data")), "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_block, q_ids, q_dims, q_data, ids, dims, data in zip(*[c.to_pylist() for c in batch.columns]):
                q_ids, ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(ids, "<i8")
                most = max(q_dims, dims)
                queries, columns = np.zeros((most, len(q_ids))), np.zeros((most, len(ids)))
                queries[:q_dims] = np.frombuffer(q_data, "<f8").reshape(q_dims, -1)
                columns[:dims] = np.frombuffer(data, "<f8").reshape(dims, -1)
                rest = rest_norms(columns, group)
                found = [branch_and_bound(q, columns, rest, ids, own, k, group) for q, own in zip(np.ascontiguousarray(queries.T), q_ids)]
                hits = [len(i) for i, _ in found]
                columns = [np.repeat(np.full(len(q_ids), q_block), hits), np.repeat(np.arange(len(q_ids)), hits), np.repeat(q_ids, hits), np.concatenate([i for i, _ in found]), np.concatenate([s for _, s in found])]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_block", "q_row", "query_id", "vec_id", "score"])

    met = dealt.join(candidates, "no").select(F.col("block").alias("q_block"), "q_ids", "q_dims", "q_data", "ids", "dims", "data")
    hits = met.mapInArrow(run, "q_block long, q_row long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("q_block", "q_row").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
