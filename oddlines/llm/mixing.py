"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source's documents are dealt into hashed blocks of about ``docs_per_block`` documents. A source's target of words
is met by whole blocks in permuted order, pass after pass, and part of one last block. The splitting tree then divides
the exact block quotas of all sources among the output shards: at each node the left half of the shards gets a
multivariate-hypergeometric draw of the node's blocks, so that shares add up exactly. Each shard draws its quota from a
source's permuted blocks (so shards are disjoint), what a document gives is what the shards draw of its block, and each
shard is shuffled locally by a hash. Sources can be any number: their targets and blocks are sums over range partitions.

Defined results: a null text has size 0; a null source is a source of its own, after all others; documents of size 0 give
nothing, whatever their source's target; very long texts are cut at a word where a quota ends within them; an empty table
gives an empty result; repeated rows are documents of their own, those with equal keys share one order; a null doc_id is
a key like any other; columns of other names are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import WORD, running, stash, word_count

WEIGHTS = (5.0, 2.0, 1.0)
#: Sources whose quotas one task splits.
BIN = 4_096


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight; a share stops at cap times its size and the excess is shared anew until none is above."""
    target, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n > 0]
    left = total
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] >= cap * sizes[i]]
        for i in full or open_:
            target[i] = cap * sizes[i] if full else each * weights[i]
        if not full:
            break
        left -= sum(target[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return target


def split_quotas(blocks: list[int], shards: int, seed: int | list[int], columns: np.ndarray | None = None) -> np.ndarray:
    """How many blocks of each source (row) each shard (column) gets; rows add up to blocks exactly, columns to columns
    where they are given, else they are even."""
    out = np.zeros((len(blocks), shards), dtype=np.int64)
    todo = [(0, shards, np.asarray(blocks, dtype=np.int64))]
    while todo:
        lo, hi, have = todo.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        rng = np.random.default_rng([*np.atleast_1d(seed), lo, hi])
        n = int(round(have.sum() * (mid - lo) / (hi - lo))) if columns is None else int(columns[lo:mid].sum())
        left = rng.multivariate_hypergeometric(have, n, method="marginals") if have.size else have
        todo += [(lo, mid, left), (mid, hi, have - left)]
    return out


def _bounds(counts: DataFrame, shards: int, seed: int) -> DataFrame:
    """sid and bounds, the running shard quotas of each source's blocks, of counts (sid, n).

    Sources are taken in bins of ``BIN``: the driver splits the bins' totals (one row a bin), a task each bin's quotas
    among its sources; a draw that is made so in two steps has the distribution of one."""
    counts = stash(counts.withColumn("bin", F.floor(F.col("sid") / BIN).cast("long")), "mix-counts")
    bins = sorted(counts.groupBy("bin").agg(F.sum("n").alias("n")).collect())
    columns = dict(zip([r["bin"] for r in bins], split_quotas([r["n"] for r in bins], shards, seed)))

    def split(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["sid"].to_pylist(), group["n"].to_pylist()))
        number = group["bin"][0].as_py()
        quotas = split_quotas([n for _, n in rows], shards, [seed, 1 + number], columns[number])
        return pa.table({"sid": pa.array([i for i, _ in rows], pa.int64()), "bounds": pa.array(np.cumsum(quotas, axis=1).tolist(), pa.list_(pa.int64()))})

    return counts.groupBy("bin").applyInArrow(split, "sid long, bounds array<long>")


def _permuted(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def _targets(totals: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """totals (source, source_size, docs) with sid (place in the sources' order), target and quota; water-filling by
    running sums over sources in the order in which they fill up."""
    line = totals.withColumns({"is_null": F.col("source").isNull(), "one": F.lit(1).cast("long")})
    line = running(line, ["is_null", "source"], sid="one").drop("is_null", "one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int"))
    full = cap * F.col("source_size")
    line = stash(line.withColumn("weight", weight).withColumn("full", full).withColumn("ratio", full / weight), "mix-sources")
    live = running(line.filter("source_size > 0").select("sid", "weight", "full", "ratio"), ["ratio", "sid"], full_before="full", weight_before="weight")
    sums = line.filter("source_size > 0").agg(F.sum("source_size").alias("all_sizes"), F.sum("weight").alias("all_weights"))
    each = (share * F.col("all_sizes") - F.col("full_before")) / (F.col("all_weights") - F.col("weight_before"))
    level = live.crossJoin(F.broadcast(sums)).withColumn("each", each).filter("each * weight < full")  # one row beside each
    level = level.agg(F.min(F.struct("ratio", "sid", "each")).alias("l")).select(F.col("l.each").alias("each"))
    filled = F.when(F.col("source_size") > 0, F.least("full", F.coalesce(F.col("each") * F.col("weight"), "full"))).otherwise(F.lit(0.0))
    rows = line.crossJoin(F.broadcast(level)).withColumn("exact", filled)  # one row beside each
    return rows.select("source", "source_size", "docs", "sid", F.round("exact", 6).alias("target"), F.floor(F.col("exact") + 0.5).cast("long").alias("quota"))


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = 1.5,
    cap: float = 2.0,
    shards: int = 16,
    docs_per_block: int = 1024,
    seed: int = 11,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, draws array<struct<pass, shard, take>> and taken,
    the sum of their words; and the columns named in keep, which also order documents that are otherwise equal."""
    if not 0 < cap <= 2:
        raise ValueError("cap must lie in (0, 2]")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), *keep)
    own = stash(own, "mix-sizes")
    totals = own.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    about = stash(_targets(totals, weights, share, cap).withColumn("n_blocks", F.ceil(F.col("docs") / docs_per_block)).withColumnRenamed("source", "s").drop("docs"), "mix-targets")
    own = own.join(about, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = own.withColumn("key", _permuted(F.lit(seed), F.col("doc_id")))
    own = own.withColumn("block", F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / F.lit(2.0**32) * F.col("n_blocks")).cast("long"))
    # a source's blocks in permuted order, pass after pass, as far as its quota of words goes
    blocks = own.groupBy("sid", "block").agg(F.sum("size").alias("words"), F.first("quota").alias("quota")).filter("words > 0")
    line = blocks.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"turn": _permuted(F.lit(seed + 1), F.col("pass"), F.col("block")), "one": F.lit(1).cast("long")})
    line = stash(running(line, ["sid", "pass", "turn", "block"], begun="words", rank="one"), "mix-line")
    first = line.groupBy("sid").agg(F.min("begun").alias("b"), F.min("rank").alias("r"))
    line = line.join(first, "sid").select("sid", "block", "pass", (F.col("rank") - F.col("r")).alias("rank"), F.least("words", F.col("quota") - (F.col("begun") - F.col("b"))).alias("gives"))
    drawn = stash(line.filter("gives > 0"), "mix-drawn")
    # the tree's quotas hand them out: a shard takes the next so many of a source's line
    bounds = _bounds(drawn.groupBy("sid").agg(F.count("*").alias("n")), shards, seed)
    dealt = drawn.join(bounds, "sid").withColumn("shard", F.size(F.filter("bounds", lambda b: b <= F.col("rank")))).filter(F.col("shard") < shards)
    held = dealt.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard", "gives"))).alias("held"))
    within = Window.partitionBy("sid", "block").orderBy("key", "doc_id", "size", *keep).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(held, ["sid", "block"], "left")
    take = lambda h: F.greatest(F.lit(0), F.least(h["gives"] - F.col("inside"), F.col("size"))).cast("long")
    draws = F.transform(F.coalesce("held", F.array().cast("array<struct<pass:int,shard:int,gives:bigint>>")), lambda h: F.struct(h["pass"].alias("pass"), h["shard"].alias("shard"), take(h).alias("take")))
    own = own.withColumn("draws", F.filter(draws, lambda d: d["take"] > 0))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["take"])
    return own.select("doc_id", "source", "size", "source_size", "target", "draws", taken.alias("taken"), *keep)


def mixed_rows(mixed: DataFrame, seed: int = 11, keep: tuple[str, ...] = ()) -> DataFrame:
    """The draws of mix(): doc_id, size, pass, take, shard, the key that shuffles a shard locally, and keep's columns."""
    rows = mixed.select("doc_id", "size", *keep, F.explode("draws").alias("d")).select("doc_id", "size", *keep, "d.pass", "d.take", "d.shard")
    return rows.withColumn("order_key", _permuted(F.lit(seed + 2), F.col("doc_id"), F.col("pass")))


def write_shards(rows: DataFrame, path: str) -> None:
    """Writes draws as one folder per shard, each shuffled locally."""
    rows.repartition("shard").sortWithinPartitions("shard", "order_key").write.partitionBy("shard").parquet(path)


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(f"[\\x20\\x09-\\x0D]*{WORD}"), F.lit(0)), 1, n.cast("int")), "")
