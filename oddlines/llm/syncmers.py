"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text's symbols end at white space and after every character that is not one of ``_INNER`` (ASCII letters but e, digits
but 0 and 5): about four characters of a Latin text, one of other scripts. Where a symbol ends depends on its own
characters alone, so that passages in scripts without spaces, in code or in encoded runs have equal symbols wherever they
stand. Of the k-mers (three symbols), the closed syncmers are kept: those whose minimal inner substring (one symbol, by
hash) stands first or last. Whether a k-mer is kept depends on itself alone too, so equal passages give equal anchors. The
fingerprint has all anchor hashes (32 bits), or the ``anchors`` smallest where that is given, with the position of each
one's first occurrence.

``likeness`` of two fingerprints is positional: among the hashes of both together, the share that both have at one
displacement (within ``drift`` symbols of the median displacement).

Defined results: a null text is an empty one; a text without a symbol has the empty fingerprint, a text too short for a
closed syncmer has one anchor, its whole; two equal fingerprints have likeness 1, an empty and another one 0; repeated
rows are fingerprinted each; texts of any length are fingerprinted whole; a null doc_id is the smallest id; empty tables
give empty results; columns of other names are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import let, text_of

#: Characters that end no symbol. Single letters, since Java looks them up in a table, which it doesn't do with ranges.
_INNER = "abcdfghijklmnopqrstuvwxyzABCDFGHIJKLMNOPQRSTUVWXYZ12346789"
_SPACE = r" \t\n\x0B\f\r"
SYMBOL = f"[{_INNER}]++[^{_INNER}{_SPACE}]?+|[^{_INNER}{_SPACE}]"
_POS_BITS = 31
_NULL_ID = -(2**63)
_LOW = (1 << _POS_BITS) - 1


def fingerprint(text: Column, anchors: int | None = None) -> Column:
    """array<long>: hash (32 bits) times 2**31 plus position, by hash, one for each hash."""

    def keyed(h: Column, at: Column) -> Column:
        return F.shiftleft(h.bitwiseAND(F.lit((1 << 32) - 1)), _POS_BITS).bitwiseOR(at.cast("long"))

    def closed(t: Column) -> Column:
        def one(i: Column) -> Column:
            a, b, c = (F.get(t, i + j) for j in range(3))
            return F.when((b >= a) | (b >= c), keyed(F.xxhash64(a, b, c), i))

        return F.when(F.size(t) >= 3, F.array_compact(F.transform(F.sequence(F.lit(0), F.size(t) - 3), one))).otherwise(F.array().cast("array<bigint>"))

    def of_symbols(symbols: Column) -> Column:
        whole = F.when(F.size(symbols) > 0, F.array(keyed(F.xxhash64(F.array_join(symbols, " ")), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
        return let(let(F.transform(symbols, lambda x: F.xxhash64(x)), closed), lambda found: F.when(F.size(found) > 0, F.sort_array(found)).otherwise(whole))

    def firsts(found: Column) -> Column:
        return F.filter(found, lambda x, i: (i == 0) | (F.shiftright(x, _POS_BITS) != F.shiftright(F.get(found, i - 1), _POS_BITS)))

    found = let(let(F.regexp_extract_all(text, F.lit(SYMBOL), F.lit(0)), of_symbols), firsts)
    return found if anchors is None else F.slice(found, 1, anchors)


def shown(found: Column) -> Column:
    """A fingerprint as a string: its numbers in hexadecimal, comma-joined; the position is the lowest 31 bits of each."""
    return F.array_join(F.transform(found, lambda x: F.hex(x)), ",")


def likeness(one: Column, other: Column, anchors: int | None = None, drift: int = 64) -> Column:
    def sided(a: Column, side: int) -> Column:
        # hash (32 bits), side (1), position (31)
        return F.transform(a, lambda x: F.shiftleft(F.shiftright(x, _POS_BITS), 32).bitwiseOR(x.bitwiseAND(F.lit(_LOW))).bitwiseOR(F.lit(side << _POS_BITS)))

    def compare(line: Column) -> Column:
        # a fingerprint has a hash once, so those of both stand side by side in the line of both
        at = lambda x: x.bitwiseAND(F.lit(_LOW))
        moved = F.array_compact(F.transform(line, lambda x, i: F.when(F.shiftright(x, 32) == F.shiftright(F.get(line, i - 1), 32), at(F.get(line, i - 1)) - at(x))))
        steady = lambda d: let(F.get(F.sort_array(d), F.floor(F.size(d) / 2).cast("int")), lambda mid: F.size(F.filter(d, lambda x: F.abs(x - mid) <= drift)))
        return let(moved, lambda d: F.coalesce(steady(d), F.lit(0)).cast("double") / (F.size(line) - F.size(d)))

    def smallest(a: Column, top: Column) -> Column:
        return F.filter(a, lambda x: F.shiftright(x, _POS_BITS) <= top)

    def both(a: Column, b: Column) -> Column:
        return let(F.sort_array(F.concat(sided(a, 0), sided(b, 1))), compare)

    if anchors is None:
        found = both(one, other)
    else:  # of the anchors' smallest hashes of both together
        hashes = F.array_union(*[F.transform(a, lambda x: F.shiftright(x, _POS_BITS)) for a in (one, other)])
        found = let(F.coalesce(F.get(F.sort_array(hashes), F.lit(anchors - 1)), F.lit(1 << 32)), lambda top: both(smallest(one, top), smallest(other, top)))
    return F.when(one == other, F.lit(1.0)).when((F.size(one) == 0) | (F.size(other) == 0), F.lit(0.0)).otherwise(found)


def _bucket(key: Column, bounds: list[int], base: int = 0) -> Column:
    """How many of the sorted bounds are below key, by halving."""
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(key <= F.lit(bounds[mid]), _bucket(key, bounds[:mid], base)).otherwise(_bucket(key, bounds[mid + 1 :], base + mid + 1))


def beside_next(rows: DataFrame, carried: Column) -> DataFrame:
    """rows (k, text) with ``carried`` (an expression over them) as own and, as next, the next smaller k's; the smallest
    k's next is the largest. Of rows of one k, the one with the smallest hash of its text is what others see.

    Rows are dealt by ranges of k and sorted there; a range's first rows see a copy of what ends the range before."""
    spark = rows.sparkSession
    n_parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("k", F.array(*[F.lit(i / n_parts) for i in range(1, n_parts)]), F.lit(10_000))).first()[0]
    rows = rows.withColumns({"part": _bucket(F.col("k"), sorted(set(cuts or []))), "h": F.xxhash64("text")})
    # one row a range
    highs = sorted(map(tuple, rows.groupBy("part").agg(F.max("k")).collect()))
    before = [(highs[i - 1][1], part) for i, (part, _) in enumerate(highs)]
    sent = rows.select("k", "h", "text").join(F.broadcast(spark.createDataFrame(before, "k long, part int")), "k")
    sent = sent.groupBy("k", "part").agg(F.min(F.struct("h", "text")).alias("x")).select("k", "part", "x.h", "x.text", F.lit(True).alias("sent"))
    order = [F.desc("sent"), F.asc("k"), F.desc("h"), F.asc("text")]
    line = rows.withColumn("sent", F.lit(False)).unionByName(sent).repartition("part").sortWithinPartitions("part", *order).withColumn("own", carried)
    w = Window.partitionBy("part").orderBy(*order)
    shown = F.col("sent") | ~F.col("k").eqNullSafe(F.lead("k").over(w))
    line = line.withColumn("shown", F.when(shown, F.struct("text", "own")))
    line = line.withColumn("next", F.last("shown", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return line.filter(~F.col("sent")).select("k", "text", "own", "next")


def compare_with_edits(docs: DataFrame, anchors: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, prints and edited_prints (fingerprint arrays), near_edited, near_next.

    A document's edited text has its last third (rounded down) replaced by as many first characters, or all, of the
    next document's by descending id; after the last id comes the first. Of rows with one id, the next document's text
    is that with the smallest hash; null ids come last.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL_ID)).alias("k"), text_of(text_col).alias("text"))
    own = beside_next(rows, fingerprint(F.col("text"), anchors)).withColumn("n", F.length("text").cast("long")).withColumn("cut", F.floor(F.col("n") / 3).cast("int"))
    kept = F.substr(F.col("text"), F.lit(1), (F.col("n") - F.col("cut")).cast("int"))
    own = own.withColumn("edited", F.concat(kept, F.substr(F.col("next.text"), F.lit(1), F.col("cut")))).withColumn("edited_prints", fingerprint(F.col("edited"), anchors))
    return own.select(
        F.nullif("k", F.lit(_NULL_ID)).alias("doc_id"), F.col("n").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.col("own").alias("prints"), "edited_prints",
        likeness(F.col("own"), F.col("edited_prints"), anchors).alias("near_edited"),
        likeness(F.col("own"), F.col("next.own"), anchors).alias("near_next"),
    )
