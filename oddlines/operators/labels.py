"""Label mining: marker lines, enclosing spans, clean spans, negatives, balanced sets, lint messages."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.constants import MARKERS
from .ranges import ranked


def marker(raw: Column, markers: tuple[tuple[str, str], ...] = MARKERS) -> Column:
    """The name of the first marker that a line shows, else null."""
    return F.coalesce(*[F.when(raw.rlike(pattern), F.lit(name)) for name, pattern in markers])


def seeded(*parts: Column | str, seed: int = 42) -> Column:
    """A repeatable random-like key of the parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file_id, line, …) with the shortest span (file_id, span_id, start, end) around them, ties to the smaller
    span_id; points without one are dropped.

    One sweep over each file's starts and points in order, with the open spans on a heap: the shortest is on top, and spans
    that have ended leave when they get there. State is the spans that are open at one line, not a row for each line."""
    ids, others = dict(spans.dtypes)["span_id"], [c for c in points.columns if c not in ("file_id", "line")]
    none = lambda df, c, to: F.lit(None).cast(dict(df.dtypes)[c]).alias(to)
    starts = spans.select("file_id", F.col("start").cast("long").alias("_at"), F.lit(0).alias("_kind"), F.col("end").cast("long").alias("_end"), F.col("span_id").alias("_span"), none(points, "line", "line"), *[none(points, c, c) for c in others])
    met = points.select("file_id", F.col("line").cast("long").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_end"), F.lit(None).cast(ids).alias("_span"), "line", *others)
    rows = starts.unionByName(met).repartition("file_id").sortWithinPartitions("file_id", "_at", "_kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, held = object(), []
        for batch in batches:
            kept, found = [], []
            for i, (f, at, kind, end, span) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("file_id", "_at", "_kind", "_end", "_span")])):
                if f != file:
                    file, held = f, []
                if kind == 0:
                    heapq.heappush(held, (end - at, span, at, end))
                    continue
                while held and held[0][3] < at:
                    heapq.heappop(held)
                if held:
                    kept.append(i)
                    found.append(held[0])
            own = batch.take(pa.array(kept, pa.int64()))
            types = [batch.schema.field("_span").type, pa.int32(), pa.int32()]
            made = [pa.array([x[j] for x in found], t) for j, t in zip((1, 2, 3), types)]
            yield pa.RecordBatch.from_arrays([*[own.column(c) for c in points_columns], *made], names=[*points_columns, "span_id", "start", "end"])

    points_columns = points.columns
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema], f"span_id {ids}, start int, `end` int"])
    return rows.mapInArrow(run, schema)


def clean_spans(spans: DataFrame, points: DataFrame) -> DataFrame:
    """Spans that hold none of the points: the first point from a span's start on lies after its end. One sort of each
    file's starts and points, backwards."""
    starts = spans.select("file_id", F.col("start").alias("_at"), F.lit(None).cast("int").alias("_point"), F.struct(*spans.columns).alias("_span"))
    met = points.select("file_id", F.col("line").cast(dict(spans.dtypes)["start"]).alias("_at"), F.col("line").cast("int").alias("_point"), F.lit(None).cast(starts.schema["_span"].dataType).alias("_span"))
    from_here = Window.partitionBy("file_id").orderBy(F.desc("_at"), F.col("_point").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nearest = starts.unionByName(met).withColumn("_next", F.last("_point", ignorenulls=True).over(from_here))
    return nearest.filter(F.col("_span").isNotNull() & (F.col("_next").isNull() | (F.col("_next") > F.col("_span.end")))).select("_span.*")


def negatives(positives: DataFrame, clean: DataFrame, seed: int = 42) -> DataFrame:
    """One clean span of the same file for each positive (file_id, line), drawn with replacement; its middle line."""
    numbered = clean.withColumn("idx", F.row_number().over(Window.partitionBy("file_id").orderBy("span_id")) - 1)
    n = clean.groupBy("file_id").agg(F.count("*").alias("n"))
    drawn = positives.select("file_id", F.col("line").alias("for_line")).join(n, "file_id")
    drawn = drawn.withColumn("idx", (F.conv(F.substring(seeded("file_id", "for_line", seed=seed), 1, 8), 16, 10).cast("long") % F.col("n")).cast("int"))
    return drawn.join(numbered, ["file_id", "idx"]).select("file_id", "for_line", "span_id", "start", "end", F.floor((F.col("start") + F.col("end")) / 2).cast("int").alias("middle"))


def balanced(samples: DataFrame, seed: int = 42) -> DataFrame:
    """As many samples of either label, the first in seeded order, shuffled by it (column ``turn``)."""
    keyed = samples.withColumn("turn", seeded("sample_id", "label", seed=seed))
    line = ranked(keyed, ["turn", "sample_id"], ("label",), "_r")
    least = samples.agg(F.least(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).alias("_n"))
    return line.crossJoin(F.broadcast(least)).filter("_r <= _n").drop("_r", "_n")  # one row beside each


def unpivot_pairs(pairs: DataFrame, key: str, faulty: str, clean: str) -> DataFrame:
    both = F.array(F.struct(F.lit(1).alias("label"), F.col(faulty).alias("code")), F.struct(F.lit(0).alias("label"), F.col(clean).alias("code")))
    return pairs.select(key, F.explode(both).alias("x")).select(key, "x.*")


def checks_by_function(messages: DataFrame, spans: DataFrame, max_per_file: int = 3) -> DataFrame:
    """Functions with lint messages (file_id, line, msg_pos, symbol): their distinct checks in order; at most
    max_per_file of a file, by first message."""
    placed = innermost(messages, spans)
    found = placed.groupBy("file_id", "span_id").agg(F.sort_array(F.collect_set("symbol")).alias("checks"), F.min("msg_pos").alias("first"))
    rank = F.row_number().over(Window.partitionBy("file_id").orderBy("first", "span_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= max_per_file)


def unflagged(functions: DataFrame, flagged: DataFrame, keys: list[str], text: str, least_breaks: int = 3) -> DataFrame:
    """Functions that are not among the flagged and have at least so many line feeds."""
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n")))
    return functions.join(flagged.select(*keys).distinct(), keys, "left_anti").filter(breaks >= least_breaks)


def counts_per_check(messages: DataFrame, spans: DataFrame) -> DataFrame:
    """check, n: in how many functions each check was met."""
    placed = innermost(messages, spans).select("file_id", "span_id", F.col("symbol").alias("check")).distinct()
    return placed.groupBy("check").agg(F.count("*").alias("n"))


def first_positives(found: DataFrame, most: int = 600) -> DataFrame:
    """checks_by_function's rows up to the most-th in order of files and of their rank within them."""
    return found.orderBy("file_id", "rank").limit(most)


def with_text(samples: DataFrame, lines: DataFrame) -> DataFrame:
    """samples (file_id, start, end, …) with code, the span's lines (file_id, line, raw), dedented by the first one's
    indentation, each ended by a line feed. Rows of one span meet, not those of a file."""
    keys = ["file_id", "start", "end"]
    laid = samples.select(*keys).distinct().select(*keys, F.explode(F.sequence("start", "end")).alias("line"))
    own = laid.join(lines.select("file_id", "line", "raw"), ["file_id", "line"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "raw"))).alias("l"))
    indent = F.length(F.col("l")[0]["raw"]) - F.length(F.regexp_replace(F.col("l")[0]["raw"], r"^[ \t]+", ""))
    text = F.concat(F.array_join(F.transform("l", lambda x: F.when(F.length(x["raw"]) >= indent, F.substr(x["raw"], indent + 1)).otherwise(x["raw"])), "\n"), F.lit("\n"))
    return samples.join(own.select(*keys, text.alias("code")), keys, "left")


def combined(sets: dict[str, DataFrame], *extras: str) -> DataFrame:
    """One table of labelled sets: set, sample_id, label, code and meta, a map of each set's own columns named in extras."""
    parts = []
    for name, rows in sets.items():
        own = [c for c in extras if c in rows.columns]
        meta = F.map_from_arrays(F.array(*map(F.lit, own)), F.array(*[F.col(c).cast("string") for c in own])) if own else F.create_map().cast("map<string,string>")
        parts.append(rows.select(F.lit(name).alias("set"), F.col("sample_id").cast("string").alias("sample_id"), F.col("label").cast("int").alias("label"), "code", meta.alias("meta")))
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    return every
