"""Streams: answers to submissions, membrane state along keyed events, drift over time windows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ..operators import features, parse
from ..operators.lif import Cells, Net, membrane_score
from ..plans import model
from ..plans.report import full_analysis, python_only, rich_lines
from ..plans.stages import written


def answer_submissions(batch: DataFrame, score: Callable[[DataFrame], DataFrame] = model.linear) -> tuple[DataFrame, DataFrame]:
    """Analyses of submissions (file_id, language, code) that are Python, each with all its lines, and file_id, language
    and error of the others and of those that could not be taken."""
    accepted, rejected = python_only(batch.withColumn("file_id", F.col("file_id").cast("string")))
    parsed = written(parse.parse_files(accepted, keep=("language",), wanted=("lines", "structures")), "submissions")
    scored = written(score(features.line_features(parsed, context=True)), "submitted-lines")
    analyses = full_analysis(rich_lines(scored), parsed.filter("error IS NULL").select("file_id"))
    refused = rejected.select("file_id", "language", F.lit("unsupported language").alias("error"))
    return analyses, refused.unionByName(parsed.filter("error IS NOT NULL").select("file_id", "language", "error"))


def serve_submissions(stream: DataFrame, place: str, score: Callable[[DataFrame], DataFrame] = model.linear) -> StreamingQuery:
    """Answers a stream of submissions batch by batch, below place/analyses and place/rejected. A batch that is run again
    replaces its own folders."""

    def answer(batch: DataFrame, n: int) -> None:
        for rows, kind in zip(answer_submissions(batch, score), ("analyses", "rejected")):
            rows.write.mode("overwrite").parquet(f"{place}/{kind}/batch={n}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()


class Membranes(StatefulProcessor):
    """Scores of one key's events in order. Events wait in list state until the watermark has passed them; a timer then
    scores what is ready and carries the membranes on in value state. A key starts anew after a long gap, and its
    state goes when the watermark has passed that gap."""

    def __init__(self, net: Net, idle_ms: int | None = None):
        self.net, self.idle_ms = net, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cells = handle.getValueState("cells", "mem1 array<double>, mem2 array<double>, last bigint")
        self.waiting = handle.getListState("waiting", "at bigint, pos bigint, vector array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        mark, first = timerValues.getCurrentWatermarkInMs(), None
        for frame in rows:
            at = frame["at"].astype("datetime64[us]").astype("int64")
            own = (at >= 1000 * mark) & frame["vector"].notna()
            kept = frame[own].assign(at=at[own])
            if len(kept):
                self.waiting.appendList([(int(t), int(o), [float(x) for x in v]) for t, o, v in zip(kept["at"], kept["pos"], kept["vector"])])
                first = int(kept["at"].min()) if first is None else min(first, int(kept["at"].min()))
        if first is not None:
            self.handle.registerTimer(max(first // 1000, mark) + 1)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted((tuple(e) for e in self.waiting.get()), key=lambda e: e[:2]) if self.waiting.exists() else []
        ready = [e for e in held if e[0] < 1000 * mark]
        state = self.cells.get() if self.cells.exists() else None
        if ready:
            cells, out, last = Cells(self.net), [], None
            if state is not None:
                cells.mem1, cells.mem2, last = np.array(state[0]), np.array(state[1]), state[2]
            for at, pos, vector in ready:
                if self.idle_ms is not None and last is not None and at - last >= 1000 * self.idle_ms:
                    cells = Cells(self.net)
                last = at
                cells.step(self.net.fc1 @ np.array(vector))
                out.append((key[0], pos, membrane_score(cells)))
            self.cells.update((cells.mem1.tolist(), cells.mem2.tolist(), ready[-1][0]))
            rest = held[len(ready) :]
            if rest:
                self.waiting.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self.waiting.clear()
                if self.idle_ms is not None:
                    self.handle.registerTimer(max(ready[-1][0] // 1000 + self.idle_ms, mark + 1))
            yield pd.DataFrame(out, columns=["key", "order", "score"])
        elif not held and state is not None and self.idle_ms is not None and state[2] // 1000 + self.idle_ms <= mark:
            self.cells.clear()

    def close(self) -> None:
        pass


def carry_membranes(events: DataFrame, net: Net, key: str, at: str, order: str, delay: str = "10 minutes", idle_ms: int | None = None) -> DataFrame:
    """key, order, score of a stream of events (key, at, order, vector) along each key in order of (at, order); those that
    come later than the watermark and those without a vector are dropped, a null order counts as -1. A key without events for idle_ms starts anew. To be started by
    ``with_state_store``."""
    rows = events.select(F.col(key).alias("key"), F.col(at).alias("at"), F.coalesce(order, F.lit(-1)).cast("long").alias("pos"), F.col("vector").cast("array<double>").alias("vector")).withWatermark("at", delay)
    kind = dict(rows.dtypes)["key"]
    return rows.groupBy("key").transformWithStateInPandas(Membranes(net, idle_ms), f"key {kind}, `order` long, score double", "Append", "EventTime")


def with_state_store(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """What start starts, with the state store that keyed state and timers need; the session's own setting comes back once
    the query has taken it over."""
    name = "spark.sql.streaming.stateStore.providerClass"
    own = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return start()
    finally:
        spark.conf.set(name, own) if own else spark.conf.unset(name)


def late_rows(query: StreamingQuery) -> int:
    """How many rows a query has dropped, since they came after the watermark."""
    return sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)


def drift(scored: DataFrame, at: str, by: str, width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Start of window, group, rows, flag rate and mean score; tumbling, or sliding by ``slide``."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    rows = scored.withWatermark(at, delay) if scored.isStreaming else scored
    counts = rows.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.avg(F.col("flag").cast("double")).alias("flag_rate"), F.avg("score").alias("mean_score"))
    return counts.select(F.col("w.start").alias("start"), by, "n", "flag_rate", "mean_score")
