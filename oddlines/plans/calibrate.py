"""Calibration and evaluation over scored samples: statistics, thresholds and their sweeps.

Samples have ``set``, ``sample_id``, ``label`` (0 or 1) and ``score``."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranges import quantiles, running_totals
from .stages import written


def stats_by(rows: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    """n, mean, population deviation, lower median and 95th percentile by group; nulls are left out."""
    plain = rows.groupBy(*by).agg(F.count(score).alias("n"), F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    found = quantiles(rows, tuple(by), score, p50=0.5, p95=0.95).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("p50_low").alias("p50"), "p95")
    return plain.join(found, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]), "left").select(*by, "n", "mean", "std", "p50", "p95")


def deviation_threshold(rows: DataFrame, k: float = 1.0, score: str = "score") -> DataFrame:
    """The other threshold rule: mean plus k population deviations."""
    return rows.agg((F.avg(score) + k * F.stddev_pop(score)).alias("threshold"))


def sample_scores(samples: DataFrame, lines: DataFrame, score: str = "score") -> DataFrame:
    """samples with the greatest score of their lines, 0 without lines."""
    best = lines.groupBy("sample_id").agg(F.max(score).alias("score"))
    return samples.join(best, "sample_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def _rates(flagged_pos: Column, flagged_neg: Column, n_pos: Column, n_neg: Column) -> Column:
    return 0.5 * (F.coalesce(flagged_pos / F.nullif(n_pos, F.lit(0)), F.lit(0.0)) + 1 - F.coalesce(flagged_neg / F.nullif(n_neg, F.lit(0)), F.lit(0.0)))


def sweep(samples: DataFrame) -> DataFrame:
    """Every candidate threshold of each set (distinct score, four decimals) with its balanced accuracy at score >= it.

    Scores and candidates are put in one order; running counts from the top answer all candidates at once."""
    points = samples.select("set", F.col("score").alias("at"), F.lit(1).alias("kind"), (F.col("label") == 1).cast("long").alias("p"), (F.col("label") == 0).cast("long").alias("q"))
    marks = samples.select("set", F.round("score", 4).alias("at")).distinct().select("set", "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    steps = points.unionByName(marks).groupBy("set", "at").agg(F.min("kind").alias("kind"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    done = running_totals(steps, [F.desc("at")], {"tp": "p", "fp": "q"}, ("set",))
    rows = _beside(done, samples.groupBy("set").agg(F.count_if(F.col("label") == 1).alias("n_pos"), F.count_if(F.col("label") == 0).alias("n_neg")))
    return rows.filter("kind = 0").select("set", F.col("at").alias("threshold"), _rates(F.col("tp"), F.col("fp"), F.col("n_pos"), F.col("n_neg")).alias("balanced_accuracy"))


def _beside(rows: DataFrame, per_set: DataFrame) -> DataFrame:
    """rows with per_set's columns of their set."""
    named = per_set.withColumnRenamed("set", "_set")
    return rows.join(named, rows["set"].eqNullSafe(named["_set"])).drop("_set")


def evaluation(samples: DataFrame, threshold: float) -> DataFrame:
    """One row per set: class sizes, flag rates, balanced accuracy at the threshold and at the best one (which must beat
    it; the smallest of equals)."""
    yes = F.col("score") >= threshold
    pos, neg = F.col("label") == 1, F.col("label") == 0
    block = samples.groupBy("set").agg(
        F.count_if(pos).alias("n_positive"), F.count_if(neg).alias("n_negative"),
        F.avg(F.when(pos, F.col("score"))).alias("mean_positive"), F.avg(F.when(neg, F.col("score"))).alias("mean_negative"),
        F.coalesce(F.avg(F.when(pos, yes.cast("int"))), F.lit(0.0)).alias("flag_rate_positive"),
        F.coalesce(F.avg(F.when(neg, yes.cast("int"))), F.lit(0.0)).alias("flag_rate_negative"),
    )
    block = block.withColumn("primary_accuracy", 0.5 * (F.col("flag_rate_positive") + 1 - F.col("flag_rate_negative")))
    best = sweep(samples).withColumn("r", F.round("balanced_accuracy", 12)).groupBy("set").agg(F.max(F.struct("r", (-F.col("threshold")).alias("minus"))).alias("best"))
    rows = block.join(best, "set", "left")
    beats = (F.col("n_positive") > 0) & (F.col("n_negative") > 0) & (F.col("best.r") > F.round("primary_accuracy", 12))
    return rows.select(
        "set", "n_positive", "n_negative", "mean_positive", "mean_negative", (F.col("mean_positive") - F.col("mean_negative")).alias("gap"), "flag_rate_positive", "flag_rate_negative", "primary_accuracy",
        F.when(beats, -F.col("best.minus")).otherwise(F.lit(threshold)).alias("optimal_threshold"), F.when(beats, F.col("best.r")).otherwise(F.col("primary_accuracy")).alias("optimal_accuracy"),
    )


def pick_threshold(samples: DataFrame) -> DataFrame:
    """set, threshold: the midpoint between neighbouring distinct scores of greatest accuracy, the smallest of equals; a
    single distinct score is its own threshold."""
    steps = samples.groupBy("set", F.col("score").alias("at")).agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("q"))
    # scores at most and rows so far, by set
    done = written(running_totals(steps.withColumn("one", F.lit(1).cast("long")), ["at"], {"below": "q", "past": "p", "i": "one"}, ("set",)), "steps")
    done = _beside(done, done.groupBy("set").agg(F.max("i").alias("k"), F.sum("p").alias("n_pos")))
    following = done.select(F.col("set").alias("_set"), (F.col("i") - 1).alias("_i"), F.col("at").alias("next_at"))
    rows = done.join(following, done["set"].eqNullSafe(following["_set"]) & (done["i"] == following["_i"]), "left").filter("next_at IS NOT NULL OR k = 1")
    right = F.when(F.col("k") == 1, F.col("n_pos")).otherwise(F.col("below") + F.col("n_pos") - F.col("past"))
    rows = rows.select("set", F.when(F.col("k") == 1, F.col("at")).otherwise((F.col("at") + F.col("next_at")) / 2).alias("threshold"), right.alias("right"))
    return rows.groupBy("set").agg(F.max(F.struct("right", (-F.col("threshold")).alias("minus"))).alias("b")).select("set", (-F.col("b.minus")).alias("threshold"), F.col("b.right").alias("n_right"))
