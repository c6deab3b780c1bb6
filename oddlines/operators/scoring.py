"""Normalising, axes, linear scores, percentile ranks and team weights: column expressions and one distributed ECDF."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import AXES, CAPS, FEATURES, LINEAR_WEIGHTS
from ..plans.stages import written
from .ranges import quantiles, running_greatest, running_totals

#: Distinct scores up to this number are sent to every task (16 MB); more are met by a join over SPREAD places a score.
MAX_SENT_SCORES, SPREAD = 1_000_000, 16


def _unit(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def normalised(feature: str) -> Column:
    return _unit(F.col(feature) / CAPS[feature])


def axis(name: str) -> Column:
    members, p95 = AXES[name]
    mean = reduce(add, [normalised(m) for m in members]) / len(members)
    return F.round(F.least(F.lit(1.0), mean / p95), 4)


def with_axes(rows: DataFrame) -> DataFrame:
    return rows.withColumns({a: axis(a) for a in AXES})


def linear_score() -> Column:
    """Weighted sum of the normalised features in [0, 1]; nine decimals, so that equal lines have equal scores."""
    return F.round(_unit(reduce(add, [F.lit(LINEAR_WEIGHTS[f]) * normalised(f) for f in FEATURES])), 9)


def ecdf_table(scores: DataFrame, score: str = "score") -> DataFrame:
    """score, n_le, n of each distinct score."""
    counts = scores.groupBy(F.col(score).alias("score")).agg(F.count("*").alias("c"))
    done = running_totals(counts, ["score"], {"n_le": "c"})
    n = counts.agg(F.sum("c").alias("n"))
    return done.crossJoin(F.broadcast(n)).select("score", "n_le", "n")  # one row beside each


def ecdf_rank(rows: DataFrame, reference: DataFrame, score: str = "score", out: str = "percentile") -> DataFrame:
    """rows with out = share of reference scores that are at most the row's; the score itself where reference is empty.

    reference holds scores (column score, or named as those of rows) or the steps that ``ecdf_table`` made of them, which
    are not counted again. The distinct scores of rows are merged with the steps in one order: each gets the count of the
    last step at or below it. They are sent to all tasks where they are few, else spread, so that a score that very many
    rows have is not one task's work. rows is read twice, reference once."""
    own = rows.select(F.col(score).alias("s")).distinct().select("s", F.lit(0).cast("long").alias("n_le"), F.lit(0).cast("long").alias("n"))
    steps = reference if "n_le" in reference.columns else ecdf_table(reference, score if score in reference.columns else "score")
    both = steps.select(F.col("score").alias("s"), "n_le", "n").unionByName(own).groupBy("s").agg(F.max("n_le").alias("n_le"), F.max("n").alias("n"))
    done = written(running_greatest(both, ["s"], {"total": "n_le"}).select("s", "n", "total"), "ecdf")
    n = done.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))
    done = done.drop("n")
    if done.count() <= MAX_SENT_SCORES:
        met = rows.join(F.broadcast(done), rows[score] == done["s"], "left").drop("s")
    else:
        places = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("_place")
        spread = rows.withColumn("_place", F.pmod(F.xxhash64(*[c for c in rows.columns if c != score]), F.lit(SPREAD)).cast("int"))
        met = spread.join(done.select(F.col("s").alias(score), "total", places), [score, "_place"], "left").drop("_place")
    ranked = met.crossJoin(F.broadcast(n))  # one row beside each
    return ranked.withColumn(out, F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.col(score))).drop("total", "n")


def with_error_override(score: Column, parse_error: Column) -> Column:
    return F.when(parse_error >= 1, F.greatest(score, F.lit(1.0))).otherwise(score)


def with_team_weights(score: Column, weights: Column, parse_error: Column | None = None) -> Column:
    """score times the strength-weighted mean of a map of axis weights (absent: 1.0); unchanged without weights,
    where all axes are nil and on lines that do not parse."""
    strength = reduce(add, [F.col(a) for a in AXES])
    weighed = reduce(add, [F.col(a) * F.coalesce(F.element_at(weights, F.lit(a)), F.lit(1.0)) for a in AXES])
    same = weights.isNull() | (F.size(weights) == 0) | (strength <= 1e-6)
    if parse_error is not None:
        same = same | (parse_error >= 1)
    return F.when(same, score).otherwise(_unit(score * weighed / strength))


def axis_p95(rows: DataFrame, by: list[str]) -> DataFrame:
    """95th percentile of each axis's mean feature over rows, by group or over all."""
    raw = {a: reduce(add, [normalised(m) for m in members]) / len(members) for a, (members, _) in AXES.items()}
    long = rows.select(*by, F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), v.alias("v")) for a, v in raw.items()])).alias("x")).select(*by, "x.*")
    found = quantiles(long, (*by, "axis"), "v", p95=0.95)
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("axis") == a, F.col("p95"))).alias(a) for a in AXES])


def correlations(rows: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """left, right, r of every pair of features, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i + 1 :]]
    n = F.count("*").cast("double")

    def r(a: str, b: str) -> Column:  # null where one of the two does not vary
        spread = F.stddev_pop(a) * F.stddev_pop(b)
        return F.covar_pop(a, b) / F.when((n > 0) & (spread > 0), spread)

    one = rows.agg(*[r(a, b).alias(f"{a}|{b}") for a, b in pairs])
    listed = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"{a}|{b}").alias("r")) for a, b in pairs])
    return one.select(F.explode(listed).alias("x")).select("x.*")
