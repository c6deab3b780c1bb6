"""The library's queries over the driver's tables. SQL for them is in ``oracle``."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.constants import AXES, CAPS, FEATURES
from .functions.lexical import line_features, lines, split_lines
from .operators import curate, features, labels, lif, parse, scoring
from .plans import calibrate, model, report, review
from .plans.stages import shared_folder, written
from .sources import files as sources
from .streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
_LEXICAL = ("nesting_depth", "length", "token_entropy", "naming_entropy", "name_flow")
#: Lines of documents that stand for markers.
DOC_MARKERS = (("license", "(?i)licen[cs]e"), ("rights", "(?i)all rights"), ("mail", "@"), ("number", "[0-9]{4,}"))
#: Two inputs, two hidden neurons, one output; fixed.
TINY = lif.Net(np.array([[0.9, 0.3], [0.2, 0.8]]), np.array([[0.7, 0.6]]))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores where their files have fewer splits than there are cores; large tables stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: their source is the repository."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    return spread(_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("file_id"), F.col("source").alias("repo"), path.alias("path"), F.col("text").alias("code"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_features(lines(files(spark, sf_dir), "repo", "path"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with linear score, percentile rank as score, flag and axes."""
    rows = scoring.with_axes(vectors(spark, sf_dir).withColumn("raw_score", scoring.linear_score()))
    own = written(rows.select("file_id", "repo", "path", "line", "raw_score", *AXES), "scored")
    ranked = scoring.ecdf_rank(own, own, "raw_score", "score")
    return ranked.withColumn("flag", F.col("score") >= 0.90)


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with their lines' greatest linear score; label 1 is low quality. Sets: language."""
    rows = vectors(spark, sf_dir).select(F.col("file_id").alias("sample_id"), scoring.linear_score().alias("score"))
    own = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id").select(F.col("lang").alias("set"), F.col("doc_id").alias("sample_id"), (1 - F.col("quality")).alias("label"))
    return written(calibrate.sample_scores(own, rows), "samples")


def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = files(spark, sf_dir)
    n = rows.select("file_id", F.size(split_lines(F.coalesce("code", F.lit("")))).cast("long").alias("n_lines"))
    kept = lines(rows).groupBy("file_id").agg(F.count("*").alias("n_scored"))
    return n.join(kept, "file_id", "left").fillna({"n_scored": 0})


def lexical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("file_id", "line", *[F.round(f, 6).alias(f) for f in _LEXICAL])


def axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoring.with_axes(vectors(spark, sf_dir))
    return rows.groupBy("repo").agg(*[F.round(F.avg(a), 6).alias(a) for a in AXES], F.count("*").alias("n"))


def linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("score", scoring.linear_score())
    return rows.groupBy("file_id").agg(F.max("score").alias("top_score"), F.round(F.avg("score"), 6).alias("mean_score"))


def percentile_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("file_id", "line", F.round("score", 9).alias("score"), "flag")


def ecdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = vectors(spark, sf_dir).select(scoring.linear_score().alias("score"))
    return scoring.ecdf_table(written(counts, "scores"))


def team_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three teams, each owning the repositories of one remainder of the name's length, two of them with weights."""
    rows = scoring.with_axes(vectors(spark, sf_dir).withColumn("score", scoring.linear_score()))
    teams = spark.createDataFrame([(0, {"complexity": 2.0, "naming": 0.5}), (1, {"naming": 3.0}), (2, {})], "team int, weights map<string,double>")
    rows = rows.withColumn("team", (F.length("repo") % 3).cast("int")).join(F.broadcast(teams), "team")
    rows = rows.withColumn("weighed", scoring.with_team_weights(F.col("score"), F.col("weights"), F.col("parse_error")))
    return rows.groupBy("file_id").agg(F.round(F.max("weighed"), 6).alias("top_weighed"), F.round(F.avg("weighed"), 6).alias("mean_weighed"))


def axis_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scoring.axis_p95(vectors(spark, sf_dir), ["repo"])
    return found.select("repo", *[F.round(a, 6).alias(a) for a in ("complexity", "tangled_state", "naming")])


def feature_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.correlations(vectors(spark, sf_dir), _LEXICAL).select("left", "right", F.round("r", 6).alias("r"))


def whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and mean of each whitened feature."""
    rows = vectors(spark, sf_dir).select(*[(F.col(f) / CAPS[f]).alias(f) for f in _LEXICAL])
    made = rows.select(*lif.whitened(list(_LEXICAL), lif.fit_whitening(rows, list(_LEXICAL))))
    one = made.agg(*[F.struct(F.min(f).alias("low"), F.avg(f).alias("mean"), F.max(f).alias("high")).alias(f) for f in _LEXICAL])
    return one.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("x")) for f in _LEXICAL])).alias("r")).select("r.feature", "r.x.*")


def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(a, b) for i, a in enumerate(_LEXICAL) for b in _LEXICAL[i:]]
    return vectors(spark, sf_dir).agg(*[F.round(F.avg(f), 6).alias(f"mean_{f}") for f in _LEXICAL], *[F.round(F.covar_samp(a, b), 5).alias(f"cov_{a}_{b}") for a, b in pairs])


def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.file_summary(scored(spark, sf_dir), files(spark, sf_dir))
    return found.withColumn("top_score", F.round("top_score", 9))


def file_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.analysis(scored(spark, sf_dir), files(spark, sf_dir))
    shown = F.transform("top_flagged", lambda x: F.concat_ws("|", x["line"].cast("string"), x["reason"]))
    return found.select("file_id", "n_flagged", F.array_join(shown, "; ").alias("top_flagged"))


def repo_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.repo_rollup(scored(spark, sf_dir), 0.95)
    return found.withColumn("top_score", F.round("top_score", 9))


def top_repo_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.top_lines(scored(spark, sf_dir), ["repo"], 20).select("repo", "path", "line", "rank", F.round("score", 9).alias("score"))


def summary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report.file_summary(scored(spark, sf_dir), files(spark, sf_dir))
    return found.orderBy(F.desc("top_score"), F.desc("n_flagged"), "path").limit(15).select("path", "n_flagged", F.round("top_score", 9).alias("top_score"))


def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibrate.stats_by(samples(spark, sf_dir), ["set", "label"])
    return found.select("set", "label", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p50", "p95")])


def deviation_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select(scoring.linear_score().alias("score"))
    return calibrate.deviation_threshold(rows).select(F.round("threshold", 6).alias("threshold"))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.sweep(samples(spark, sf_dir)).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))


def evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = calibrate.evaluation(samples(spark, sf_dir), 0.2)
    return found.select("set", "n_positive", "n_negative", *[F.round(c, 6).alias(c) for c in found.columns if c not in ("set", "n_positive", "n_negative")])


def accuracy_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibrate.pick_threshold(samples(spark, sf_dir)).withColumn("threshold", F.round("threshold", 9))


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 5 == 0, "/tests/").otherwise("/")
    return rows.select(F.col("source").alias("repo"), F.concat(F.col("lang"), folder, F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.col("n_chars").alias("size"), "doc_id")


def curated_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _listing(spark, sf_dir).filter(curate.wanted_path(F.col("path")) & curate.sized(F.col("size")))
    return curate.even_stride(rows, 12).select("repo", "path", "size")


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.corpus_counts(_listing(spark, sf_dir))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.histograms(_table(spark, sf_dir, "labels"), "quality", "toxic")


def first_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.first_texts(_table(spark, sf_dir, "conversations").filter("turn = 0"), "text", "conv_id", 50).select("conv_id", "text")


def binary_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").withColumn("label", curate.binary_class(F.concat(F.lit(" "), F.upper("event_type")), ("view", "click"), ("error", "purchase")))
    return rows.filter("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(files(spark, sf_dir)).withColumn("marker", labels.marker(F.col("raw"), DOC_MARKERS))
    return rows.filter("marker IS NOT NULL").select("file_id", "line", "marker")


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a span, and within it runs of three lines."""
    n = files(spark, sf_dir).select("file_id", F.size(split_lines(F.coalesce("code", F.lit("")))).alias("n")).filter("n > 0")
    runs = n.select("file_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 3).cast("int"))).alias("r"))
    small = runs.select("file_id", (F.col("r") + 1).alias("span_id"), (3 * F.col("r") + 1).alias("start"), F.least(3 * F.col("r") + 3, F.col("n")).alias("end"))
    return n.select("file_id", F.lit(0).alias("span_id"), F.lit(1).alias("start"), F.col("n").alias("end")).unionByName(small)


def marker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marked(spark, sf_dir).groupBy("marker").agg(F.count("*").alias("n"))


def marker_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = labels.innermost(_marked(spark, sf_dir), _spans(spark, sf_dir))
    return found.withColumn("within", F.col("line") - F.col("start"))


def clean_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.clean_spans(_spans(spark, sf_dir), _marked(spark, sf_dir))


def drawn_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.negatives(_marked(spark, sf_dir), clean_spans(spark, sf_dir))


def balanced_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.col("toxic").alias("label"))
    return labels.balanced(rows)


def unpivoted_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring turns as pairs."""
    rows = _table(spark, sf_dir, "conversations").withColumn("pair_id", F.concat_ws(":", "conv_id", F.floor(F.col("turn") / 2)))
    side = lambda i: F.max(F.when(F.col("turn") % 2 == i, F.col("text")))
    pairs = rows.groupBy("pair_id").agg(side(0).alias("a"), side(1).alias("b"))
    return labels.unpivot_pairs(curate.usable_pairs(pairs, "a", "b", "pair_id"), "pair_id", "a", "b")


def span_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _marked(spark, sf_dir).select("file_id", "line", F.col("line").alias("msg_pos"), F.col("marker").alias("symbol"))
    found = labels.checks_by_function(messages, _spans(spark, sf_dir).filter("span_id > 0"))
    return found.select("file_id", "span_id", F.array_join("checks", ",").alias("checks"), "rank")


def unflagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = _marked(spark, sf_dir).select("file_id")
    return labels.unflagged(files(spark, sf_dir), flagged, ["file_id"], "code").select("file_id", "path")


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for each order: every line item is a file with one hunk; odd-looking content on even lines."""
    q, p = F.col("l_quantity").cast("int").cast("string"), F.concat(F.lit("src/p"), (F.col("l_partkey") % 7).cast("string"), F.when(F.col("l_returnflag") == "R", ".txt").otherwise(".py"))
    even = F.col("l_linenumber") % 2 == 0
    body = F.concat(
        F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -"), q, F.lit(",2 +"), q, F.when(even, F.lit(",3 @@")).otherwise(F.lit(",2 @@")), F.lit("\n ctx\n"),
        F.when(even, F.lit("--- gone")).otherwise(F.lit("-gone")), F.lit("\n+new "), F.col("l_partkey").cast("string"), F.when(even, F.concat(F.lit("\n+++ odd "), F.col("l_suppkey").cast("string"))).otherwise(F.lit("")),
    )
    rows = _table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", body.alias("body"), "l_partkey", "l_suppkey").alias("x"))
    made = rows.groupBy(F.col("l_orderkey").alias("pr_id")).agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return made.select("pr_id", F.array_join(F.transform("xs", lambda x: x["body"]), "\n").alias("diff"))


def changed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.changed_lines(diffs(spark, sf_dir))


def _pr_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of lines around the changed ones, from the line items themselves."""
    p = F.concat(F.lit("src/p"), (F.col("l_partkey") % 7).cast("string"), F.lit(".py"))
    line = F.explode(F.sequence(F.col("l_quantity").cast("long"), F.col("l_quantity").cast("long") + 3))
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pr_id"), p.alias("path"), line.alias("line"), ((F.col("l_suppkey") % 10) / 10 + F.col("l_discount")).alias("score"))
    return rows.groupBy("pr_id", "path", "line").agg(F.max("score").alias("score")).withColumn("flag", F.col("score") >= 0.5)


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = review.flagged_in_diff(_pr_scored(spark, sf_dir), changed_lines(spark, sf_dir), 0.5)
    return review.top_comments(kept, 2).select("pr_id", "path", "line", F.round("score", 6).alias("score"), "rank")


def _functions(spark: SparkSession, sf_dir: str, shift: float) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pr_id"), F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")).alias("path"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("function"))
    return rows.agg(F.round(F.max("l_discount") + shift * F.max("l_tax"), 4).alias("function_score"))


def worse_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.worse_functions(_functions(spark, sf_dir, 1.0), _functions(spark, sf_dir, 0.0), 0.05, 2)


def pr_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = written(changed_lines(spark, sf_dir), "changed")
    kept = review.flagged_in_diff(_pr_scored(spark, sf_dir), changed, 0.5).withColumn("reason", F.lit("high on naming — unusual"))
    found = review.pr_summary(changed.select("pr_id", "path"), kept, review.top_comments(kept, 2), worse_functions(spark, sf_dir))
    return found.select("pr_id", "files_touched", "total_before_cap", "flagged_count", "verdict", "summary_comment")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membrane scores of the tiny net along each user's events."""
    rows = _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.array(F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)), (F.col("event_type") == "error").cast("double")).alias("vector"))
    found = lif.score_sequences(rows, TINY, "user_id", ["ts", "event_id"])
    return found.select("user_id", "event_id", F.round("score", 6).alias("score"))


def event_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select("ts", "event_type", F.col("value").alias("score"), (F.col("value") >= 50).alias("flag"))
    return jobs.drift(rows, "ts", "event_type", "1 day").select("start", "event_type", "n", F.round("flag_rate", 6).alias("flag_rate"), F.round("mean_score", 6).alias("mean_score"))


def streamed_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_drift as a stream: a micro-batch run to its end, written as Parquet."""
    events = _table(spark, sf_dir, "events")
    place = f"{shared_folder(spark)}/drift-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    rows = stream.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("value").alias("score"), (F.col("value") >= 50).alias("flag"))
    found = jobs.drift(rows, "ts", "event_type", "1 day")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/rows")

    done = found.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{place}/rows").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("flag_rate", 6).alias("flag_rate"), F.round("mean_score", 6).alias("mean_score"))


def _event_stream(spark: SparkSession, sf_dir: str, place: str) -> DataFrame:
    """events as a stream of five files in order of time, a file at a time. The fourth holds the first one's rows again,
    long after their time, and the last one a row of no user a year later, which lets all windows end."""
    rows = _event_vectors(spark, sf_dir).join(_table(spark, sf_dir, "events").select("event_id", "event_type", "value"), "event_id").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = rows.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    part = F.floor((F.unix_micros("ts") - low) * 3 / (high - low + 1))
    end = spark.range(1).select(*[F.timestamp_micros(F.lit(high + 365 * 86_400_000_000)).alias("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema])
    for own in (rows.filter(part == 0), rows.filter(part == 1), rows.filter(part == 2), rows.filter(part == 0).withColumn("event_id", -F.col("event_id") - 1), end):
        own.coalesce(1).write.mode("append").parquet(f"{place}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{place}/in")


def streamed_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_sequences as a stream that carries each user's membranes from one micro-batch to the next."""
    place = f"{shared_folder(spark)}/sequences-{uuid.uuid4().hex}"
    found = jobs.carry_membranes(_event_stream(spark, sf_dir, place), TINY, "user_id", "ts", "event_id", "1 hour")
    run = found.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True)
    jobs.with_state_store(spark, run.start).awaitTermination()
    kept = spark.read.schema(found.schema).parquet(f"{place}/out").filter("key IS NOT NULL")
    return kept.select(F.col("key").alias("user_id"), F.col("order").alias("event_id"), F.round("score", 6).alias("score"))


def appended_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift over windows of two days, a day apart, as a stream that gives each window out once, when it has ended."""
    place = f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    rows = _event_stream(spark, sf_dir, place).select("ts", "event_type", F.col("value").alias("score"), (F.col("value") >= 50).alias("flag"))
    found = jobs.drift(rows, "ts", "event_type", "2 days", "1 day")
    found.writeStream.outputMode("append").format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.schema(found.schema).parquet(f"{place}/out").filter("event_type IS NOT NULL")
    return kept.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("flag_rate", 6).alias("flag_rate"), F.round("mean_score", 6).alias("mean_score"))


_CODE_HEAD = '"""Orders."""\nimport os\n\nRATE = 2\n\n\ndef helper(a, b):\n    try:\n        return a + b * RATE\n    except ValueError:\n        raise\n\n\ndef total_of(items'


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_orderkey and xs, array<struct<l_linenumber, code>>: two lines of code for each item of an order."""
    item = F.concat(F.lit("    if part"), F.col("l_linenumber").cast("string"), F.lit(" > "), F.col("l_partkey").cast("string"), F.lit(":\n        total = helper(total, len(items))"))
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("code")))).alias("xs"))


def _code(xs: Column, opening: Column) -> Column:
    return F.concat(F.lit(_CODE_HEAD), opening, F.lit("):\n    total = 0\n"), F.array_join(F.transform(xs, lambda x: x["code"]), "\n"), F.lit("\n    return total\n"))


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python file for each order, of two lines per item and a few fixed functions; every ninth order's does not parse."""
    opening = F.when(F.col("l_orderkey") % 9 == 0, F.lit("(")).otherwise(F.lit(""))
    return _items(spark, sf_dir).select(F.col("l_orderkey").cast("string").alias("file_id"), _code(F.col("xs"), opening).alias("code"))


def code_reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each order as a pull request that adds every second item to its file."""
    rows = written(_items(spark, sf_dir), "items")
    odd = F.filter("xs", lambda x, i: i % 2 == 0)
    side = lambda xs: rows.select(F.col("l_orderkey").alias("pr_id"), F.lit("src/orders.py").alias("path"), _code(xs, F.lit("")).alias("code"))
    hunk = lambda x, i: F.concat(F.lit("@@ -15,0 +"), (16 + 2 * i).cast("string"), F.lit(",2 @@\n+"), F.replace(x["code"], F.lit("\n"), F.lit("\n+")), F.lit("\n"))
    hunks = F.array_join(F.transform("xs", lambda x, i: F.when(i % 2 == 1, hunk(x, i)).otherwise(F.lit(""))), "")
    diffs_ = rows.select(F.col("l_orderkey").alias("pr_id"), F.concat(F.lit("--- a/src/orders.py\n+++ b/src/orders.py\n"), hunks).alias("diff"))
    return review.review_changes(diffs_, side(F.col("xs")), side(odd), lambda rows: model.linear(rows, 0.2), 0.2, 0.01, 2, 2)


def pr_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_reviews(spark, sf_dir)[0].select("pr_id", "path", "line", "rank", "source", "body")


def pr_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return code_reviews(spark, sf_dir)[2]


_CLASS_HEAD = (
    "class Basket:\n    size = 0\n\n    def fill(self, items):\n        self.total = 0\n        self.seen = {}\n\n        def note(x):\n            return self.log(x)\n\n"
    "        for item in items:\n            self.total += item.price\n"
)
_CLASS_TAIL = (
    "        return self.seen\n\n    def log(self, x):\n        return scaled(x)\n\n\nclass Empty(Basket):\n    async def size_of(self): return self.seen\n\n\ndef scaled(x):\n    return x * FACTOR\n\n\nFACTOR = 2\n"
)


def class_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of classes, methods and nested functions for each order, with two lines of a method for each item."""
    item = F.concat(F.lit("            if item.part == "), F.col("l_partkey").cast("string"), F.lit(":\n                self.seen["), F.col("l_linenumber").cast("string"), F.lit("] = note(self.total)\n"))
    rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", item.alias("code")))).alias("xs"))
    code = F.concat(F.lit(_CLASS_HEAD), F.array_join(F.transform("xs", lambda x: x["code"]), ""), F.lit(_CLASS_TAIL))
    return rows.select(F.col("l_orderkey").cast("string").alias("file_id"), code.alias("code"))


def class_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the class files' lines, summed by file."""
    rows = features.line_features(parse.parse_files(class_files(spark, sf_dir), wanted=("lines",)))
    names = ("nesting_depth", "length", "cyclomatic_proxy", "use_def_distance", "name_flow", "call_graph_shape", "exception_density", "global_reach", "attr_reach", "call_graph_depth")
    return rows.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.count("*").alias("n_lines"), *[F.round(F.sum(f), 6).alias(f) for f in names])


def class_function_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.function_features(parse.parse_files(class_files(spark, sf_dir), wanted=("bodies",)))
    names = ("nesting_depth", "length", "cyclomatic_proxy", "use_def_distance", "name_flow", "call_graph_shape", "exception_density")
    return rows.select(F.col("file_id").cast("long").alias("file_id"), "name", "line", "end_line", *[F.round(f, 6).alias(f) for f in names])


def class_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Function and innermost structure of each line of the class files."""
    rows = features.line_features(parse.parse_files(class_files(spark, sf_dir), wanted=("spans", "structures", "labels")), context=True)
    shown = F.concat(F.get("lineage", F.lit(0))["kind"], F.lit("@"), F.get("lineage", F.lit(0))["line"].cast("string"), F.lit("/"), F.size("lineage").cast("string"))
    return rows.groupBy(F.col("file_id").cast("long").alias("file_id"), "function").agg(F.count("*").alias("n_lines"), F.count(shown).alias("n_inside"), F.max(F.size("lineage")).alias("deepest"))


def failed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code files of which some are nested too deeply for the parser: they are named with an error, all others are parsed."""
    deep = F.concat(F.repeat(F.lit("-"), 200_000), F.lit("1"))
    rows = code_files(spark, sf_dir).withColumn("code", F.when(F.col("file_id").cast("long") % 997 == 0, deep).otherwise(F.col("code")))
    parsed = parse.parse_files(rows.withColumn("path", F.concat("file_id", F.lit(".py"))), keep=("path",), wanted=())
    failed = report.failed_files(parsed).select("path", (F.col("error").rlike("^(RecursionError|MemoryError): ?")).alias("known"))
    return failed.groupBy("known").agg(F.count("*").alias("n"), F.min("path").alias("first"))


def _code_lines(spark: SparkSession, sf_dir: str, context: bool = False) -> DataFrame:
    wanted = ("lines", "structures") if context else ("lines",)
    return features.line_features(parse.parse_files(code_files(spark, sf_dir), wanted=wanted), context=context)


def code_line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen features of the code files' lines, summed by file."""
    rows = _code_lines(spark, sf_dir)
    names = ("nesting_depth", "cyclomatic_proxy", "use_def_distance", "call_graph_shape", "exception_density", "parse_error", "global_reach", "attr_reach", "call_graph_depth")
    return rows.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.count("*").alias("n_lines"), *[F.round(F.sum(f), 6).alias(f) for f in names])


def code_function_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.function_features(parse.parse_files(code_files(spark, sf_dir), wanted=("bodies",)))
    names = ("nesting_depth", "length", "token_entropy", "naming_entropy", "cyclomatic_proxy", "use_def_distance", "name_flow", "call_graph_shape", "exception_density")
    return rows.select(F.col("file_id").cast("long").alias("file_id"), "name", "line", "end_line", *[F.round(f, 6).alias(f) for f in names])


def code_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.line_features(parse.parse_files(code_files(spark, sf_dir), wanted=("spans", "structures", "labels")), context=True)
    shown = F.array_join(F.transform("lineage", lambda x: F.concat(x["label"], F.lit("@"), x["line"].cast("string"))), " < ")
    return rows.select(F.col("file_id").cast("long").alias("file_id"), "line", "function", F.coalesce(shown, F.lit("")).alias("lineage"))


def code_linear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags by the fixed formula: a line that does not parse has score 1."""
    rows = model.linear(_code_lines(spark, sf_dir))
    return rows.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.count_if("flag").alias("n_flagged"), (F.max("score") == 1).alias("broken"), F.max("malformed").alias("malformed"))


def _calibrated(lines_: DataFrame) -> tuple[lif.Net, DataFrame, tuple | None]:
    """The unfitted net of 13, 128 and 32 cells with its rates and reference over the lines, and their whitening."""
    whitening = lif.fit_whitening(lines_.select(*[scoring.normalised(f).alias(f) for f in FEATURES]), list(FEATURES))
    return *model.calibrate(lines_, lif.random_net(13, seed=3), whitening), whitening


def code_sequence_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = written(_code_lines(spark, sf_dir), "code-lines")
    rows = model.sequence(lines_, *_calibrated(lines_))
    return rows.groupBy(F.col("file_id").cast("long").alias("file_id")).agg(F.count_if("flag").alias("n_flagged"), F.round(F.max("score"), 6).alias("top_score"))


def code_function_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines_ = written(_code_lines(spark, sf_dir, context=True), "code-lines")
    return model.function_scores(lines_, *_calibrated(lines_))


def model_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.diagnostics(*_calibrated(written(_code_lines(spark, sf_dir), "code-lines"))[:2])


def stored_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of events' values within a stored reference, values in tenths: the second version that was saved."""
    place = f"{shared_folder(spark)}/calibration-{uuid.uuid4().hex}"
    rows = _table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", F.round(F.col("value") / 100, 2).alias("score"), F.floor(F.col("value") / 10).alias("tenth"))
    model.save_calibration(spark, place, TINY, rows.limit(1).select("score"))
    model.save_calibration(spark, place, TINY, rows.select((F.col("tenth") / 10).alias("score")))
    known = model.load_calibration(spark, place)
    return scoring.ecdf_rank(rows.drop("tenth"), known.ecdf).select("event_id", F.round("percentile", 9).alias("percentile"))


def fitted_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a small net after six passes of plasticity over the events of all users."""
    net = lif.fit(_event_vectors(spark, sf_dir), TINY, "user_id", ["ts", "event_id"])
    cells = [(layer, i, j, round(float(w[i, j]), 6)) for layer, w in enumerate((net.fc1, net.fc2)) for i, j in np.ndindex(*w.shape)]
    return spark.createDataFrame(cells, "layer int, i int, j int, weight double")


def read_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON corpora of a hundred each, every third without a path in its manifest, written and read back."""
    place = f"{shared_folder(spark)}/corpora-{uuid.uuid4().hex}"
    none = F.lit(None).cast("string")
    entry = F.struct(F.col("source").alias("repo"), none.alias("branch"), F.when(F.col("doc_id") % 3 != 0, F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("path"), none.alias("sha"), F.col("n_chars").alias("chars"))
    rows = _table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("bucket"), F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"), entry.alias("m")).alias("x"))
    rows = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("x.doc_id", "x.text", "x.m"))).alias("xs"))
    for kind, field in (("corpus", "text"), ("manifest", "m")):
        rows.select("bucket", F.to_json(F.transform("xs", lambda x: x[field])).alias("value")).repartition("bucket").write.partitionBy("bucket").text(f"{place}/{kind}")
    found = sources.with_manifest(sources.json_corpus(spark, f"{place}/corpus"), sources.manifest_rows(spark, f"{place}/manifest"), ("bucket", "pos"))
    return found.select(F.col("bucket").cast("long").alias("bucket"), "pos", "path", "repo", "chars", F.length("code").alias("n_code"), F.md5("code").alias("code_md5"))


def read_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON lines, every tenth malformed and every tenth blank."""
    place = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    line = F.when(F.col("doc_id") % 10 == 0, F.lit('{"doc_id": ')).when(F.col("doc_id") % 10 == 1, F.lit("")).otherwise(F.to_json(F.struct("doc_id", "lang", "n_chars")))
    _table(spark, sf_dir, "documents").select(line.alias("value")).write.text(place)
    return sources.json_lines(spark, place, "doc_id long, lang string, n_chars long")


def read_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and second turns as a table of pairs, read under short names; those that differ, as labelled rows."""
    place = f"{shared_folder(spark)}/pairs-{uuid.uuid4().hex}"
    turn = lambda i: F.max(F.when(F.col("turn") == i, F.col("text")))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turn(0).alias("Faulty Code"), turn(1).alias("Fault Free Code"), F.max("role").alias("Bug_Type"))
    rows.write.parquet(place)
    found = curate.usable_pairs(sources.pairs(spark, place), "faulty", "fault_free", "conv_id")
    return labels.unpivot_pairs(found, "conv_id", "faulty", "fault_free").select("conv_id", "label", F.md5("code").alias("code_md5"))


def reports_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_summaries as JSON text, written and read back."""
    place = f"{shared_folder(spark)}/reports-{uuid.uuid4().hex}"
    found = file_summaries(spark, sf_dir)
    report.as_json(found).write.text(place)
    return spark.read.text(place).select(F.from_json("value", found.schema).alias("r")).select("r.*").fillna({"n_lines": 0})


def repaired_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code files, every second one with its line feeds escaped: of the text as it is and with them restored, the
    first that parses."""
    rows = code_files(spark, sf_dir)
    odd = F.col("file_id").cast("long") % 2 == 1
    rows = rows.withColumn("as_is", F.when(odd, F.replace("code", F.lit("\n"), F.lit("\\n"))).otherwise(F.col("code")))
    both = parse.first_that_parses(rows.select("file_id", "as_is", curate.unescaped(F.col("as_is")).alias("restored")), ("as_is", "restored"))
    kept = curate.first_that_parses([("as_is", "as_is_parses"), ("restored", "restored_parses")])
    return both.select(F.col("file_id").cast("long").alias("file_id"), F.md5(kept).alias("code_md5"), F.length(kept).alias("chars"))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents below folders and names of which some are skipped."""
    folders = F.array(*map(F.lit, ("src/a", "venv/b", "x/node_modules/y", "envs", "build", "b/.git/c", "lib")))
    names = F.array(*map(F.lit, ("m", "m_pb2", "conftest", "setup.x", "m")))
    path = F.concat(F.get(folders, (F.col("doc_id") % 7).cast("int")), F.lit("/"), F.get(names, (F.col("doc_id") % 5).cast("int")), F.when(F.col("doc_id") % 11 == 0, ".txt").otherwise(".py"))
    return _table(spark, sf_dir, "documents").select("doc_id", path.alias("path")).filter(curate.in_source_tree(F.col("path")))


def marked_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """marker_spans as positive samples with their spans' text."""
    rows = files(spark, sf_dir)
    all_lines = rows.select("file_id", F.posexplode(split_lines(F.coalesce("code", F.lit("")))).alias("pos", "raw")).select("file_id", (F.col("pos") + 1).alias("line"), "raw")
    found = labels.with_text(labels.innermost(_marked(spark, sf_dir), _spans(spark, sf_dir)), all_lines)
    return found.select("file_id", "line", "span_id", (F.col("line") - F.col("start")).alias("within"), F.length("code").alias("chars"), F.md5("code").alias("code_md5"))


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents"), "doc_id")
    own = lambda label, *more: rows.select(F.col("doc_id").alias("sample_id"), label.alias("label"), F.col("text").alias("code"), *more)
    return labels.combined({"quality": own(1 - F.col("quality"), "lang"), "toxic": own(F.col("toxic"), "lang", "source"), "bare": own(F.lit(0))}, "lang", "source")


def _shown_sets(found: DataFrame) -> DataFrame:
    return found.select("set", "sample_id", "label", F.md5("code").alias("code_md5"), F.element_at("meta", "lang").alias("lang"), F.element_at("meta", "source").alias("source"), F.size("meta").alias("n_meta"))


def combined_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_sets(_combined(spark, sf_dir))


def written_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """combined_sets written as JSON lines and read again."""
    found, place = _combined(spark, sf_dir), f"{shared_folder(spark)}/sets-{uuid.uuid4().hex}"
    sources.write(found, place, "json")
    return _shown_sets(spark.read.schema(found.schema).json(place))


def first_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten functions with checks in order of files, where mining stops."""
    messages = _marked(spark, sf_dir).select("file_id", "line", F.col("line").alias("msg_pos"), F.col("marker").alias("symbol"))
    found = labels.first_positives(labels.checks_by_function(messages, _spans(spark, sf_dir).filter("span_id > 0")), 10)
    return found.select("file_id", "span_id", F.array_join("checks", ",").alias("checks"), "rank")


def event_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of the tiny net with its rates and reference over all events."""
    rows, order = _event_vectors(spark, sf_dir), ["ts", "event_id"]
    rates = {(r["layer"], r["neuron"]): r["rate"] for r in lif.baselines(rows, TINY, "user_id", order).collect()}  # one row a neuron
    net = lif.Net(TINY.fc1, TINY.fc2, np.array([rates["hidden", i] for i in range(2)]), np.array([rates["output", 0]]))
    return model.diagnostics(net, lif.score_sequences(rows, net, "user_id", order).select("score"))


def check_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _marked(spark, sf_dir).select("file_id", "line", F.col("marker").alias("symbol"))
    return labels.counts_per_check(messages, _spans(spark, sf_dir).filter("span_id > 0"))


def kept_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, kept files and their spans (as functions) of each repository."""
    rows = _listing(spark, sf_dir)
    kept = rows.filter(curate.wanted_path(F.col("path")) & curate.sized(F.col("size")))
    spans = _spans(spark, sf_dir).filter("span_id > 0").join(rows.select(F.col("doc_id").alias("file_id"), "repo", "path"), "file_id")
    return curate.kept_of_candidates(rows, kept, spans)


def _event_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0))
    return _table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.array(x, (F.col("event_type") == "error").cast("double")).alias("vector"))


def event_spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spike-only scores of the tiny net along each user's events."""
    found = lif.score_sequences(_event_vectors(spark, sf_dir), TINY, "user_id", ["ts", "event_id"], mode="spike")
    return found.select("user_id", "event_id", F.round("score", 6).alias("score"))


def event_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membrane and spike scores of the tiny net over fixed firing rates."""
    net = lif.Net(TINY.fc1, TINY.fc2, np.array([0.25, 0.125]), np.array([0.375]))
    rows, order = written(_event_vectors(spark, sf_dir), "events"), ["ts", "event_id"]
    both = [lif.score_sequences(rows, net, "user_id", order, mode=m).select("event_id", F.round("score", 6).alias(m)) for m in ("membrane", "spike")]
    return both[0].join(both[1], "event_id")


def isolated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate-coded scores of the tiny net for each event by itself."""
    return lif.isolated_scores(_event_vectors(spark, sf_dir), TINY, ["event_id"]).select("event_id", F.round("score", 6).alias("score"))


def whitened_covariance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariances of whitened features before they are clamped, in units of their mean variance: the identity."""
    names = _LEXICAL[1:]  # documents have no nesting
    rows = vectors(spark, sf_dir).select(*names)
    mean, w = lif.fit_whitening(rows, list(names))
    made = rows.select(*[sum((F.col(f) - float(m)) * float(x) for f, m, x in zip(names, mean, row)).alias(f) for f, row in zip(names, w)])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    one = made.agg(*[F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs])
    unit = sum(F.col(f"{f}|{f}") for f in names) / len(names)
    listed = F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), (F.round(F.col(f"{a}|{b}") / unit, 4) + 0.0).alias("covariance")) for a, b in pairs])
    return one.select(F.explode(listed).alias("x")).select("x.*")


def event_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lif.baselines(_event_vectors(spark, sf_dir), TINY, "user_id", ["ts", "event_id"]).select("layer", "neuron", F.round("rate", 9).alias("rate"))


def answered_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code files as a stream of submissions in several spellings of the language, run to its end."""
    place = f"{shared_folder(spark)}/submissions-{uuid.uuid4().hex}"
    kind = F.col("file_id").cast("long") % 4
    language = F.when(kind == 0, "python").when(kind == 1, " Python ").when(kind == 2, "cpp")
    code_files(spark, sf_dir).withColumn("language", language).write.parquet(f"{place}/in")
    stream = spark.readStream.schema("file_id string, code string, language string").parquet(f"{place}/in")
    jobs.serve_submissions(stream, f"{place}/out").awaitTermination()
    answers = spark.read.parquet(f"{place}/out/analyses").select("file_id", "verdict", F.size("lines").alias("n_lines"), F.get("top_flagged", F.lit(0))["reason"].alias("reason"))
    refused = spark.read.parquet(f"{place}/out/rejected").select("file_id", F.col("error").alias("verdict"), F.lit(None).cast("int").alias("n_lines"), F.lit(None).cast("string").alias("reason"))
    return answers.unionByName(refused).withColumn("file_id", F.col("file_id").cast("long"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        split_counts, lexical_features, axes, linear_scores, percentile_flags, ecdf, team_weights, axis_p95, feature_correlations, whitening, moments, file_summaries, file_analyses, repo_rollup,
        top_repo_lines, summary_order, label_statistics, deviation_threshold, threshold_sweep, evaluation, accuracy_threshold, curated_sample, corpus_counts, histograms, first_events, binary_labels,
        marker_counts, marker_spans, clean_spans, drawn_negatives, balanced_samples, unpivoted_turns, span_checks, unflagged_files, changed_lines, review_lines, worse_functions, pr_summaries, pr_comments, pr_reports,
        event_sequences, streamed_sequences, event_drift, streamed_drift, appended_drift, code_line_features, code_function_features, code_lineage, class_line_features, class_function_features, class_lineage, failed_files, code_linear_scores, code_sequence_scores, code_function_scores, model_diagnostics, stored_percentiles, fitted_weights,
        read_corpus, read_json_lines, read_pairs, reports_as_json, repaired_code, listed_files, marked_texts, combined_sets, written_sets, first_checks, event_diagnostics, check_counts, kept_files, event_spikes, event_excess, isolated_events, whitened_covariance, event_baselines, answered_submissions,
    )
}
