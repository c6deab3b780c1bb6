import random

import numpy as np
import pytest
from oddlines.functions.constants import AXES
from oddlines.operators import curate, labels, lif, scoring
from oddlines.plans import calibrate, report, review
from oddlines.sources import files
from oddlines.streaming import jobs
from pyspark.sql import functions as F

DIFF = """diff --git a/src/a.py b/src/a.py
--- a/src/a.py
+++ b/src/a.py
@@ -1,4 +1,5 @@
 one
--- gone
+++ odd
+two
 three
\\ No newline at end of file
 four
@@ -10 +11,2 @@ def f():
-x
+y
+z
--- a/notes.txt
+++ b/notes.txt
@@ -0,0 +1 @@
+text
--- /dev/null
+++ b/new.py
@@ -0,0 +1,2 @@
+first
+second
--- a/old.py
+++ /dev/null
@@ -1,2 +0,0 @@
-first
-second
"""


def test_diff_lines(spark):
    df = spark.createDataFrame([(1, DIFF), (2, None), (3, "")], "pr_id long, diff string")
    got = sorted((r["path"], r["line"], r["text"]) for r in review.changed_lines(df).collect())
    assert got == [("new.py", 1, "first"), ("new.py", 2, "second"), ("src/a.py", 2, "++ odd"), ("src/a.py", 3, "two"), ("src/a.py", 11, "y"), ("src/a.py", 12, "z")]


def _line(spark, **axes):
    values = {a: float(axes.get(a, 0.0)) for a in AXES}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{a} double" for a in AXES))


def test_reasons(spark):
    say = lambda **a: _line(spark, **a).select(report.reason()).first()[0]
    assert say(complexity=1.0, naming=0.5) == "high on complexity (1.00) + naming (0.50) — deeply nested / branchy control flow; unusual identifier density"
    assert say(naming=0.4, complexity=0.3) == "high on naming (0.40): unusual identifier density"
    assert say(hidden_calls=0.2) == "broadly elevated across axes; leader is hidden_calls (0.20)"


def test_weights(spark):
    row = _line(spark, complexity=0.5, malformed=0.5).withColumn("s", F.lit(0.6)).withColumn("none", F.expr("map()").cast("map<string,double>"))
    weigh = lambda m, error=0.0: row.select(scoring.with_team_weights(F.col("s"), m, F.lit(error))).first()[0]
    ones = F.create_map(*[F.lit(x) for a in AXES for x in (a, 1.0)])
    damp = F.create_map(F.lit("complexity"), F.lit(0.1))
    assert weigh(ones) == weigh(F.col("none")) == 0.6 and weigh(damp) < 0.6 and weigh(damp, 1.0) == 0.6
    assert row.select(scoring.with_error_override(F.col("s"), F.lit(1.0))).first()[0] == 1.0


def test_rank_against_another_reference(spark):
    rnd = random.Random(1)
    ref, own = [rnd.randint(0, 50) / 10 for _ in range(500)], [rnd.randint(-5, 60) / 10 for _ in range(200)]
    a, b = (spark.createDataFrame([(float(x),) for x in v], "score double") for v in (ref, own))
    for r in scoring.ecdf_rank(b, a).collect():
        assert abs(r["percentile"] - sum(x <= r["score"] for x in ref) / 500) < 1e-12
    assert {r["percentile"] == r["score"] for r in scoring.ecdf_rank(b, a.limit(0)).collect()} == {True}


def test_thresholds_with_ties_and_one_class(spark):
    rows = [("t", i, i % 2, 0.5) for i in range(4)] + [("one", 9, 1, 0.3)] + [("s", 20 + i, int(i > 2), i / 10) for i in range(6)]
    df = spark.createDataFrame(rows, "set string, sample_id long, label int, score double")
    got = {r["set"]: r for r in calibrate.evaluation(df, 0.9).collect()}
    assert got["s"]["optimal_threshold"] == 0.3 and got["s"]["optimal_accuracy"] == 1.0
    assert got["one"]["optimal_threshold"] == 0.9 and got["t"]["optimal_threshold"] == 0.9
    cut = {r["set"]: r["threshold"] for r in calibrate.pick_threshold(df).collect()}
    assert cut["t"] == 0.5 and cut["one"] == 0.3 and abs(cut["s"] - 0.25) < 1e-12


def test_function_deltas_and_comments(spark):
    head = spark.createDataFrame([(1, "a.py", "f", 0.9), (1, "a.py", "g", 0.5)], "pr_id long, path string, function string, function_score double")
    base = head.filter("function = 'f'").withColumn("function_score", F.lit(0.7))
    flagged = _line(spark, naming=0.9).selectExpr("1L AS pr_id", "'a.py' AS path", "'f' AS function", "3 AS line", "0.95D AS score", "'why' AS reason", "array(named_struct('label', 'x', 'line', 1)) AS lineage", "*")
    row = review.with_function_deltas(flagged, head, base).select("function_score_delta", review.comment_body().alias("b")).first()
    assert row["function_score_delta"] == 0.2 and "Inside `f` — function-level score `0.90` (↑ +0.20 — was `0.70` before your changes)" in row["b"] and "`naming` 0.90" in row["b"]
    assert [r["function"] for r in review.worse_functions(head, base).collect()] == ["f"]


def test_path_rules(spark):
    df = spark.createDataFrame([(p,) for p in ("a/b.py", "venv/x.py", "a/node_modules/y.py", "setup.py", "m_pb2.py", "a/b.txt", "env/x.py")], "path string")
    assert [r[0] for r in df.filter(curate.in_source_tree(F.col("path"))).collect()] == ["a/b.py", "env/x.py"]


def test_sources(spark, tmp_path):
    (tmp_path / "t" / "dist").mkdir(parents=True)
    (tmp_path / "t" / "a.py").write_bytes(b"x = 1\r\ny = '\xff'\r")
    (tmp_path / "t" / "dist" / "b.py").write_text("no")
    good, bad = files.source_tree(spark, str(tmp_path / "t"))
    assert [(r["path"], r["code"]) for r in good.collect()] == [("a.py", "x = 1\ny = '�'\n")] and bad.count() == 0
    (tmp_path / "c.json").write_text('["a", "b"]')
    corpus = files.json_corpus(spark, str(tmp_path / "c.json"))
    manifest = spark.createDataFrame([(0, "p.py")], "pos int, path string")
    assert sorted((r["path"], r["code"]) for r in files.with_manifest(corpus, manifest).collect()) == [("corpus_1.py", "b"), ("p.py", "a")]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{bad\n{"a": 2}\n')
    assert files.json_lines(spark, str(tmp_path / "l.jsonl"), "a int").filter("a IS NOT NULL").count() == 2


def test_sampling_pairs_and_labels(spark):
    listing = spark.createDataFrame([("r", f"p{i:02}", i * 10) for i in range(25)] + [("q", "x", 1)], "repo string, path string, size long")
    got = [r["path"] for r in curate.even_stride(listing, 4).orderBy("path").collect()]
    assert got == ["p00", "p06", "p12", "p18", "x"]
    code = spark.createDataFrame([("a\\nb", False, True), ("ok", True, True), ("bad", False, False)], "c string, ok boolean, ok2 boolean").withColumn("c2", curate.unescaped(F.col("c")))
    assert [r[0] for r in code.select(curate.first_that_parses([("c", "ok"), ("c2", "ok2")])).collect()] == ["a\nb", "ok", None]
    lines = spark.createDataFrame([("x  # noqa: E501",), ("# TODO refactor this",), ("y  # type: ignore",), ("z",)], "raw string")
    assert [r[0] for r in lines.select(labels.marker(F.col("raw"))).collect()] == ["noqa", "todo_refactor", "type_ignore", None]


def test_sequences_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [(k, i, rng.random(3).tolist()) for k in range(7) for i in range(30)]
    df = spark.createDataFrame(rows, "key long, i long, vector array<double>")
    net = lif.random_net(3, 8, 4, 2)
    one = sorted(map(tuple, lif.score_sequences(df.coalesce(1), net, "key", ["i"]).collect()))
    many = sorted(map(tuple, lif.score_sequences(df.repartition(6), net, "key", ["i"]).collect()))
    assert one == many and all(0 <= s <= 1 for _, _, s in one)
    rates = lif.baselines(df, net, "key", ["i"]).collect()
    assert len(rates) == 12 and all(0 <= r["rate"] <= 1 for r in rates)
    fitted = lif.fit(df, net, "key", ["i"], epochs=2)
    assert fitted.fc1.shape == net.fc1.shape and (fitted.fc1 >= 0).all() and (fitted.fc1 <= 1).all() and not np.allclose(fitted.fc1, net.fc1)
    alone = lif.isolated_scores(df, net, ["key", "i"])
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, lif.isolated_scores(df.repartition(3), net, ["key", "i"]).collect()))
    assert lif.fit_whitening(df.select(*[F.col("vector")[i].alias(f"v{i}") for i in range(3)]).limit(50), ["v0", "v1", "v2"]) is None


def test_innermost_and_clean_spans_equal_brute_force(spark):
    rnd = random.Random(5)
    spans = []
    for f in ("a", "b", None):
        for i in range(60):
            start = rnd.randint(1, 80)
            spans.append((f, i, start, start + rnd.choice([0, 1, 3, 30])))
    points = [(rnd.choice(["a", "b", "c", None]), rnd.randint(1, 120), f"m{i}") for i in range(90)]
    s = spark.createDataFrame(spans, "file_id string, span_id long, start int, end int")
    p = spark.createDataFrame(points, "file_id string, line int, marker string")
    want = []
    for f, line, m in points:
        around = [(e - b, i, b, e) for g, i, b, e in spans if g == f and b <= line <= e]
        if around:
            want.append((f, line, m, *min(around)[1:]))
    found = labels.innermost(p, s)
    assert found.columns == ["file_id", "line", "marker", "span_id", "start", "end"]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key) and len(want) > 40
    clean = [x for x in spans if not any(g == x[0] and x[2] <= line <= x[3] for g, line, _ in points)]
    assert sorted(map(tuple, labels.clean_spans(s, p).collect()), key=key) == sorted(clean, key=key) and clean


@pytest.mark.parametrize("layout", [{}, {"indent": 1}, {"separators": (",", ":")}, {"ensure_ascii": False}])
def test_one_large_array_is_read_in_parts(spark, tmp_path, layout):
    import json

    rnd = random.Random(7)
    texts = ["", '"', "\\", '\\"', 'x", ', '", "', "a\nb\\\\", "é中\u2028", "[1, {}]", "'"] + ["".join(rnd.choices('ab"\\\n ,[]é', k=rnd.randint(0, 40))) for _ in range(400)]
    (tmp_path / "c.json").write_text(json.dumps(texts, **layout), encoding="utf-8")
    own = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        read = files.json_corpus(spark, str(tmp_path / "c.json"))
        assert [r["code"] for r in read.orderBy("pos").collect()] == texts
        assert spark.read.option("lineSep", '"').text(str(tmp_path / "c.json")).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", own)


def test_lockstep_equals_single_steps_over_any_batches():
    rng = np.random.default_rng(12)
    net = lif.random_net(5, 16, 6, 3)
    keys = [k for k in range(40) for _ in range(int(rng.integers(1, 30)))]
    inputs = rng.random((len(keys), 5)) * 2
    want, last, cells = [], None, None
    for k, x in zip(keys, inputs):
        if k != last:
            last, cells = k, lif.Cells(net)
        cells.step(net.fc1 @ x)
        want.append(lif.membrane_score(cells))
    for size in (1, 7, 100, len(keys)):
        lock, got = lif.Lockstep(net), np.zeros(len(keys))
        for at in range(0, len(keys), size):
            for rows, state, _, _ in lock.steps(keys[at : at + size], inputs[at : at + size]):
                got[at + rows] = lif._membranes(net, state[0], state[1])
        assert np.allclose(got, want) and lock.sequences == 40


def test_fit_shuffles_its_sequences_once(spark):
    df = spark.createDataFrame([(k, i, [0.5, 0.1]) for k in range(6) for i in range(4)], "key long, i long, vector array<double>")
    kept = lif.laid_out(df, "key", ["i"])
    plan = lif._partial(kept, lif.random_net(2, 3, 2, 4), fit=True)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "hashpartitioning(layer" in plan  # of sums only


def test_draws_do_not_hang_on_layout(spark):
    df = spark.range(200).select("id", F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 0.9, 1.0)]).alias("v"))
    draws = [df.repartition(n).select("id", lif.rate_coded(["id"], F.col("v"), 5, 25, 7).alias("d")) for n in (1, 5)]
    one, many = (sorted(map(tuple, d.collect())) for d in draws)
    assert one == many
    share = [np.mean([(x >> f) & 1 for _, d in one for x in d]) for f in range(5)]
    assert share[0] == 0 and share[4] == 1 and np.allclose(share[1:4], [0.25, 0.5, 0.9], atol=0.03)


def test_stream_carries_membranes_like_a_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    rng, start = np.random.default_rng(6), datetime(2024, 1, 1)
    rows = [(k, start + timedelta(minutes=int(m)), n, rng.random(2).tolist()) for n, (k, m) in enumerate((k, m) for k in range(3) for m in rng.permutation(40))]
    df = spark.createDataFrame(rows, "user long, ts timestamp, event_id long, vector array<double>")
    closing = spark.createDataFrame([(k, start + timedelta(days=1), 999, [0.0, 0.0]) for k in range(3)], df.schema)
    net = lif.random_net(2, 4, 2, 1)
    place = str(tmp_path / "in")
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(place)
    out: list = []

    def keep(batch, n):
        out.extend(map(tuple, batch.collect()))

    def run():
        found = jobs.carry_membranes(stream, net, "user", "ts", "event_id").writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
        jobs.with_state_store(spark, found.start).awaitTermination()

    # two files cut by time, the second one starting before the watermark of the first has gone far
    early = F.col("ts") < F.lit(start + timedelta(minutes=22))
    for part in (df.filter(early), df.filter(~early), closing):
        part.coalesce(1).write.mode("append").parquet(place)
        run()
    want = sorted((r["user"], r["event_id"], round(r["score"], 9)) for r in lif.score_sequences(df, net, "user", ["ts", "event_id"]).collect())
    assert sorted((k, o, round(s, 9)) for k, o, s in out) == want


def test_late_rows_are_dropped_and_idle_keys_forgotten(spark, tmp_path):
    from datetime import datetime, timedelta

    start, net = datetime(2024, 1, 1), lif.random_net(1, 4, 2, 1)
    at = lambda minutes: start + timedelta(minutes=minutes)
    files = [[(1, at(0), 1), (1, at(1), 2), (2, at(1), 3), (None, at(2), 4)], [(1, at(90), 5), (2, at(40), 6)], [(1, at(2), 7), (3, at(300), 8)], [(1, at(310), None), (2, at(900), 9)], [(9, at(2000), 10)]]
    for rows in files:
        spark.createDataFrame([(*r, [0.8] if r[2] else None) for r in rows], "user long, ts timestamp, event_id long, vector array<double>").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user long, ts timestamp, event_id long, vector array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = []
    found = jobs.carry_membranes(stream, net, "user", "ts", "event_id", "1 minute", idle_ms=60 * 60_000).writeStream.foreachBatch(lambda b, n: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "state"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    jobs.with_state_store(spark, found.trigger(availableNow=True).start).awaitTermination()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) == before
    got = {o: (k, round(s, 9)) for k, o, s in out}
    # 7 is late; 2's membranes have not been forgotten at minute 40, but at 900
    assert set(got) == {1, 2, 3, 4, 5, 6, 8, 9}
    cells, want = lif.Cells(net), []
    for _ in range(2):
        cells.step(net.fc1 @ np.array([0.8]))
        want.append(round(lif.membrane_score(cells), 9))
    assert got[1] == (1, want[0]) and got[2] == (1, want[1]) and got[3] == (2, want[0]) and got[6] == (2, want[1]) and got[9] == (2, want[0]) and got[4] == (None, want[0])


CODE = "import os\n\n\nclass Box:\n    def put(self, item):\n        for part in item:\n            if part:\n                self.seen = os.path.join(part, helper(part, len(item), self.seen))\n        return self\n\n\ndef helper(a, b, c):\n    return a or b or c\n"


def test_analyses_of_submissions(spark, tmp_path):
    from oddlines.plans import model

    rows = [(1, " Python ", CODE), (2, "cpp", "int x;"), (3, None, ""), (4, "PYTHON", "def f(:\n    pass\n")]
    df = spark.createDataFrame(rows, "file_id long, language string, code string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    jobs.serve_submissions(stream, str(tmp_path / "out"), lambda lines: model.linear(lines, 0.3)).awaitTermination()
    got = {r["file_id"]: r for r in spark.read.parquet(str(tmp_path / "out" / "analyses")).collect()}
    assert [(r["file_id"], r["error"]) for r in spark.read.parquet(str(tmp_path / "out" / "rejected")).collect()] == [("2", "unsupported language")]
    assert set(got) == {"1", "3", "4"} and got["3"]["lines"] == [] and got["3"]["verdict"] == "no suspicious spikes detected"
    lines = {x["line"]: x for x in got["1"]["lines"]}
    assert list(lines) == [4, 5, 6, 7, 8, 9, 12, 13] and [i for i, x in lines.items() if x["flag"]] == [8]
    odd = lines[8]
    assert odd["context"]["function"] == "put" and odd["context"]["span"] == [5, 9] and odd["context"]["function_score"] is None
    assert [x["line"] for x in odd["context"]["lineage"]] == [7, 6, 5] and odd["raw_features"]["call_graph_shape"] == 3.5 and set(odd["axes"]) == set(AXES)
    assert odd["reason"].endswith("inside `if part` at L7, inside `for part in item` at L6, inside function `put` at L5.") and lines[9]["context"] is None and lines[9]["reason"] is None
    assert got["1"]["top_flagged"] == [odd] and got["4"]["top_flagged"][0]["line"] == 1 and got["4"]["top_flagged"][0]["context"] is None


def test_failed_files_are_kept_apart(spark, monkeypatch):
    from oddlines.operators import parse

    deep = "x = " + "(" * 5000 + ")" * 5000
    df = spark.createDataFrame([("1", "a.py", "x = 1\n"), ("2", "b.py", None), ("3", "c.py", "-" * 200_000 + "1")], "file_id string, path string, code string")
    parsed = parse.parse_files(df, keep=("path",))
    unread = spark.createDataFrame([("d.py", "unreadable")], "path string, error string")
    got = {r["path"]: r["error"] for r in report.failed_files(parsed, unread).collect()}
    assert got.pop("d.py") == "unreadable" and set(got) == {"c.py"} and got["c.py"].split(":")[0] in ("RecursionError", "MemoryError") and deep


def test_calibration_is_stored_and_loaded(spark, tmp_path):
    from oddlines.plans import model

    net, place = lif.random_net(3, 4, 2, 1), str(tmp_path / "c")
    net = lif.Net(net.fc1, net.fc2, np.array([0.1, 0.2, 0.3, 0.4]), np.array([0.5, 0.6]))
    scores = lambda *x: spark.createDataFrame([(v,) for v in x], "score double")
    assert model.versions(spark, place) == []
    first = model.save_calibration(spark, place, net, scores(0.1, 0.3, 0.1), 0.8)
    second = model.save_calibration(spark, place, lif.Net(net.fc1, net.fc2), scores(0.7), whitening=(np.array([0.5, 0.1, 0.2]), np.eye(3)))
    assert [v for _, v in model.versions(spark, place)] == [first, second]
    back = model.load_calibration(spark, place, first)
    assert all(np.array_equal(getattr(back.net, f), getattr(net, f)) for f in ("fc1", "fc2", "hidden_rate", "output_rate")) and back.threshold == 0.8 and back.whitening is None
    assert sorted(map(tuple, back.ecdf.collect())) == [(0.1, 2, 3), (0.3, 3, 3)]
    now = model.load_calibration(spark, place)
    assert now.net.hidden_rate is None and np.array_equal(now.whitening[1], np.eye(3)) and list(now.whitening[0]) == [0.5, 0.1, 0.2] and sorted(map(tuple, now.ecdf.collect())) == [(0.7, 1, 1)]


def test_scores_from_a_stored_calibration_equal_those_from_raw_scores(spark, tmp_path):
    from oddlines.operators import features, parse
    from oddlines.plans import model

    # the same line many times: scores repeat
    codes = [(str(i), "x = f(1)\n" * (3 + i % 4) + CODE * (i % 2)) for i in range(12)]
    lines = features.line_features(parse.parse_files(spark.createDataFrame(codes, "file_id string, code string")), context=True).persist()
    net, reference = model.calibrate(lines, lif.random_net(13, 8, 4, 3))
    reference = spark.createDataFrame(reference.collect())
    model.save_calibration(spark, str(tmp_path / "c"), net, reference, 0.9)
    known = model.load_calibration(spark, str(tmp_path / "c"))
    raw, stored = ({(r["file_id"], r["line"]): r["score"] for r in rows.collect()} for rows in (model.sequence(lines, net, reference), model.scored_by(lines, known)))
    assert raw == stored and len(raw) == lines.count() > len(set(raw.values()))
    raw, stored = (sorted(map(tuple, model.function_scores(lines, net, x).collect())) for x in (reference, known.ecdf))
    assert raw == stored and {r[1] for r in raw} == {"put", "helper"}
    lines.unpersist()


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_ranks_from_steps_and_from_scores(spark, monkeypatch, sent):
    from oddlines.operators import scoring

    monkeypatch.setattr(scoring, "MAX_SENT_SCORES", sent)
    reference = spark.createDataFrame([(0.1,), (0.1,), (0.1,), (0.9,)], "score double")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate((0.0, 0.1, 0.5, 0.9, 2.0, 0.5))], "i long, score double")
    want = [0.0, 0.75, 0.75, 1.0, 1.0, 0.75]
    for known in (reference, scoring.ecdf_table(reference)):
        assert [r["percentile"] for r in scoring.ecdf_rank(rows, known).orderBy("i").collect()] == want
    assert [r["percentile"] for r in scoring.ecdf_rank(rows, reference.limit(0)).orderBy("i").collect()] == [0.0, 0.1, 0.5, 0.9, 2.0, 0.5]


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3)) @ np.array([[1, 0.5, 0], [0, 1, 0.2], [0, 0, 1]])
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    mean, w = lif.fit_whitening(df, ["a", "b", "c"])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    plain = vectors @ np.diag(np.maximum(values, 1e-3) ** -0.5) @ vectors.T
    y = np.abs((x - x.mean(axis=0)) @ plain.T)
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(w, plain / (2 * np.percentile(y, 99)), rtol=2e-2)
    got = np.array([list(r) for r in df.select(*lif.whitened(["a", "b", "c"], (mean, w))).collect()])
    assert np.allclose(np.sort(got, axis=0), np.sort(np.clip((x - mean) @ w.T + 0.5, 0, 1), axis=0))


def test_fit_and_rates_equal_plain_loops(spark):
    rng = np.random.default_rng(9)
    rows = [(k, i, rng.random(2).tolist()) for k in range(5) for i in range(12)]
    df = spark.createDataFrame(rows, "key long, i long, vector array<double>")
    net = lif.random_net(2, 3, 2, 4)
    shapes = (net.fc1.shape, net.fc2.shape)
    pot, dep, fired = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes], [np.zeros(s[0]) for s in shapes]
    fade, spikes = np.exp(-1 / lif.TAU), {}
    for k in range(5):
        mem, pre, post = [np.zeros(s[0]) for s in shapes], [np.zeros(s[1]) for s in shapes], [np.zeros(s[0]) for s in shapes]
        for _, i, v in (r for r in rows if r[0] == k):
            x, out = np.array(v), []
            for n, weights in enumerate((net.fc1, net.fc2)):
                mem[n] = 0.9 * mem[n] + weights @ x - (mem[n] > 1)
                after = (mem[n] > 1).astype(float)
                pre[n], post[n] = pre[n] * fade + x, post[n] * fade + after
                pot[n] += np.outer(after, pre[n])
                dep[n] += np.outer(post[n], x)
                fired[n] += after
                out.append(after.mean())
                x = after
            spikes[k, i] = 0.7 * out[0] + 0.3 * out[1]
    got = lif.fit(df, net, "key", ["i"], epochs=1)
    for n, (weights, fitted) in enumerate(((net.fc1, got.fc1), (net.fc2, got.fc2))):
        assert np.allclose(fitted, np.clip(weights * (1 - lif.DECAY) + (lif.A_PLUS * pot[n] - lif.A_MINUS * dep[n] * weights) / 5, 0, 1))
    rates = {(r["layer"], r["neuron"]): r["rate"] for r in lif.baselines(df, net, "key", ["i"]).collect()}
    assert all(abs(rates[layer, i] - fired[n][i] / 60) < 1e-12 for n, layer in enumerate(("hidden", "output")) for i in range(shapes[n][0]))
    assert all(abs(r["score"] - spikes[r["key"], r["i"]]) < 1e-12 for r in lif.score_sequences(df, net, "key", ["i"], mode="spike").collect())


def test_totals_and_quantiles_over_ranges(spark):
    from oddlines.operators.ranges import quantiles, ranked, running_totals

    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), i, rnd.randint(0, 9)) for i in range(500)] + [("c", 900, 3)]
    df = spark.createDataFrame(rows, "g string, i long, v long")
    got = {(r["g"], r["i"]): (r["total"], r["rank"]) for r in ranked(running_totals(df, [F.desc("i")], {"total": "v"}, ("g",)), [F.desc("i")], ("g",)).collect()}
    for g in ("a", "b", None, "c"):
        total = 0
        for n, (_, i, v) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: -r[1]), 1):
            total += v
            assert got[g, i] == (total, n)
    for r in quantiles(df.withColumn("v", F.col("v").cast("double")), ("g",), "v", p50=0.5, p95=0.95).collect():
        own = sorted(float(v) for g, _, v in rows if g == r["g"])
        assert r["n"] == len(own) and abs(r["p95"] - np.percentile(own, 95)) < 1e-9 and r["p50_low"] == own[(len(own) - 1) // 2]


def test_review_by_the_net_with_function_scores_of_their_own(spark):
    from oddlines.operators import features, parse
    from oddlines.plans import model
    from oddlines.queries import _CLASS_HEAD, _CLASS_TAIL

    item = "            if item.part == 7:\n                self.seen[1] = note(self.total)\n"
    old, new = _CLASS_HEAD + item + _CLASS_TAIL, _CLASS_HEAD + 3 * item + _CLASS_TAIL
    sides = lambda *rows: spark.createDataFrame(rows, "pr_id long, path string, code string")
    head, base = sides((1, "a.py", new), (1, "b.py", CODE), (2, "a.py", new), (2, "gone.py", CODE)), sides((1, "a.py", old), (1, "b.py", CODE), (2, "a.py", old), (2, "gone.py", CODE))
    diff = "--- a/a.py\n+++ b/a.py\n@@ -14,0 +15,4 @@\n+" + (2 * item).rstrip("\n").replace("\n", "\n+") + "\n"
    diffs = spark.createDataFrame([(1, diff), (2, diff)], "pr_id long, diff string")
    status = spark.createDataFrame([(2, "a.py", "added"), (2, "gone.py", "removed")], "pr_id long, path string, status string")
    lines = features.line_features(parse.parse_files(spark.createDataFrame([("new", new), ("old", old)], "file_id string, code string")), context=True).persist()
    net, reference = model.calibrate(lines, lif.random_net(13, 8, 4, 3))
    reference = spark.createDataFrame(reference.collect())
    known = {(r["file_id"], r["function"]): r["function_score"] for r in model.function_scores(lines, net, reference).collect()}
    comments, worse, summaries = review.review_changes(
        diffs, head, base, lambda rows: model.sequence(rows, net, reference, threshold=0.0), 0.0, -1.0, 10, 10, lambda rows, keep: model.function_scores(rows, net, reference, keep=keep), status
    )
    told = {(r["pr_id"], r["line"]): r["body"] for r in comments.collect()}
    assert set(told) == {(p, i) for p in (1, 2) for i in range(15, 19)}
    score, before = known["new", "fill"], known["old", "fill"]
    assert all(f"function-level score `{score:.2f}`" in body and "Inside `fill`" in body for body in told.values())
    # of an added file nothing is known from before
    assert all(("before your changes" in body) == (p == 1) for (p, _), body in told.items())
    moved = {(r["pr_id"], r["path"], r["function"]): (r["function_score"], r["function_score_before"]) for r in worse.collect()}
    assert moved[1, "a.py", "fill"] == (score, before) and {k[:2] for k in moved} == {(1, "a.py"), (1, "b.py")}
    assert {r["pr_id"]: r["files_touched"] for r in summaries.collect()} == {1: 2, 2: 1}
    lines.unpersist()


def test_a_folder_is_scanned_in_one_call(spark, tmp_path):
    from oddlines.plans import model
    from oddlines.plans.scan import scan

    for name, code in (("a.py", CODE), ("pkg/b.py", "def f(:\n    pass\n"), ("pkg/empty.py", ""), ("pkg/deep.py", "-" * 200_000 + "1"), ("dist/c.py", CODE), ("notes.txt", "x")):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(code)
    good, bad = files.source_tree(spark, str(tmp_path / "t"))
    found = scan(good.withColumn("repo", F.lit("t")), bad, lambda rows: model.linear(rows, 0.3))
    summaries = {r["path"]: (r["n_lines"], r["n_flagged"]) for r in found.summaries.collect()}
    assert summaries == {"a.py": (8, 1), "pkg/b.py": (2, 1)}
    top = {(r["path"], r["line"]): r for r in found.top.collect()}
    assert set(top) == {("a.py", 8), ("pkg/b.py", 1)} and top["pkg/b.py", 1]["rank"] == 1 and top["a.py", 8]["context"]["function"] == "put"
    assert [(r["path"], r["error"].split(":")[0] in ("RecursionError", "MemoryError")) for r in found.failed.collect()] == [("pkg/deep.py", True)]
    assert {(r["repo"], r["path"]): r["n_flagged"] for r in found.totals.collect()} == {("t", "a.py"): 1, ("t", "pkg/b.py"): 1, ("t", None): 2, (None, None): 2}


def test_touched_files_by_status(spark):
    head = spark.createDataFrame([(1, "a.py", "h"), (1, "b.py", "h"), (1, "c.py", "h"), (1, "d.txt", "h")], "pr_id long, path string, code string")
    base = head.withColumn("code", F.lit("b"))
    status = spark.createDataFrame([(1, "a.py", "removed"), (1, "b.py", "added")], "pr_id long, path string, status string")
    assert sorted(map(tuple, files.head_and_base(head, base, status).collect())) == [(1, "b.py", "h", None), (1, "c.py", "h", "b")]


def test_language_gate(spark):
    df = spark.createDataFrame([(1, " Python ", "x = 1\n"), (2, "cpp", "int x;"), (3, None, "")], "file_id long, language string, code string")
    good, bad = report.python_only(df)
    assert sorted(r["file_id"] for r in good.collect()) == [1, 3] and [r["file_id"] for r in bad.collect()] == [2]
