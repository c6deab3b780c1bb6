import corpus_pipeline
import pytest
from oddlines.llm.shared import stash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], SF), name))
    return out


def test_columns_and_decisions(stages):
    docs, known, unique, redacted, mixed, packed = stages
    for stage in (known, unique, redacted, mixed):
        assert stage.columns == docs.columns
    assert known.count() <= docs.count() and known.exceptAll(docs).count() == 0
    assert unique.count() < known.count() and unique.exceptAll(known).count() == 0
    assert redacted.count() == unique.count() and redacted.filter("text LIKE '%[SECRET]%'").count() == redacted.exceptAll(unique).count()
    assert mixed.select("doc_id").exceptAll(redacted.select("doc_id").unionByName(redacted.select("doc_id"))).count() == 0


def test_dedup_keeps_one_of_each_group(stages):
    from tests.llm.test_neardup import brute

    roots = brute({r["doc_id"]: r["text"] for r in stages[1].collect()})
    assert sorted(r["doc_id"] for r in stages[2].collect()) == sorted(d for d, (_, root) in roots.items() if d == root)


def test_mixture_meets_targets_and_packs_whole(stages):
    from oddlines.llm.mixing import water_fill

    sizes, taken = {}, {}
    for rows, into in ((stages[3], sizes), (stages[4], taken)):
        for r in rows.collect():
            into[r["source"]] = into.get(r["source"], 0) + len((r["text"] or "").encode().split())
    names = sorted(sizes)
    targets = water_fill([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    assert all(abs(taken[n] - t) <= 1 for n, t in zip(names, targets))
    fills = {}
    for r in stages[5].collect():
        fills[r["sequence_id"]] = fills.get(r["sequence_id"], 0) + r["length"]
    assert all(n == 1024 or n & (n - 1) == 0 for n in fills.values())


def test_run_equals_the_stages(spark, stages):
    assert corpus_pipeline.run(spark, SF).select("doc_id", "length").groupBy().sum("length").first()[0] == stages[5].groupBy().sum("length").first()[0]


def test_null_and_repeated_ids(spark):
    from collections import Counter

    from oddlines.llm.mixing import water_fill
    from pyspark.sql import functions as F
    from tests.llm.test_neardup import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = F.when(F.col("doc_id") % 10 == 3, None).when(F.col("doc_id") % 10 < 3, F.col("doc_id") - F.col("doc_id") % 10).otherwise(F.col("doc_id"))
    docs = docs.withColumn("doc_id", odd).unionByName(docs.filter("doc_id % 40 = 4"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stash(stage(spark, out[-1], SF), f"odd-{name}"))
    known, unique, redacted, mixed = ([tuple(r[c] for c in ("doc_id", "text", "source")) for r in x.collect()] for x in out[1:5])

    rows = sorted(known, key=lambda r: (r[0] is not None, r[0] or 0))
    roots = brute({i: r[1] for i, r in enumerate(rows)})
    kept = [rows[i] for i, (_, root) in roots.items() if i == root]
    least = lambda found: sorted((-1 if r[0] is None else r[0]) for r in found)
    assert least(unique) == least(kept) and any(r[0] is None for r in kept)
    assert any(n > 1 for d, n in Counter(r[0] for r in kept).items() if d is not None)
    assert least(redacted) == least(unique)

    words = lambda text: len((text or "").encode().split())
    sizes, taken = Counter(), Counter()
    for into, found in ((sizes, redacted), (taken, mixed)):
        for _, text, source in found:
            into[source] += words(text)
    names = sorted(sizes)
    targets = water_fill([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2)
    assert all(abs(taken[n] - t) <= 1 for n, t in zip(names, targets))
    assert all(n <= 2 * m for n, m in ((Counter(map(str, mixed))[k], Counter(map(str, redacted))[k]) for k in set(map(str, redacted))))
    assert {r["doc_id"] for r in out[5].select("doc_id").collect()} == {r[0] for r in mixed}


def test_each_stage_on_odd_tables(spark):
    from pyspark.sql import functions as F

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = " ".join(f"word{i % 977} of the house" for i in range(40_000))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, words, "en", "a", None), (2, words, "en", "a", None), (None, "the one and only house", None, None, 22), (3, "token=abcdef " * 3, "en", "b", 39)]
    extra = {"size": F.lit("x"), "take": F.lit(1), "shard": F.lit("s"), "pass": F.lit(0), "order_key": F.lit("k"), "row_key": F.lit(1), "id": F.lit(2), "root": F.lit(3), "score": F.lit(4.0), "base": F.lit(5), "spans": F.lit(6), "_metadata": F.lit(7)}
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame(rows, schema).limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            for df in (docs, stash(docs.withColumns(extra), "odd")):
                got = stage(spark, df, SF).collect()
                ids = sorted((r["doc_id"] or 0) for r in got)
                if docs.isEmpty():
                    assert ids == []
                elif name == "language_id":
                    assert ids in ([0, 2, 2, 3], [0, 2, 2])
                elif name == "near_dedup":
                    assert ids == [0, 0, 1, 2, 3]
                elif name == "secret_scan":
                    assert ids == [0, 0, 1, 2, 2, 3] and sum(r["text"].count("[SECRET]") for r in got) == 3
                elif name == "mixing":
                    assert set(ids) <= {0, 2, 3} and all(r["text"] for r in got)
                else:
                    assert set(ids) == {0, 1, 2, 3}


def test_python_gets_modest_batches(spark, tmp_path, monkeypatch):
    """What crosses to Python counts in an executor's memory several times over: a file of many rows is sent in parts."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.repeat(batch.num_rows, batch.num_rows)], names=["doc_id", "length"])

    def predict(docs, model, id_col="doc_id", keep=()):
        seen = docs.select(id_col).mapInArrow(sizes, "doc_id long, length long")
        seen = seen.selectExpr("doc_id", "if(length > 1024, 'und', 'en') AS lang_pred", "1D AS score")
        return seen.join(docs.withColumnRenamed(id_col, "doc_id"), "doc_id") if keep else seen

    rows = spark.range(5_000).selectExpr("id AS doc_id", "'the house' AS text", "'en' AS lang", "'a' AS source", "9L AS n_chars")
    rows.coalesce(1).write.parquet(f"{tmp_path}/rows")
    docs = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(corpus_pipeline.langid, "predict", predict)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda d, *a, **b: d.select("doc_id").mapInArrow(sizes, "doc_id long, length long"))
    own = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert corpus_pipeline.identify_language(spark, docs, SF).count() == 5_000
    assert corpus_pipeline.pack_sequences(spark, docs, SF).groupBy().max("length").first()[0] <= 1024
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == own
