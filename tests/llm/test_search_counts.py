import math
import random

import numpy as np
from oddlines.llm import counts, search
from pyspark.sql import functions as F


def test_search_equals_brute_force(spark):
    rnd = random.Random(2)
    base = [[rnd.choice([-0.5, 0.0, 0.25, rnd.uniform(-1, 1)]) for _ in range(10)] for _ in range(60)]
    rows = [(i, base[rnd.randrange(60)] if i % 3 else base[0]) for i in range(300)]
    rows += [(300, None), (301, [1.0, None]), (302, [float("nan")] * 10), (303, [float("inf")] * 10), (304, [1.0, 1.0]), (5, base[1]), (305, [])]
    # an empty vector counts as zeros
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in search.top_k(df, F.col("vec_id") % 25 == 0, k=5, block_rows=64, query_rows=4, group=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v] + [0] * (10 - len(v))) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    for q, v in ok:
        if q % 25 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q)[:5]
            assert [(i, s) for _, i, s in sorted(got[q])] == [(i, -s) for s, i in best]
    assert search.top_k(df.limit(0), F.lit(True)).count() == 0
    assert search.top_k(df.filter("vec_id = 1"), F.lit(True)).count() == 0


def test_query_rows_of_one_id_are_queries_of_their_own(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.5, 0.0]), (2, [0.0, 0.5]), (3, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in search.top_k(df, F.col("vec_id") == 0, k=2).collect())
    assert got == [(0, 1, 1, 32768), (0, 1, 2, 32768), (0, 2, 1, 0), (0, 2, 2, 0)]


def test_token_counts_are_those_of_whole_texts(spark):
    from oddlines.llm.queries import TOKENIZERS
    from oddlines.llm.tokens import public_path
    from tokenizers import Tokenizer

    paths = {v: public_path(f) for v, f in TOKENIZERS.items()}
    rows = [(1, None, "x", 7), (2, "", None, 7), (3, "It's one, two  three.\n\tÉlan <|x|> 中文", "x", 7), (3, "word " * 50_000, "x", 7)]
    df = spark.createDataFrame(rows, "n long, text string, source string, text_byte long").withColumn("new", F.upper("text"))
    got = counts.count_tokens(df, paths, ("text", "new"), ("n", "source")).collect()
    for version, path in paths.items():
        tokenizer = Tokenizer.from_file(path)
        size = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
        want = sorted((n, size(t), size((t or "").upper())) for n, t, *_ in rows)
        assert sorted((r["n"], r[f"text_{version}"], r[f"new_{version}"]) for r in got) == want
    assert counts.count_tokens(df.limit(0), paths).collect() == []


def test_query_of_counts_equals_a_plain_count(spark):
    import hashlib
    import re

    from oddlines.llm.queries import BOILERPLATE, TOKENIZERS, op4_token_counts
    from oddlines.llm.tokens import public_path
    from tokenizers import Tokenizer

    kept = {}
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        key = hashlib.sha256((r["text"] or "").encode()).hexdigest()
        if key not in kept or r["doc_id"] < kept[key]["doc_id"]:
            kept[key] = r
    want = {}
    for version, name in TOKENIZERS.items():
        tokenizer = Tokenizer.from_file(public_path(name))
        for r in kept.values():
            cell = want.setdefault((r["source"], r["lang"], version), [0, 0])
            cell[0] += 1
            cell[1] += len(tokenizer.encode(re.sub(BOILERPLATE, "", r["text"] or ""), add_special_tokens=False).ids)
    got = {(r["source"], r["lang"], r["tokenizer_version"]): [r["docs"], r["tokens"]] for r in op4_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert got == want


def test_rollups_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = spark.createDataFrame([("a", "en", 3), ("a", "en", 4), (None, None, None)], "source string, lang string, n long")
    one = counts.changes(rows, 1, "v1", F.col("n"))
    counts.commit(one, path, 1)
    want = sorted(map(str, counts.totals(spark, path).collect()))
    counts.commit(one, path, 1)
    assert sorted(map(str, counts.totals(spark, path).collect())) == want
    revised = counts.changes(rows.limit(1), -1, "v1", F.col("n")).unionByName(counts.changes(rows.limit(1), 1, "v1", F.lit(10)))
    counts.commit(revised, path, 2)
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["docs"], r["tokens"]) for r in counts.totals(spark, path).collect()}
    assert got == {("a", "en", "v1"): (2, 14), (None, None, "v1"): (1, 0)}
    counts.commit(one.limit(0), path, 3)
    counts.commit(counts.changes(rows, -1, "v1", F.col("n")), path, 4)
    extra = rows.withColumns({"docs": F.lit(5), "tokens": F.lit(5), "sign": F.lit(5)})
    assert not counts.commit(counts.changes(extra, 1, "v1", F.col("n")), path, 4)
    assert counts.totals(spark, path).count() == 1 and counts.totals(spark, path, keep_empty=True).count() == 2


def test_compaction_and_broken_commits(spark, tmp_path):
    path = str(tmp_path / "rollup")
    rows = spark.createDataFrame([("a", "en", 3), ("b", None, 4)], "source string, lang string, n long")
    assert counts.totals(spark, path).count() == 0
    for batch in (1, 2):
        assert counts.commit(counts.changes(rows, 1, "v1", F.col("n")), path, batch)
    want = sorted(map(str, counts.totals(spark, path).collect()))
    for _ in range(2):
        counts.compact(spark, path)
        assert sorted(map(str, counts.totals(spark, path).collect())) == want
    assert not counts.commit(counts.changes(rows, 1, "v1", F.col("n")), path, 2) and not (tmp_path / "rollup" / "batch=2").exists()
    # a commit that broke off has rows and no mark of success; so has a snapshot
    broken = counts.changes(rows, 1, "v1", F.col("n")).groupBy("source", "lang", "tokenizer_version").agg(F.sum("sign").alias("docs"), F.sum("tokens").alias("tokens"))
    for folder in ("batch=3", "sums=z"):
        broken.write.parquet(f"{path}/{folder}")
        (tmp_path / "rollup" / folder / "_SUCCESS").unlink()
    assert sorted(map(str, counts.totals(spark, path).collect())) == want
    assert counts.commit(counts.changes(rows, 1, "v1", F.col("n")), path, 3)
    assert {r["docs"] for r in counts.totals(spark, path).collect()} == {3}
