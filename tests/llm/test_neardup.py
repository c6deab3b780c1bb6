import random
from collections import Counter, defaultdict

import numpy as np
from oddlines.llm import neardup


def brute(docs):
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    held = defaultdict(list)
    for d in sets:
        shared = Counter(e for x in sets[d] for e in held[x])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(sets[d]) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for x in sets[d]:
            held[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in sets}


def check(spark, docs, **more):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs.items()], "doc_id long, text string, id string, root int")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, **more).collect()}
    assert got == brute(docs)


def planted(seed, n_groups=12, copies=12):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    docs, at, common = {}, 0, [word() for _ in range(40)]
    for _ in range(n_groups):
        base = [word() for _ in range(rnd.choice([3, 6, 30, 120]))]
        if rnd.random() < 0.5:
            base = base[:60] + common
        for _ in range(copies):
            copy = [word() if rnd.random() < rnd.choice([0, 0.01, 0.04]) else w for w in base]
            docs[at] = rnd.choice([" ", "\n", "\t "]).join(copy)
            at += rnd.randint(1, 3)
    return docs | {at + 1: None, at + 2: "", at + 3: "  \n", at + 4: "One two", at + 5: "one TWO", at + 6: "É é É é É é", at + 7: "é é é é é é"}


def test_components_equal_brute_force(spark):
    check(spark, planted(1))


def test_blocks_alone_equal_brute_force(spark):
    check(spark, planted(2), hub_rounds=0)


def test_given_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    check(spark, docs)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "x")], "doc_id long, text string")
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1, r["kept"]) for r in neardup.near_duplicates(rows).collect())
    assert got == [(-1, -1, True), (4, -1, False), (4, -1, False), (7, 7, True)]


def test_chain_of_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 99), (5, 5), (70, 90), (90, 80)], "a long, b long")
    got = {r["id"]: r["root"] for r in neardup.components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 99, 99: 99, 70: 70, 80: 70, 90: 70}


def test_stars_end_the_component_search_at_once(spark, monkeypatch):
    written = []
    stash = neardup.stash
    monkeypatch.setattr(neardup, "stash", lambda df, label: written.append(label) or stash(df, label))
    stars = [(10 * i + j, 10 * i) for i in range(5) for j in range(1, 10)]
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {i: i - i % 10 for i in range(50)}
    assert len(written) <= 2  # the edges and the result, no round of its own
    written.clear()
    hubs = [(10 * i + j, 10 * i + 5) for i in range(5) for j in range(10)]
    got = {r["id"]: r["root"] for r in neardup.components(spark.createDataFrame(hubs, "a long, b long")).collect()}
    assert got == {i: i - i % 10 for i in range(50)}
    assert len(written) <= 4  # one round


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(4)
    a, b = (np.unique(rng.integers(0, 2**63, 400, dtype=np.uint64)) for _ in range(2))
    assert np.array_equal(np.maximum(neardup.sketch(a), neardup.sketch(b)), neardup.sketch(np.union1d(a, b)))
    for share, wanted in ((0.9, True), (0.75, True), (0.3, False)):
        missed = 0
        for _ in range(200):
            x = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64))
            both = int(500 * 2 * share / (1 + share))
            y = np.concatenate([x[:both], rng.integers(0, 2**63, 500 - both, dtype=np.uint64)])
            p, q = neardup.sketch(x), neardup.sketch(y)
            ok = neardup.not_ruled_out(np.array([(p > q).sum()]), np.array([(p < q).sum()]), np.array([len(x)]), np.array([len(y)]))
            missed += bool(ok[0]) != wanted
        assert missed == 0


def test_hot_keys_are_spread(spark):
    from oddlines.llm.shared import hot_join
    from pyspark.sql import functions as F

    left = spark.range(6000).select("id", F.when(F.col("id") < 5000, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(0, 6000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v")).unionByName(spark.range(1).select(F.lit(1).cast("long").alias("k"), F.lit(7).cast("long").alias("v")))
    for how in ("inner", "left"):
        got, want = (sorted(map(str, x.select("id", "k", "v").collect())) for x in (hot_join(left, right, "k", "id", how), left.join(right, "k", how)))
        assert got == want
    spread = hot_join(left, right, "k", "id").filter("k = 1").groupBy(F.spark_partition_id()).count()
    assert spread._jdf.queryExecution().analyzed() is not None and spread.agg(F.sum("count")).first()[0] == 5000


def test_running_sums(spark):
    from oddlines.llm.shared import running
    from pyspark.sql import functions as F

    rows = spark.range(0, 500).select((F.col("id") * 7 % 500).alias("k"), (F.col("id") % 3).alias("v"))
    got = {r["k"]: (r["v"], r["before"]) for r in running(rows, ["k"], before="v").collect()}
    total = 0
    for k in range(500):
        assert got[k][1] == total
        total += got[k][0]


def test_one_group_of_many_copies(spark):
    words = [f"w{i}" for i in range(40)]
    docs = {i: " ".join(words) for i in range(3000)} | {3000 + i: " ".join(words + [f"x{i}"]) for i in range(1500)} | {9000: None, 9001: "alone"}
    check(spark, docs)


def test_long_texts(spark):
    words = [f"w{i * 7919 % 99991}" for i in range(60_000)]
    check(spark, {1: " ".join(words), 2: " ".join(words[:-3000]), 3: " ".join(words[::-1])})
