import hashlib
from collections import Counter

import numpy as np
from oddlines.llm import mixing


def test_water_fill_stops_and_shares():
    assert mixing.water_fill([10, 10], [5, 1], 20, 2) == [20 * 5 / 6, 20 / 6]
    assert mixing.water_fill([1, 10, 10], [5, 2, 1], 21 * 1.5, 2) == [2, (31.5 - 2) * 2 / 3, (31.5 - 2) / 3]
    assert mixing.water_fill([0, 4], [5, 2], 6, 2) == [0, 6]
    assert mixing.water_fill([], [], 0, 2) == []


def test_split_quotas_add_up_and_repeat():
    blocks = [1000, 30, 0, 7]
    a = mixing.split_quotas(blocks, 7, 3)
    assert a.sum(axis=1).tolist() == blocks and (a >= 0).all() and np.array_equal(a, mixing.split_quotas(blocks, 7, 3))
    assert abs(a.sum(axis=0) - 1037 / 7).max() <= 3


def _mix(spark, rows, **more):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, target int, size string"), **more)


def test_given_columns_are_met():
    a = mixing.split_quotas([5, 0, 9], 3, [1, 2], np.array([4, 7, 3]))
    assert a.sum(axis=0).tolist() == [4, 7, 3] and a.sum(axis=1).tolist() == [5, 0, 9]


def brute(rows, per_block, weights=(5, 2, 1), seed=11):
    """(doc_id, source) -> words taken, by a plain walk along each source's permuted blocks."""
    md5 = lambda *x: hashlib.md5(":".join(str(i) for i in x if i is not None).encode()).hexdigest()
    by = {}
    for d, text, source, *_ in rows:
        by.setdefault(source, []).append((md5(seed, d), -1 if d is None else d, len((text or "").split())))
    names = sorted(by, key=lambda x: (x is None, x or ""))
    sizes = [sum(n for *_, n in by[x]) for x in names]
    targets = mixing.water_fill(sizes, [weights[i % 3] for i in range(len(names))], 1.5 * sum(sizes), 2)
    taken = Counter()
    for name, target in zip(names, targets):
        blocks = {}
        for key, d, n in sorted(by[name]):
            blocks.setdefault(int(int(key[:8], 16) / 2**32 * -(-len(by[name]) // per_block)), []).append((d, n))
        left = int(target + 0.5)
        for p in (0, 1):
            for b in sorted((b for b in blocks if sum(n for _, n in blocks[b])), key=lambda b: (md5(seed + 1, p, b), b)):
                for d, n in blocks[b]:
                    taken[d, name] += min(left, n)
                    left -= min(left, n)
    return {k: n for k, n in taken.items() if n}


def test_taken_words_are_those_of_the_drawn_blocks(spark):
    rows = [(i, "w " * (i % 13), ("a", "b", None)[i % 3], 0, "") for i in range(600)] + [(1000, None, "c", 0, ""), (1, "w", "b", 0, ""), (1, "w", "b", 0, ""), (None, "w w", "b", 0, "")]
    got = _mix(spark, rows, docs_per_block=8, shards=5).collect()
    assert len(got) == len(rows)
    found, line = Counter(), {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == sum(d["take"] for d in r["draws"])
        assert all(d["take"] > 0 and 0 <= d["shard"] < 5 for d in r["draws"]) and len({d["pass"] for d in r["draws"]}) == len(r["draws"])
        found[-1 if r["doc_id"] is None else r["doc_id"], r["source"]] += r["taken"]
        for d in r["draws"]:
            line.setdefault(d["shard"], []).append((r["source"], r["doc_id"], d["pass"]))
    assert {k: n for k, n in found.items() if n} == brute(rows, 8)
    assert set(line) == set(range(5)) and max(map(len, line.values())) < 3 * min(map(len, line.values()))
    again = _mix(spark, list(reversed(rows)), docs_per_block=8, shards=5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert _mix(spark, rows[:0]).collect() == []
    assert [r["taken"] for r in _mix(spark, [(1, None, None, 0, ""), (2, "", "a", 0, "")]).collect()] == [0, 0]


def test_many_sources(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 7)
    rows = [(i, "w " * (1 + i % 5), f"s{i % 41:02}", 0, "") for i in range(400)]
    got = Counter()
    for r in _mix(spark, rows, docs_per_block=2, shards=3).collect():
        got[r["doc_id"], r["source"]] += r["taken"]
    assert {k: n for k, n in got.items() if n} == brute(rows, 2)


def test_shards_are_written_shuffled(spark, tmp_path):
    rows = [(i, "w w w", "a", 0, "") for i in range(50)]
    draws = mixing.mixed_rows(_mix(spark, rows, docs_per_block=4, shards=3))
    mixing.write_shards(draws, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == draws.count()


def test_first_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a\tb  c ", 2), ("a", 5), ("", 1)], "t string, n long")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a\tb", "a", ""]
