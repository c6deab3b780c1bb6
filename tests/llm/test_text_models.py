import functools
import hashlib
import math
import random
import re

import numpy as np
import xxhash
from oddlines.llm import langid, syncmers
from pyspark.sql import functions as F


def _tree(texts, **more):
    keys, n = np.unique(np.concatenate([langid.keys_of(p) for t in texts for p in langid.slices(t)]), return_counts=True)
    return langid.build_tree(keys, n.astype(float), **more)


class Plain:
    """PPM by dictionaries: P(symbol | context), escaping to shorter contexts with exclusion."""

    def __init__(self, texts, grow):
        self.grow, self.seen = grow, {}
        for text in texts:
            for part in langid.slices(text):
                for i in range(langid.DEPTH, len(part)):
                    for order in range(langid.DEPTH + 1):
                        found = self.seen.setdefault(part[i - order : i], {})
                        found[part[i]] = found.get(part[i], 0) + 1

    def share(self, context, symbol):
        found = self.seen.get(context, {})
        lower = (lambda s: self.share(context[1:], s)) if context else (lambda s: 1 / 256)
        if not found or len(context) > 2 and sum(found.values()) < self.grow:
            return lower(symbol)
        n, kinds = sum(found.values()), len(found)
        if symbol in found:
            return found[symbol] / (n + kinds)
        return kinds / (n + kinds) * lower(symbol) / (1 - sum(map(lower, found)))

    def bits(self, text):
        return -sum(math.log2(self.share(p[i - langid.DEPTH : i], p[i])) for p in langid.slices(text) for i in range(langid.DEPTH, len(p)))


def test_code_lengths_equal_a_plain_ppm():
    learnt = ["the theme of the thesis is thin, the thief thinks", "Überall über übermut", "then there they"] * 3
    for grow in (2, 4):
        tree, plain = _tree(learnt, grow=grow), Plain(learnt, grow)
        model = langid.Model(["x"], [tree])
        for text in ("the thesis", "zebra", "übel then ⅷ", "t"):
            assert abs(model.code_lengths([text])[0, 0] - plain.bits(text)) < 1e-3
        for context in (b"     ", b"the t", b"zzzzz", b"  the"):
            keys = np.array([int.from_bytes(context[::-1] + bytes([s]), "big") for s in range(256)], np.uint64)
            assert abs(np.exp2(-tree.costs(keys).astype(float)).sum() - 1) < 1e-4


def test_slices_add_up_and_small_trees_are_small(monkeypatch):
    rnd = random.Random(4)
    text = " ".join("".join(rnd.choices("abcdefé", k=rnd.randint(1, 9))) for _ in range(3000))
    tree = _tree([text])
    whole = langid.Model(["x"], [tree]).code_lengths([text, "abc", text])
    monkeypatch.setattr(langid, "_SLICE", 100)
    parts = langid.Model(["x"], [tree]).code_lengths([text, "abc", text])
    assert np.allclose(whole, parts) and abs(whole[0, 0] - whole[2, 0]) < 1e-6
    small = _tree(["One short text of a label that nobody else has."])
    assert sum(x.nbytes for pair in [*small.nodes, *small.contexts] for x in pair) + small.base.nbytes < 20_000


def test_small_languages_and_copies_stay_in_the_model(spark):
    rows = [("aa", f"the small house number {chr(97 + i % 26)}{chr(97 + i // 26)} is here") for i in range(60)] + [("bb", "ein kurzer satz")] + [("cc", "une phrase qui se trouve partout")] * 500 + [(None, "x"), ("dd", None), ("ee", "uno"), ("ee", "dos")]
    df = spark.createDataFrame(rows, "lang string, text string")
    model = langid.train(df, max_train_docs=10)
    assert model.languages == ["aa", "bb", "cc", "ee"]
    taken = langid._sample(df.dropna(), 10, 10**6).groupBy("lang").count().collect()
    counts = {r["lang"]: r["count"] for r in taken}
    assert 1 <= counts["aa"] <= 25 and counts["bb"] == counts["cc"] == 1 and counts["ee"] == 2
    assert langid._sample(df.dropna(), 10, 1).count() == 4


def test_held_out_accuracy_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(docs.filter(~langid.held_out()).select("text", "lang"))
    got = langid.predict(docs.filter(langid.held_out()), model, keep=("lang",)).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.99 * len(got) > 100
    odd = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "12 $$ 3", 0.5), (4, "the and of thing " * 40_000, 0.5), (5, "퟿中", 0.5), (6, "½ ² Ⅷ", 0.5), (None, "le monde", 0.5)], "doc_id long, text string, score double")
    rows = {r["doc_id"]: r for r in langid.predict(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3, 4, 6, None)] == ["und", "und", "und", "en", "und", "fr"] and rows[5]["lang_pred"] in model.languages
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    none = langid.train(docs.limit(0).select("text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}


def test_held_out_is_by_crc(spark):
    import zlib

    got = spark.range(200).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_fingerprints_and_edits(spark):
    words = [f"w{i * 7919 % 997}" for i in range(600)]
    texts = [" ".join(words[:300]), " ".join(words[:300]), None, "", "one two", "é😀" * 50, " ".join(words[300:])]
    rows = [(10 * i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, k string")
    got = {r["doc_id"]: r for r in syncmers.compare_with_edits(df).select("*", syncmers.shown(F.col("prints")).alias("p")).collect()}
    order = sorted(got, reverse=True)
    for i, d in enumerate(order):
        text, after = (texts[x // 10] or "" for x in (d, order[(i + 1) % len(order)]))
        cut = len(text) // 3
        edited = text[: len(text) - cut] + after[:cut]
        assert (got[d]["n_chars"], got[d]["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[d]["near_edited"] <= 1 and 0 <= got[d]["near_next"] <= 1
    assert got[0]["p"] == got[10]["p"] != "" and got[20]["p"] == got[30]["p"] == ""
    assert got[10]["near_next"] == 1 and got[0]["near_edited"] > 0.3 and got[60]["near_next"] == 0
    one = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "doc_id long, text string")
    assert syncmers.compare_with_edits(one).first()["near_next"] == 1
    assert syncmers.compare_with_edits(df.limit(0)).count() == 0
    same_ids = spark.createDataFrame([(1, "a b c"), (1, "d e f g"), (2, "h i j"), (None, "k")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0) for r in syncmers.compare_with_edits(same_ids).collect()) == [0, 1, 1, 2]


def brute_print(text):
    """{hash: first position} by direct hashing."""
    h = lambda *x: functools.reduce(lambda seed, v: xxhash.xxh64_intdigest(v if isinstance(v, bytes) else v.to_bytes(8, "little"), seed=seed), x, 42)
    symbols = [m[0] for m in re.finditer(syncmers.SYMBOL, text)]
    t = [h(x.encode()) for x in symbols]
    signed = lambda v: v - 2**64 if v >= 2**63 else v
    found = {}
    for i in range(len(t) - 2):
        three = list(map(signed, t[i : i + 3]))
        if min(three) in (three[0], three[2]):
            found.setdefault(h(*t[i : i + 3]) & 0xFFFFFFFF, i)
    if not found and symbols:
        found = {h(" ".join(symbols).encode()) & 0xFFFFFFFF: 0}
    return found


def test_prints_equal_brute_force(spark):
    rnd = random.Random(8)
    texts = ["".join(rnd.choices("abeioz9XYZ中ü (.\n", k=rnd.randint(0, 200))) for _ in range(60)] + ["", " ", "a", "xyz", "The quick brown fox"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", syncmers.fingerprint(F.col("t")).alias("p"))
    for r in df.collect():
        assert {x >> 31: x & (2**31 - 1) for x in r["p"]} == brute_print(r["t"]) and r["p"] == sorted(r["p"])


def test_anchors_are_context_free(spark):
    rnd = random.Random(9)
    for letters, joint in (("天地玄黄宇宙洪荒日月盈昃", ""), ("abcdefghijklmnopqrstuvwxyz0123456789", ""), ("กขคงจฉชซ", ""), ("abcdefgh", " ")):
        passage = joint.join("".join(rnd.choices(letters, k=7)) for _ in range(60))
        df = spark.createDataFrame([(passage,), ("e" + "x" * 5 + passage,), (passage + "zz",)], "t string")
        one, moved, longer = ({x >> 31 for x in r[0]} for r in df.select(syncmers.fingerprint(F.col("t"))).collect())
        assert len(one & moved) >= 0.8 * len(one) and len(one & longer) >= 0.95 * len(one) and len(one) >= 15


def test_short_edits_stay_near(spark):
    rnd = random.Random(10)
    word = lambda: "".join(rnd.choices("aeiourstlndmcb", k=rnd.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(4 + i % 4))) for i in range(400)]
    got = {r["doc_id"]: r for r in syncmers.compare_with_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [sum(got[i]["near_edited"] > 0 for i in range(n, 400, 4)) for n in range(4)]
    # texts of 4, 5, 6 and 7 words, of which two thirds are unchanged
    assert near[0] >= 35 and near[1] >= 75 and min(near[2:]) >= 90, near
    assert sum(r["near_next"] > 0 for r in got.values()) <= 20


def test_next_over_ranges(spark):
    rnd = random.Random(1)
    for ids in (list(range(0, 900, 3)), [5], [5, 5, 5], [None, 1, 1, 9, 9, 9, 4], [7] * 200 + [8, 6]):
        rows = [(-(2**63) if i is None else i, "".join(rnd.choices("ab", k=3))) for i in ids]
        df = spark.createDataFrame(rows, "k long, text string")
        least = {}
        for k, text in rows:
            h = xxhash.xxh64_intdigest(text.encode(), seed=42)
            h -= 2**64 if h >= 2**63 else 0
            least[k] = min(least.get(k, (2**63, "")), (h, text))
        order = sorted(least)
        want = sorted((k, t, t.upper(), (x := least[order[order.index(k) - 1]][1]), x.upper()) for k, t in rows)
        got = sorted((r["k"], r["text"], r["own"], r["next"]["text"], r["next"]["own"]) for r in syncmers.beside_next(df, F.upper("text")).collect())
        assert got == want


def test_a_passage_shared_by_long_texts_is_found(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choices("abcdefghij", k=6))
    passage = [word() for _ in range(80)]
    one, other = ([word() for _ in range(3000)] + passage + [word() for _ in range(n)] for n in (3000, 200))
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(other))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in syncmers.compare_with_edits(df).collect()}
    assert all(len(got[d]["prints"]) > 1000 for d in got)

    def plain(a, b):
        a, b = ({x >> 31: x & (2**31 - 1) for x in y} for y in (a, b))
        moved = sorted(a[h] - b[h] for h in a.keys() & b.keys())
        return sum(abs(d - moved[len(moved) // 2]) <= 64 for d in moved) / len(a.keys() | b.keys()) if moved else 0

    assert got[2]["near_next"] == plain(got[2]["prints"], got[1]["prints"]) > 0
    assert all(abs(got[d]["near_edited"] - plain(got[d]["prints"], got[d]["edited_prints"])) < 1e-12 for d in got)
