import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from oddlines.llm import align, ranking, repeats
from oddlines.llm.tokens import public_path

DOCS = "doc_id long, text string, lang string"
A, B = "byte_bpe_50k.json", "piece_bpe_32k.model"


# ---- 11: ranked search


def _terms(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def _ranked(docs, items, k=50):
    import math

    own = [(d, Counter(_terms(t))) for d, t in docs if _terms(t)]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        hits = []
        for doc, c in own:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(_terms(text)) if t in c)
            if score > 0:
                hits.append((-score, doc is not None, doc or 0, doc))
        out += [(item, rank, h[3], -h[0]) for rank, h in enumerate(sorted(hits)[:k], 1)]
    return out


def _corpus(rnd, n):
    words = [f"w{i}" for i in range(60)] + ["Été", "中文", "naïve", "X1"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.choice([1, 3, 8, 30, 200])))) for i in range(n)]
    docs += [(n + i, "w1 w2, w3-w4 w5") for i in range(80)]  # ties
    return docs + [(None, "w1 w1 w7"), (3, "w1 W2"), (3, "w1 W2"), (n + 90, None), (n + 91, ""), (n + 92, " .,;\n"), (n + 93, "w9 " * 20_000 + "once")]


@pytest.mark.parametrize("block_terms", [1 << 18, 5])
def test_ranked_search_equals_brute_force(spark, block_terms):
    rnd = random.Random(3)
    docs = _corpus(rnd, 300)
    items = [(i, " ".join(rnd.choices([f"w{j}" for j in range(70)] + ["É", "中文", "été"], k=9))) for i in range(12)] + [(50, None), (51, "..."), (None, "w1 w2"), (52, "w1 w2"), (52, "w1 w2"), (53, "absent")]
    index, n_docs, _ = ranking.build_index(spark.createDataFrame([(*d, "x") for d in docs], DOCS).repartition(5))
    found = ranking.search(index, n_docs, spark.createDataFrame(items, "item_id long, text string"), block_terms=block_terms)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(_ranked(docs, items), key=key)


def test_ranked_search_of_empty_tables(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b", "x")], DOCS)
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    index, n_docs, _ = ranking.build_index(none)
    assert ranking.search(index, n_docs, items).collect() == []
    index, n_docs, _ = ranking.build_index(some)
    assert ranking.search(index, n_docs, items.limit(0)).collect() == []
    assert [r.doc_id for r in ranking.search(index, n_docs, items).collect()] == [1]


def test_bounds_hold_and_spare_work():
    rnd = random.Random(4)
    vocabulary = [f"t{i}".encode() for i in range(3000)]
    queries = ranking.Queries([(q, {t: rnd.randint(1, 9000) for t in rnd.sample(vocabulary, 12)}) for q in range(20)])
    best = ranking.Best(queries, 5, np.zeros(20, np.int64))
    columns = defaultdict(list)
    for doc in range(600):
        tf = Counter(rnd.choices(vocabulary, k=rnd.choice([5, 50, 400])))
        counts = np.array(list(tf.values()))
        m = 50 + counts.sum()
        level, sketch = ranking.fold(np.array([ranking.crc32(t) for t in tf], np.uint32), ranking.impacts(counts, m))
        bounds = queries.bounds(sketch[None], level)[0]
        exact = [sum(w * ((10**9 * tf[t]) // (1000 * tf[t] + 20 * m)) for t, w in q.items() if t in tf) for q in queries.terms]
        assert (bounds >= exact).all()
        for name, value in zip(("docs", "ms", "terms", "tfs", "levels", "sketches"), (doc, int(m), b" ".join(tf).decode(), counts.astype("<u4").tobytes(), level, sketch.tobytes())):
            columns[name].append(value)
    best.offer(**columns | {"levels": np.array(columns["levels"])})
    assert best.scored < 600 * 20 / 2


# ---- 12: repeats


def _kept(docs, length):
    order = sorted(range(len(docs)), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    seen, out = set(), []
    for i in order:
        data = (docs[i][1] or "").encode()
        gone = np.zeros(len(data), bool)
        for at in range(len(data) - length + 1):
            if data[at : at + length] in seen:
                gone[at : at + length] = True
            seen.add(data[at : at + length])
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out.append((docs[i][0], len(data), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def _texts(rnd, n, passages):
    letters = "ab é\n"
    out = []
    for i in range(n):
        text = "".join(rnd.choice(passages)[rnd.randint(0, 30) :] if rnd.random() < 0.4 else "".join(rnd.choices(letters, k=rnd.randint(0, 60))) for _ in range(rnd.randint(0, 8)))
        out.append((i, text))
    return out


@pytest.mark.parametrize("length,gram,hot,piece", [(100, 24, 4096, 1 << 20), (20, 8, 4, 256), (12, 5, 3, 64)])
def test_repeats_equal_brute_force(spark, length, gram, hot, piece):
    rnd = random.Random(length)
    passages = ["".join(rnd.choices("abcdefgh éß中", k=rnd.choice([length // 2, length, 3 * length]))) for _ in range(6)]
    docs = _texts(rnd, 120, passages)
    docs += [(200 + i, docs[i % 7][1]) for i in range(30)] + [(300, None), (301, ""), (302, "a" * 5 * length), (303, "ab" * 4 * length), (304, " " * (length - 1)), (305, "a" * length)]
    docs += [(None, passages[0] * 3), (7, passages[1]), (310, "x".join(passages) * 20)]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS).coalesce(1)
    found = repeats.remove_repeats(df, length, gram, hot, block_bytes=2000, piece=piece)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(_kept(docs, length), key=key)


def test_repeats_of_an_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).collect() == []


def test_repeats_leave_no_shuffle_files_of_ended_jobs(spark):
    import gc
    import time

    def shuffled():
        return {f.getName() for f in _files() if f.getName().startswith("shuffle_")}

    def _files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return [found.apply(i) for i in range(found.size())]

    rnd = random.Random(5)
    docs = _texts(rnd, 60, ["".join(rnd.choices("abcdefgh ", k=300)) for _ in range(4)])
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS)
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own, before = spark.conf.get(name, None), shuffled()
    gc.disable()
    try:
        found = repeats.remove_repeats(df)
    finally:
        gc.enable()
    for _ in range(50):  # files are deleted in the background
        if not (left := shuffled() - before):
            break
        time.sleep(0.1)
    assert not left and spark.conf.get(name, None) == own
    assert sorted(map(tuple, found.collect())) == sorted(_kept(docs, 100))


@pytest.mark.parametrize("seed", range(5))
def test_suffix_array_is_sorted(seed):
    rnd = random.Random(seed)
    text = b"\0".join(bytes(rnd.choices(b"ab" if seed % 2 else b"abcdxyz", k=rnd.randint(1, 40))) for _ in range(30)) + b"\0"
    found = repeats.suffix_array(np.frombuffer(text, np.uint8), 64)
    assert sorted(found.tolist()) == list(range(len(text)))
    ends = [text[i : text.index(b"\0", i) + 1] for i in found.tolist()]
    assert ends == sorted(ends)


# ---- 13: alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_path(A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_path(B))


PARTS = ["a", " b", "é", "'s", " ", "  ", "\n", ". ", ",", "12", " the", " word", "中", "😀", "<|endoftext|>", "<s>", "▁", "\t", "re", "İ", "　", "�", " <unk>", "ﬁ"]


def test_ids_are_those_of_the_named_vocabularies(tokenizers):
    rnd = random.Random(6)
    a, b = align.SpacedEncoder(public_path(A)), align.SpacingEncoder(public_path(B))
    texts = ["".join(rnd.choices(PARTS, k=rnd.randint(1, 14))) for _ in range(3000)] + ["ab" * 30_000, " " * 3000 + "x"]
    assert a._fast and a.encode(texts) == [tokenizers[0].encode(f" {t}", add_special_tokens=False).ids for t in texts]
    assert b.encode(texts) == [tokenizers[1].encode(t) for t in texts]
    a._fast = None
    assert a.encode(texts[:50]) == [tokenizers[0].encode(f" {t}", add_special_tokens=False).ids for t in texts[:50]]


def _aligned(docs, tokenizers):
    a, b = tokenizers
    letters = {letter: byte for byte, letter in align._byte_letters().items()}
    pairs, links = Counter(), []
    for _, text in docs:
        ids_a = a.encode(f" {text}", add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(bytes_a) != b"".join(bytes_b) or b"".join(bytes_a) != f" {text}".encode():
            ids_a, ids_b, bytes_a, bytes_b = [], [], [], []
        ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
        own, groups, i, j = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_i, to_j = ends_a.index(end) + 1, ends_b.index(end) + 1
            own.append((ids_a[to_i - 1], ids_b[to_j - 1]))
            groups.append(",".join(map(str, ids_a[i:to_i])) + "|" + ",".join(map(str, ids_b[j:to_j])))
            i, j = to_i, to_j
        pairs.update(own)
        links.append((len(ids_a), len(ids_b), own, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
    most = defaultdict(int)
    for (_, y), n in pairs.items():
        most[y] = max(most[y], n)
    return [(doc, n_a, n_b, len(own), len(own), digest, sum(pairs[p] == most[p[1]] for p in own), sum(pairs[p] for p in own)) for (doc, _), (n_a, n_b, own, digest) in zip(docs, links)]


@pytest.mark.parametrize("block_bytes", [align.BLOCK_BYTES, 300])
def test_alignment_equals_brute_force(spark, tokenizers, block_bytes):
    rnd = random.Random(8)
    docs = [(i, "".join(rnd.choices(PARTS, k=rnd.randint(0, 30)))) for i in range(150)]
    docs += [(200, None), (201, ""), (None, "one two"), (3, "again"), (3, "again"), (202, "the quick brown " * 5000), (203, " "), (204, "▁")]
    df = spark.createDataFrame([(*d, "x") for d in docs], DOCS).repartition(3)
    found = align.align(df, public_path(A), public_path(B), block_bytes=block_bytes)
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=lambda r: str(key(r))) == sorted(_aligned(docs, tokenizers), key=lambda r: str(key(r)))


def test_alignment_of_an_empty_table(spark):
    assert align.align(spark.createDataFrame([], DOCS), public_path(A), public_path(B)).collect() == []


# ---- the registered queries over the small tables

SF = "/root/testdata/sf0.001"


def _documents():
    import duckdb

    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY ALL").fetchall()


def test_op11_equals_sql(spark):
    import duckdb
    from oddlines.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(SQL["op11_ranked_search"])
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES["op11_ranked_search"](spark, SF).select(*names).collect())) == sorted(want.fetchall())


def test_op12_equals_brute_force(spark):
    from oddlines.llm.queries import QUERIES

    assert sorted(map(tuple, QUERIES["op12_repeats"](spark, SF).collect())) == sorted(_kept(_documents(), 100))


def test_op13_equals_brute_force(spark, tokenizers):
    from oddlines.llm.queries import QUERIES

    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted(map(tuple, QUERIES["op13_alignment"](spark, SF).select(*columns).collect())) == sorted(_aligned(_documents(), tokenizers))
