import random
from collections import defaultdict

import numpy as np
import pytest
from oddlines.llm import idfiles, packing
from oddlines.llm.tokens import encoder, public_path

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
BITS = ["a", "B", "é", "'s", "'", "t", " ", "  ", "\n", ".", ",", "1", "23", " ", "š", "ß", "ª", "́", "<|endoftext|>", "<", "中", "文", "\t", "İ", "Σ", "\x1c", "re", " the", "😀", "²"]


@pytest.mark.parametrize("name", NAMES)
def test_pieces_give_the_tokenizers_ids(name):
    enc, rnd = encoder(public_path(name)), random.Random(5)
    assert enc._piecewise
    for _ in range(4000):
        text = "".join(rnd.choices(BITS, k=rnd.randint(1, 14)))
        assert enc.encode(text) == enc._full(text), text
    assert enc.encode(None) == enc.encode("") == b""


def test_memo_is_bounded():
    from oddlines.llm.tokens import PieceEncoder

    enc = PieceEncoder(public_path(NAMES[0]), max_pieces=10)
    text = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(100))
    assert enc.encode(text) == enc._full(text) and len(enc) <= 10


@pytest.mark.parametrize("window", [16, 64])
def test_packing_keeps_every_id_once(window):
    rnd = random.Random(window)
    docs = [(i, bytes(4 * rnd.choice([1, 2, 3, 5, 7, window - 1, window, window + 3, 5 * window + 1]))) for i in range(400)]
    docs = [(d, np.arange(d * 1000, d * 1000 + len(b) // 4, dtype="<u4").tobytes()) for d, b in docs]
    seen, partial = defaultdict(list), []
    for sequence in packing.pack_partition(iter(docs), window):
        fill = sum(len(p[3]) // 4 for p in sequence)
        assert fill == window or fill & (fill - 1) == 0
        partial += [fill] * (fill < window)
        for doc, start, total, ids in sequence:
            assert ids == dict(docs)[doc][4 * start : 4 * start + len(ids)] and total == len(dict(docs)[doc]) // 4
            seen[doc].append((start, len(ids) // 4))
    for doc, ids in docs:
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == len(ids) // 4
    assert len(partial) == len(set(partial)) <= window.bit_length()


def test_level_choice_minimises_the_sum_of_squares():
    rnd = random.Random(1)
    packer = packing.SumOfSquares(12)
    for step in range(200):
        packer.count[:] = [0] + [rnd.randint(0, 3) for _ in range(11)] + [0]
        size = rnd.randint(1, 12)
        best = []
        for level in range(0, 13 - size):
            if level == 0 or packer.count[level]:
                after = packer.count.copy()
                after[level] -= level > 0
                after[level + size] += 1
                best.append((int((after[1:12] ** 2).sum()), -level))
        assert packer.level_for(size) == -min(best)[1]


def test_pack_edge_rows(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "word " * 3000, 0), (3, "x", 0), (3, "x", 0)], "doc_id long, text string, length int")
    got = packing.pack(df, public_path(NAMES[0])).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 1) == 1 and sum(r["length"] for r in got if r["doc_id"] == 3) == 4
    assert packing.pack(df.limit(0), public_path(NAMES[0])).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 13, 16, 17, 32])
def test_bits_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 2**bits, 1000, dtype=np.uint64).astype("<u4")
    data = idfiles.pack_bits(ids, bits)
    assert len(data) == -(-1000 * bits // 8)
    for a, b in ((0, 1000), (7, 7), (3, 11), (995, 1000)):
        assert np.array_equal(idfiles.unpack_bits(data, bits, a, b), ids[a:b])


def test_id_files_read_back(spark, tmp_path):
    rows = [(5, "b c"), (3, None), (None, "n"), (9, ""), (7, "long " * 5000), (7, "long")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int")
    path, enc = str(tmp_path / "ids"), encoder(public_path(NAMES[1]))
    idfiles.write_ids(df, path, public_path(NAMES[1]), block_ids=64)
    got = sorted(idfiles.read_ids(spark, path).collect(), key=lambda r: r["start"])
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (doc, text), r in zip(want, got, strict=True):
        ids = enc._full(text or "") + b"\1\0\0\0"
        assert (r["doc_id"], r["start"], r["n_tokens"], bytes(r["ids"])) == (doc, at, len(ids) // 4, ids)
        at += len(ids) // 4
    only = idfiles.read_ids(spark, path, only=[9, 5]).collect()
    assert sorted(map(str, only)) == sorted(str(r) for r in got if r["doc_id"] in (5, 9))
    idfiles.write_ids(df.limit(0), str(tmp_path / "none"), public_path(NAMES[1]))
    assert idfiles.read_ids(spark, str(tmp_path / "none")).count() == 0


def test_packing_query_on_given_documents(spark):
    import zlib

    from oddlines.llm.queries import op3_packing
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    ids = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in op3_packing(spark, "/root/testdata/sf0.001").collect():
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for groups, end in ((pieces, lambda d: len(ids[d])), (sequences, lambda s: sum(n for _, n in sequences[s]))):
        for name, found in groups.items():
            at = 0
            for start, length in sorted(found):
                assert start == at and length > 0
                at += length
            assert at == end(name)
    assert all((n := sum(x for _, x in s)) == 1024 or n & (n - 1) == 0 for s in sequences.values())
