"""Alignment of two tokenizers' ids by the bytes that they cover, and corpus-wide counts of aligned id pairs.

Tasks go over blocks of texts with Arrow columns: ids are nested lists, flattened with their parents' indices; each id's
length in bytes is taken from a table, and segmented running sums give the byte offsets at which tokens end. An Acero hash
join on document-end keys (document and end) finds the tokens of both sides that end together; each such pair is a link,
and closes a group of A and B ids that cover the same bytes. ``Table.group_by`` counts a block's id pairs, and Spark merges
these counts over all blocks. A block then meets the totals of its own distinct pairs by a cogrouped join on its number, so
that neither the vocabulary nor the links of the corpus stand in one place.

A's ids are those of a byte-level BPE of the tokenizers library, B's those of a sentencepiece model with byte fallback. Both
read special tokens inside texts as plain text, and both read a text with one space before it.

Defined results: a text that is null or empty, or whose A or B tokens don't spell out a space and the text, has no tokens:
zeros and an empty digest. Texts are read whole, of whatever length (a long one is a block of its own); rows that repeat a
doc_id are documents each, null included; ties for the greatest count of a B id all count; an empty table gives an empty
result; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stash
from .tokens import _byte_letters

#: Bytes of text that make a block.
BLOCK_BYTES = 1 << 18
_END = 32
_DOC = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_BLOCK = f"block long, docs array<struct<{_DOC.replace(' long', ': long').replace(' string', ': string')}>>, links binary, pairs array<long>, pair_links array<long>"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>").fullmatch


#: Fixed value: how byte-level BPE cuts a text before it merges bytes.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class SpacedEncoder:
    """Ids of a space and the text by a byte-level BPE of the tokenizers library, special tokens' strings as plain text.

    Where merges are ranked by their ids and texts are cut by ``_CUTS``, as a probe shows, tiktoken gives the same ids from
    the same vocabulary in half the time; any other vocabulary is left to the tokenizers library."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self._whole = Tokenizer.from_file(path)
        self._whole.encode_special_tokens = True
        letters = {letter: b for b, letter in _byte_letters().items()}
        self.token_bytes = [bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode() for token in map(self._whole.id_to_token, range(self._whole.get_vocab_size()))]
        special = self._whole.get_added_tokens_decoder()
        ranks = {b: i for i, b in enumerate(self.token_bytes) if i not in special}
        self._fast = None
        if all(bytes([b]) in ranks for b in range(256)):
            self._fast = tiktoken.Encoding("ranks", pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={})
            probe = "The quick, brown fox: Élan  vital! x2 3.14 (a)b\n New line.\t\n\nüber straße don't <|x|> 'quoted' 中文 ²Ⅷ end " + "".join(special[i].content for i in special)
            if self._fast.encode_ordinary(f" {probe}") != self._slow(probe):
                self._fast = None

    def _slow(self, text: str) -> list[int]:
        return self._whole.encode(f" {text}", add_special_tokens=False).ids

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._fast.encode_ordinary(f" {t}") if self._fast else self._slow(t) for t in texts]


class SpacingEncoder:
    """Ids by a sentencepiece model, which puts a space before a text itself."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        names = [self._model.id_to_piece(i) for i in range(self._model.get_piece_size())]
        self.token_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE(name)) else name.replace("▁", " ").encode() for name in names]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


class Side:
    """One tokenizer: its encoder, and by id the bytes and their number."""

    def __init__(self, encoder: SpacedEncoder | SpacingEncoder):
        self.encode = encoder.encode
        self.spelt = pa.array(encoder.token_bytes, pa.binary())
        self.lengths = pa.array([len(b) for b in encoder.token_bytes], pa.int64())

    def lists(self, texts: list[str | None]) -> pa.ListArray:
        found = iter(self.encode([t for t in texts if t]))
        return pa.array([next(found) if t else [] for t in texts], pa.list_(pa.int32()))

    def spells(self, ids: pa.ListArray, expected: pa.Array) -> np.ndarray:
        """Which lists spell out what is expected."""
        parts = pa.ListArray.from_arrays(ids.offsets, self.spelt.take(ids.flatten()))
        return pc.equal(pc.binary_join(parts, pa.scalar(b"", pa.binary())), expected).to_numpy(zero_copy_only=False)

    def ends(self, ids: pa.ListArray) -> pa.Array:
        """By flattened id: the document's place and, in the low bits, the byte offset at which the token ends."""
        parents = ids.value_parent_indices()
        running = pc.cumulative_sum(self.lengths.take(ids.flatten()))
        firsts = ids.offsets.to_numpy()[:-1]
        before = np.concatenate([[0], running.to_numpy()])[firsts]
        return pc.add(pc.subtract(running, pa.array(before).take(parents)), pc.shift_left(pc.cast(parents, pa.int64()), _END))


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[Side, Side, pa.Array]:
    """Both tokenizers, and the strings of ids within groups: A's with "," and "|" after them, B's with ",", ";" and none."""
    a, b = Side(SpacedEncoder(a_path)), Side(SpacingEncoder(b_path))
    marks = [f"{i}{m}" for i in range(len(a.spelt)) for m in ",|"] + [f"{i}{m}" for i in range(len(b.spelt)) for m in (",", ";", "")]
    return a, b, pa.array(marks, pa.string())


def _shown(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, docs: np.ndarray, n_a: int, marks: pa.Array) -> list[str]:
    """Each document's groups in writing. a_ends, b_ends: places of the last id of each group on both sides; docs: the bounds
    of the documents in numbers of groups."""
    a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    a_last[a_ends], b_last[b_ends] = 1, 1
    full = docs[1:][docs[1:] > docs[:-1]]
    b_kind = b_last.copy()
    b_kind[b_ends[full - 1]] = 2
    a_group, b_group = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
    line = np.empty(len(a) + len(b), np.int32)
    b_before = np.concatenate([[0], b_ends + 1])
    line[np.arange(len(a)) + b_before[a_group]] = 2 * a + a_last
    line[np.arange(len(b)) + (a_ends + 1)[b_group]] = 2 * n_a + 3 * b + b_kind
    bounds = np.concatenate([[0], a_ends + 1])[docs] + b_before[docs]
    parts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), marks.take(pa.array(line)))
    return pc.binary_join(parts, "").to_pylist()


def align_block(doc_ids: list[int | None], texts: list[str | None], a: Side, b: Side, marks: pa.Array) -> dict[str, object]:
    """A block's documents, links (numbers of id pairs, document by document), its distinct id pairs and their links."""
    expected = pa.array([b" " + t.encode() if t else b"" for t in texts], pa.binary())
    a_ids, b_ids = a.lists(texts), b.lists(texts)
    right = a.spells(a_ids, expected) & b.spells(b_ids, expected)
    if not right.all():
        texts = [t if ok else None for t, ok in zip(texts, right)]
        a_ids, b_ids = a.lists(texts), b.lists(texts)
    places = lambda ids: pa.array(np.arange(len(ids.flatten())), pa.int32())
    left = pa.table({"key": a.ends(a_ids), "a": a_ids.flatten(), "a_at": places(a_ids)})
    other = pa.table({"key": b.ends(b_ids), "b": b_ids.flatten(), "b_at": places(b_ids)})
    links = left.join(other, "key", join_type="inner", use_threads=False).sort_by("key")
    docs = np.searchsorted(links["key"].to_numpy() >> _END, np.arange(len(texts) + 1))
    n_links = np.diff(docs).tolist()
    pair = pc.bit_wise_or(pc.shift_left(pc.cast(links["a"], pa.int64()), 32), pc.cast(links["b"], pa.int64())).combine_chunks()
    encoded = pc.dictionary_encode(pair)
    counted = pa.table({"pair": encoded.indices}).group_by("pair", use_threads=False).aggregate([("pair", "count")]).sort_by("pair")
    written = _shown(a_ids.flatten().to_numpy(), b_ids.flatten().to_numpy(), links["a_at"].to_numpy(), links["b_at"].to_numpy(), docs, len(a.spelt), marks)
    sizes = [pc.list_value_length(ids).to_pylist() for ids in (a_ids, b_ids)]
    names = [x.split()[0] for x in _DOC.split(", ")]
    rows = zip(doc_ids, *sizes, n_links, n_links, (hashlib.sha256(w.encode()).hexdigest() if w else "" for w in written))
    return {"docs": [dict(zip(names, r)) for r in rows], "links": encoded.indices.to_numpy().astype("<i4").tobytes(), "pairs": encoded.dictionary.to_pylist(), "pair_links": counted["pair_count"].to_pylist()}


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of documents with their links. Written and read back, since block numbers hang on the tasks that made them."""
    schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.struct([(n.split()[0], pa.string() if "string" in n else pa.int64()) for n in _DOC.split(", ")]))), ("links", pa.binary()), ("pairs", pa.list_(pa.int64())), ("pair_links", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, marks = sides(a_path, b_path)
        base, made, size = TaskContext.get().partitionId() << 32, 0, 0
        ids: list[int | None] = []
        texts: list[str | None] = []

        def close() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"block": base + made} | align_block(ids, texts, a, b, marks)], schema=schema)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                length = len(text.as_buffer()) if text.is_valid else 0
                if ids and size + length > block_bytes:
                    yield close()
                    made, size, ids, texts = made + 1, 0, [], []
                ids.append(doc)
                texts.append(text.as_py())
                size += length
        if ids:
            yield close()

    return stash(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _BLOCK), "aligned-blocks")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """pair (A's id << 32 | B's id), its links corpus-wide, and whether no pair of its B id has more."""
    partial = blocks.select(F.explode(F.arrays_zip("pairs", "pair_links")).alias("p")).select("p.pairs", "p.pair_links")
    counts = stash(partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("pair_links").alias("count")), "aligned-pairs")
    b_id = F.col("pair").bitwiseAND((1 << 32) - 1)
    # a row for each of B's ids at most
    most = F.broadcast(counts.groupBy(b_id.alias("b")).agg(F.max("count").alias("most")))
    return counts.join(most, b_id == F.col("b")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: its numbers of tokens, groups and links, the digest of its groups, how many links are of the
    commonest pair of their B id, and the sum of its links' corpus-wide counts."""
    blocks = aligned_blocks(docs, a_path, b_path, id_col, text_col, block_bytes)
    held = blocks.select("block", F.posexplode("pairs").alias("no", "pair"))
    met = held.join(pair_counts(blocks), "pair").select(F.col("block").alias("of"), "no", "count", "best")
    names = [*(x.split()[0] for x in _DOC.split(", ")), "n_best", "count_sum"]

    def run(block: pa.Table, pairs: pa.Table) -> pa.Table:
        counts, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        order = pairs["no"].to_numpy()
        counts[order], best[order] = pairs["count"].to_numpy(), pairs["best"].to_numpy(zero_copy_only=False)
        found = block["docs"].combine_chunks().flatten()
        links = np.frombuffer(block["links"][0].as_py(), "<i4")
        ends = np.cumsum([0, *found.field("n_links").to_pylist()])
        summed = [pa.array(np.diff(np.concatenate([[0], np.cumsum(x[links])])[ends])) for x in (best, counts)]
        return pa.table([*(found.field(n) for n in names[:-2]), *summed], names=names)

    return blocks.select("block", "docs", "links").groupBy("block").cogroup(met.groupBy("of")).applyInArrow(run, f"{_DOC}, n_best long, count_sum long")
