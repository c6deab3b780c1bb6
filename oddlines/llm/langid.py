"""Language identification by prediction by partial matching (PPM).

Every language has a byte context tree of variable order: contexts of 0 to 2 bytes are all kept, a longer one (up to
``DEPTH`` bytes) where it has been seen ``grow`` times. A context with n symbols of d kinds gives a seen symbol c / (n + d)
and escapes with d / (n + d) (method C) to the context that is one byte shorter, with exclusion: what the longer context
has seen is left out of the shorter one's share, so each context's code is complete. Statistics are frozen after training,
so that the exact code lengths of seen symbols and of escapes are entries of the tree. A text is scored by looking up its
distinct (context, byte) keys and adding; the language with the shortest code wins, its score is its posterior share under
equal priors.

Training takes a bounded sample of the labelled documents: of each language's distinct texts, chosen by a hash of the
text, about ``max_train_docs`` texts and ``max_train_chars`` characters at most, and one in any case. One task builds one
language's tree, which these bounds keep small: 12 bytes a (context, byte) pair and 1 kB, some 10 kB for a label of one
short text. The trees go to the executors as one broadcast. Texts are scored whole, in slices, so memory does not grow
with them.

Defined results: a null text, a text without a letter and any text where nothing was learnt get ``und`` with score 0;
ties go to the smaller language name; repeated rows get the same result each; an empty table gives an empty result; a null
doc_id is never held out; columns of other names are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import modest_batches

UNKNOWN = "und"
DEPTH = 5
#: ASCII bytes other than letters count as one, a space.
_FOLD = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SLICE = 1 << 18
_OUT_ROWS, _OUT_CHARS = 512, 1 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def slices(text: str) -> Iterator[bytes]:
    """The text's folded bytes in slices, each behind the DEPTH bytes before it (spaces at the start), a space at the end."""
    last = b" " * DEPTH
    for at in range(0, len(text), _SLICE):
        part = last + text[at : at + _SLICE].lower().encode("utf-8", "replace").translate(_FOLD)
        if at + _SLICE >= len(text):
            part += b" "
        yield part
        last = part[-DEPTH:]


def keys_of(data: bytes) -> np.ndarray:
    """For each byte after the first DEPTH: those before it, the nearest one highest, and itself as the lowest byte, as one
    number. Sorted keys then have their contexts of any order sorted too."""
    b = np.frombuffer(data, np.uint8)
    n = max(0, len(b) - DEPTH)
    out = np.zeros(n, np.uint64)
    for back in (*range(1, DEPTH + 1), 0):
        out = (out << np.uint64(8)) | b[DEPTH - back : DEPTH - back + n]
    return out


def _context(keys: np.ndarray, order: int) -> np.ndarray:
    return keys >> np.uint64(8 * (DEPTH + 1 - order))


def _coded(context: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """(context, byte) pairs: the contexts and the lowest bytes of keys."""
    return (context << np.uint64(8)) | (keys & np.uint64(255))


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in the sorted table, and whether they are there."""
    at = np.minimum(np.searchsorted(table, keys), max(len(table) - 1, 0))
    return at, (table[at] == keys) if len(table) else np.zeros(len(keys), bool)


@dataclass(frozen=True)
class Tree:
    """Code lengths in bits. base: of a byte without context. nodes, contexts: for each order from 1 to DEPTH sorted keys and
    code lengths, of (context, byte) pairs and of a context's escape."""

    base: np.ndarray
    nodes: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]

    def costs(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), np.float32), np.arange(len(keys))
        for order in range(DEPTH, 0, -1):
            left = keys[open_]
            context = _context(left, order)
            at, hit = _find(self.nodes[order - 1][0], _coded(context, left))
            out[open_[hit]] += self.nodes[order - 1][1][at[hit]]
            open_, context = open_[~hit], context[~hit]
            at, hit = _find(self.contexts[order - 1][0], context)
            out[open_[hit]] += self.contexts[order - 1][1][at[hit]]
        out[open_] += self.base[(keys[open_] & np.uint64(255)).astype(np.int64)]
        return out


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, n, len(found))


def build_tree(keys: np.ndarray, n: np.ndarray, grow: int = 4) -> Tree:
    """The tree of counted keys (as keys_of gives them)."""
    counts = np.bincount((keys & np.uint64(255)).astype(np.int64), n, 256)
    kinds = np.count_nonzero(counts)
    escape = kinds / (counts.sum() + kinds) if 0 < kinds < 256 else 0.0
    base = np.where(counts > 0, counts * (1 - escape) / max(counts.sum(), 1), escape / max(256 - kinds, 1)) if kinds else np.full(256, 1 / 256)
    nodes, contexts = [], []
    for order in range(1, DEPTH + 1):
        code, c = _summed(_coded(_context(keys, order), keys), n)
        context, at, kinds = np.unique(code >> np.uint64(8), return_inverse=True, return_counts=True)
        total = np.bincount(at, c, len(context))
        stays = total >= (grow if order > 2 else 1)
        own = (np.cumsum(stays) - 1)[at][stays[at]]
        code, c, context, total, kinds = code[stays[at]], c[stays[at]], context[stays], total[stays], kinds[stays]
        shorter = _coded(code >> np.uint64(16), code)
        if order == 1:
            below = base[(code & np.uint64(255)).astype(np.int64)]
        else:  # a symbol seen after a context was seen after the shorter one, which is kept where the longer one is
            below = np.exp2(-nodes[-1][1][_find(nodes[-1][0], shorter)[0]].astype(np.float64))
        left = np.maximum(1 - np.bincount(own, below, len(context)), 1e-9)
        nodes.append((code, -np.log2(c / (total + kinds)[own]).astype(np.float32)))
        contexts.append((context, (np.log2(left) - np.log2(kinds / (total + kinds))).astype(np.float32)))
    return Tree(-np.log2(base).astype(np.float32), nodes, contexts)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    trees: list[Tree]

    def code_lengths(self, texts: Iterable[str]) -> np.ndarray:
        """Bits of each text in each language."""
        sums: list[np.ndarray] = []
        held: list[tuple[int, np.ndarray]] = []
        size = 0

        def add() -> None:
            nonlocal held, size
            if held:
                keys, at = np.unique(np.concatenate([k for _, k in held]), return_inverse=True)
                starts = np.cumsum([0] + [len(k) for _, k in held[:-1]])
                for j, tree in enumerate(self.trees):
                    for (i, _), bits in zip(held, np.add.reduceat(tree.costs(keys)[at], starts, dtype=np.float64)):
                        sums[i][j] += bits
            held, size = [], 0

        for i, text in enumerate(texts):
            sums.append(np.zeros(len(self.trees)))
            for part in slices(text):
                held.append((i, keys_of(part)))
                size += len(part)
                if size >= _SLICE:
                    add()
        add()
        return np.array(sums).reshape(-1, len(self.trees))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [i for i, t in enumerate(texts) if t and self.languages and has_letter(t)]
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if known:
            bits = self.code_lengths(texts[i] for i in known)
            best = bits.argmin(axis=1)
            share = 1 / np.exp2(np.clip(bits.min(axis=1)[:, None] - bits, -1000, 0)).sum(axis=1)
            for i, b, s in zip(known, best, share):
                names[i], score[i] = self.languages[b], s
        return names, score


def _sample(rows: DataFrame, max_docs: int, max_chars: int) -> DataFrame:
    """Distinct (lang, text) of rows, thinned by language to the bounds; a text's copies stay or go together."""
    drawn = rows.select("lang", "text", F.xxhash64("text", F.lit(5)).alias("h"))
    seen = drawn.groupBy("lang", "h").agg(F.max(F.length("text")).alias("chars"))
    totals = seen.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("chars").alias("chars"), F.min("h").alias("least"))
    # one row a language
    share = F.least(F.lit(1.0), max_docs / F.col("docs"), max_chars / F.greatest(F.col("chars"), F.lit(1)))
    top = F.lit(float(-(2**63))) + share * float(2**64)
    met = drawn.join(F.broadcast(totals.select("lang", "least", top.alias("top"))), "lang").filter((F.col("h") == F.col("least")) | (F.col("h").cast("double") < F.col("top")))
    return met.groupBy("lang", "h").agg(F.min("text").alias("text")).select("lang", "text")


def train(rows: DataFrame, max_train_docs: int = 2_000, max_train_chars: int = 4_000_000, grow: int = 4) -> Model:
    """The model of rows (text, lang); those with a null are left out."""
    rows = rows.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                for part in slices(text.as_py()):
                    keys, n = np.unique(keys_of(part), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(keys)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "code", "n"])

    def build(group: pa.Table) -> pa.Table:
        tree = build_tree(group["code"].to_numpy().view(np.uint64), group["n"].to_numpy().astype(np.float64), grow)
        return pa.table({"lang": group["lang"][:1], "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    counted = _sample(rows, max_train_docs, max_train_chars).mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # a group is one language's counts, at most max_train_chars rows or a single text's; the driver gets a tree a language
    with modest_batches(rows.sparkSession):
        found = sorted(counted.groupBy("lang").applyInArrow(build, "lang string, tree binary").collect())
    return Model([r["lang"] for r in found], [pickle.loads(r["tree"]) for r in found])


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score and the columns named in keep, which may name the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    others = [c for c in keep if c != text_col]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col), *others)
    types = {f.name: f.dataType.simpleString() for f in docs.select(*keep).schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts, chars = 0, [], 0
            columns = {text_col: batch.column(1)} | {c: batch.column(2 + i) for i, c in enumerate(others)}
            for i in range(batch.num_rows):
                texts.append(batch.column(1)[i].as_py())
                chars += len(texts[-1] or "")
                if i + 1 == batch.num_rows or len(texts) == _OUT_ROWS or chars >= _OUT_CHARS:
                    names, score = shared.value.predict(texts)
                    own = [columns[c].slice(at, len(texts)) for c in keep]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(names, pa.string()), pa.array(score), *own], names=["doc_id", "lang_pred", "score", *keep])
                    at, texts, chars = i + 1, [], 0

    return rows.mapInArrow(run, ", ".join(["doc_id long, lang_pred string, score double", *[f"`{c}` {types[c]}" for c in keep]]))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by crc32 of its id as text."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
