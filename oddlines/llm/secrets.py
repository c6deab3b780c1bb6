"""Secret scans in DataFrame functions only.

Base rules (key assignments, access keys, long hex) are patterns. The entropy rule looks at candidate strings: maximal
runs over a character class's alphabet. A window of fixed width slides over each candidate; the counts of its characters
are updated by one entering and one leaving character, and with them S = sum(c * log2 c), so that the window's Shannon
entropy log2(width) - S / width costs one step each. A candidate whose hottest window reaches the class's threshold
gives one span, from the start of its first hot window to the end of its last. Stretches that the allow-list matches
(words at separators, sequences, digests, words of a path) part a string into pieces, which are candidates of their own.

Spans are ``kind:start:end`` in code points, end exclusive. Defined results: a null text is an empty one and has no
spans; ties of the start go by kind in the order of ``KINDS``; repeated rows are scanned each; empty tables give empty
results; columns of other names are ignored. Texts are scanned whole, of whatever length, each within one row.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, text_of

#: Fixed patterns of the base rules; group 2 of the first is the value.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"""(?i:passw|secret|token|api_?key)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class CharClass:
    """A character class of the entropy rule: runs of ``alphabet``, at least ``width`` long, that match each of ``also``."""

    kind: str
    alphabet: str
    width: int
    bits: float
    also: tuple[str, ...]


#: Digits among letters, unlike a word with a number at its end.
_AMONG = "[0-9].*[A-Za-z].*[0-9]|[A-Za-z].*[0-9].*[A-Za-z]"
#: Thresholds are by hits on random strings and false alarms on the given documents and on source code. Strings of under
#: 16 characters have too little entropy to be told from words. Lower-case hex of 24 and more is the base rule's.
CLASSES = (
    CharClass("entropy_hex", "0-9A-Fa-f", 16, 2.9, (_AMONG, "^(?![0-9a-f]{24,}$)")),
    CharClass("entropy_base64", "A-Za-z0-9+/=_-", 20, 3.7, ("[0-9].*[0-9]", "[a-z]", "[A-Z]")),
    CharClass("entropy_lower", "a-z0-9", 16, 3.2, (_AMONG, "[g-z]")),
    CharClass("entropy_upper", "A-Z0-9", 16, 3.2, (_AMONG, "[G-Z]")),
    # at most one digit; capitals that stand closer than those of names
    CharClass("entropy_mixed", "A-Za-z0-9+/=_-", 20, 3.9, ("^[^0-9]*[0-9]?[^0-9]*$", "[a-z]", "[A-Z][a-z]?[A-Z]")),
    CharClass("entropy_short", "A-Za-z0-9+/=_-", 16, 3.5, (_AMONG, "[a-z]", "[A-Z]", "^.{16,19}$")),
)
#: A path's word: lower-case or capitalised words and a short number, nothing that a random string would have.
_WORD = r"[A-Z]?[a-z]{2,}+(?:[_-]?[A-Z][a-z]{2,}+|[_-][a-z]{2,}+)*+(?:[_-]?[0-9]{1,4})?"
_B64 = "[A-Za-z0-9+/_-]"
#: Stretches that look random and are not secrets; what stands beside them is looked at.
ALLOWED = (
    r"(?<![A-Za-z0-9+])[A-Za-z0-9+]*?(?i:example|sample|dummy|placeholder|your[_-]?(?:key|token|secret))[A-Za-z0-9+]*",
    r"(?i:(?<![0-9a-z])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-z]))",
    "(?i:abcdefgh" + "".join(f"(?:{c}" for c in "ijklmnopqrstuvwxyz") + ")?" * 18 + ")|0123456789",
    rf"(?<![A-Za-z0-9])(?i:sha512[-_](?:[0-9a-f]{{128}}|{_B64}{{86}}(?:==)?)|sha384[-_](?:[0-9a-f]{{96}}|{_B64}{{64}})|sha256[-_](?:[0-9a-f]{{64}}|{_B64}{{43}}=?)|sha1[-_](?:[0-9a-f]{{40}}|{_B64}{{27}}=?)|md5[-_](?:[0-9a-f]{{32}}|{_B64}{{22}}(?:==)?))",
    r"(.)\1{7,}",
    rf"(?<=/){_WORD}(?=/|$)|^{_WORD}(?=/)",
)
KINDS = ("assign", "access", "hex", *(c.kind for c in CLASSES))


def _pieces(text: Column, pattern: str) -> Column:
    """array<struct<start, text>> of what stands between the leftmost non-overlapping matches, in code points."""
    empty = F.array().cast("array<struct<start:bigint,text:string>>")
    return F.aggregate(
        F.arrays_zip(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")),
        F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
        lambda a, z: F.struct(
            (a["at"] + F.length(z["g"]) + F.coalesce(F.length(z["m"]), F.lit(0))).cast("long").alias("at"),
            F.array_append(a["out"], F.struct(a["at"].alias("start"), z["g"].alias("text"))).alias("out"),
        ),
        lambda a: a["out"],
    )


def _matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """array<struct<start, text>> of the leftmost non-overlapping matches, in code points.

    A text split at its matches has the gaps between them, so starts are running sums of gap and match lengths."""
    empty = F.array().cast("array<struct<start:bigint,text:string>>")

    def walk(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        return F.aggregate(
            F.arrays_zip(found.alias("m"), gaps.alias("g")),
            F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")),
            lambda a, z: F.struct(
                (a["at"] + F.length(z["g"]) + F.length(z["m"])).cast("long").alias("at"),
                F.array_append(a["out"], F.struct((a["at"] + F.length(z["g"])).cast("long").alias("start"), z["m"].alias("text"))).alias("out"),
            ),
            lambda a: a["out"],
        )

    return F.when(text.rlike(hint or pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)).otherwise(empty)


def _spans(matches: Column, kind: str) -> Column:
    order = KINDS.index(kind)
    return F.transform(
        matches,
        lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("ord"), (m["start"] + F.length(m["text"])).cast("long").alias("end")),
    )


def _clog(c: Column) -> Column:
    return F.when(c > 0, c * F.log2(c)).otherwise(F.lit(0.0))


def hot_window(text: Column, width: int, bits: float) -> Column:
    """struct<first, last> starts (from 0) of the first and last window of text with at least bits of entropy, or null.

    State of the slide: counts by character (a map), S, and the hot windows so far. One step changes two counts."""

    def slide(chars: Column) -> Column:
        start = F.struct(
            F.map_from_arrays(F.array_distinct(chars), F.transform(F.array_distinct(chars), lambda c: F.lit(0.0))).alias("n"),
            F.lit(0.0).alias("s"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
        )

        def step(a: Column, i: Column) -> Column:
            new = F.element_at(chars, i)
            old = F.when(i > width, F.element_at(chars, F.greatest(i - width, F.lit(1))))
            up, down = F.element_at(a["n"], new), F.element_at(a["n"], old)
            same = F.coalesce(new == old, F.lit(False))
            s = F.when(same, a["s"]).otherwise(a["s"] + _clog(up + 1) - _clog(up) + F.coalesce(_clog(down - 1) - _clog(down), F.lit(0.0)))
            n = F.when(same, a["n"]).otherwise(F.transform_values(a["n"], lambda k, v: v + F.when(k == new, 1.0).otherwise(0.0) - F.when(k == old, 1.0).otherwise(0.0)))
            hot = (i >= width) & (math.log2(width) - s / width >= bits - 1e-9)
            at = (i - width).cast("int")
            first = F.when(hot & a["first"].isNull(), at).otherwise(a["first"])
            return F.struct(n.alias("n"), s.alias("s"), first.alias("first"), F.when(hot, at).otherwise(a["last"]).alias("last"))

        return F.aggregate(F.sequence(F.lit(1), F.size(chars)), start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return F.when(F.length(text) >= width, let(F.split(text, ""), slide))


def _within(outer: Column, inner: Callable[[Column], Column]) -> Column:
    """inner's array<struct<start, text>> of each of outer's texts, with starts as outer counts them."""
    return F.flatten(F.transform(outer, lambda o: F.transform(inner(o["text"]), lambda m: F.struct((o["start"] + m["start"]).alias("start"), m["text"].alias("text")))))


def _open_pieces(text: Column, classes: tuple[CharClass, ...], allowed: tuple[str, ...]) -> Column:
    """array<struct<start, text>> of the pieces of text that may hold candidates: runs over all classes' alphabets,
    parted at what the allow-list matches."""
    if not classes:
        return F.array().cast("array<struct<start:bigint,text:string>>")
    width = min(c.width for c in classes)
    runs = _matches(text, f"[{''.join(f'[{c.alphabet}]' for c in classes)}]{{{width},}}")
    if allowed:
        runs = _within(runs, lambda run: _pieces(run, "|".join(f"(?:{a})" for a in allowed)))
    return F.filter(runs, lambda p: F.length(p["text"]) >= width)


def _entropy_spans(pieces: Column, cls: CharClass) -> Column:
    def candidate(m: Column) -> Column:
        ok = F.lit(True)
        for pattern in cls.also:
            ok = m["text"].rlike(pattern) & ok
        return ok

    found = F.filter(_within(pieces, lambda piece: _matches(piece, f"[{cls.alphabet}]{{{cls.width},}}")), candidate)
    hot = F.transform(found, lambda m: F.struct(m["start"].alias("start"), hot_window(m["text"], cls.width, cls.bits).alias("w")))
    order = KINDS.index(cls.kind)
    return F.transform(
        F.filter(hot, lambda h: h["w"]["first"].isNotNull()),
        lambda h: F.struct((h["start"] + h["w"]["first"]).cast("long").alias("start"), F.lit(order).alias("ord"), (h["start"] + h["w"]["last"] + cls.width).cast("long").alias("end")),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", classes: tuple[CharClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, text, base and spans, each array<struct<start, kind, end>> by start, then kind;
    and the columns named in keep."""
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"), *keep)
    # the value's length is that of what is left of a match without its keyword and signs
    value = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
    assign = F.filter(_matches(text, ASSIGN, ASSIGN_HINT), lambda m: F.length(F.regexp_replace(m["text"], value, "")) >= 6)
    base = F.concat(_spans(assign, "assign"), _spans(_matches(text, ACCESS), "access"), _spans(_matches(text, HEX), "hex"))
    spans_of = lambda p: F.concat(*[_entropy_spans(p, c) for c in classes])
    rows = rows.select("doc_id", "text", F.array_sort(base).alias("base"), let(_open_pieces(text, classes, allowed), spans_of).alias("more"), *keep)
    kinds = F.array(*[F.lit(k) for k in KINDS])
    named = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, s["ord"] + 1).alias("kind"), s["end"].alias("end")))
    return rows.select("doc_id", "text", named(F.col("base")).alias("base"), named(F.array_sort(F.concat("base", "more"))).alias("spans"), *keep)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(scanned: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """scan()'s rows with column ``redacted``: the text with every span replaced by the mark (overlaps by one mark)."""
    walk = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] >= a["at"], F.array_append(F.array_append(a["out"], F.substr(F.col("text"), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int"))), F.lit(mark))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substr(F.col("text"), (a["at"] + 1).cast("int"), F.length("text"))),
    )
    return scanned.withColumn("redacted", F.when(F.size("spans") > 0, walk).otherwise(F.col("text")))
