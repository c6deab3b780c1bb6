"""Lines, tokens and the lexical line features, without a parser: projections only, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .constants import FEATURES

#: Characters that end a line.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
#: Comments, strings, names, numbers and operators; the same text means the same to Java and RE2.
TOKEN = (
    r"""#.*|"[^"]*"|'[^']*'|[\p{L}_][\p{L}\p{M}\p{N}_]*|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?"""
    r"""|\.\.\.|\*\*=?|//=?|<<=?|>>=?|->|:=|[=!<>+\-*/%&|^@]=|[^\s\p{L}\p{N}_]"""
)
NAME = r"^[\p{L}_][\p{L}\p{M}\p{N}_]*$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _bits(counts: Column, n: Column) -> Column:
    total = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * F.log2(c.cast("double")))
    return F.when(n <= 1, F.lit(0.0)).otherwise(F.log2(n.cast("double")) - total / n)


def entropy(items: Column) -> Column:
    """Shannon bits over an array's items, from the runs of the sorted array; 0 for at most one item."""

    def bits(a: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(a)), lambda i: (i == F.size(a)) | (F.get(a, i - 1) != F.get(a, i)))
        return let(ends, lambda e: _bits(F.transform(e, lambda x, k: x - F.coalesce(F.get(e, k - 1), F.lit(0))), F.size(a)))

    return F.when(F.size(items) <= 1, F.lit(0.0)).otherwise(let(F.sort_array(items), bits))


def char_entropy(text: Column) -> Column:
    """Shannon bits over a text's characters, from the runs of its sorted characters."""
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    return _bits(F.transform(runs, lambda r: F.length(r)), F.length(text))


def split_lines(code: Column) -> Column:
    """array<string> of a text's lines; a final line end opens no further line."""
    return let(F.split(code, LINE_END, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def lines(files: DataFrame, *keep: str) -> DataFrame:
    """file_id, line (from 1), raw and the columns in keep; blank lines and comment lines are left out."""
    rows = files.select("file_id", *keep, F.posexplode(split_lines(F.coalesce("code", F.lit("")))).alias("pos", "raw"))
    return rows.select("file_id", *keep, (F.col("pos") + 1).alias("line"), "raw").filter(~F.col("raw").rlike(r"^\s*(#|$)"))


def tokens(raw: Column) -> Column:
    return F.filter(F.regexp_extract_all(raw, F.lit(TOKEN), F.lit(0)), lambda x: ~F.startswith(x, F.lit("#")))


def line_features(rows: DataFrame) -> DataFrame:
    """rows (… raw) with the thirteen features; those that need a parser are 0."""
    rows = rows.withColumn("_t", tokens(F.col("raw"))).withColumn("_n", F.filter("_t", lambda x: F.rlike(x, F.lit(NAME))))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", r"^[ \t]+", ""))
    found = {
        "nesting_depth": F.floor(indent / 2) * F.lit(0.7),
        "length": F.size("_t").cast("double"),
        "token_entropy": entropy(F.col("_t")),
        "naming_entropy": char_entropy(F.array_join("_n", "")),
        "name_flow": F.size(F.array_distinct("_n")).cast("double"),
    }
    return rows.withColumns({f: found.get(f, F.lit(0.0)).cast("double") for f in FEATURES}).drop("_t", "_n")
