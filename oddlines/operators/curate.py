"""Corpus curation: path and size filters, per-repository samples, pairs and counts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.constants import COMPLEX_CLASSES, MAX_CHARS, MIN_CHARS, SIMPLE_CLASSES, SKIP_DIRS, SKIP_FILES, SKIP_SUBSTRINGS
from .ranges import ranked


def wanted_path(path: Column, prefix: str = "", suffix: str = ".py", without: tuple[str, ...] = SKIP_SUBSTRINGS) -> Column:
    """Below prefix, of the suffix, and without any of the substrings."""
    return path.startswith(prefix) & path.endswith(suffix) & ~path.rlike("|".join(map(re.escape, without)))


def _globs(names: tuple[str, ...]) -> str:
    """One Java pattern of several shell patterns of * and ?."""
    return "|".join("".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in n) for n in names)


def in_source_tree(path: Column, skip_dirs: tuple[str, ...] = SKIP_DIRS, skip_files: tuple[str, ...] = SKIP_FILES) -> Column:
    """A .py file outside the skipped folders and names."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return path.endswith(".py") & ~F.exists(folders, lambda x: x.rlike(f"^(?:{_globs(skip_dirs)})$")) & ~F.element_at(parts, -1).rlike(f"^(?:{_globs(skip_files)})$")


def sized(size: Column, low: int = MIN_CHARS, high: int = MAX_CHARS) -> Column:
    return size.between(low, high)


def even_stride(listing: DataFrame, max_files: int, by: str = "repo", size: str = "size", tie: str = "path") -> DataFrame:
    """At most max_files rows of each group, evenly spaced in order of size: ranks int(i * (n / max_files))."""
    line = ranked(listing, [size, tie], (by,), "_i").withColumn("_i", F.col("_i") - 1)
    n = listing.groupBy(by).agg(F.count("*").alias("_n"))
    # a smaller group is taken whole
    step = F.greatest(F.col("_n") / F.lit(max_files), F.lit(1.0))
    wanted = n.select(by, F.explode(F.transform(F.sequence(F.lit(0), F.least(F.col("_n"), F.lit(max_files)) - 1), lambda i: F.floor(i * step))).alias("_i"))
    return line.join(wanted, [by, "_i"]).select(*listing.columns)


def first_that_parses(candidates: list[tuple[str, str]]) -> Column:
    """Of (code, parse_ok) columns, the first code whose flag is true, else null."""
    return F.coalesce(*[F.when(F.col(ok), F.col(code)) for code, ok in candidates])


def unescaped(code: Column) -> Column:
    return F.replace(F.replace(code, F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t"))


def usable_pairs(pairs: DataFrame, a: str, b: str, order: str, n: int | None = None) -> DataFrame:
    """Pairs with both sides given and different after trimming; the first n in order."""
    rows = pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.trim(a) != F.trim(b)))
    return rows if n is None else rows.orderBy(order).limit(n)


def first_texts(rows: DataFrame, text: str, order: str, n: int) -> DataFrame:
    return rows.filter(F.trim(text) != "").orderBy(order).limit(n)


def kept_of_candidates(candidates: DataFrame, kept: DataFrame, functions: DataFrame, by: str = "repo", key: str = "path") -> DataFrame:
    """candidates, kept and functions (rows of the kept files) of each group and (null, is_total 1) of all."""
    ours = kept.select(by, key, F.lit(1).alias("_kept"))
    per = functions.groupBy(by, key).agg(F.count("*").alias("_functions"))
    rows = candidates.select(by, key).join(ours, [by, key], "left").join(per, [by, key], "left")
    mine = F.when(F.col("_kept") == 1, F.coalesce("_functions", F.lit(0)))
    return rows.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("candidates"), F.count("_kept").alias("kept"), F.coalesce(F.sum(mine), F.lit(0)).alias("functions"))


def corpus_counts(files: DataFrame, by: str = "repo") -> DataFrame:
    """Files and characters of each group and (null) of all."""
    return files.rollup(by).agg(F.grouping(by).cast("int").alias("is_total"), F.count("*").alias("files"), F.sum("size").alias("chars"))


def histograms(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Counts by a and by b, in one pass."""
    return rows.groupingSets([[F.col(a)], [F.col(b)]], F.col(a), F.col(b)).agg(F.grouping(a).cast("int").alias(f"over_{b}"), F.count("*").alias("n"))


def binary_class(name: Column, simple: tuple[str, ...] = SIMPLE_CLASSES, complex_: tuple[str, ...] = COMPLEX_CLASSES) -> Column:
    """0 for simple, 1 for complex classes, null for others; trimmed, in lower case."""
    folded = F.lower(F.trim(name))
    return F.when(folded.isin(*simple), 0).when(folded.isin(*complex_), 1)
