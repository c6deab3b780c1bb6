"""From source files to the reports of a repository scan, in one call."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import features, parse
from . import model, report
from .stages import written


class Scan(NamedTuple):
    """summaries: one row a file; top: each repository's oddest lines with reason and context; totals: by repository, file
    and over everything; failed: files that could not be taken, with their error."""

    summaries: DataFrame
    top: DataFrame
    totals: DataFrame
    failed: DataFrame


def scan(
    files: DataFrame, unread: DataFrame | None = None, score: Callable[[DataFrame], DataFrame] = model.linear, min_score: float = 0.0, n: int = 20, score_functions: Callable[[DataFrame], DataFrame] | None = None
) -> Scan:
    """Scans files (repo, path, code); unread (path, error) are failures that reading has met already. Files are parsed once
    and lines scored once; reasons and contexts are made for the lines that are shown."""
    own = files.select("repo", "path", "code", F.concat_ws(":", "repo", "path").alias("file_id"))
    parsed = written(parse.parse_files(own, keep=("repo", "path"), wanted=("lines", "structures")), "scan-parsed")
    scored = written(score(features.line_features(parsed, ("repo", "path"), context=True)), "scan-scored")
    taken = parsed.filter("error IS NULL").select("file_id", "repo", "path")
    shown = scored.withColumn("flag", F.col("flag") & (F.round("score", 4) >= min_score))
    top = report.rich_lines(report.top_lines(shown, ["repo"], n), score_functions and score_functions(scored))
    return Scan(report.file_summary(scored, taken), top.select("repo", "path", "line", "rank", F.round("score", 4).alias("score"), "reason", "context"), report.repo_rollup(scored, min_score), report.failed_files(parsed, unread))
