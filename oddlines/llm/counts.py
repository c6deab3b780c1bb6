"""Token counts as delta-maintained rollups.

``count_tokens`` counts a text's tokens with public tokenizers, each a tokenizer version. A change is a signed row (source,
lang, tokenizer_version, sign, tokens): +1 for an insert, -1 for a delete; a revised count is a delete of the old count and
an insert of the new one. A batch of changes is summed by its keys and committed under its batch id; totals are sums over
batches. A batch id that has been committed is skipped when it comes again, and a commit that broke off left nothing that
readers see and is written anew, so delivering a batch twice changes nothing. ``compact`` sums what is committed into a
snapshot, which knows the ids it holds.

Defined results: null sources, languages and versions are keys of their own; null counts and signs are 0; a null or empty
text has no tokens, texts of any length are counted whole; repeated rows are changes of their own; keys whose documents
and tokens cancel out stay with zeros unless ``totals`` drops them; an empty batch is a commit without rows; sums have no
order, so ties cannot matter; columns of other names are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import delete, finished
from .tokens import encoder

KEYS = ("source", "lang", "tokenizer_version")
_DELTAS = "source string, lang string, tokenizer_version string, docs long, tokens long"


def count_tokens(docs: DataFrame, paths: dict[str, str], text_cols: tuple[str, ...] = ("text",), keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in keep and, for each text column and each tokenizer (version: path of its file), a count named
    COLUMN_VERSION (long). A second text that equals the first is not encoded again."""
    rows = docs.select(*keep, *[F.col(c).alias(f"_{i}") for i, c in enumerate(text_cols)])
    kept = docs.select(*keep).schema
    names = [f"{c}_{v}" for c in text_cols for v in paths]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(p) for p in paths.values()]
        for batch in batches:
            found: list[list[int]] = [[] for _ in names]
            for texts in zip(*[batch.column(len(keep) + i) for i in range(len(text_cols))]):
                known: dict[str | None, list[int]] = {}
                for i, text in enumerate(t.as_py() for t in texts):
                    if text not in known:
                        known[text] = [len(e.encode(text)) // 4 for e in encoders]
                    for j, n in enumerate(known[text]):
                        found[i * len(encoders) + j].append(n)
            own = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*own, *[pa.array(c, pa.int64()) for c in found]], names=[*keep, *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{n}` long" for n in names])
    return rows.mapInArrow(run, schema)


def changes(rows: DataFrame, sign: int, version: str, tokens: Column) -> DataFrame:
    """Signed changes of rows that have source and lang."""
    return rows.select("source", "lang", F.lit(version).alias("tokenizer_version"), F.lit(sign).cast("long").alias("sign"), F.coalesce(tokens, F.lit(0)).cast("long").alias("tokens"))


def _done(spark: SparkSession, path: str, kind: str) -> list[str]:
    """The folders kind=… below path whose writing has come to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(n for n in names if n.startswith(f"{kind}=") and finished(spark, f"{path}/{n}"))


def _snapshot(spark: SparkSession, path: str) -> tuple[str | None, list[int]]:
    """The latest finished snapshot's folder and the ids of the batches it holds."""
    done = _done(spark, path, "ids")
    if not done:
        return None, []
    latest = done[-1].removeprefix("ids=")
    return f"{path}/sums={latest}", [r[0] for r in spark.read.schema("batch long").parquet(f"{path}/{done[-1]}").collect()]


def commit(batch: DataFrame, path: str, batch_id: int) -> bool:
    """Sums a batch of changes by its keys and commits it; False where that batch id has been committed before."""
    spark, place = batch.sparkSession, f"{path}/batch={int(batch_id)}"
    if finished(spark, place) or int(batch_id) in _snapshot(spark, path)[1]:
        return False
    sign = F.coalesce(F.col("sign"), F.lit(0))
    delta = batch.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("docs"), F.sum(sign * F.coalesce(F.col("tokens"), F.lit(0))).cast("long").alias("tokens"))
    delta.write.mode("overwrite").parquet(place)
    return True


def _open(spark: SparkSession, path: str) -> tuple[DataFrame, list[int], list[int]]:
    """Rows of the snapshot and of batches beyond it, the ids of either."""
    sums, held = _snapshot(spark, path)
    ids = [int(n.removeprefix("batch=")) for n in _done(spark, path, "batch")]
    more = [i for i in ids if i not in set(held)]
    places = [p for p in (sums, *[f"{path}/batch={i}" for i in more]) if p]
    rows = spark.read.schema(_DELTAS).parquet(*places) if places else spark.createDataFrame([], _DELTAS)
    return rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")), held, more


def totals(spark: SparkSession, path: str, keep_empty: bool = False) -> DataFrame:
    """source, lang, tokenizer_version, docs, tokens over all committed batches."""
    rows, _, _ = _open(spark, path)
    return rows if keep_empty else rows.filter("docs != 0 OR tokens != 0")


def compact(spark: SparkSession, path: str) -> None:
    """Sums all committed batches into one snapshot and deletes their folders. The list of ids is written last: until it
    is whole, readers keep to what was there before."""
    rows, held, more = _open(spark, path)
    old = _done(spark, path, "ids")
    number = f"{len(held) + len(more):020d}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/sums={number}")
    spark.createDataFrame([(i,) for i in [*held, *more]], "batch long").write.parquet(f"{path}/ids={number}")
    for name in [f"batch={i}" for i in more] + old + [n.replace("ids=", "sums=") for n in old]:
        delete(spark, f"{path}/{name}")
