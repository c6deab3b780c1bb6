"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session that sets none gets a temporary one; a
    cluster's executors would not see that, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stash(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._stash_path = path
    return kept


def discard(df: DataFrame) -> None:
    """Deletes what stash() wrote for df, which must not be read any more."""
    delete(df.sparkSession, df._stash_path)


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write to path has come to its end."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def running(rows: DataFrame, order: list[str], **sums: str) -> DataFrame:
    """rows with, for each out=column, the sum of column over all rows before a row in order (unique). Rows are
    range-partitioned; only one row a partition meets in one place."""
    ranged = stash(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    line = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_{out}") for out, c in sums.items()])
    ends = ends.select("_part", *[F.coalesce(F.sum(f"_{out}").over(line), F.lit(0)).alias(f"_{out}") for out in sums])
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = [F.coalesce(F.sum(c).over(within), F.lit(0)).alias(out) for out, c in sums.items()]
    met = ranged.select(*rows.columns, "_part", *own).join(F.broadcast(ends), "_part")
    return met.select(*rows.columns, *[(F.col(out) + F.col(f"_{out}")).alias(out) for out in sums])


def _hot(rows: DataFrame, key: str, n: int | None = None) -> DataFrame | None:
    """key and _places, into how many parts its rows go, of the keys that hold more than a 10,000th of rows (at least
    64 rows), so 10,000 keys at most; None without such keys. n: the number of rows, where it is known."""
    heavy = max(64, (rows.count() if n is None else n) // 10_000)
    found = rows.groupBy(key).agg(F.ceil(F.count("*") / heavy).cast("int").alias("_places")).filter("_places > 1").collect()
    return F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(key, F.lit(0).alias("_places")).schema)) if found else None


def _deal(rows: DataFrame, hot: DataFrame, key: str, spread_by: str) -> DataFrame:
    return rows.join(hot, key, "left").withColumn("_place", F.pmod(F.xxhash64(spread_by), F.coalesce("_places", F.lit(1))).cast("int")).drop("_places")


def dealt(rows: DataFrame, key: str, spread_by: str) -> DataFrame:
    """rows with _place: those of a key that holds many are dealt by spread_by over several places. rows is read thrice."""
    hot = _hot(rows, key)
    return rows.withColumn("_place", F.lit(0)) if hot is None else _deal(rows, hot, key, spread_by)


def hot_join(left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str = "inner", like: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """left joined to right on key, where a key may hold much of left and little of right: the rows of such keys are
    dealt by spread_by over several places, to each of which right's rows of that key go. like has left's keys, as
    often, and is read for the counts. n: the number of left's rows, where it is known."""
    hot = _hot(left if like is None else like, key, n)
    if hot is None:
        return left.join(right, key, how)
    copied = right.join(hot, key, "left").withColumn("_place", F.explode(F.sequence(F.lit(0), F.coalesce("_places", F.lit(1)) - 1))).drop("_places")
    return _deal(left, hot, key, spread_by).join(copied, [key, "_place"], how).drop("_place")


def numbered(df: DataFrame, label: str, name: str, columns: tuple[str, ...]) -> DataFrame:
    """columns of df and one of unique longs, the same at every reading: the file's number and the row's place in the file.

    A table that is read from files keeps them; any other is written first. The driver sees one row a file."""
    if "_metadata" in df.columns or df._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation":
        df = stash(df.select(*columns), label)
    placed = df.select(*columns, F.col("_metadata.file_path").alias("_path"), F.col("_metadata.row_index").alias("_at"))
    files = sorted(r[0] for r in placed.select("_path").distinct().collect())
    order = F.broadcast(df.sparkSession.createDataFrame(list(enumerate(files)), "_file long, _path string"))
    return placed.join(order, "_path").select(*columns, F.shiftleft("_file", 40).bitwiseOR(F.col("_at")).alias(name))


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within it, a job's shuffle files go as soon as it has ended; else they stay until the driver happens to collect its
    garbage, and the disk holds those of all jobs so far. For jobs that end within it; the session gets its own setting back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    own = spark.conf.get(name, None)
    try:
        spark.conf.set(name, "true")
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


@contextmanager
def modest_batches(spark: SparkSession) -> Iterator[None]:
    """Within it, the session sends at most 1,024 rows or some 4 MB to Python at once, since what crosses is held several
    times over (in the JVM's buffers, on the way, in the worker) by each task. For jobs that end within it: Spark has this
    setting for a session only, which gets its own back. A session that asks for less keeps it."""
    names = {f"spark.sql.execution.arrow.{name}": most for name, most in (("maxRecordsPerBatch", 1024), ("maxBytesPerBatch", 4 << 20))}
    own = {name: spark.conf.get(name, None) for name in names}
    try:
        for name, most in names.items():
            if not 0 < _bytes(own[name]) <= most:
                spark.conf.set(name, str(most))
        yield
    finally:
        for name, value in own.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _bytes(value: str | None) -> int:
    """A setting's number, with a unit or without; 0 where it is unset."""
    digits = (value or "0").lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(digits[-1:], 1)
    return int(digits.rstrip("kmg")) * unit


def small_batches(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Slices of batches, so that what is made of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def word_count(col: str = "text") -> Column:
    return F.regexp_count(text_of(col), F.lit(WORD)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
