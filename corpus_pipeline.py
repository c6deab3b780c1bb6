"""A training-corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents:

1. language ID drops documents without a recognisable language (``und``, or a posterior below ``MIN_SCORE``);
2. near-dedup keeps the first document of each group;
3. the secret scan replaces every span it finds by a mark;
4. mixing draws each source up to its target: documents go, stay, or appear twice, the last one cut to its words taken,
   in shards that are shuffled locally;
5. packing gives the pieces of the final sequences.

Stages 2 and 4 meet rows by a key of their own (``ROW``), so that rows with a null or repeated doc_id are documents like
any other: of a group, the row with the least doc_id stays (null comes first; the first row of equal ones), and texts that
are unlike stay although they share an id. A null or empty text has no language and goes in stage 1; a stage that is run
alone keeps it (near-dedup: unlike all others; secret scan: as an empty text), except that mixing draws no words from it. A
null lang teaches nothing, a null source is a source of its own. Texts of any length are processed whole, ties are settled
by doc_id or by hashes, repeated rows are documents each until near-dedup keeps one, an empty table gives empty results,
and columns other than those of documents are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlines.llm import langid, mixing, neardup, packing, secrets
from oddlines.llm.shared import modest_batches, numbered, stash, table
from oddlines.llm.tokens import public_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
MIN_SCORE = 0.5
#: A row's own key within a stage.
ROW = "row_key"
#: Pieces of text that a worker keeps when it packs, since it goes on to other stages with them.
MAX_PIECES = 50_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, "language-rows", ROW, COLUMNS)
    model = langid.train(docs.filter(~langid.held_out()).select("text", "lang"))
    found = langid.predict(docs.select(ROW, "text"), model, id_col=ROW)
    known = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= MIN_SCORE)
    with modest_batches(spark):  # the texts come from the table again, not from Python
        dropped = stash(found.filter(~known).select(F.col("doc_id").alias(ROW)), "language-dropped")
    return docs.join(dropped, ROW, "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = numbered(docs, "dedup-rows", ROW, COLUMNS)
    found = neardup.near_duplicates(docs, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id")
    first = F.min(F.struct("doc_id", ROW)).alias("first")
    kept = stash(found.join(docs.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(first).select(f"first.{ROW}"), "dedup-kept")
    return docs.join(kept, ROW, "left_semi").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = secrets.redact(secrets.scan(docs.select(*COLUMNS), keep=("lang", "source")))
    return found.select("doc_id", F.col("redacted").alias("text"), "lang", "source", F.length("redacted").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = numbered(docs, "mix-rows", ROW, COLUMNS)
    mixed = mixing.mix(docs, shards=shards, keep=(ROW,))
    draws = mixing.mixed_rows(mixed, keep=(ROW,)).select(ROW, "take", "shard", "order_key", "size")
    drawn = docs.join(draws, ROW).repartition(shards, "shard").sortWithinPartitions("shard", "order_key", ROW)
    text = F.when(F.col("take") < F.col("size"), mixing.first_words(F.col("text"), F.col("take"))).otherwise(F.col("text"))
    return drawn.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with modest_batches(spark):
        return stash(packing.pack(docs.select(*COLUMNS), public_path("byte_bpe_50k.json"), max_pieces=MAX_PIECES), "packed")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Sketches, language models and tokenizers have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
