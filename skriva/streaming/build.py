"""Batches of documents into the index, from a stream or not.

Each batch writes its postings, then its build log, under folders named by its number, replacing
what an earlier attempt of that batch left, so that a batch that runs again after a failure counts once. Documents that the
build log of earlier batches has with the same load are skipped; those of a later load are indexed anew, and the table `replaced` names
them, so that readers leave out what earlier batches wrote of them. The length of a field goes with each of its postings, and the sum of all with
each batch, so no query reads a table of all documents.

<path>/index-<version>/{postings,log,replaced,corpus}/batch=<n>: compaction writes the next version as a whole, and readers take the last
one that is ready.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import LOWER, Analyzer, doc_stats, field_column, postings, text_length
from ..schema import BUILD_LOG, CORPUS, INDEX_POSTINGS, REPLACED
from ..session import TASK_CHARS, TASK_ROWS, tasks
from ..sources.loaders import latest
from ..sources.store import LIVE_RATIO, write_postings

TABLES = {"postings": INDEX_POSTINGS, "log": BUILD_LOG, "replaced": REPLACED, "corpus": CORPUS}
#: So many replaced documents at most are sent to all tasks.
FEW_IDS = 100_000


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    system, folder = _file_system(spark, path)
    return [x.getPath().getName() for x in system.listStatus(folder)] if system.exists(folder) else []


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of the index that are ready, ascending; the first needs no mark."""
    found = sorted(int(m[1]) for x in _names(spark, path) if (m := re.fullmatch(r"index-(\d+)", x)))
    return [v for v in found if not v or "_READY" in _names(spark, f"{path}/index-{v}")]


def index_folder(spark: SparkSession, path: str) -> str:
    return f"{path}/index-{(versions(spark, path) or [0])[-1]}"


def last_batch(spark: SparkSession, path: str) -> int:
    """The number of the last batch that is in the build log; 0 before the first."""
    return max((int(x[6:]) for x in _names(spark, f"{index_folder(spark, path)}/log") if x.startswith("batch=")), default=0)


def read_index(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table that the batches wrote, with the column `batch`; empty before the first."""
    folder = f"{index_folder(spark, path)}/{table}"
    kind = f"{TABLES[table]}, batch long"
    names = spark.createDataFrame([], kind)
    if not any(x.startswith("batch=") for x in _names(spark, folder)):
        return names
    return spark.read.schema(kind).parquet(folder).select(*names.columns)


def live_postings(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """The postings that no later batch has replaced. Only those of batches before the last that replaced any need a join for that: with the ids in
    memory where they are few, else by hash tables of the ids, so that postings aren't sorted. parts: spread over so many tasks, for a rewrite of all."""
    post = read_index(spark, path, "postings")
    spread = (lambda df: df.repartition(parts, "field", "doc_id")) if parts else (lambda df: df)
    again = [int(x[6:]) for x in _names(spark, f"{index_folder(spark, path)}/replaced") if x.startswith("batch=")]
    if not again:
        return spread(post)
    replaced = read_index(spark, path, "replaced")
    few = replaced.count() <= FEW_IDS  # by the files' footers
    gone = replaced.groupBy("field", "doc_id").agg(F.max("batch").alias("__since"))
    later = F.col("batch") >= max(again)
    # an outer join: the optimizer would move a left_anti one below the exchange of `spread`, which then is a second one
    first = spread(post.filter(~later)).join(F.broadcast(gone) if few else gone.hint("shuffle_hash"), ["field", "doc_id"], "left")
    return first.filter(F.col("__since").isNull() | (F.col("batch") >= F.col("__since"))).select(*post.columns).unionByName(spread(post.filter(later)))


def live_log(spark: SparkSession, path: str) -> DataFrame:
    """The last entry of each document and field."""
    return latest(read_index(spark, path, "log"), F.col("batch"), ["field", "doc_id"])


def _texts(rows: DataFrame, new: DataFrame, field: str, unit: str, counts: dict[int, int]) -> DataFrame:
    """The row of each new document, one even if its load has several (then the longest). counts: of the new documents by load.

    Only loads that hold new documents are read, and nothing is joined where these hold nothing else.
    """
    own = rows.filter(F.col("load").isin(list(counts))) if counts else rows.filter(F.lit(False))
    if {r.load: r.n for r in own.groupBy("load").agg(F.count("*").alias("n")).collect()} == counts:
        return own
    ids = new.select(F.col("doc_id").alias("__id"), F.col("load").alias("__of"))
    found = own.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("load") == F.col("__of")), "left_semi")
    longest = F.struct(F.coalesce(text_length(F.col(field), unit), F.lit(-1)), F.col(field).alias("text"))
    return found.groupBy("doc_id", "load").agg(F.max(longest).alias("__d")).select("doc_id", F.col("__d.text").alias(field), "load")


def build_batch(docs: DataFrame, batch: int, path: str, field: str = "text", analyzer: Analyzer = LOWER, unit: str = "chars", done: Callable[[int, int], None] | None = None) -> int:
    """Add the documents that aren't built yet, or of a later load than the one built; a batch with the same number replaces itself.

    Of several rows with one id that of the largest `load` counts, where docs has this column, and of these the longest. Only the
    field's column is read. Gives the number of documents, as it does to `done` with the batch's number.
    """
    spark, column = docs.sparkSession, field_column(docs, field)
    folder = index_folder(spark, path)
    earlier = read_index(spark, path, "log").filter((F.col("batch") < batch) & (F.col("field") == field))
    built = earlier.groupBy(F.col("doc_id").alias("__built")).agg(F.max("load").alias("__load"), F.max_by("field_len", "batch").alias("__old"))
    order = (F.col("load") if "load" in docs.columns else F.lit(0)).cast("long")
    rows = docs.select("doc_id", F.col(column).alias(field), order.alias("load"))
    # which documents are new is told by ids and lengths alone: texts are moved once, to be analyzed
    lengths = doc_stats(rows, field, unit=unit, keep=("load",)).groupBy("doc_id", "load").agg(F.max("field_len").alias("field_len"))
    last = lengths.groupBy("doc_id").agg(F.max("load").alias("load"), F.max_by("field_len", "load").alias("field_len"))
    new = last.join(built, F.col("doc_id") == F.col("__built"), "left").filter(F.col("__load").isNull() | (F.col("load") > F.col("__load")))
    log = new.select(F.lit(field).alias("field"), "doc_id", "field_len", "load", F.lit(batch).cast("long").alias("batch_id"), "__old", "__built").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        loads = {r.load: r for r in log.groupBy("load").agg(F.count("*").alias("n"), F.sum(F.greatest("field_len", F.lit(0))).alias("chars"), F.count("__built").alias("again")).collect()}
        texts = _texts(rows, log, field, unit, {k: r.n for k, r in loads.items()})
        post = postings(texts, field, analyzer, unit=unit, parts=tasks(spark, sum(r.chars for r in loads.values()), TASK_CHARS))
        write_postings(post, f"{folder}/postings/batch={batch}", "overwrite")
        if any(r.again for r in loads.values()):
            log.filter("__built IS NOT NULL").select("field", "doc_id").write.mode("overwrite").parquet(f"{folder}/replaced/batch={batch}")
        change = log.groupBy("field").agg(F.sum(F.when(F.col("__built").isNull(), 1).otherwise(0)).alias("docs"), F.sum(F.col("field_len") - F.coalesce("__old", F.lit(0))).alias("chars"))
        change.write.mode("overwrite").parquet(f"{folder}/corpus/batch={batch}")
        log.select("field", "doc_id", "field_len", "load", "batch_id").write.mode("overwrite").parquet(f"{folder}/log/batch={batch}")  # last: only with it does the batch count
    finally:
        log.unpersist()
    n = sum(r.n for r in loads.values())
    if done:
        done(batch, n)
    return n


def compact_index(spark: SparkSession, path: str, least: float = LIVE_RATIO, force: bool = False) -> bool:
    """Rewrite the index as one batch if under `least` of its postings are live; gives whether it did. The version before stays for readers that have begun, older ones go."""
    ready, old = versions(spark, path), index_folder(spark, path)
    stored, live = read_index(spark, path, "postings"), live_postings(spark, path)
    total = stored.count()
    if not total or (not force and live.count() >= least * total):
        return False
    new, batch = f"{path}/index-{(ready or [0])[-1] + 1}", last_batch(spark, path)
    system, _ = _file_system(spark, new)
    gone = spark._jvm.org.apache.hadoop.fs.Path
    system.delete(gone(new), True)  # what an attempt that failed left
    write_postings(live_postings(spark, path, tasks(spark, total, TASK_ROWS)).drop("batch"), f"{new}/postings/batch={batch}")
    read_index(spark, path, "corpus").groupBy("field").agg(F.sum("docs").alias("docs"), F.sum("chars").alias("chars")).write.parquet(f"{new}/corpus/batch={batch}")
    live_log(spark, path).drop("batch").write.parquet(f"{new}/log/batch={batch}")
    system.create(gone(f"{new}/_READY")).close()
    for v in ready:
        if f"{path}/index-{v}" != old:
            system.delete(gone(f"{path}/index-{v}"), True)
    return True


def stream_build(stream: DataFrame, path: str, checkpoint: str, field: str = "text", analyzer: Analyzer = LOWER, interval: str | None = None, done: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Start the build; without an interval it takes what is there and ends. done: is told the number of each batch and of its documents."""
    trigger = {"processingTime": interval} if interval else {"availableNow": True}

    def add(df: DataFrame, n: int) -> None:
        build_batch(df, n + 1, path, field, analyzer, done=done)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def document_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
