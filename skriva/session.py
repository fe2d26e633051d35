"""SparkSession factory."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "skriva", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and ANSI mode; conf overrides anything.

    On a cluster master and resources come from spark-submit; shuffle partitions then are the upper bound that
    adaptive execution coalesces from.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


#: What one task takes at most of stored bytes, of characters of text and of postings.
TASK_BYTES, TASK_CHARS, TASK_ROWS = 8 << 20, 16 << 20, 1_000_000


def tasks(spark: SparkSession, amount: int, each: int) -> int:
    """As many tasks as the session has shuffle partitions, and more where a task would get more than `each` of the amount: its memory doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def stored_bytes(df: DataFrame) -> int:
    """Bytes of what df reads, by the optimizer's figures; sources of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 60)


def read_parts(df: DataFrame) -> int:
    """In how many parts df is read; 0 where a shuffle comes first, as then only running it would tell."""
    query = df._jdf.queryExecution()
    plan = query.executedPlan()
    return 0 if plan.nodeName() == "AdaptiveSparkPlan" or "Exchange" in plan.toString() else query.toRdd().getNumPartitions()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session.

    Where it is unset in local mode, as in tests, a temporary folder is made and set. A cluster without it is a
    ValueError, as no folder of one machine would do.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir():
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="skriva-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_shared(spark: SparkSession, path: str) -> None:
    """Remove a folder that isn't read any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def clean_shared(spark: SparkSession, hours: float = 24.0) -> list[str]:
    """Remove the folders of `shared_path` that are older than that, which results have been read from; gives their names.

    A result is read from its folder lazily, so nothing but the caller knows when it is done with.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    system, gone = root.getFileSystem(spark._jsc.hadoopConfiguration()), []
    for x in system.listStatus(root) if system.exists(root) else []:
        name = x.getPath().getName()
        if re.search(r"-[0-9a-f]{32}(-compact)?$", name) and x.getModificationTime() < (time.time() - 3600 * hours) * 1000:
            system.delete(x.getPath(), True)
            gone.append(name)
    return gone
