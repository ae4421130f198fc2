"""What the operators of this subpackage share.

Conventions that hold for all of them unless a docstring says otherwise:

* a null text is the empty text; a null ``doc_id`` stays null and is kept;
* operators select the columns they need first, so further columns of any name do no harm;
* rows that repeat a ``doc_id`` are separate documents;
* an empty table gives an empty result of the same schema.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``doc_id`` as a long and ``text`` without nulls, then the keys."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *(keys or []))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with value computed once a row, also where a lambda inside body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, one under the working folder if that is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.abspath("spark-warehouse/checkpoints")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed and written to the shared folder; survives lost executors and has no lineage."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, what is executed goes to Python in batches of so many rows at most, which the JVM and the worker hold outside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def with_key(docs: DataFrame) -> DataFrame:
    """docs with __k1 and __k2, two hashes of doc_id and text: rows that share both are copies with the same id, or without one."""
    what = [F.col("doc_id").isNull(), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))]
    return docs.withColumns({"__k1": F.xxhash64(F.lit(1), *what), "__k2": F.xxhash64(F.lit(2), *what)})


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs, all columns, with one row of each root in found (doc_id, __k1, __k2, root: a row a document).

    It is the row of the smallest doc_id, nulls last; of rows that repeat it, the one of the smallest key.
    """
    chosen = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__k1", "__k2")).alias("x")).select("x.__k1", "x.__k2")
    kept = with_key(docs).join(chosen, ["__k1", "__k2"], "left_semi")
    twice = checkpoint(found.groupBy("__k1", "__k2").count().where("count > 1").select("__k1", "__k2").join(chosen, ["__k1", "__k2"], "left_semi"))
    if not twice.isEmpty():
        many = kept.join(twice, ["__k1", "__k2"], "left_semi").dropDuplicates(["__k1", "__k2"])
        kept = kept.join(twice, ["__k1", "__k2"], "left_anti").unionByName(many)
    return kept.drop("__k1", "__k2")


def trim() -> None:
    """Give memory that a task has freed back to the system; Python workers stay and would hold it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more; it does so only when the driver collects its garbage.

    Python's references reach the JVM a little later, and so do finished jobs; what the first collection leaves, the second finds.
    """
    import gc
    import time

    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
