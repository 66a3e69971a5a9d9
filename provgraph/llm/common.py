"""Shared helpers: table access, shared scratch tables, word definitions."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as every operator here understands it.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of ``sf_dir``, read by Spark alone (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(docs: DataFrame, column: str = "text") -> Column:
    """The text column, null read as empty."""
    return F.coalesce(docs[column].cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of ``text``."""
    return F.array_remove(F.split(text, f"[{SPACE}]+"), "")


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application under ``spark.checkpoint.dir``.

    The setting is read from the session. Where it is unset (tests on one
    machine) a temporary folder is used; on a cluster it has to be set, since
    executors do not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="provgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: What goes to Python at once; Spark's own bounds are 10,000 rows and 64 MB.
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Within it, jobs send Python batches of bounded rows and bytes (one row
    at least): a task holds each batch several times, as the JVM's buffers,
    which double as they grow, and in Python as sent, worked on and returned."""
    before = {k: spark.conf.get(k) for k in (ARROW_ROWS, ARROW_BYTES)}
    # sizes are given back as "67108864b"; zero or less is no bound
    for key, most in ((ARROW_ROWS, BATCH_ROWS), (ARROW_BYTES, BATCH_BYTES)):
        held = before[key].rstrip("b")
        spark.conf.set(key, min(most, int(held)) if held.isdigit() and int(held) else most)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Scratch:
    """Parquet tables in the shared folder that cut lineage.

    A lost executor does not lose them, unlike cached or locally checkpointed
    blocks. ``drop`` deletes those that no returned DataFrame reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and read it back."""
        return self.spark.read.schema(df.schema).parquet(self.write(df))

    def write(self, df: DataFrame) -> str:
        self.count += 1
        path = f"{self.base}/{self.count}"
        with small_batches(self.spark):
            df.write.parquet(path)
        return path

    def drop(self) -> None:
        """Delete every table written so far."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
