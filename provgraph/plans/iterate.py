"""Tables that cut the plan between rounds of an iteration."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Rounds:
    """Writes a round's result to the folder in ``spark.checkpoint.dir`` and
    reads it back, so that plans stay short and a lost executor costs nothing
    that was written. Without that setting (tests) a temporary folder serves.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.gettempdir()
        self.spark, self.base, self.n = spark, f"{base.rstrip('/')}/rounds-{uuid.uuid4().hex[:12]}", 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the result apart, and delete the rounds' own tables."""
        out = Rounds(self.spark).save(df)
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.base)
        folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        return out


def kept(table: DataFrame) -> bool:
    """Whether the files of a table that was written are still there."""
    hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs
    conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
    paths = [hadoop.Path(f) for f in table.inputFiles()]
    return all(p.getFileSystem(conf).exists(p) for p in paths)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with each row's place, from 0, in the order of some columns.

    Rows are dealt by ranges of those columns, numbered within each range, and
    shifted by how many the ranges before hold: no task sees all.
    """
    dealt = Rounds(df.sparkSession).save(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = dealt.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = counts.select(F.col("__part").alias("__p"), (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__shift"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    rows = dealt.withColumn("__place", place).join(F.broadcast(before), F.col("__part") == F.col("__p"))
    return rows.select(*df.columns, (F.col("__shift") + F.col("__place")).alias(name))
