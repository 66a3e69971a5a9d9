"""Tables of named files: what a reader sees is what numbered commits name."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.errors import Conflict

#: Every so many commits one names all entries, so that readers start there.
WHOLE = 32


class Files:
    """A folder of any file system that Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def sizes(self, name: str = "") -> dict[str, int]:
        """Length of each file right under a folder; none without the folder."""
        folder = self.at(name)
        if not self.fs.exists(folder):
            return {}
        return {s.getPath().getName(): s.getLen() for s in self.fs.listStatus(folder) if not s.getPath().getName().startswith(("_", "."))}

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def put(self, name: str, text: str) -> None:
        """The file appears whole, or Conflict if there is one of that name.

        A rename that does not replace, atomic on HDFS; a hard link on a local
        or mounted file system. On object stores whose client renames by
        copying, one writer at a time has to be seen to by other means.
        """
        temporary = f".{uuid.uuid4().hex}.tmp"
        out = self.fs.create(self.at(temporary), True)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            if self.fs.getScheme() == "file":
                paths = [self.jvm.java.io.File(self.at(n).toUri().getPath()).toPath() for n in (name, temporary)]
                self.jvm.java.nio.file.Files.createLink(*paths)
            else:
                rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
                how = self.spark.sparkContext._gateway.new_array(rename, 1)
                how[0] = rename.NONE
                self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf).rename(self.at(temporary), self.at(name), how)
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName():
                raise Conflict(f"{self.path}/{name}") from error
            raise
        finally:
            if self.fs.exists(self.at(temporary)):
                self.fs.delete(self.at(temporary), False)

    def delete(self, name: str = "") -> None:
        self.fs.delete(self.at(name), True)


class Manifest:
    """Entries by name, and facts; changed by numbered commits only."""

    def __init__(self, spark: SparkSession, path: str):
        self.files = Files(spark, path)

    def state(self) -> tuple[int, dict[str, dict], dict]:
        """(number of the last commit, entries in order, facts)."""
        numbers = sorted(int(n.removesuffix(".json")) for n in self.files.sizes() if n.endswith(".json"))
        entries, facts = {}, {}
        start = max((i for i, n in enumerate(numbers) if n % WHOLE == 0), default=0)
        for n in numbers[start:]:
            said = json.loads(self.files.text(f"{n:020d}.json"))
            if "all" in said:
                entries = {}
            for name in said["drop"]:
                entries.pop(name, None)
            entries |= {e["name"]: e for e in said.get("all", said["add"])}
            facts = said["facts"]
        return (numbers[-1] if numbers else 0), entries, facts

    def commit(self, after: int, entries: dict[str, dict], facts: dict, add: list[dict], drop: list[str] = ()) -> None:
        """The commit that follows number ``after``, whose entries were given;
        Conflict if that number is taken."""
        said = {"add": add, "drop": list(drop), "facts": facts}
        if (after + 1) % WHOLE == 0:
            said["all"] = [e for e in entries.values() if e["name"] not in drop] + add
        self.files.put(f"{after + 1:020d}.json", json.dumps(said, ensure_ascii=False))


def described(spark: SparkSession, folder: str, key: str) -> list[dict]:
    """For each Parquet file of a folder its name, length, sha256, and the
    least and greatest value of a text column."""
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    hashed = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    ends = spark.read.parquet(folder).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("rows"))
    return [r.asDict() for r in hashed.join(ends, F.col("file") == F.col("f")).drop("f").orderBy("file").collect()]  # a row a file


def clustered(rows: DataFrame, columns: list[str], files: int, bloom: str | None, distinct: int, path: str) -> None:
    """Write rows dealt to files by ranges of columns, in their order, with a
    Bloom filter on one of them and row groups of some megabytes."""
    writer = rows.repartitionByRange(files, *columns).sortWithinPartitions(*columns).write.option("parquet.block.size", 16 << 20)
    if bloom:
        writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true").option(f"parquet.bloom.filter.expected.ndv#{bloom}", max(1000, distinct))
    writer.parquet(path)
