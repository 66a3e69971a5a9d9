"""Token counts: delta-maintained rollups.

A ledger keeps additive totals (documents, tokens, characters) by source,
language and tokenizer version. A batch of changes (insert, revise, delete) is
turned into signed deltas: minus what the document counted for before, plus
what it counts for now. The deltas' sums are added to the totals of the commit
before, which a commit replaces; no total is ever recounted.

Beside the totals a commit names runs of entries: what each document counts
for, by batch. A commit adds one run, and merges the last ones as long as they
are not less than half as large as the one before, so that there are at most
about log2(entries) runs however many batches came before, and a row is
rewritten as often. Runs that a later commit has replaced are deleted.

Commits are idempotent and atomic. A batch writes its run and totals under its
own number, overwriting what an interrupted attempt left; its manifest, which
names the runs and totals that hold from then on, appears last by a rename.
What no manifest names is not read, and a batch with one is not committed
again.

Scale: counting is one pass over the texts without a shuffle. A commit
shuffles only the batch's rows and the entries (id and numbers) by document;
deltas are summed map-side, so a hot source is a few rows a task. The
vocabulary (about 50,000 tokens) goes to executors with the function.

Defined results: null text counts 0 tokens; a null source or language is a
group of its own; a delete of an unknown document does nothing, an insert of a
known one revises it; of several changes to one document in a batch the one
with the greatest ``at`` (then greatest values) holds; groups whose documents
are all gone leave the totals; a batch without changes is a commit of its own.
Changes with a null doc_id are ignored, and columns of other names too.
"""

from __future__ import annotations

import base64
import json
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.llm.common import Scratch, table, text_of
from provgraph.llm.hashing import slices

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
# Fixed value: how the public byte-level vocabulary splits text.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHANGES = "op string, doc_id long, source string, lang string, version string, n_tokens long, n_chars long, at long"


def count_tokens(rows: DataFrame, columns: list[str], folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` with each text column replaced by its number of tokens, null
    staying null. The vocabulary file is read on the driver."""
    held = Path(folder, f"{vocabulary}.tiktoken").read_bytes()
    at = [rows.columns.index(c) for c in columns]

    def run(batches):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.splitlines()) if a}
        encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for whole in batches:
            for batch in slices(whole, at[0]):
                arrays = [pa.array([None if x is None else len(encode(x)) for x in c.to_pylist()], pa.int64()) if i in at else c for i, c in enumerate(batch.columns)]
                yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    kinds = [f"`{n}` {'long' if n in columns else t}" for n, t in rows.dtypes]
    return rows.mapInArrow(run, ", ".join(kinds))


SUMS = ["docs", "tokens", "chars"]
GROUP = ["source", "lang", "version"]
ENTRIES = "doc_id long, version string, alive boolean, source string, lang string, n_tokens long, n_chars long, batch long"
TOTALS = "source string, lang string, version string, docs long, tokens long, chars long"
NOTHING = {"batch": None, "runs": [], "totals": None}


class TokenLedger:
    """Totals under ``path``, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._paths(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        folder = self._paths(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(folder) if s.getPath().getName().isdigit()) if self._fs.exists(folder) else []

    def _manifest(self) -> dict:
        """What the last commit says: its batch, runs [(name, rows)], totals."""
        done = self._commits()
        if not done:
            return NOTHING
        return json.loads(self.spark.read.text(f"{self.path}/commits/{done[-1]}", wholetext=True).first().value)

    def _publish(self, manifest: dict) -> None:
        draft, final = (self._paths(f"{self.path}/commits/{name}") for name in (f"_draft-{manifest['batch']}", str(manifest["batch"])))
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"batch {manifest['batch']} was committed meanwhile")

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self._fs.delete(self._paths(f"{self.path}/{name}"), True)

    def _entries(self, runs: list) -> DataFrame:
        """The last entry of each document of these runs, gone ones too."""
        rows = self.spark.read.schema(ENTRIES).parquet(*[f"{self.path}/{name}" for name, _ in runs])
        last = F.max_by(F.struct("alive", "source", "lang", "n_tokens", "n_chars", "batch"), "batch").alias("s")
        return rows.groupBy("doc_id", "version").agg(last).select("doc_id", "version", "s.*")

    def state(self) -> DataFrame:
        """What each known document counts for."""
        runs = self._manifest()["runs"]
        rows = self._entries(runs) if runs else self.spark.createDataFrame([], ENTRIES)
        return rows.filter("alive").drop("alive", "batch")

    def _merged(self, runs: list, batch: int) -> list:
        """The runs after those at the end have been merged."""
        first = len(runs) - 1
        rows = runs[first][1]
        while first and 2 * rows >= runs[first - 1][1]:
            first -= 1
            rows += runs[first][1]
        if first == len(runs) - 1:
            return runs
        found = self._entries(runs[first:])
        name = f"runs/{batch}-merged"
        # without older runs nothing is left for a deletion to hide
        (found if first else found.filter("alive")).write.mode("overwrite").parquet(f"{self.path}/{name}")
        return [*runs[:first], [name, self.spark.read.schema(ENTRIES).parquet(f"{self.path}/{name}").count()]]

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Add a batch; False if it was committed before. Later batches have
        greater numbers."""
        before = self._manifest()
        if before["batch"] is not None and batch <= before["batch"]:
            if batch in self._commits():
                return False
            raise ValueError("batches are committed in order")
        row = F.struct("at", (F.col("op") != "delete").alias("alive"), "source", "lang", "n_tokens", "n_chars")
        new = changes.filter("doc_id is not null").groupBy("doc_id", "version").agg(F.max(row).alias("r"))
        number = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit(0)).cast("long").alias(c)
        new = new.select("doc_id", "version", "r.alive", "r.source", "r.lang", number("n_tokens"), number("n_chars"), F.lit(batch).cast("long").alias("batch"))
        name = f"runs/{batch}"
        new.write.mode("overwrite").parquet(f"{self.path}/{name}")
        new = self.spark.read.schema(ENTRIES).parquet(f"{self.path}/{name}")
        signed = lambda df, s: df.filter("alive").select(*GROUP, *[(s * x).cast("long").alias(n) for n, x in zip(SUMS, (F.lit(1), F.col("n_tokens"), F.col("n_chars")))])
        sums = signed(new, 1)
        if before["runs"]:
            keys = new.select(F.col("doc_id").alias("d"), F.col("version").alias("v"))
            old = self._entries(before["runs"]).join(keys, (F.col("doc_id") == F.col("d")) & F.col("version").eqNullSafe(F.col("v")), "left_semi")
            sums = sums.union(signed(old, -1))
        if before["totals"]:
            sums = sums.union(self._totals(before).select(*GROUP, *SUMS))
        sums = sums.groupBy(*GROUP).agg(*[F.sum(c).alias(c) for c in SUMS]).filter("docs != 0 or tokens != 0 or chars != 0")
        sums.write.mode("overwrite").parquet(f"{self.path}/totals/{batch}")
        runs = self._merged([*before["runs"], [name, new.count()]], batch)
        self._publish({"batch": batch, "runs": runs, "totals": f"totals/{batch}"})
        kept = {r for r, _ in runs}
        self._drop([r for r, _ in [*before["runs"], [name, 0]] if r not in kept] + ([before["totals"]] if before["totals"] else []))
        return True

    def _totals(self, manifest: dict) -> DataFrame:
        return self.spark.read.schema(TOTALS).parquet(f"{self.path}/{manifest['totals']}")

    def totals(self) -> DataFrame:
        """(source, lang, version, docs, tokens, chars) as of the last commit."""
        manifest = self._manifest()
        return self._totals(manifest) if manifest["totals"] else self.spark.createDataFrame([], TOTALS)


def tidy(text):
    """A text without spaces at line ends, and with single spaces."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r" +(\n|$)|^ ", "$1")


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals after three batches over all documents.

    Batch 1 inserts every document, and is delivered twice; batch 2 revises
    those whose text changes when tidied; batch 3 deletes exact copies of a
    document of smaller id.
    """
    scratch, result = Scratch(spark, "counted"), Scratch(spark, "ledger")
    docs = table(spark, sf_dir, "documents")
    text = text_of(docs)
    rows = docs.select("doc_id", "source", "lang", F.length(text).cast("long").alias("n_chars"), F.xxhash64(text).alias("h1"), F.md5(text).alias("h2"), text.alias("tokens"), tidy(text).alias("t2"))
    rows = rows.withColumn("c2", F.length("t2").cast("long")).withColumn("t2", F.when(F.col("t2") != F.col("tokens"), F.col("t2")))
    counted = scratch.save(count_tokens(rows, ["tokens", "t2"]))
    changes = lambda df, op, n="tokens", c="n_chars": df.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(VOCABULARY).alias("version"), F.col(n).alias("n_tokens"), F.col(c).alias("n_chars"), F.lit(0).cast("long").alias("at"))
    ledger = TokenLedger(spark, result.base)
    first = counted.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first != last")
    # a table of its own, so that the join can split a text that many share
    first = scratch.save(first.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first"))
    copies = counted.join(first, (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))).filter("doc_id != first")
    for batch, rows in ((1, changes(counted, "insert")), (1, changes(counted, "insert")), (2, changes(counted.filter("t2 is not null"), "revise", "t2", "c2")), (3, changes(copies, "delete"))):
        ledger.commit(batch, rows)
    scratch.drop()
    return ledger.totals()
