"""The append-only event log and its checkpoints, as Parquet folders."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provgraph.errors import Conflict, DamagedLog, ValidationError
from provgraph.functions.validation import event_rules, require_valid
from provgraph.plans.iterate import numbered
from provgraph.schema import CHECKPOINTS, EDGES, EVENT_TYPES, EVENTS, NODES
from provgraph.sources.manifest import Files, Manifest, clustered, described

EVENTS_COLUMNS = [field.split()[0] for field in EVENTS.split(", ")]


class EventLog:
    """Events under ``path``/events, snapshots under ``path``/checkpoints.

    Only ever appended to. A batch is written to a folder of its own and then
    named, with its range of numbers and its files' lengths and hashes, by a
    numbered commit that is put only if its number is free: readers see all of
    it or nothing, and of two writers at once the later one renumbers what it
    has written, or learns of the other if it expected none. Files that are
    not as long as their commit says, or whose pages do not match their
    checksums, are refused; ``verify`` hashes all.

    ``cluster`` brings batches together in files by ranges of entity, so that
    an entity's history is read from few places, while the commits' ranges of
    numbers still tell which files hold what follows a number.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = Manifest(spark, f"{self.path}/commits")
        self.files = Files(spark, f"{self.path}/events")

    def events(self) -> DataFrame:
        return self._read(self.manifest.state()[1].values())

    def _read(self, entries, low: str | None = None) -> DataFrame:
        """The events of some entries; with ``low``, of those files alone in
        which that entity may stand."""
        paths = []
        for entry in entries:
            found = self.files.sizes(entry["name"])
            for file in entry["files"]:
                if found.get(file["file"]) != file["bytes"]:
                    raise DamagedLog(f"{entry['name']}/{file['file']}")
                if low is None or file["low"] <= low <= file["high"]:
                    paths.append(f"{self.files.path}/{entry['name']}/{file['file']}")
        if not paths:
            return self.spark.createDataFrame([], EVENTS)
        return self.spark.read.schema(EVENTS).option("parquet.page.verify-checksum.enabled", "true").parquet(*paths)

    def _exists(self, part: str) -> bool:
        return self.files.fs.exists(self.files.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}"))

    def append(self, batch: DataFrame, expected: int | None = None, attempts: int = 20) -> int:
        """Check all by the rules of events, number in order of ``position``,
        append; returns the last number. What an entity's fields may hold is
        checked by commands before. Positions 0, 1, 2 ... are taken as they
        are; others, or none, are brought in order first.

        ``expected`` is the last number that the batch relies on: if another
        writer has appended since, Conflict is raised and nothing appended.
        """
        filled = batch
        for name, kind, value in (("payload", "string", None), ("before", "string", None), ("actor", "string", "system"), ("reason", "string", ""), ("occurred_at", "timestamp_ntz", None), ("position", "int", 0)):
            filled = filled.withColumn(name, F.col(name).cast(kind) if name in batch.columns else F.lit(value).cast(kind))
        filled = filled.withColumns({
            "actor": F.when(F.trim(F.coalesce("actor", F.lit(""))) == "", "system").otherwise(F.col("actor")),
            "payload": F.when(~F.trim("payload").isin("", "null"), F.col("payload")),
            "occurred_at": F.coalesce("occurred_at", F.current_timestamp().cast("timestamp_ntz")),
        })
        require_valid(filled, event_rules())
        seen = filled.agg(F.count(F.lit(1)).alias("n"), F.min("position").alias("least"), F.max("position").alias("most"), F.count_distinct("position").alias("different")).first()
        if not seen.n:
            return self.max_seq()
        if (seen.least, seen.most, seen.different) != (0, seen.n - 1, seen.n):
            filled = numbered(filled, ["position"], "place").withColumn("position", F.col("place")).drop("place")
        rows, base = filled.withColumn("seq", F.col("position").cast("bigint")).select(*EVENTS_COLUMNS), 0
        for _ in range(attempts):
            version, entries, facts = self.manifest.state()
            last = facts.get("last_seq", 0)
            if expected is not None and last != expected:
                raise Conflict(f"{last} events, not {expected}")
            name = uuid.uuid4().hex
            rows.withColumn("seq", F.col("seq") + (last + 1 - base)).write.parquet(f"{self.files.path}/{name}")
            entry = {"name": name, "first": last + 1, "last": last + seen.n, "rows": seen.n, "clustered": False, "files": described(self.spark, f"{self.files.path}/{name}", "entity_id")}
            try:
                self.manifest.commit(version, entries, {"last_seq": last + seen.n}, [entry])
                return last + seen.n
            except Conflict:  # the batch is read back, as its plan need not give the same rows again
                rows, base = self.spark.read.schema(EVENTS).parquet(f"{self.files.path}/{name}"), last + 1
        raise Conflict(f"not appended after {attempts} attempts")

    def max_seq(self) -> int:
        """The last number, from the commits alone."""
        return self.manifest.state()[2].get("last_seq", 0)

    def count(self) -> int:
        return sum(e["rows"] for e in self.manifest.state()[1].values())

    def range(self, from_seq: int = 0, until=None) -> DataFrame:
        """Events after ``from_seq`` and not after ``until``, from the files
        that reach beyond that number."""
        entries = [e for e in self.manifest.state()[1].values() if e["last"] > from_seq]
        return range_of(self._read(entries), from_seq, until)

    def of_entity(self, entity_id: str) -> DataFrame:
        """An entity's events, from files in whose range of ids it lies; Bloom
        filters and statistics leave out most of their row groups."""
        return self._read(self.manifest.state()[1].values(), entity_id).filter(F.col("entity_id") == entity_id)

    def verify(self) -> int:
        """Hash every named file; how many there are, or DamagedLog."""
        told = {f"{e['name']}/{f['file']}": f["sha256"] for e in self.manifest.state()[1].values() for f in e["files"]}
        if told:
            content = self.spark.read.format("binaryFile").load([f"{self.files.path}/{p}" for p in told])
            found = content.select(F.array_join(F.slice(F.split("path", "/"), -2, 2), "/").alias("p"), F.sha2("content", 256).alias("h"))
            if wrong := sorted(r.p for r in found.collect() if told[r.p] != r.h):  # a row a file
                raise DamagedLog(", ".join(wrong))
        return len(told)

    def cluster(self, rows_per_file: int = 1_000_000) -> int:
        """Bring the batches since the last call together in one entry, along
        with entries that are not much larger; how many it replaced.

        Entries hold ranges of numbers, and each is at least twice as large as
        the next, so that an event is written again a logarithmic number of
        times. An entity of any number of events is spread over files by seq.
        """
        version, entries, facts = self.manifest.state()
        held = sorted(entries.values(), key=lambda e: e["first"])
        merged, rows = [], 0
        while held and (not held[-1]["clustered"] or held[-1]["rows"] <= 2 * rows):
            merged.append(held.pop())
            rows += merged[-1]["rows"]
        if not merged or (len(merged) == 1 and merged[0]["clustered"]):
            return 0
        name = uuid.uuid4().hex
        clustered(self._read(merged), ["entity_id", "seq"], -(-rows // rows_per_file), "entity_id", min(rows, rows_per_file), f"{self.files.path}/{name}")
        entry = {"name": name, "first": merged[-1]["first"], "last": merged[0]["last"], "rows": rows, "clustered": True, "files": described(self.spark, f"{self.files.path}/{name}", "entity_id")}
        drop = [e["name"] for e in merged]
        while True:
            try:
                self.manifest.commit(version, entries, facts, [entry], drop)
                return len(drop)
            except Conflict:  # appends since do no harm; another clustering does
                version, entries, facts = self.manifest.state()
                if not set(drop) <= set(entries):
                    raise

    def save_checkpoint(self, nodes: DataFrame, edges: DataFrame, last_seq: int) -> None:
        """A snapshot of both tables as of ``last_seq``.

        Its row (id, last_seq, counts, created_at) is written last: a snapshot
        without one, such as a crash leaves, is not read.
        """
        pad = lambda df, ddl: df.sparkSession.createDataFrame([], ddl).unionByName(df, allowMissingColumns=True)
        name = uuid.uuid4().hex
        target = f"{self.path}/checkpoints/{name}"
        for part, df, ddl in (("nodes", nodes, NODES), ("edges", edges, EDGES)):
            pad(df, ddl).write.parquet(f"{target}/{part}")
        counts = [self.spark.read.parquet(f"{target}/{part}").count() for part in ("nodes", "edges")]
        row = self.spark.createDataFrame([(name, last_seq, *counts)], "id string, last_seq bigint, node_count bigint, edge_count bigint")
        row.withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{self.path}/checkpoint_rows")

    def checkpoints(self) -> DataFrame:
        """(id, last_seq, node_count, edge_count, created_at) of whole ones."""
        if not self._exists("checkpoint_rows"):
            return self.spark.createDataFrame([], CHECKPOINTS)
        return self.spark.read.schema(CHECKPOINTS).parquet(f"{self.path}/checkpoint_rows")

    def checkpoint_seqs(self) -> list[int]:
        return sorted(r.last_seq for r in self.checkpoints().select("last_seq").collect())  # one small row a checkpoint

    def latest_checkpoint(self, not_after=None) -> tuple[int, DataFrame, DataFrame] | None:
        """(last_seq, nodes, edges) of the greatest last_seq among those made
        not later than ``not_after``.

        One that cannot be read, or does not hold what its row says, is passed
        over for the one before: the log alone is enough to go on.
        """
        rows = self.checkpoints()
        if not_after is not None:
            rows = rows.filter(F.col("created_at") <= not_after)
        for row in rows.orderBy(F.desc("last_seq"), F.desc("created_at"), "id").toLocalIterator():
            at = f"{self.path}/checkpoints/{row.id}"
            nodes, edges = (self.spark.read.schema(ddl).parquet(f"{at}/{part}") if self._exists(f"checkpoints/{row.id}/{part}") else None for part, ddl in (("nodes", NODES), ("edges", EDGES)))
            try:
                if nodes is not None and edges is not None and (nodes.count(), edges.count()) == (row.node_count, row.edge_count):
                    return row.last_seq, nodes, edges
            except Py4JJavaError:  # a file that is no Parquet
                pass
        return None

    def maybe_checkpoint(self, interval: int = 500, projection=None) -> bool:
        """Save a snapshot when ``interval`` events have come since the last:
        of the maintained projection if there is one, else of a fold."""
        from provgraph.operators.replay import replay_live

        last = self.max_seq()
        if interval <= 0 or last < interval:
            return False
        seqs = self.checkpoint_seqs()
        if last - (seqs[-1] if seqs else 0) < interval:
            return False
        if projection is None:
            self.save_checkpoint(*replay_live(self), last)
        else:
            projection.catch_up()
            last, graph = projection.snapshot()
            self.save_checkpoint(graph.nodes, graph.edges, last)
        return True


def range_of(log: DataFrame, from_seq: int = 0, until=None) -> DataFrame:
    """Events after ``from_seq`` and not after ``until``, by seq."""
    rows = log.filter(F.col("seq") > from_seq)
    if until is not None:
        rows = rows.filter(F.col("occurred_at") <= until)
    return rows.orderBy("seq")


def event_page(log: DataFrame, limit: int = 50, offset: int = 0, **filters) -> dict:
    """items, the total before paging, and the limit and offset in effect."""
    rows = matching(log, **{k: v for k, v in filters.items() if k != "desc"})
    limit, offset = page_limit(limit), max(0, offset)
    return {"items": list_events(log, limit=limit, offset=offset, **filters), "total": rows.count(), "limit": limit, "offset": offset}


def page_limit(limit: int) -> int:
    return 50 if limit <= 0 else min(limit, 500)


def list_events(log: DataFrame, entity_id: str = "", actor: str = "", types=(), start=None, end=None, desc: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the log, newest first by default; limit 1 to 500."""
    log = matching(log, entity_id, actor, types, start, end)
    return log.orderBy(F.desc("seq") if desc else F.asc("seq")).offset(max(0, offset)).limit(page_limit(limit))


def matching(log: DataFrame, entity_id: str = "", actor: str = "", types=(), start=None, end=None) -> DataFrame:
    """The events that meet all conditions; both bounds are included."""
    if start is not None and end is not None and start > end:
        raise ValidationError("start is after end")
    if unknown := [t for t in types if t not in EVENT_TYPES]:
        raise ValidationError(f"unknown event types {unknown}")
    for given, name in ((entity_id, "entity_id"), (actor, "actor")):
        if given:
            log = log.filter(F.col(name) == given)
    if types:
        log = log.filter(F.col("event_type").isin(*types))
    if start is not None:
        log = log.filter(F.col("occurred_at") >= start)
    if end is not None:
        log = log.filter(F.col("occurred_at") <= end)
    return log


def entity_timeline(log: DataFrame, entity_id: str, limit: int = 50) -> DataFrame:
    return list_events(log, entity_id=entity_id, limit=limit)


def bounds(log: DataFrame) -> DataFrame:
    """(count, earliest, latest)."""
    return log.agg(F.count(F.lit(1)).alias("count"), F.min("occurred_at").alias("earliest"), F.max("occurred_at").alias("latest"))
