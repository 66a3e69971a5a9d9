"""The maintained graph kept by a stream of events.

Order is that of seq, never of time, so there is no watermark. The state store
remembers, for each entity, the numbers of its last event and of its last
delete; what a batch of events changes passes on, and what comes late with a
smaller seq, or again, does not. The changes of a batch are merged into the
projection as a batch of a log is, so that a batch costs what it changes.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from provgraph.operators.projection import Projection
from provgraph.schema import EVENTS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


class Newest(StatefulProcessor):
    """Of each entity the last event, if it is later than the one known, and
    the last delete likewise: it takes edges along even if it comes late."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "last bigint, gone bigint")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:  # noqa: N802, N803
        import pandas as pd

        last, gone = self.known.get() if self.known.exists() else (0, 0)
        newest = deleted = None
        for part in rows:  # an entity of many events comes in parts
            row = part.loc[[part["seq"].idxmax()]]
            if int(row["seq"].iloc[0]) > last:
                newest, last = row, int(row["seq"].iloc[0])
            if len(ends := part[part["event_type"] == "node_deleted"]):
                row = ends.loc[[ends["seq"].idxmax()]]
                if int(row["seq"].iloc[0]) > gone:
                    deleted, gone = row, int(row["seq"].iloc[0])
        found = [r for r in (newest, deleted) if r is not None]
        if found:
            self.known.update((last, gone))
            yield pd.concat(found).drop_duplicates("seq")

    def close(self) -> None:
        pass


def newest_events(events: DataFrame) -> DataFrame:
    """The events of a stream that change what is known of their entity. The
    session's state store becomes RocksDB, which such state needs."""
    events.sparkSession.conf.set(PROVIDER, ROCKS)
    return events.groupBy("entity_type", "entity_id").transformWithStateInPandas(Newest(), EVENTS, "Append", "None")


def fold_stream(events: DataFrame, target: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Keep the projection in ``target`` up to a stream of events. A batch that
    is repeated after a failure is known by its number and changes nothing."""
    held = Projection(None, target, events.sparkSession)

    def merge(batch: DataFrame, number: int) -> None:
        # written once, since every action on a batch would go through its state again
        incoming = f"{held.path}/incoming"
        batch.write.mode("overwrite").parquet(incoming)
        rows = batch.sparkSession.read.schema(EVENTS).parquet(incoming)
        n, last = rows.selectExpr("count(*)", "coalesce(max(seq), 0)").first()
        if n:
            held.apply(rows, last, n, f"batch-{number}")
        held.files.delete("incoming")

    return newest_events(events).writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
