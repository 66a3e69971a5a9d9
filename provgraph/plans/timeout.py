"""A time limit on everything that a block of code asks of Spark."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from provgraph.errors import QueryTimeout


@contextmanager
def time_limit(spark: SparkSession, seconds: float = 10.0) -> Iterator[None]:
    """Jobs that this thread starts inside are cancelled when the time is up,
    and the block raises QueryTimeout; 0 or less sets no limit."""
    if seconds <= 0:
        yield
        return
    context, group = spark.sparkContext, f"limited-{uuid.uuid4().hex}"
    late, over = threading.Event(), threading.Event()

    def watch() -> None:
        if not over.wait(seconds):
            late.set()
            while not over.wait(0.2):  # jobs that the block starts afterwards, too
                context.cancelJobGroup(group)

    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}
    context.setJobGroup(group, f"at most {seconds:g} s", interruptOnCancel=True)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield
    except Exception as error:
        if late.is_set():
            raise QueryTimeout(f"stopped after {seconds:g} s") from error
        raise
    finally:
        over.set()
        watcher.join()
        for k, v in before.items():
            context.setLocalProperty(k, v)
