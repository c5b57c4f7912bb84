"""Reads that end in time: the jobs of a block are cancelled when its seconds are over."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class DeadlineExceeded(TimeoutError):
    """The call's jobs were cancelled."""


@contextmanager
def deadline(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Cancel the jobs begun in the block (by this thread) that are not done after ``seconds``; none where it is zero."""
    if not seconds:
        yield
        return
    context, tag, passed = spark.sparkContext, f"read-{uuid.uuid4().hex}", threading.Event()

    def cancel() -> None:
        passed.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, cancel)
    timer.daemon = True
    context.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if passed.is_set():
            raise DeadlineExceeded(f"no answer within {seconds} seconds") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)
