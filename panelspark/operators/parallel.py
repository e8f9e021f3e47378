"""Independent fits side by side: driver threads that share one session."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_all(spark: SparkSession, tasks: list[Callable], most: int = 4) -> list:
    """The results of ``tasks`` in their order, at most ``most`` of them at a time.

    Their Spark jobs carry one tag and, where the scheduler is FAIR, one pool each, and take over the
    caller's job properties. If a task fails, the jobs of the others are cancelled, those that haven't
    begun never do, and the first failure is raised once all threads have ended.
    """
    context, tag, failed_one = spark.sparkContext, f"fits-{uuid.uuid4().hex}", threading.Event()

    def one(number: int, task: Callable):
        if failed_one.is_set():
            return None
        context.addJobTag(tag)
        context.setLocalProperty("spark.scheduler.pool", f"{tag}-{number % most}")
        try:
            return task()
        except BaseException:
            failed_one.set()
            raise

    with ThreadPoolExecutor(max(1, min(most, len(tasks)))) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(one), i, t) for i, t in enumerate(tasks)]
        done, open_ = wait(futures, return_when=FIRST_EXCEPTION)
        failed = next((f for f in futures if f in done and f.exception()), None)
        if failed is not None:
            while open_:  # also jobs that a thread begins only now
                context.cancelJobsWithTag(tag)
                open_ = wait(open_, timeout=0.5).not_done
            raise failed.exception()
    return [f.result() for f in futures]
