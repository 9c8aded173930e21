"""Spark jobs side by side, a bounded number at a time."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Sequence
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from functools import reduce
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession, functions as F

Result = TypeVar("Result")


def grid(**choices: Sequence) -> list[dict]:
    """All combinations of the choices, the last one fastest."""
    return [dict(zip(choices, values)) for values in itertools.product(*choices.values())]


def run_all(spark: SparkSession, jobs: Iterable[Callable[[], Result]], workers: int = 4) -> list[Result]:
    """The results of all jobs in their order, `workers` of them at a time.

    Every worker has a scheduler pool of its own, so in a session with fair
    scheduling a long trial leaves room for short ones. When a job fails, the
    others' Spark jobs are cancelled, no further one is begun, and its error is
    raised.
    """
    if workers < 1:
        raise ValueError("one worker at least is needed")
    jobs, context, tag = list(jobs), spark.sparkContext, f"trials-{uuid.uuid4().hex}"
    failed: list[int] = []

    def run(place: int) -> Result:
        if failed:
            raise RuntimeError("an earlier job failed")
        context.setLocalProperty("spark.scheduler.pool", f"trial-{place % workers}")
        context.addJobTag(tag)
        try:
            return jobs[place]()
        except BaseException:
            failed.append(place)
            raise
        finally:
            context.removeJobTag(tag)

    with ThreadPoolExecutor(workers) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run), k) for k in range(len(jobs))]
        done, _ = wait(futures, return_when=FIRST_EXCEPTION)
        if any(f.exception() for f in done if not f.cancelled()):
            for f in futures:
                f.cancel()
            context.cancelJobsWithTag(tag)
    if failed:
        raise futures[failed[0]].exception()
    return [f.result() for f in futures]


def sweep(spark: SparkSession, job: Callable[..., DataFrame], workers: int = 4, **choices: Sequence) -> DataFrame:
    """Union of `job(**params)` over all combinations, parameters kept as columns."""
    params = grid(**choices)
    tables = run_all(spark, [lambda p=p: job(**p) for p in params], workers)
    named = [
        out.select(*[F.lit(v).alias(k) for k, v in p.items()], *out.columns) for p, out in zip(params, tables)
    ]
    return reduce(DataFrame.unionByName, named)
