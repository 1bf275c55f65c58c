"""Branches of retrieval side by side: each on a thread and under a job tag of its own, cut off once its time is over."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from lorespark.functions.scratch import cut

#: What can befall a branch; anything else is a mistake in it and is raised.
EXPECTED = (PySparkException, Py4JError, OSError)
BAD = ("failed", "timed_out")


@dataclass
class Outcome:
    status: str  # success, empty, failed, timed_out
    rows: DataFrame
    seconds: float
    error: str | None = None


class AllFailed(RuntimeError):
    pass


class Branch:
    """One branch: its rows are made once, as a checkpoint in the shared folder."""

    def __init__(self, spark: SparkSession, name: str, work: Callable[[], DataFrame], limit: float):
        self.spark, self.name, self.work, self.limit = spark, name, work, limit
        self.tag = f"branch-{uuid.uuid4().hex}"
        self.late, self.done = threading.Event(), threading.Event()
        self.rows: DataFrame | None = None
        self.error: BaseException | None = None
        self.began = time.monotonic()
        self.seconds = 0.0
        threading.Thread(target=inheritable_thread_target(spark)(self._run), name=name, daemon=True).start()

    def _run(self) -> None:
        self.spark.sparkContext.addJobTag(self.tag)
        try:
            planned = self.work()
            if not self.late.is_set():
                self.rows = cut(planned)
        except BaseException as e:  # kept for the caller, who decides
            self.error = e
        finally:
            self.seconds = time.monotonic() - self.began
            self.done.set()

    def outcome(self, empty: DataFrame) -> Outcome:
        """Waits until the branch has ended or its time is over; then its jobs are cancelled and none begins any more."""
        in_time = self.done.wait(max(0.0, self.began + self.limit - time.monotonic()))
        if not in_time:
            self.late.set()
            self.spark.sparkContext.cancelJobsWithTag(self.tag)
            return Outcome("timed_out", empty, time.monotonic() - self.began, "TimeoutError")
        if self.error is not None:
            if not isinstance(self.error, EXPECTED):
                raise self.error
            return Outcome("timed_out" if isinstance(self.error, TimeoutError) else "failed", empty, self.seconds, type(self.error).__name__)
        return Outcome("empty" if self.rows.isEmpty() else "success", self.rows, self.seconds)


def run(spark: SparkSession, branches: Mapping[str, Callable[[], DataFrame]], empty: DataFrame, seconds: float | Mapping[str, float] = 60.0, strict: bool = False) -> dict[str, Outcome]:
    """Outcomes of all branches, which run at the same time; one that fails or is late leaves the empty frame, so that the others can be fused. In
    strict mode the first such branch is raised. If none is left, so is the whole. seconds: the limit of each, or by name."""
    limit = seconds if isinstance(seconds, Mapping) else dict.fromkeys(branches, seconds)
    started = {name: Branch(spark, name, work, limit[name]) for name, work in branches.items()}
    out: dict[str, Outcome] = {}
    for name in sorted(started, key=lambda n: limit[n]):  # the shortest limit first, so that each is cut off in time
        out[name] = started[name].outcome(empty)
        if strict and out[name].status in BAD:
            for other in started.values():
                other.late.set()
                spark.sparkContext.cancelJobsWithTag(other.tag)
            raise started[name].error or TimeoutError(f"{name} took more than {limit[name]} seconds")
    if out and all(o.status in BAD for o in out.values()):
        raise AllFailed(", ".join(f"{n}: {o.error}" for n, o in out.items()))
    return {name: out[name] for name in branches}


def fused(outcomes: Mapping[str, Outcome], key: str) -> DataFrame:
    """key, branches (the names of those that found it, sorted), failed and late (names of the branches that did, comma-joined)."""
    of = lambda status: ",".join(sorted(n for n, o in outcomes.items() if o.status == status))
    rows = [o.rows.select(key, F.lit(n).alias("branch")) for n, o in outcomes.items() if o.status == "success"]
    both = rows[0]
    for more in rows[1:]:
        both = both.unionByName(more)
    found = both.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("branch")), ",").alias("branches"))
    return found.withColumns({"failed": F.lit(of("failed")), "late": F.lit(of("timed_out"))})


def statuses(outcomes: Mapping[str, Outcome], spark: SparkSession) -> DataFrame:
    """branch, status, degraded (whether any branch failed)."""
    bad = any(o.status in BAD for o in outcomes.values())
    return spark.createDataFrame([(n, o.status, bad) for n, o in outcomes.items()], "branch string, status string, degraded boolean")
