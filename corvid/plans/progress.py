"""What a scan tells while its job runs: accumulators on the executors, a thread on the driver."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark import AccumulatorParam
from pyspark.sql import SparkSession

#: Fixed value: routes of an event.
BATCH = 40


class _Counts(AccumulatorParam):
    def zero(self, value: dict) -> dict:
        return {}

    def addInPlace(self, a: dict, b: dict) -> dict:  # noqa: N802  Spark's name
        for k, n in b.items():
            a[k] = a.get(k, 0) + n
        return a


class Progress:
    """Counts that tasks add to (`counts.add({name: n})`), told as they grow: `tell("routes-discovered", JSON of framework and routes)`
    for each BATCH of them and for the rest at the end, and `tell("pack-failed", name)` for each failure, named "!name".

    Spark sends counts when a task ends, so events come while other tasks run. A task that runs twice counts twice: these are signs of
    life, not results. An exception of `tell` ends the telling, not the job, and is raised when the job is over."""

    def __init__(self, spark: SparkSession, tell: Callable[[str, str], None], every: float = 0.1):
        self.counts = spark.sparkContext.accumulator({}, _Counts())
        self._tell, self._every, self._told, self._over, self._error = tell, every, {}, threading.Event(), None
        self._thread = threading.Thread(target=self._watch, daemon=True)

    def _report(self, last: bool = False) -> None:
        for name, n in sorted(dict(self.counts.value).items()):
            while n - self._told.get(name, 0) >= (1 if last or name.startswith("!") else BATCH):
                some = min(BATCH, n - self._told.get(name, 0)) if not name.startswith("!") else 1
                self._told[name] = self._told.get(name, 0) + some
                self._tell("pack-failed", name[1:]) if name.startswith("!") else self._tell("routes-discovered", json.dumps({"framework": name, "routes": some}))

    def _watch(self) -> None:
        try:
            while not self._over.wait(self._every):
                self._report()
        except Exception as error:  # told where the job is waited for
            self._error = error

    def __enter__(self) -> Progress:
        self._thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self._over.set()
        self._thread.join()
        if self._error:
            raise self._error
        if kind is None:
            self._report(last=True)
