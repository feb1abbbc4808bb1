"""One run at a time, with a status that can be asked for and a way to stop it."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import SparkSession


class Busy(RuntimeError):
    """A run is going on."""


@dataclass(frozen=True)
class Status:
    state: str = "idle"
    runs: int = 0
    failures: int = 0
    started: float | None = None
    seconds: float | None = None
    error: str = ""
    changed: bool = False


class RunController:
    """Starts runs in the background; a second one is refused until the first has ended."""

    def __init__(self, spark: SparkSession | None = None, group: str = "notewright-run"):
        self.spark, self.group = spark, group
        self._lock, self._status, self._thread = threading.Lock(), Status(), None

    def status(self) -> Status:
        with self._lock:
            return self._status

    def trigger(self, run: Callable[[], object]) -> None:
        with self._lock:
            if self._status.state == "running":
                raise Busy("a run is going on")
            self._status = replace(self._status, state="running", started=time.time(), seconds=None, error="")
            self._thread = threading.Thread(target=self._execute, args=(run,), daemon=True)
            self._thread.start()

    def _execute(self, run: Callable[[], object]) -> None:
        error, changed = "", False
        try:
            if self.spark is not None:
                self.spark.sparkContext.setJobGroup(self.group, "run", interruptOnCancel=True)
            changed = bool(getattr(run(), "changed", False))
        except BaseException as e:  # noqa: BLE001  the status reports whatever ended the run
            error = f"{type(e).__name__}: {e}"
        with self._lock:
            s = self._status
            self._status = replace(s, state="failed" if error else "succeeded", runs=s.runs + 1, failures=s.failures + bool(error), seconds=time.time() - s.started, error=error, changed=changed)

    def cancel(self) -> None:
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self, timeout: float | None = None) -> Status:
        if self._thread is not None:
            self._thread.join(timeout)
        return self.status()
