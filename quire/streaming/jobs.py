"""Jobs that are watched while they run: updates of their states, progress, one at a time."""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def updates(states: DataFrame, key: str, order: str, revision: str, *, heartbeat_ms: int | None = None) -> DataFrame:
    """key, kind, order, revision: what a watcher of a stream of states is told.

    Of each key the first state in full (kind full), then only states whose revision differs
    from the one before (update). With heartbeat_ms also heartbeat where nothing came for so long,
    with the last order and revision; a query with it goes on until it is stopped, even if it is
    to process what is available only. Keyed state holds order and revision, across batches and
    restarts. A state whose order isn't beyond what was told is passed over. Rows of a batch may
    come in any order.
    """
    timeout = GroupStateTimeout.NoTimeout if heartbeat_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    kinds = {name: states.schema[name].dataType.simpleString() for name in (key, order, revision)}
    out = f"{key} {kinds[key]}, kind string, {order} {kinds[order]}, {revision} {kinds[revision]}"

    def tell(key_: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if heartbeat_ms is not None and held.hasTimedOut:
            told = [(key_[0], "heartbeat", *held.get)]
        else:
            now = held.get if held.exists else None
            told = []
            rows = sorted((row for batch in batches for row in batch[[order, revision]].itertuples(index=False, name=None)), key=lambda r: r[0])
            for at, number in rows:
                if now is not None and at <= now[0]:
                    continue
                if now is None or number != now[1]:
                    told.append((key_[0], "full" if now is None else "update", at, number))
                now = (at, number)
            if now is not None:
                held.update(now)
        if heartbeat_ms is not None and held.exists:
            held.setTimeoutDuration(heartbeat_ms)
        yield pd.DataFrame(told, columns=[key, "kind", order, revision])

    rows = states.select(key, order, revision)
    return rows.groupBy(key).applyInPandasWithState(tell, out, f"{order} {kinds[order]}, {revision} {kinds[revision]}", "append", timeout)


class Progress(StreamingQueryListener):
    """The last progress reports of streaming queries: (name, batch, rows, seconds)."""

    def __init__(self, most: int = 2000) -> None:
        self.reports: deque = deque(maxlen=most)
        self.ended: deque = deque(maxlen=most)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.reports.append((p.name, p.batchId, p.numInputRows, p.batchDuration / 1000))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append((str(event.id), event.exception))


class Busy(RuntimeError):
    """A job of the workspace is running."""


class Jobs:
    """One Spark job a workspace at a time, in a thread of the driver; it can be stopped, and its status read.

    status: running, done, failed or stopped. What a job reads is what its function gets; changes
    of the caller's variables after submit don't reach it if it is given its own arguments.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self._lock = threading.Lock()
        self._threads: dict[str, threading.Thread] = {}
        self._status: dict[str, dict] = {}

    def submit(self, workspace: str, run: Callable, *args: object) -> None:
        """Start run(*args); raises Busy while the workspace has a job."""
        with self._lock:
            if workspace in self._threads and self._threads[workspace].is_alive():
                raise Busy(workspace)
            status = self._status[workspace] = {"status": "running", "error": None, "result": None, "stopping": False}
            thread = InheritableThread(target=self._run, args=(workspace, status, run, args), daemon=True)
            self._threads[workspace] = thread
            thread.start()

    def _run(self, workspace: str, status: dict, run: Callable, args: tuple) -> None:
        self.spark.sparkContext.setJobGroup(f"workspace-{workspace}", workspace, interruptOnCancel=True)
        try:
            result = run(*args)
            status.update(result=result, status="stopped" if status["stopping"] else "done")
        except Exception as error:  # noqa: BLE001  whatever stops a job is its error
            status.update(status="stopped" if status["stopping"] else "failed", error=str(error))

    def stop(self, workspace: str) -> None:
        """Cancel the workspace's job; what it has committed stays."""
        with self._lock:
            if workspace in self._status:
                self._status[workspace]["stopping"] = True
        self.spark.sparkContext.cancelJobGroup(f"workspace-{workspace}")

    def wait(self, workspace: str, seconds: float | None = None) -> dict:
        """The status, after the job's end or so many seconds."""
        self._threads[workspace].join(seconds)
        return {k: v for k, v in self._status[workspace].items() if k != "stopping"}


def state_stream(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events (event_id, event_type, key) as states: the type is the revision."""
    return events.select(key, F.col("event_id").alias("at"), F.col("event_type").alias("revision"))
