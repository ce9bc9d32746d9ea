"""A sign of life for every batch of a stream."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQueryListener


class Heartbeat(StreamingQueryListener):
    """Gives one JSON line to ``emit`` for each batch: the rows done so far, and done when the stream ends. Register it with
    ``spark.streams.addListener``."""

    def __init__(self, emit: Callable[[str], None] = print):
        self.emit, self.rows = emit, 0

    def onQueryStarted(self, event) -> None:
        self.emit(json.dumps({"heartbeat": True, "completed_rows": 0}))

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.emit(json.dumps({"heartbeat": True, "completed_rows": self.rows}))

    def onQueryIdle(self, event) -> None:
        self.emit(json.dumps({"heartbeat": True, "completed_rows": self.rows}))

    def onQueryTerminated(self, event) -> None:
        self.emit(json.dumps({"worker_job_done": event.exception is None, "completed_rows": self.rows}))
