"""Progress of running streams, kept for display."""

from __future__ import annotations

from collections import deque

from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """The last ``keep`` progress records of all streams of a session: id, batch, rows, rows a second."""

    def __init__(self, keep: int = 1000) -> None:
        self.records: deque[dict] = deque(maxlen=keep)
        self.ended: list[tuple[str, str | None]] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.records.append({"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rate": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended.append((str(event.id), event.exception))
