"""Samples of what streams have read: when, how many records, and how far each source is."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql.streaming.listener import QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener


@dataclass(frozen=True)
class Sample:
    """One batch of a query. size: records read, as often as the plan scans them. head: by source, the offset that the batch ends at."""

    date: str
    size: int
    head: dict[str, str]


class Samples(StreamingQueryListener):
    """The latest samples of every query, of a bounded number; add it by spark.streams.addListener."""

    def __init__(self, most: int = 100):
        self.most, self.taken = most, {}

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        self.taken[str(event.runId)] = deque(maxlen=self.most)

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        self.taken.setdefault(str(p.runId), deque(maxlen=self.most)).append(Sample(p.timestamp, p.numInputRows, {s.description: s.endOffset for s in p.sources}))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        """Samples of a query that has ended stay until drop()."""

    def drop(self, run_id: str) -> None:
        self.taken.pop(run_id, None)
