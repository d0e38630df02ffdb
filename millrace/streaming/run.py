"""The same network over a stream of lines: one query for each sink."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from millrace.plans.model import Compat, ProcessDef
from millrace.plans.planner import plan
from millrace.sources.files import lines_of, stream_lines


def start(spark: SparkSession, process: ProcessDef, inputs: dict[str, str], output: str, checkpoint: str, *, compat: Compat = Compat(), available_now: bool = True, max_files: int | None = None) -> list[StreamingQuery]:
    """Streams every sink as lines to output/<sink>; the network keeps no state, so any mode of arrival gives the batch result."""
    got = plan(process, {name: stream_lines(spark, path, max_files) for name, path in inputs.items()}, compat)
    formats = {t.name: t.format for t in process.outputs}
    queries = []
    for sink, df in got.sinks.items():
        w = lines_of(df, formats.get(sink)).writeStream.format("text").outputMode("append").option("path", f"{output}/{sink}").option("checkpointLocation", f"{checkpoint}/{sink}")
        queries.append((w.trigger(availableNow=True) if available_now else w).start())
    return queries
