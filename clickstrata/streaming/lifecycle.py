"""A stream's life: what each of its batches did, and a stop between two batches."""

from __future__ import annotations

import json
import time

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

FIELDS = "query string, run string, batch_id long, rows long, state_rows long, duration_ms long"


class Progress(StreamingQueryListener):
    """Records rows, state size and duration of the last ``most`` batches of a session's streams, and their ends."""

    def __init__(self, most: int = 10_000):
        self.most, self.batches, self.ended = most, [], {}

    def onQueryStarted(self, event) -> None:
        self.ended.pop(str(event.runId), None)

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        state = sum(s["numRowsTotal"] for s in p.get("stateOperators", []))
        row = (p["id"], p["runId"], p["batchId"], p.get("numInputRows", 0), state, p.get("durationMs", {}).get("triggerExecution", 0))
        self.batches = [*self.batches[1 - self.most :], row]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)] = event.exception

    def table(self, spark: SparkSession):
        return spark.createDataFrame(self.batches, FIELDS)


def marked(spark: SparkSession, path: str) -> bool:
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)


def run_until_marked(query: StreamingQuery, spark: SparkSession, marker: str, every: float = 0.2, quiet: float = 0.05) -> bool:
    """Waits for the query's end or for a file at ``marker``; then lets the batch under way end and stops. Whether it ended by itself.

    What a stop breaks off all the same, the next batch's beginning, is repeated by the next start from the checkpoint. A
    failure is raised.
    """
    while query.isActive and not marked(spark, marker):
        time.sleep(every)
    if not query.isActive:
        query.awaitTermination()
        return True
    last = lambda: (query.lastProgress or {}).get("batchId")
    seen = last()
    while query.isActive and query.status["isTriggerActive"] and last() == seen:
        time.sleep(quiet)
    query.stop()
    return False
