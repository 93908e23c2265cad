"""Progress of streaming queries as rows: a listener that writes a JSON line for each batch, and their reader."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from webloom.sources.manifests import file_system

PROGRESS = "query_id string, run_id string, name string, batch bigint, at string, input_rows bigint, took_ms bigint, state_rows bigint, error string"


class ProgressLog(StreamingQueryListener):
    """Each batch that had an end is a file of one line in the folder; a query that fails leaves a line with its error. Add it to spark.streams."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _put(self, name: str, row: dict) -> None:
        path, fs = file_system(self.spark, f"{self.folder}/{name}.json")
        out = fs.create(path, True)
        out.write(json.dumps(row).encode())
        out.close()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"query_id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows, "took_ms": p.batchDuration, "state_rows": sum(s.numRowsTotal for s in p.stateOperators)}
        self._put(f"{p.runId}-{p.batchId:012d}", row)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self._put(f"{event.runId}-failed", {"query_id": str(event.id), "run_id": str(event.runId), "error": event.exception[:4000]})


def read_progress(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(PROGRESS).json(folder)
