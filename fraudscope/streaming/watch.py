"""An account of what running queries drop.

``run_to_end`` can tell for a query that ends. One under a ``processingTime`` trigger does
not end: ``DropWatch`` listens to the progress of every query of the session and writes a small
file for each batch that lost something, so that the loss is a table that anyone can read.

The state operator counts what it drops after a task's partial sums, so ``dropped_groups``
is a lower bound of the rows; ``streaming.feed`` counts, keeps and merges the rows themselves.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from fraudscope import files
from fraudscope.streaming.jobs import NO_STEP

DROPS_SCHEMA = "query string, run string, batch long, watermark string, input_rows long, dropped_groups long, rows_without_step long"


class DropWatch(StreamingQueryListener):
    """Register with ``spark.streams.addListener(DropWatch(spark, out_dir))``.

    A batch reported twice writes the same file again.
    """

    def __init__(self, spark: SparkSession, out_dir: str):
        self._spark, self._out = spark, out_dir.rstrip("/")

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        dropped = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        observed = p.observedMetrics.get(NO_STEP)
        no_step = 0 if observed is None else observed["n"]
        if dropped or no_step:
            record = {
                "query": str(p.id), "run": str(p.runId), "batch": p.batchId, "watermark": p.eventTime.get("watermark"),
                "input_rows": p.numInputRows, "dropped_groups": dropped, "rows_without_step": no_step,
            }
            files.write_text(self._spark, f"{self._out}/{p.id}-{p.batchId}.json", json.dumps(record))


def drops(spark: SparkSession, out_dir: str) -> DataFrame:
    """A row for each batch that dropped rows, or had rows without a step."""
    if not files.listing(spark, out_dir):
        return spark.createDataFrame([], DROPS_SCHEMA)
    return spark.read.schema(DROPS_SCHEMA).json(out_dir).orderBy("query", "batch")
