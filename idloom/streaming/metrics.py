"""Metrics of running streams: what a batch counted on its way (``observe``), and what Spark says of its progress, as lines.

Counting costs no pass of its own: the numbers are gathered while the batch's rows go by. A listener keeps the last lines of
each query, a bounded number, and gives them as gauges or text.
"""

from __future__ import annotations

import re
import threading
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from idloom.operators.reports import metric_lines

SCHEMA = "query string, batch long, name string, value double"
#: Gauges that are kept, over all queries.
KEPT = 10_000


def counted(rows: DataFrame, name: str, /, **metrics: Column) -> DataFrame:
    """``rows`` with aggregates that are observed while they pass, as ``name_metric``."""
    return rows.observe(name, *[c.alias(k) for k, c in metrics.items()])


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9_]+", "_", name.lower())


class Gauges(StreamingQueryListener):
    """A listener: add it with ``spark.streams.addListener``."""

    def __init__(self, kept: int = KEPT):
        self.rows: deque[tuple[str, int, str, float]] = deque(maxlen=kept)
        self.failed: dict[str, str] = {}
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        query = p.name or str(p.id)
        found = {"rows_in": float(p.numInputRows), "state_rows": float(sum(s.numRowsTotal for s in p.stateOperators)), "late_rows": float(sum(s.numRowsDroppedByWatermark for s in p.stateOperators)), "batch_ms": float(p.batchDuration)}
        for name, row in p.observedMetrics.items():
            found |= {f"{name}_{k}": float(v) for k, v in row.asDict().items() if v is not None}
        with self.lock:
            self.rows += [(query, p.batchId, _plain(k), v) for k, v in found.items()]

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            with self.lock:
                self.failed[str(event.id)] = event.exception.splitlines()[0]

    def gauges(self, spark: SparkSession) -> DataFrame:
        """(query, batch, name, value) of what is kept."""
        with self.lock:
            return spark.createDataFrame(list(self.rows), SCHEMA)

    def lines(self, spark: SparkSession) -> DataFrame:
        """The latest value of each gauge as a line of text, its query in braces."""
        with self.lock:
            last = {(q, n): v for q, _, n, v in self.rows}
        rows = [(f'{n}{{query="{q}"}}', v) for (q, n), v in sorted(last.items())]
        return metric_lines(spark.createDataFrame(rows, "name string, value double"))
