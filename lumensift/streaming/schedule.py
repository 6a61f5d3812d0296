"""Scans by the clock: a stream of ticks on the cluster's side, whose batches start a scan when one is due."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumensift.functions import cron

log = logging.getLogger(__name__)


def next_run(spark: SparkSession, expr: str, now: dt.datetime) -> dt.datetime | None:
    """The next time at which a schedule is due; None if it names no plain hour and minute."""
    one = spark.createDataFrame([(expr, now)], "expr string, now timestamp")
    return one.select(cron.next_run(F.col("expr"), F.col("now"))).first()[0]


class Schedule:
    """Starts ``scan`` whenever the schedule is due. What a scan raises is logged, and the schedule goes on."""

    def __init__(self, spark: SparkSession, expr: str, scan: Callable[[], object], now: Callable[[], dt.datetime] = dt.datetime.now):
        if not spark.createDataFrame([(expr,)], "expr string").select(cron.valid(F.col("expr"))).first()[0]:
            raise ValueError(f"not a schedule: {expr!r}")
        self.spark, self.expr, self.scan, self.now = spark, expr, scan, now
        self.due = next_run(spark, expr, now())

    def tick(self, *_: object) -> bool:
        """Starts the scan if it is due by now; whether it did."""
        now = self.now()
        if self.due is None or now < self.due:
            return False
        try:
            self.scan()
        except Exception:
            log.exception("scheduled scan failed")
        self.due = next_run(self.spark, self.expr, now)
        return True

    def start(self, every: str = "1 second") -> StreamingQuery:
        """A stream whose batches are ticks; it ends by ``stop()``."""
        ticks: DataFrame = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, batch: self.tick()).trigger(processingTime=every).start()
