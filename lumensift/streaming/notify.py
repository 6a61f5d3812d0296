"""Notifications: payloads posted to a target, from the driver or from a stream's batches, and the runner around a scan."""

from __future__ import annotations

import datetime as dt
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame


def payload(data: dict, at: str | None = None) -> dict:
    """What goes out, alerts included: they are the data of a success."""
    return {"event": "scan.complete", "timestamp": at or dt.datetime.now().isoformat(), "status": "success", "data": data}


def post(target: str, body: str, timeout: float = 10) -> bool:
    """Whether the target took the JSON (an answer of 2xx); no failure is raised."""
    if not target:
        return False
    try:
        request = urllib.request.Request(target, body.encode("utf-8"), {"Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return 200 <= answer.status < 300
    except (urllib.error.URLError, OSError, ValueError):
        return False


def post_each(target: str, timeout: float = 10) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: posts every row's ``payload``. Rows come one by one to the driver, never all at once."""

    def send(batch: DataFrame, _: int) -> None:
        for row in batch.select("payload").toLocalIterator():
            post(target, row.payload, timeout)

    return send


class Runner:
    """Runs a scan and tells of it. A failed scan is told at most once in ``throttle`` seconds, and raised in any case."""

    def __init__(self, scan: Callable[[], dict], target: str = "", notify: bool = False, throttle: float = 0, repo: str = "unknown", timeout: float = 10, clock: Callable[[], float] = time.time):
        self.scan, self.target, self.notify, self.throttle, self.repo, self.timeout, self.clock = scan, target, notify, throttle, repo, timeout, clock
        self.last: float | None = None

    def run(self) -> dict:
        try:
            result = self.scan()
        except Exception as e:
            if self.notify and (self.throttle <= 0 or self.last is None or self.clock() - self.last >= self.throttle):
                told = {"event": "scan.failure", "timestamp": dt.datetime.now().isoformat(), "status": "error", "error_type": type(e).__name__, "error_message": str(e), "data": {"repo": self.repo}}
                post(self.target, json.dumps(payload(told), ensure_ascii=False), self.timeout)
                self.last = self.clock()
            raise
        if self.notify:
            post(self.target, json.dumps(payload(result), ensure_ascii=False), self.timeout)
        return result
