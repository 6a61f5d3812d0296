"""Cron expressions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fields in order, with their bounds.
FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day_of_month", 1, 31), ("month", 1, 12), ("day_of_week", 0, 7)]


def fields(expression: Column) -> Column:
    return F.split(F.trim(expression), r"\s+")


def _number_in(text: Column, low: int, high: int) -> Column:
    number = F.when(text.rlike(r"^\+?[0-9]{1,9}$"), text).try_cast("int")
    return F.coalesce(number.between(low, high), F.lit(False))


def valid_field(value: Column, low: int, high: int) -> Column:
    """``*``, ``*/n``, or a list of numbers and ranges, all of it within the bounds."""
    part = lambda p: F.when(p.contains("-"), (F.size(F.split(p, "-")) == 2) & F.forall(F.split(p, "-"), lambda x: _number_in(x, low, high))).otherwise(_number_in(p, low, high))
    return F.when(value == "*", True).when(value.startswith("*/"), _number_in(F.substring(value, 3, 100), low, high)).otherwise(F.forall(F.split(value, ","), part))


def valid(expression: Column) -> Column:
    parts = fields(expression)
    ok = F.size(parts) == len(FIELDS)
    for i, (_, low, high) in enumerate(FIELDS):
        ok = ok & F.coalesce(valid_field(F.get(parts, F.lit(i)), low, high), F.lit(False))
    return F.coalesce(ok & (F.trim(expression) != ""), F.lit(False))


def next_run(expression: Column, now: Column) -> Column:
    """The next time of the day's minute and hour after now; null unless both are ``*`` (0) or a plain number.

    The other fields don't matter to it, as in the scheduler that this replaces.
    """
    parts = fields(expression)
    plain = lambda i: F.when(F.get(parts, F.lit(i)) == "*", 0).when(F.get(parts, F.lit(i)).rlike("^[0-9]+$"), F.get(parts, F.lit(i)).try_cast("int"))
    today = F.date_trunc("day", now)
    at = today + F.make_interval(hours=plain(1), mins=plain(0))
    at = F.when(at <= now, at + F.expr("interval 1 day")).otherwise(at)
    return F.when(valid(expression), at)
