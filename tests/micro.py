"""Tiny raw tables written by hand."""

from datetime import datetime, timezone
from decimal import Decimal

from cartwright.schemas import RAW_EVENTS


def at(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def event(time, kind="view", user=1, product=1, price="10", session="s1", brand="acme",
          code="toys.cars", category=7):
    return (at(time), kind, product, category, code, brand, Decimal(price), user, session)


def raw_table(spark, *events):
    return spark.createDataFrame(list(events), RAW_EVENTS)


def rows(frame, *columns):
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=_nulls_last)


def _nulls_last(row):
    return [(value is None, value) for value in row]
