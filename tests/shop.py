"""Hand-worked nested events."""

from __future__ import annotations

import datetime as dt

from sessionlens.model import EVENT_SCHEMA

SECOND = 1_000_000


def event(name, user="u1", sid=1, at=0, day="20201102", medium=None, eng=None, number=None, page=None, device="desktop",
          country="Spain", first_touch="organic", revenue=None, items=None):
    """One event; only parameters with a value are present, as in a real export. `at` is seconds."""
    params = []
    for key, text, whole in (
        ("ga_session_id", None, sid), ("medium", medium, None), ("engagement_time_msec", None, eng),
        ("ga_session_number", None, number), ("page_location", page, None),
    ):
        if text is not None or whole is not None:
            params.append((key, (text, whole)))
    part = dt.datetime.strptime(day, "%Y%m%d").date()
    return (day, int(at * SECOND), name, user, params, (device,), (country,), (first_touch,), (revenue,), items, part)


def item(name="Tee", category="Apparel", price=12.0, quantity=None):
    return (name, category, price, quantity)


def raw(spark, events):
    return spark.createDataFrame(events, EVENT_SCHEMA)


def flat(spark, events):
    from sessionlens.sources.events import flatten_events

    return flatten_events(raw(spark, events))
