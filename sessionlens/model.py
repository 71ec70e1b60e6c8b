"""Data model: event window, funnel definition, canonical event schema."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import types as T

# The five funnel steps, the first-timestamp column of each, the
# count column of each and the label of each.
STEPS = ("session_start", "view_item", "add_to_cart", "begin_checkout", "purchase")
STEP_TS = {
    "session_start": "ts_s",
    "view_item": "ts_v",
    "add_to_cart": "ts_c",
    "begin_checkout": "ts_k",
    "purchase": "ts_p",
}
STEP_COUNTS = {
    "session_start": "sessions",
    "view_item": "view_item",
    "add_to_cart": "add_to_cart",
    "begin_checkout": "begin_checkout",
    "purchase": "purchase",
}
STEP_LABELS = {
    "session_start": "Session Start",
    "view_item": "View Products",
    "add_to_cart": "Add to Cart",
    "begin_checkout": "Begin Checkout",
    "purchase": "Purchase",
}
COUNT_COLUMNS = tuple(STEP_COUNTS[s] for s in STEPS)

NOT_SET = "(not set)"
NO_PAGE_VIEW = "(no page_view)"

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 6e7
MICROS_PER_HOUR = 3.6e9

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_date", T.StringType()),
        T.StructField("event_timestamp", T.LongType()),
        T.StructField("event_name", T.StringType()),
        T.StructField("user_pseudo_id", T.StringType()),
        T.StructField(
            "event_params",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("key", T.StringType()),
                        T.StructField(
                            "value",
                            T.StructType(
                                [
                                    T.StructField("string_value", T.StringType()),
                                    T.StructField("int_value", T.LongType()),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
        T.StructField("device", T.StructType([T.StructField("category", T.StringType())])),
        T.StructField("geo", T.StructType([T.StructField("country", T.StringType())])),
        T.StructField("traffic_source", T.StructType([T.StructField("medium", T.StringType())])),
        T.StructField(
            "ecommerce", T.StructType([T.StructField("purchase_revenue", T.DoubleType())])
        ),
        T.StructField(
            "items",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("item_name", T.StringType()),
                        T.StructField("item_category", T.StringType()),
                        T.StructField("price", T.DoubleType()),
                        T.StructField("quantity", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("event_date_part", T.DateType()),
    ]
)


def parse_day(text: str) -> dt.date:
    """The calendar day of an export folder's name, such as 20210131."""
    if isinstance(text, str) and len(text) == 8 and text.isascii() and text.isdigit():
        return dt.date.fromisoformat("-".join((text[:4], text[4:6], text[6:])))  # refuses days that no calendar has
    raise ValueError(f"not the eight digits of a day: {text!r}")


@dataclass(frozen=True)
class EventWindow:
    """Inclusive window of export days."""

    start: str
    end: str

    def __post_init__(self):
        if self.last_day < self.first_day:
            raise ValueError(f"the window ends on {self.end}, before it begins on {self.start}")

    @property
    def first_day(self) -> dt.date:
        return parse_day(self.start)

    @property
    def last_day(self) -> dt.date:
        return parse_day(self.end)

    @property
    def label(self) -> str:
        """First and last month, both always shown."""
        return " – ".join(d.strftime("%b %Y") for d in (self.first_day, self.last_day))

    @property
    def period_label(self) -> str:
        """The month, or the range of months."""
        months = dict.fromkeys(d.strftime("%b %Y") for d in (self.first_day, self.last_day))
        return " – ".join(months)

    def shares_days(self, other: "EventWindow") -> bool:
        """Whether any day lies in both windows."""
        return max(self.first_day, other.first_day) <= min(self.last_day, other.last_day)

    def last_month(self) -> "EventWindow":
        """The days of the window in the month it ends in."""
        begin = self.last_day.replace(day=1).strftime("%Y%m%d")
        return EventWindow(max(begin, self.start), self.end)

    def versus(self, previous: "EventWindow | None") -> "EventWindow | None":
        """`previous` as the period to compare the last month with; the two must not share a day."""
        now = self.last_month()
        if previous and previous.shares_days(now):
            raise ValueError(f"{previous.start} to {previous.end} shares days with {now.start} to {now.end}")
        return previous


@dataclass(frozen=True)
class FunnelSpec:
    """Ordered funnel steps from `entry` on."""

    steps: tuple[str, ...] = STEPS
    entry: str = "session_start"

    def __post_init__(self):
        if self.entry not in self.steps:
            raise ValueError(f"entry {self.entry!r} is not one of {self.steps}")

    @property
    def active(self) -> tuple[str, ...]:
        return self.steps[self.steps.index(self.entry) :]

    @property
    def flags(self) -> tuple[str, ...]:
        return tuple(f"s{i}" for i in range(1, len(self.active) + 1))
