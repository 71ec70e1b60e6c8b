"""The session table kept up to date by days: mergeable states instead of a rebuild.

A day's events become one state a session, with everything that `session_base` derives: first timestamps, counts, sums, and first values
beside their timestamps. States of one session merge into one by minima and sums. The table keeps the merged states by the day of
their last event, so a new day reads its own events and the sessions still open, and writes the few day parts that these leave
or enter; the day states are kept too, so that a day can be given again. Both change in whole versions (`sources.versions`).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sessionlens.functions.exprs import day
from sessionlens.model import STEP_TS, FunnelSpec
from sessionlens.operators.sessions import SESSION, first_value, funnel_sessions, shop_dims, with_step_flags
from sessionlens.sources.events import PARTITION
from sessionlens.sources.staging import stage
from sessionlens.sources.versions import VersionedTable

SPEC = FunnelSpec()
FIRST_DAY, LAST_DAY = "first_day", "last_day"

#: How the state columns that are not minima merge.
SUMS = ("revenue", "n_events", "n_medium", "n_page_view", "eng_msec")
MAXIMA = ("session_number", LAST_DAY)


def day_states(ev: DataFrame, dims: dict[str, Column] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """One state a session (and `by`) from its events; first values are structs (event_timestamp, v)."""
    dims = shop_dims() if dims is None else dims
    in_funnel = F.col("event_name").isin(*SPEC.active)
    is_event = lambda name: F.col("event_name") == name
    aggs = [F.min(F.when(is_event(step), F.col("event_timestamp"))).alias(STEP_TS[step]) for step in SPEC.active]
    aggs += [first_value(value, in_funnel).alias(name) for name, value in dims.items()]
    aggs += [
        F.sum(F.when(is_event("purchase"), F.col("purchase_revenue"))).alias("revenue"),
        first_value(F.col("medium")).alias("session_medium"),
        F.count("*").alias("n_events"),
        F.count("medium").alias("n_medium"),
        F.count_if(is_event("page_view")).alias("n_page_view"),
        F.sum(F.coalesce("eng_msec", F.lit(0))).alias("eng_msec"),
        F.max("session_number").alias("session_number"),
        first_value(F.col("page_path"), is_event("page_view")).alias("landing_page"),
        F.min(day("event_date")).alias("session_date"),
        F.min(PARTITION).alias(FIRST_DAY),
        F.max(PARTITION).alias(LAST_DAY),
    ]
    return ev.where(F.col("session_id").isNotNull()).groupBy(*SESSION, *by).agg(*aggs).drop(*by)


def merged(states: DataFrame) -> DataFrame:
    """One state a session from any number of its states."""
    how = {**dict.fromkeys(SUMS, F.sum), **dict.fromkeys(MAXIMA, F.max)}
    return states.groupBy(*SESSION).agg(*[how.get(c, F.min)(c).alias(c) for c in states.columns if c not in SESSION])


def session_rows(states: DataFrame, dims: tuple[str, ...] | None = None) -> DataFrame:
    """The columns of `session_base` from merged states."""
    first_values = {*(shop_dims() if dims is None else dims), "session_medium", "landing_page"}
    columns = []
    for c in states.columns:
        if c in first_values:
            columns.append(F.col(c)["v"].alias(c))
        elif c == "eng_msec":
            columns.append((F.col(c) / 1000).alias("engaged_s"))
        elif c not in (FIRST_DAY, LAST_DAY):
            columns.append(F.col(c))
    return with_step_flags(states.select(*columns), SPEC)


def _same(a: str, b: str) -> Column:
    return F.col(f"{a}.user_pseudo_id").eqNullSafe(F.col(f"{b}.user_pseudo_id")) & (F.col(f"{a}.session_id") == F.col(f"{b}.session_id"))


class SessionTable:
    """Sessions under `path`, brought up to date day by day.

    `open_days`: a session goes on if its next event comes at most so many days after its last one; later events under its key would
    make a second row, which `reopened` finds. None looks through the keys of all sessions instead.
    """

    def __init__(self, spark: SparkSession, path: str, dims: dict[str, Column] | None = None, open_days: int | None = 1):
        self.spark, self.dims, self.open_days = spark, shop_dims() if dims is None else dims, open_days
        # one manifest for both, so that a reader or a restarted writer never sees one without the other
        self.table = VersionedTable(spark, path)

    @staticmethod
    def _days(parts, kind: str) -> list[dt.date]:
        return sorted(dt.date.fromisoformat(p.split("=")[1]) for p in parts if p.startswith(f"{kind}="))

    def _read(self, kind: str, days, version: int | None) -> DataFrame | None:
        return self.table.read(version, [f"{kind}={d}" for d in days]) if days else None

    def states(self, days: list[dt.date] | None = None) -> DataFrame:
        """Merged states, of sessions that ended on some days or of all."""
        manifest = self.table.manifest()
        known = self._days(manifest["parts"], "sessions") if manifest else []
        found = self._read("sessions", [d for d in known if days is None or d in days], manifest and manifest["version"])
        if found is None:
            raise FileNotFoundError(f"no sessions under {self.table.path}")
        return found

    def base(self) -> DataFrame:
        """The rows that `session_base` makes of all days' events."""
        return session_rows(self.states(), tuple(self.dims))

    def sessions(self) -> DataFrame:
        """The rows that `funnel_sessions` makes of them."""
        return funnel_sessions(self.base())

    def reopened(self) -> DataFrame:
        """Sessions with more than one row: `open_days` was too small for them."""
        return self.states().groupBy(*SESSION).agg(F.count("*").alias("rows")).where("rows > 1")

    def put_day(self, events: DataFrame, when: dt.date) -> int:
        """Adds the events of one day, or gives them anew; `events` may hold other days, which are left out. Returns the version."""
        manifest = self.table.manifest()
        version, parts = (manifest["version"], manifest["parts"]) if manifest else (0, {})
        fresh, _ = stage(day_states(events.where(F.col(PARTITION) == F.lit(when)), self.dims), "day-states")
        again = self._read("states", [when] if f"states={when}" in parts else [], version)
        ended = self._days(parts, "sessions")
        near = [d for d in ended if self.open_days is None or d >= when - dt.timedelta(days=self.open_days)]
        before = self._read("sessions", near, version)
        keys = fresh.select(*SESSION) if again is None else fresh.select(*SESSION).union(again.select(*SESSION)).distinct()
        if before is None:
            now = fresh
        else:
            met = before.alias("a").join(keys.alias("k"), _same("a", "k"), "left_semi")
            met = stage(met, "met-sessions")[0]
            if again is None:
                now = merged(met.unionByName(fresh))
            else:
                # a day given again cannot be taken out of a sum: its sessions are merged anew from their day states
                span = met.agg(F.min(FIRST_DAY), F.max(LAST_DAY)).first()
                lo, hi = min(span[0] or when, when), max(span[1] or when, when)
                others = self._read("states", [d for d in self._days(parts, "states") if lo <= d <= hi and d != when], version)
                same = fresh
                if others is not None:
                    same = fresh.unionByName(others.alias("a").join(keys.alias("k"), _same("a", "k"), "left_semi"))
                now = merged(same)
        now = stage(now, "merged-sessions")[0]
        # only parts that a session leaves or enters are written
        left = {r[0] for r in met.select(LAST_DAY).distinct().collect()} if before is not None else set()
        entered = {r[0] for r in now.select(LAST_DAY).distinct().collect()}
        new = {f"sessions={d}": None for d in left} | {f"states={when}": self.table.write(fresh)}
        stay = self._read("sessions", sorted((left | entered) & set(near)), version)
        if stay is not None:
            now = stay.alias("a").join(keys.alias("k"), _same("a", "k"), "left_anti").unionByName(now)
        return self.table.commit(new | self.table.write_parts(now, LAST_DAY, "sessions"), fresh.schema, after=version)

    def load(self, events: DataFrame) -> int:
        """The first version from the events of many days, in one pass."""
        if self.table.versions():
            raise ValueError(f"{self.table.path} has sessions already; add days with put_day")
        states, _ = stage(day_states(events, self.dims, (PARTITION,)), "day-states")
        parts = self.table.write_parts(states, LAST_DAY, "states")
        return self.table.commit(parts | self.table.write_parts(merged(states), LAST_DAY, "sessions"), states.schema, after=0)
