"""Sessions brought up to date by days against a rebuild from all events."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sessionlens.operators import session_state
from sessionlens.operators.session_state import SessionTable
from sessionlens.operators.sessions import funnel_sessions, session_base
from tests.shop import event, flat

DAYS = ["20240101", "20240102", "20240103", "20240104", "20240105"]
STEPS = ["session_start", "view_item", "add_to_cart", "begin_checkout", "purchase", "page_view", "scroll"]


def day(text):
    return dt.date.fromisoformat("-".join((text[:4], text[4:6], text[6:])))


def shop(seed, days=DAYS, gap=1):
    """Random events of sessions that go on over midnight, with null users; consecutive days of a session lie `gap` apart at most."""
    rng = random.Random(seed)
    out = []
    for sid in range(60):
        first = rng.randrange(len(days))
        user = rng.choice(["u1", "u2", f"u{sid}", None])
        for k, d in enumerate(days[first : first + rng.choice((1, 1, 2, 3)) * gap : gap]):
            for _ in range(rng.randint(1, 4)):
                some = lambda *values: rng.choice((None, *values))
                out.append(event(
                    rng.choice(STEPS), user=user, sid=sid, at=day(d).toordinal() * 86_400 + rng.choice((7, rng.randrange(86_400))), day=d,
                    medium=some("cpc", "email"), eng=some(10, 2_000), number=some(1, 2), page=some("https://x/a", "https://x/b"),
                    device=some("desktop", "mobile"), country=some("Spain"), first_touch=some("organic"), revenue=some(1.5, 20.25),
                ))
    return out


def rows(df):
    def value(x):
        return round(x, 6) if isinstance(x, float) else x

    return sorted((tuple(value(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=str)


@pytest.mark.parametrize("order", [DAYS, [DAYS[i] for i in (2, 0, 4, 1, 3)], [*DAYS[:3], DAYS[1], *DAYS[3:]]], ids=["forward", "any", "again"])
def test_days_equal_a_rebuild(spark, tmp_path, order):
    ev = flat(spark, shop(3)).cache()
    table = SessionTable(spark, str(tmp_path / "s"))
    for d in order:
        table.put_day(ev, day(d))
    assert rows(table.base()) == rows(session_base(ev))
    assert rows(table.sessions()) == rows(funnel_sessions(session_base(ev)))
    assert table.reopened().isEmpty()


def test_load_and_go_on(spark, tmp_path):
    ev = flat(spark, shop(8)).cache()
    table = SessionTable(spark, str(tmp_path / "s"))
    table.load(ev.where(F.col("event_date") < DAYS[3]))
    for d in (*DAYS[3:], DAYS[2]):
        table.put_day(ev, day(d))
    assert rows(table.base()) == rows(session_base(ev)) and table.table.versions() == [3, 4]
    with pytest.raises(ValueError, match="put_day"):
        table.load(ev)


def test_a_day_given_anew_replaces_the_old_one(spark, tmp_path):
    old, new = shop(4), shop(4)
    new = [e for k, e in enumerate(new) if k % 3 or e[0] != DAYS[1]] + [event("purchase", user="new", sid=500, at=1, day=DAYS[1])]
    table = SessionTable(spark, str(tmp_path / "s"))
    for d in DAYS:
        table.put_day(flat(spark, old), day(d))
    before = table.base()
    table.put_day(flat(spark, new), day(DAYS[1]))
    assert rows(table.base()) == rows(session_base(flat(spark, new)))
    assert rows(before) == rows(session_base(flat(spark, old)))  # a reader of the version before


def test_empty_day_and_reopened_sessions(spark, tmp_path):
    events = shop(5, gap=2)
    ev = flat(spark, events).cache()
    near, all_days = SessionTable(spark, str(tmp_path / "a")), SessionTable(spark, str(tmp_path / "b"), open_days=None)
    with pytest.raises(FileNotFoundError):
        near.base()
    near.put_day(ev, dt.date(2023, 12, 31))
    assert near.table.versions() == [1]
    for d in DAYS:
        near.put_day(ev, day(d))
        all_days.put_day(ev, day(d))
    assert rows(all_days.base()) == rows(session_base(ev)) and all_days.reopened().isEmpty()
    assert not near.reopened().isEmpty()


def test_a_day_touches_open_sessions_only(spark, tmp_path, monkeypatch):
    """Parts that hold no open session are neither read nor written, and no event of another day is read."""
    ev = flat(spark, shop(6)).cache()
    table = SessionTable(spark, str(tmp_path / "s"))
    for d in DAYS[:4]:
        table.put_day(ev, day(d))
    before = table.table.manifest()["parts"]
    read, seen = table.table.read, []
    monkeypatch.setattr(table.table, "read", lambda version=None, parts=None: (seen.extend(parts), read(version, parts))[1])
    table.put_day(ev.where(F.col("event_date_part") == F.lit(day(DAYS[4]))), day(DAYS[4]))
    after = table.table.manifest()["parts"]
    assert set(seen) == {f"sessions={day(DAYS[3])}"}
    assert {p for p in after if before.get(p) != after[p]} == {f"sessions={day(DAYS[3])}", f"sessions={day(DAYS[4])}", f"states={day(DAYS[4])}"}
    assert rows(table.base()) == rows(session_base(ev))


def test_states_merge_in_any_grouping(spark):
    ev = flat(spark, shop(7))
    parts = [session_state.day_states(ev.where(F.col("event_date") == d)) for d in DAYS]
    left = session_state.merged(session_state.merged(parts[0].unionByName(parts[1])).unionByName(parts[2]))
    right = session_state.merged(parts[0].unionByName(session_state.merged(parts[2].unionByName(parts[1]))))
    assert rows(left) == rows(right)
