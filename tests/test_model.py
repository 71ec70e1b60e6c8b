import pytest

from sessionlens.model import EventWindow, FunnelSpec

WINTER = EventWindow("20221215", "20230309")


def test_labels_and_last_month():
    assert WINTER.label == "Dec 2022 – Mar 2023"
    assert WINTER.last_month() == EventWindow("20230301", "20230309")
    assert WINTER.last_month().period_label == "Mar 2023" and WINTER.last_month().label == "Mar 2023 – Mar 2023"
    assert EventWindow("20230305", "20230309").last_month().start == "20230305"


@pytest.mark.parametrize("day", ["20230229", "20231301", "2023030", "2023-3-1", "٢٠٢٣٠١٠١", None, 20230101])
def test_days_must_exist(day):
    with pytest.raises(ValueError):
        EventWindow(day, "20231231")


def test_window_must_run_forward():
    with pytest.raises(ValueError, match="before it begins"):
        EventWindow("20230310", "20230309")


def test_compared_period_must_be_apart():
    earlier = EventWindow("20230101", "20230228")
    assert WINTER.versus(None) is None and WINTER.versus(earlier) is earlier
    with pytest.raises(ValueError, match="shares days"):
        WINTER.versus(EventWindow("20230220", "20230301"))


def test_funnel_steps_from_entry():
    spec = FunnelSpec(entry="view_item")
    assert spec.active == ("view_item", "add_to_cart", "begin_checkout", "purchase")
    assert spec.flags == ("s1", "s2", "s3", "s4")
    with pytest.raises(ValueError):
        FunnelSpec(entry="scroll")
