import random
import re

import pytest
from pyspark.sql import functions as F

from sessionlens.functions import exprs
from tests.shop import event, item, raw


def values(df, column):
    return [r[0] for r in df.select(column).collect()]


def last_segment(label):
    """The rule: the last part between slashes, where a slash among blanks belongs to a name."""
    names = [part.strip() for part in re.split(r"(?<! )/|/(?! )", label.strip("/"))]
    return names[-1] or "(not set)"


def test_category_label_of_random_paths(frame):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé&'-") for _ in range(rng.randint(1, 6)))
    name = lambda: " / ".join(word() for _ in range(rng.choice((1, 1, 1, 2, 3))))
    labels = ["/".join(name() for _ in range(rng.randint(1, 5))) + "/" * rng.randint(0, 2) for _ in range(300)]
    labels += ["/" * n for n in (1, 2, 3)]
    df = frame("c string", [(x,) for x in labels])
    assert values(df, exprs.category_label("c")) == [last_segment(x) for x in labels]


def test_category_label_missing_stays(frame):
    assert values(frame("c string", [(exprs.NOT_SET,)]), exprs.category_label("c")) == [exprs.NOT_SET]


def test_raw_category_blank_is_not_set(frame):
    df = frame("c string", [(None,), ("  ",), (" \t",), (" Bags ",)])
    assert values(df, exprs.raw_category("c")) == ["(not set)"] * 3 + ["Bags"]


@pytest.mark.parametrize(
    "label, parent",
    [("Home/Apparel/Hats/", "Apparel"), ("Home/Sale/", "Home"), ("Lifestyle/Bags/", "Lifestyle"), ("Bags", None),
     ("(not set)", None), ("Home/Men's / Unisex/Tees/", "Men's / Unisex")],
)
def test_parent_node(frame, label, parent):
    assert values(frame("c string", [(label,)]), exprs.parent_node("c")) == [parent]


def test_page_path(frame):
    urls = ["https://shop.example.com/a/b?x=1#top", "http://shop.example.com", "https://h/a#b?c", None]
    assert values(frame("u string", [(u,) for u in urls]), exprs.page_path("u")) == ["/a/b", "", "/a", None]


def test_price_bands(frame):
    df = frame("p double", [(x,) for x in (None, -1.0, 0.0, 9.99, 10.0, 20.0, 30.0, 49.99, 50.0, 900.0)])
    assert values(df, exprs.price_band("p")) == [
        None, None, None, "under $10", "$10–20", "$20–30", "$30–50", "$30–50", "$50+", "$50+"]


def test_size_buckets(frame):
    df = frame("n long", [(x,) for x in (1, 3, 4, 5, 6, 8, 9, 15, 16, None)])
    assert values(df, exprs.size_bucket("n")) == [
        "1–3", "1–3", "4–5", "4–5", "6–8", "6–8", "9–15", "9–15", "16+", "16+"]


def test_visitor_type(frame):
    assert values(frame("n long", [(1,), (2,), (0,), (None,)]), exprs.visitor_type("n")) == [
        "new", "returning", "unknown", "unknown"]


def test_week_starts_on_monday(frame):
    df = frame("d string", [("20201101",), ("20201102",), ("20201108",)])
    assert [str(v) for v in values(df, exprs.week_start("d"))] == ["2020-10-26", "2020-11-02", "2020-11-02"]


def test_shopping_pages(frame):
    pages = ["/Apparel", "/signin.html", "/Sign-In", "/basket.html", "/store-policies/faq/", "/CHECKOUT", "/"]
    assert values(frame("p string", [(p,) for p in pages]), exprs.is_shopping_page("p")) == [
        True, False, False, False, False, False, True]


@pytest.mark.parametrize("p, text", [(0.6184, "p = 0.618"), (0.0451, "p = 0.045"), (1e-3, "p = 0.001"), (9.99e-4, "p < 0.001"), (1.0, "p = 1.000"), (None, None)])
def test_p_label(frame, p, text):
    assert values(frame("p double", [(p,)]), exprs.p_label("p")) == [text]


def test_session_key_is_null_when_a_part_is(frame):
    df = frame("u string, s long", [("u", 1), (None, 1), ("u", None)])
    assert values(df, exprs.session_key("u", "s")) == ["u-1", None, None]


def test_param_first_match_and_missing(spark):
    df = raw(spark, [event("x", medium="cpc", eng=5), event("y")])
    assert values(df, exprs.param("medium", "string")) == ["cpc", None]
    assert values(df, exprs.param("engagement_time_msec")) == [5, None]
    twice = spark.sql(
        "SELECT array(named_struct('key','k','value',named_struct('string_value',CAST(NULL AS STRING),'int_value',1L)),"
        "named_struct('key','k','value',named_struct('string_value',CAST(NULL AS STRING),'int_value',2L))) AS event_params"
    )
    assert values(twice, exprs.param("k")) == [1]
    assert values(spark.sql("SELECT CAST(NULL AS array<struct<key:string,value:struct<string_value:string,int_value:bigint>>>) AS event_params"),
                  exprs.param("k")) == [None]


def test_items_quality(spark):
    df = raw(spark, [event("a", items=[item(quantity=1), item(), item(quantity=0)]), event("b", items=[]), event("c")])
    assert values(df, exprs.items_count("items")) == [3, 0, None]
    assert values(df, exprs.carted_items("items")) == [1, 0, None]


def test_micros_ignores_the_session_time_zone(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00.123456' AS t, timestamp_ntz'1969-12-31 23:59:59.5' AS b")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", zone)
            assert df.select(exprs.micros("t"), exprs.micros("b")).first() == (1710037800123456, -500000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_null_safe_key_keeps_null_and_blank_apart(frame):
    assert len(set(values(frame("u string", [(None,), ("",), ("=",)]), exprs.null_safe_key("u")))) == 3
