"""Column builders. Every one is a built-in Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sessionlens.model import MICROS_PER_SECOND, NOT_SET

# White space stripped from labels.
WHITESPACE = (
    " \t\n\u000b\f\r\u0085         "
    "        　"
)

# Price bands, upper bound (exclusive) and label, cheapest first.
PRICE_BANDS = (
    (10, "under $10"),
    (20, "$10–20"),
    (30, "$20–30"),
    (50, "$30–50"),
    (None, "$50+"),
)

# Session-length buckets, largest event count (inclusive) and label.
SIZE_BUCKETS = (
    (3, "1–3"),
    (5, "4–5"),
    (8, "6–8"),
    (15, "9–15"),
    (None, "16+"),
)

# Fixed value: pages that are not meant to show products.
NON_SHOPPING_PAGES = (
    r"(?i)sign-?in|log-?in|register|my-?account|basket|cart|checkout|store-policies|faq"
)


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def scalars(one_row: DataFrame) -> Column:
    """A one-row DataFrame as a struct-valued scalar subquery (runs once, joins nothing)."""
    return one_row.select(F.struct(*[F.col(c) for c in one_row.columns])).scalar()


def attach(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """`df` with a one-row DataFrame as struct column `name`.

    The subquery stands in the plan once however often its fields are used; naming `scalars` in several
    expressions would copy its whole plan into each.
    """
    return df.withColumn(name, scalars(one_row))


def literal_rows(spark, **columns) -> DataFrame:
    """A tiny fixed dimension, one row per position of the given equally long lists."""
    names = list(columns)
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, vals)]) for vals in zip(*columns.values())]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def param(key: str, kind: str = "int", params="event_params") -> Column:
    """Value of the first event parameter named `key`, null when there is none.

    Position lookup over parallel arrays instead of a lambda: it stays in generated code, and the scan
    reads only the key and the wanted value fields of the parameter array.
    """
    params = _c(params)
    place = F.array_position(params["key"], F.lit(key)).cast("int")
    return F.get(params["value"][f"{kind}_value"], place - 1)


def page_path(url) -> Column:
    """URL without scheme, host, query string and fragment."""
    no_host = F.regexp_replace(_c(url), r"^https?://[^/]+", "")
    return F.regexp_replace(no_host, r"[?#].*$", "")


def raw_category(item_category) -> Column:
    """Listing label as recorded; blank or missing becomes '(not set)'."""
    return F.coalesce(F.nullif(F.btrim(_c(item_category), F.lit(WHITESPACE)), F.lit("")), F.lit(NOT_SET))


def _path_segment(raw: Column, position: int) -> Column:
    """Segment of a '/' path counted from the end; ' / ' belongs to a name."""
    shielded = F.replace(raw, F.lit(" / "), F.lit(" | "))
    segments = F.split(F.btrim(shielded, F.lit("/")), "/")
    segment = F.try_element_at(segments, F.lit(position))
    name = F.btrim(F.replace(segment, F.lit(" | "), F.lit(" / ")), F.lit(WHITESPACE))
    return F.nullif(name, F.lit(""))


def category_label(raw) -> Column:
    """Last path segment of a raw listing label."""
    raw = _c(raw)
    return F.when(raw == NOT_SET, raw).otherwise(F.coalesce(_path_segment(raw, -1), F.lit(NOT_SET)))


def parent_node(raw) -> Column:
    """Path segment above the label; null for a flat label."""
    raw = _c(raw)
    return F.when(raw != NOT_SET, _path_segment(raw, -2))


def _banded(value: Column, bands, inclusive: bool) -> Column:
    """Label of the first band whose upper bound holds the value; the last band takes the rest."""
    *bounded, (_, last) = bands
    fits = [(value <= F.lit(up) if inclusive else value < F.lit(up), label) for up, label in bounded]
    out = F.when(*fits[0])
    for test, label in fits[1:]:
        out = out.when(test, label)
    return out.otherwise(last)


def price_band(price) -> Column:
    """Band label of a price; null when missing or not positive."""
    price = _c(price)
    return F.when(price > 0, _banded(price, PRICE_BANDS, inclusive=False))


def size_bucket(n_events) -> Column:
    """Session-length bucket; an unknown length falls in the last one."""
    return _banded(_c(n_events), SIZE_BUCKETS, inclusive=True)


def visitor_type(session_number) -> Column:
    n = _c(session_number)
    return F.when(n == 1, "new").when(n > 1, "returning").otherwise("unknown")


def day(event_date) -> Column:
    return F.to_date(_c(event_date), "yyyyMMdd")


def week_start(event_date) -> Column:
    """Monday of a YYYYMMDD day."""
    return F.trunc(day(event_date), "week")


def session_key(user, session_id) -> Column:
    """user-session text key; null if either part is."""
    return F.concat(_c(user), F.lit("-"), _c(session_id).cast("string"))


def items_count(items) -> Column:
    return F.size(_c(items)).cast("long")


def carted_items(items) -> Column:
    """Items of an event with a positive quantity; null for a null array."""
    return F.size(F.filter(_c(items), lambda it: F.coalesce(it["quantity"], F.lit(0)) > 0)).cast("long")


def is_shopping_page(path) -> Column:
    return ~_c(path).rlike(NON_SHOPPING_PAGES)


def p_label(p) -> Column:
    """'p = 0.259', or 'p < 0.001' below that."""
    p = _c(p)
    return F.when(p >= 0.001, F.format_string("p = %.3f", p)).when(p < 0.001, "p < 0.001")


def country_name(country) -> Column:
    """Country with '' and '(not set)' as null."""
    return F.nullif(F.nullif(_c(country), F.lit("")), F.lit(NOT_SET))


def pct(part, whole) -> Column:
    """part / whole in percent; null when the base is null or zero."""
    return ratio(part, whole) * 100


def ratio(part, whole) -> Column:
    return F.try_divide(_c(part).cast("double"), _c(whole).cast("double"))


def round_half_even(value, digits: int = 0) -> Column:
    return F.bround(_c(value), digits)


def null_safe_key(col) -> Column:
    """Text key under which nulls form one group of their own ('' is kept apart from null)."""
    return F.coalesce(F.concat(F.lit("="), _c(col)), F.lit(""))


def micros(ts) -> Column:
    """Microseconds since the epoch of a zone-less timestamp, whatever the session time zone."""
    ts = _c(ts)
    days = F.unix_date(F.to_date(ts)).cast("long") * F.lit(86_400 * MICROS_PER_SECOND)
    seconds = F.hour(ts).cast("long") * 3600 + F.minute(ts).cast("long") * 60
    fraction = F.extract(F.lit("SECOND"), ts) * F.lit(MICROS_PER_SECOND)
    return days + seconds * F.lit(MICROS_PER_SECOND) + fraction.cast("long")
