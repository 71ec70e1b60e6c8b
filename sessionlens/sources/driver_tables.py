"""Adapter: the driver's benchmark tables as canonical nested events.

Rules (also written as SQL in the oracle): a user's events form sessions cut at gaps over 12 hours; the
session id is the Unix second of its first event; every session gets one `session_start` and one
`page_view` row at its first timestamp, and every later event with an even id a `page_view` of its own
page. Tags, prices and categories follow fixed rules on `props.k`, `user_id` and `part`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sessionlens.functions.exprs import micros, scalars
from sessionlens.model import EVENT_SCHEMA, MICROS_PER_SECOND

GAP_US = 12 * 3600 * MICROS_PER_SECOND
BUCKET_US = GAP_US

# Fixed values of the mapping.
EVENT_NAMES = {
    "view": "view_item",
    "click": "add_to_cart",
    "signup": "begin_checkout",
    "purchase": "purchase",
    "error": "scroll",
}
MEDIUMS = ("organic", "cpc", "referral", "(none)", "email")
DEVICES = ("desktop", "mobile", "tablet")
FIRST_TOUCH = ("organic", "cpc", "(none)")
MAX_ITEMS = 3
RARELY_CARTED = "STANDARD"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(labels, index: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), index.cast("int"))


def _session_spans(events: DataFrame) -> DataFrame:
    """(user, bucket) → the session it belongs to.

    Two events of one bucket are never more than a gap apart, so a session can only begin at the first event of a
    bucket. Gaps are therefore found on one row per user and active bucket: no task ever holds all events
    of a user, however many that user has.
    """
    buckets = events.groupBy("user_id", "bucket").agg(
        F.min(F.struct("us", "event_id")).alias("first"), F.max("us").alias("last_us")
    )
    by_user = Window.partitionBy("user_id").orderBy("bucket")
    so_far = by_user.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.lag("last_us").over(by_user)
    opens = previous.isNull() | (F.col("first.us") - previous > GAP_US)
    return (
        buckets.withColumn("opens", opens)
        .withColumn("session_number", F.count_if("opens").over(so_far))
        .withColumn("session_first", F.last(F.when(F.col("opens"), F.col("first")), True).over(so_far))
        .select("user_id", "bucket", "session_number", "session_first")
    )


def _user_dims(spark: SparkSession, sf_dir: str, users: DataFrame) -> DataFrame:
    """Per user: country and the items a list of theirs can show, once; events make their lists of them after the joins."""
    part = table(spark, sf_dir, "part")
    n_parts = scalars(part.agg(F.count("*").alias("n")))["n"]
    slots = users.select(
        "user_id", F.explode(F.sequence(F.lit(0), F.lit(MAX_ITEMS - 1))).alias("slot")
    ).withColumn("p_partkey", (F.col("user_id") * 7 + F.col("slot")) % n_parts)
    kind = F.col("p_partkey") % 3
    category = (
        F.when(kind == 0, F.concat(F.lit("Home/"), "p_type", F.lit("/")))
        .when(kind == 1, F.concat(F.lit("Home/Apparel/"), "p_type", F.lit("/")))
        .otherwise(F.col("p_type"))
    )
    # Half of the users never cart one type, so that its page sells below the average.
    cartable = (F.col("slot") == 0) & ((F.col("p_type") != RARELY_CARTED) | (F.floor(F.col("user_id") / 16) % 2 == 0))
    listed = F.struct(
        "slot",
        cartable.alias("cartable"),
        F.col("p_name").alias("item_name"),
        category.alias("item_category"),
        F.col("p_size").cast("double").alias("price"),
    )
    items = (
        slots.join(part.select("p_partkey", "p_name", "p_type", "p_size"), "p_partkey")
        .groupBy("user_id")
        .agg(F.array_sort(F.collect_list(listed)).alias("slots"))
    )
    nation = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("nation_id"), "n_name"
    )
    user = F.col("user_id")
    return (
        items.withColumn("nation_id", user % 25)
        .join(nation, "nation_id", "left")
        .select("user_id", "slots", F.when(user % 10 == 0, "").otherwise(F.col("n_name")).alias("country"))
    )


def _as_items(slots: Column, carted: Column) -> Column:
    """The items of a list: it shows the shelf from its first slot on; carting carts the first item, where it can be."""
    return F.transform(
        slots,
        lambda it: F.struct(
            it["item_name"].alias("item_name"),
            it["item_category"].alias("item_category"),
            it["price"].alias("price"),
            F.when(it["cartable"] & carted, 1).cast("long").alias("quantity"),
        ),
    )


def _named_params(**values) -> Column:
    """Parameter array, one entry per name; a parameter without a value holds nulls."""
    entries = []
    for key, (kind, value) in values.items():
        text = value if kind == "string" else F.lit(None).cast("string")
        number = value if kind == "int" else F.lit(None)
        pair = F.struct(text.alias("string_value"), number.cast("long").alias("int_value"))
        entries.append(F.struct(F.lit(key).alias("key"), pair.alias("value")))
    return F.array(*entries)


def _canonical(df: DataFrame) -> DataFrame:
    """The columns of the event schema. Where a type already is the wanted one but for nulls there is no cast: it would build nested
    values anew, and hide from the optimiser that a parameter looked up in them is just a column."""
    own = {f.name: f.dataType.simpleString() for f in df.schema}
    same = lambda f: own[f.name] == f.dataType.simpleString()
    return df.select(*[F.col(f.name) if same(f) else F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENT_SCHEMA])


def shop_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `events` table as a shop's nested event export."""
    events = table(spark, sf_dir, "events").select(
        "event_id",
        micros("ts").alias("us"),
        "user_id",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )
    events = events.withColumn("bucket", F.floor(F.col("us") / BUCKET_US))
    spans = _session_spans(events)
    dims = _user_dims(spark, sf_dir, events.select("user_id").distinct())
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    n_pages = scalars(pages.agg(F.count("*").alias("n")))["n"]

    placed = (
        # Neither side has a size bound, so this is a shuffle join; a heavy (user, hour) is split by
        # adaptive execution.
        events.join(spans.hint("merge"), ["user_id", "bucket"])
        # Low page ids come up more often, so a few pages take most landings.
        .withColumn("page_id", F.floor(F.col("k") * F.col("k") * n_pages / 10000))
        .join(pages, "page_id", "left")
        # The lists come last, so that no sort holds them a row an event; one row a user is hashed, and a heavy user's events are split.
        .join(dims.hint("shuffle_hash"), "user_id")
    )
    k = F.col("k")
    own = F.struct(
        F.create_map(*[F.lit(x) for kv in EVENT_NAMES.items() for x in kv])[F.col("event_type")].alias("name"),
        F.lit(True).alias("own"),
        F.when(k % 3 == 0, _pick(MEDIUMS, F.floor(k / 3) % 5)).alias("medium"),
        F.round(F.col("value") * 1000).cast("long").alias("engaged"),
    )
    added = [
        F.struct(
            F.lit(n).alias("name"), F.lit(False).alias("own"),
            F.lit(None).cast("string").alias("medium"), F.lit(None).cast("long").alias("engaged"),
        )
        for n in ("session_start", "page_view")
    ]
    is_first = (F.col("us") == F.col("session_first.us")) & (
        F.col("event_id") == F.col("session_first.event_id")
    )
    opens_page = F.col("event_id") % 2 == 0
    day_number = F.floor(F.col("us") / (86_400 * MICROS_PER_SECOND)).cast("int")
    # What all rows of an event have is made once, before it becomes rows.
    told = placed.withColumns(
        {"day": F.date_from_unix_date(day_number), "session_id": F.floor(F.col("session_first.us") / MICROS_PER_SECOND)}
    ).withColumn("event_date", F.date_format("day", "yyyyMMdd"))
    rows = told.withColumn(
        "row",
        F.explode(
            F.when(is_first, F.array(*added, own))
            .when(opens_page, F.array(added[1], own))
            .otherwise(F.array(own))
        ),
    )
    is_own, name = F.col("row.own"), F.col("row.name")
    carries_items = is_own & name.isin("view_item", "add_to_cart") & (k % 4 > 0)
    shown = _as_items(F.slice("slots", F.lit(1), (k % 4).cast("int")), name == "add_to_cart")
    return _canonical(
        rows.select(
            "event_date",
            F.col("us").alias("event_timestamp"),
            name.alias("event_name"),
            F.col("user_id").cast("string").alias("user_pseudo_id"),
            _named_params(
                ga_session_id=("int", F.col("session_id")),
                ga_session_number=("int", F.col("session_number")),
                medium=("string", F.col("row.medium")),
                engagement_time_msec=("int", F.col("row.engaged")),
                page_location=("string", F.col("url")),
            ).alias("event_params"),
            F.struct(_pick(DEVICES, F.col("user_id") % 3).alias("category")).alias("device"),
            F.struct("country").alias("geo"),
            F.struct(_pick(FIRST_TOUCH, F.col("user_id") % 3).alias("medium")).alias("traffic_source"),
            F.struct(
                F.when((name == "purchase") & (k % 10 != 0), F.col("value")).alias("purchase_revenue")
            ).alias("ecommerce"),
            F.when(carries_items, shown).alias("items"),
            F.col("day").alias("event_date_part"),
        )
    )


def order_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The `orders` table as visits: one `session_start` per order, tagged with its priority.

    It spans years, which the event stream does not, so retention is studied on it.
    """
    orders = table(spark, sf_dir, "orders")
    us = micros("o_orderdate")
    day = F.to_date("o_orderdate")
    null_text = F.lit(None).cast("string")
    return _canonical(
        orders.select(
            F.date_format(day, "yyyyMMdd").alias("event_date"),
            us.alias("event_timestamp"),
            F.lit("session_start").alias("event_name"),
            F.col("o_custkey").cast("string").alias("user_pseudo_id"),
            _named_params(
                ga_session_id=("int", F.col("o_orderkey")),
                medium=("string", F.col("o_orderpriority")),
            ).alias("event_params"),
            F.struct(null_text.alias("category")).alias("device"),
            F.struct(null_text.alias("country")).alias("geo"),
            F.struct(null_text.alias("medium")).alias("traffic_source"),
            F.struct(F.lit(None).cast("double").alias("purchase_revenue")).alias("ecommerce"),
            F.lit(None).cast(EVENT_SCHEMA["items"].dataType).alias("items"),
            day.alias("event_date_part"),
        )
    )
