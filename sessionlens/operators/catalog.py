"""Catalogue conversion from nested items: listing pages, price bands, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sessionlens.functions.exprs import (
    PRICE_BANDS, attach, category_label, literal_rows, parent_node, pct, price_band, raw_category, round_half_even, scalars,
)
from sessionlens.functions.ranks import average_ranks, exact_quantiles
from sessionlens.functions.stats import t_two_sided_p, wilson_ci
from sessionlens.model import NOT_SET
from sessionlens.operators.inference import chi_square

# Listing levels and the two parents that decide them.
LEVELS = ("product type", "brand", "collection", "parent")
BRAND_PARENT = "Shop by Brand"
ROOT_PARENT = "Home"
SEPARATOR = " · "


def _items(ev: DataFrame, *events: str) -> DataFrame:
    """One row per item of the named events; events without items vanish.

    The projection comes before the explode, so each item row carries only what operators need.
    """
    return (
        ev.where(F.col("event_name").isin(*events))
        .select("user_pseudo_id", "session_id", "event_name", "event_timestamp", F.explode("items").alias("it"))
        .select(
            "user_pseudo_id", "session_id", "event_name", "event_timestamp", "it.item_name", "it.price",
            F.coalesce("it.quantity", F.lit(0)).alias("quantity"),
            raw_category("it.item_category").alias("raw_category"),
        )
    )


def _seen_carted(items: DataFrame, key: str) -> DataFrame:
    """Per session and key: first sighting and last cart of the carted item itself.

    A cart counts when the LAST one is at or after the FIRST sighting (unlike the funnel's rule).
    """
    viewed = F.col("event_name") == "view_item"
    carted = (F.col("event_name") == "add_to_cart") & (F.col("quantity") > 0)
    return (
        items.where(F.col("session_id").isNotNull() & F.col(key).isNotNull())
        .groupBy("user_pseudo_id", "session_id", key)
        .agg(
            F.min(F.when(viewed, F.col("event_timestamp"))).alias("ts_first_view"),
            F.max(F.when(carted, F.col("event_timestamp"))).alias("ts_last_cart"),
        )
    )


def _seen_carted_counts(steps: DataFrame, key: str) -> DataFrame:
    seen = F.col("ts_first_view").isNotNull()
    return steps.groupBy(key).agg(
        F.count_if(seen).alias("viewing_sessions"),
        F.count_if(seen & (F.col("ts_last_cart") >= F.col("ts_first_view"))).alias("carting_sessions"),
    )


def listing_items(ev: DataFrame) -> DataFrame:
    """Viewed and carted items with the normalised listing label."""
    return _items(ev, "view_item", "add_to_cart").withColumn("item_category", category_label("raw_category"))


def item_cells(ev: DataFrame) -> DataFrame:
    """Items counted by event, product, raw label and price.

    The table grows with the catalogue, not with the traffic, and one pass over the items serves labels,
    parents, prices and product overlap.
    """
    return (
        _items(ev, "view_item", "add_to_cart")
        .groupBy("event_name", "item_name", "raw_category", "price").agg(F.count("*").alias("n"))
        .withColumn("item_category", category_label("raw_category"))
    )


def session_listing_steps(ev: DataFrame) -> DataFrame:
    return _seen_carted(listing_items(ev), "item_category")


def session_price_band_steps(ev: DataFrame) -> DataFrame:
    items = _items(ev, "view_item", "add_to_cart").withColumn("price_band", price_band("price"))
    return _seen_carted(items, "price_band")


def listing_pages(ev: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Seen → carted by listing label, with its raw labels, median listed price and parent node.

    Labels are normalised before the session grouping, so two spellings in one session count once.
    `cells` is `item_cells(ev)`, if it has been written already.
    """
    cells = item_cells(ev) if cells is None else cells
    spellings = cells.groupBy("item_category", "raw_category").agg(F.sum("n").alias("n"))
    labels = spellings.groupBy("item_category").agg(
        F.count("*").alias("n_source_labels"),
        F.array_join(F.array_sort(F.collect_set("raw_category")), SEPARATOR).alias("source_labels"),
    )
    parents = (
        spellings.withColumn("parent", parent_node("raw_category"))
        .where(F.col("parent").isNotNull())
        .groupBy("item_category", "parent").agg(F.sum("n").alias("n"))
        .groupBy("item_category")
        .agg(F.min(F.struct(-F.col("n"), F.col("parent")))["parent"].alias("parent_node"))
    )
    seen = cells.where(F.col("event_name") == "view_item")
    prices = exact_quantiles(seen, ["item_category"], "price", 0.5, weight="n").select(
        "item_category", F.col("q_cont").alias("median_price")
    )
    return (
        _seen_carted_counts(session_listing_steps(ev), "item_category")
        .join(labels, "item_category")
        .join(prices, "item_category", "left")
        .join(parents, "item_category", "left")
        .select(
            "item_category", "viewing_sessions", "carting_sessions", "n_source_labels", "source_labels",
            "median_price", "parent_node",
        )
        .orderBy(F.desc("viewing_sessions"), "item_category")
    )


def category_overlap(cells: DataFrame) -> DataFrame:
    """Per product, the listing labels it was seen under, from `item_cells`; most-viewed first."""
    return (
        cells.where((F.col("event_name") == "view_item") & F.col("item_name").isNotNull())
        .where(F.col("item_category") != NOT_SET)
        .groupBy("item_name", "item_category").agg(F.sum("n").alias("n"))
        .groupBy("item_name")
        .agg(
            F.sum("n").alias("sightings"), F.count("*").alias("n_categories"),
            F.array_join(F.array_sort(F.collect_set("item_category")), SEPARATOR).alias("categories"),
        )
        .orderBy(F.desc("sightings"), "item_name")
    )


def overlap_summary(overlap: DataFrame) -> DataFrame:
    """Products, products under several labels, and the most-viewed example (one row)."""
    multi = F.col("n_categories") > 1
    example = F.min(F.when(multi, F.struct(-F.col("sightings"), "item_name", "n_categories", "categories")))
    return overlap.agg(
        F.count("*").alias("items"), F.count_if(multi).alias("multi"), example.alias("e")
    ).select(
        "items", "multi", F.col("e.item_name").alias("example_item"),
        F.col("e.n_categories").alias("example_n"), F.col("e.categories").alias("example_categories"),
    )


def price_bands(ev: DataFrame) -> DataFrame:
    return _seen_carted_counts(session_price_band_steps(ev), "price_band").orderBy("price_band")


def listing_levels(lp: DataFrame) -> DataFrame:
    """Level of each listing page: parent of others, brand, collection, else product type."""
    parents = (
        lp.where(F.col("parent_node").isNotNull() & (F.col("parent_node") != ""))
        .select(F.col("parent_node").alias("item_category")).distinct().withColumn("_is_parent", F.lit(True))
    )
    level = (
        F.when(F.col("_is_parent"), "parent")
        .when(F.col("parent_node") == BRAND_PARENT, "brand")
        .when(F.col("parent_node") == ROOT_PARENT, "collection")
        .otherwise("product type")
    )
    return lp.join(parents, "item_category", "left").withColumn("level", level).drop("_is_parent")


def listing_coverage(lp: DataFrame, min_views: int = 500) -> DataFrame:
    """How far the labels cover the catalogue: merging, untagged share, pages left out, levels (one row)."""
    named = F.col("item_category") != NOT_SET
    listed = named & (F.col("viewing_sessions") >= min_views)
    at = lambda lv: F.count_if(listed & (F.col("level") == lv)).alias(f"{lv.replace(' ', '_')}_pages")
    unset = F.sum(F.when(~named, F.col("viewing_sessions")).otherwise(0))
    return listing_levels(lp).agg(
        F.sum("n_source_labels").alias("raw_labels"), F.count("*").alias("labels"),
        F.count_if(F.col("n_source_labels") > 1).alias("merged_groups"),
        F.coalesce(pct(unset, F.sum("viewing_sessions")), F.lit(0.0)).alias("notset_share"),
        F.count_if(named & ~listed).alias("left_out"), *[at(lv) for lv in LEVELS],
    )


def site_average(df: DataFrame, k: str = "carting_sessions", n: str = "viewing_sessions") -> DataFrame:
    """Pooled rate in percent, 0 without volume (one row)."""
    return df.agg(F.coalesce(pct(F.sum(k), F.sum(n)), F.lit(0.0)).alias("average_pct"))


def flag_categories(
    df: DataFrame, average: DataFrame, k: str = "carting_sessions", n: str = "viewing_sessions",
    rate: str = "atc_pct",
) -> DataFrame:
    """Interval, below / above / neutral against the average, carts at stake for pages below it."""
    avg = F.col("average_pct")
    lo, hi = wilson_ci(k, n)
    stake = round_half_even((avg - F.col(rate)) / 100 * F.col(n)).cast("long")
    return (
        attach(df, average, "_a")
        .withColumns({"ci_lo": lo, "ci_hi": hi, "average_pct": F.col("_a.average_pct")})
        .withColumn(
            "status",
            F.when(F.col("ci_hi") < avg, "below").when(F.col("ci_lo") > avg, "above").otherwise("neutral"),
        )
        .withColumn("carts_at_stake", F.when(F.col("status") == "below", stake).otherwise(0))
        .drop("_a")
    )


def _listed(lp: DataFrame, min_views: int) -> DataFrame:
    return listing_levels(lp).where(
        (F.col("item_category") != NOT_SET) & (F.col("viewing_sessions") >= min_views)
    ).withColumn("atc_pct", pct("carting_sessions", "viewing_sessions"))


# Orders of the ranking: carts at stake, rate, volume.
RANKING_ORDERS = {
    "stake": lambda: [F.desc("carts_at_stake"), F.asc("atc_pct"), F.asc("item_category")],
    "rate": lambda: [F.asc("atc_pct"), F.asc("item_category")],
    "volume": lambda: [F.desc("viewing_sessions"), F.asc("item_category")],
}


def category_ranking(lp: DataFrame, min_views: int = 500, order: str = "stake") -> DataFrame:
    """Product-type pages with volume, flagged against their pooled average."""
    typed = _listed(lp, min_views).where(F.col("level") == "product type")
    return (
        flag_categories(typed, site_average(typed))
        .select(
            "item_category", "viewing_sessions", "carting_sessions", "atc_pct", "median_price", "ci_lo", "ci_hi",
            "average_pct", "status", "carts_at_stake",
        )
        .orderBy(*RANKING_ORDERS[order]())
    )


def listing_other(lp: DataFrame, min_views: int = 500) -> DataFrame:
    """Brand, collection and parent pages with volume: rate and interval, not ranked."""
    lo, hi = wilson_ci("carting_sessions", "viewing_sessions")
    position = F.array_position(F.array(*[F.lit(x) for x in LEVELS]), F.col("level"))
    return (
        _listed(lp, min_views).where(F.col("level") != "product type")
        .select("item_category", "level", "viewing_sessions", "carting_sessions", "atc_pct",
                lo.alias("ci_lo"), hi.alias("ci_hi"))
        .orderBy(position, F.desc("viewing_sessions"), "item_category")
    )


def category_targets(ranked: DataFrame, k: int = 3) -> DataFrame:
    """The k flagged pages with the most carts at stake."""
    return (
        ranked.where("carts_at_stake > 0")
        .select("item_category", "carts_at_stake", "atc_pct")
        .orderBy(F.desc("carts_at_stake"), "item_category").limit(k)
    )


def category_summary(ranked: DataFrame, k: int = 3) -> DataFrame:
    """Counts per status, carts at stake in total and in the top k, prices of flagged and other pages."""
    is_ = lambda s: F.col("status") == s
    top = scalars(category_targets(ranked, k).agg(F.coalesce(F.sum("carts_at_stake"), F.lit(0)).alias("n")))["n"]
    prices = ranked.select(is_("below").alias("flagged"), "median_price")
    medians = exact_quantiles(prices, ["flagged"], "median_price", 0.5, few_groups=True).agg(
        F.max(F.when(F.col("flagged"), F.col("q_cont"))).alias("flagged_median_price"),
        F.max(F.when(~F.col("flagged"), F.col("q_cont"))).alias("other_median_price"),
    )
    counts = ranked.agg(
        F.count("*").alias("categories"), F.count_if(is_("below")).alias("below"),
        F.count_if(is_("above")).alias("above"), F.count_if(is_("neutral")).alias("neutral"),
        F.coalesce(F.sum("carts_at_stake"), F.lit(0)).alias("total_at_stake"),
        F.min("atc_pct").alias("rate_min"), F.max("atc_pct").alias("rate_max"),
    )
    return attach(counts, medians, "_m").select(*counts.columns, "_m.*", top.alias("top_at_stake"))


def price_rank_corr(ranked: DataFrame, min_n: int = 5) -> DataFrame:
    """Spearman correlation of median price with the rate; null under min_n pages, and where all pages share a price or a rate (one row).

    Ranks come from binned running counts, so no global window ever sorts the pages in one task.
    """
    rows = ranked.where(F.col("median_price").isNotNull()).select("median_price", "atc_pct")
    ranked_rows = rows.join(average_ranks(rows, "median_price", "r_price"), "median_price").join(
        average_ranks(rows, "atc_pct", "r_rate"), "atc_pct"
    )
    # corr divides by both spreads, which is an error where one is zero; ranks are whole or half numbers, so equal ones compare as equal
    varied = lambda c: F.min(c) < F.max(c)
    spread = ranked_rows.agg((varied("r_price") & varied("r_rate")).alias("varied"))
    some = attach(ranked_rows, spread, "_s").withColumn("_y", F.when(F.col("_s.varied"), F.col("r_rate")))
    one = some.agg(F.count("*").alias("n"), F.corr("r_price", "_y").alias("rho"))
    enough = F.col("n") >= min_n
    rho = F.when(F.abs(F.col("rho")) < 1, F.col("rho"))
    t = rho * F.sqrt((F.col("n") - 2) / (1 - rho * rho))
    p = F.when(F.abs(F.col("rho")) >= 1, 0.0).when(F.col("rho").isNotNull(), t_two_sided_p(t, F.col("n") - 2))
    return one.select("n", F.when(enough, F.col("rho")).alias("rho"), F.when(enough, p).alias("p"))


def price_band_test(bands: DataFrame) -> DataFrame:
    """Bands in price order: rate, interval, best and worst, chi-square over the bands present."""
    labels = [label for _, label in PRICE_BANDS]
    order = literal_rows(bands.sparkSession, band_order=list(range(1, len(labels) + 1)), price_band=labels)
    rate = pct("carting_sessions", "viewing_sessions")
    rows = order.join(bands, "price_band").withColumn("atc_pct", rate)
    ends = rows.agg(
        F.min(F.struct(-F.col("atc_pct"), "band_order", "price_band"))["price_band"].alias("best"),
        F.min(F.struct("atc_pct", "band_order", "price_band"))["price_band"].alias("worst"),
    )
    lo, hi = wilson_ci("carting_sessions", "viewing_sessions")
    test = chi_square(bands, "carting_sessions", "viewing_sessions")
    return attach(attach(rows, ends, "_e"), test, "_t").select(
        F.col("band_order").cast("long").alias("band_order"), "price_band", "viewing_sessions", "carting_sessions",
        "atc_pct", lo.alias("ci_lo"), hi.alias("ci_hi"),
        (F.col("price_band") == F.col("_e.best")).alias("is_best"),
        (F.col("price_band") == F.col("_e.worst")).alias("is_worst"), "_t.*",
    ).orderBy("band_order")
